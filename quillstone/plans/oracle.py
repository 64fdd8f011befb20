"""The same queries in SQL, written independently of the operators."""

from __future__ import annotations

from .queries import COMMITS, NAMES, PATHS, SPDX


def _lit(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_lit, r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + ")"


FILES = """f AS (SELECT l_orderkey AS "commit", l_returnflag AS language, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity AS lines_changed,
 ((l_partkey * 7919 + l_suppkey * 31) % 1000) / 999.0::DOUBLE AS p_ai FROM lineitem)"""


def _agg(by: str) -> str:
    return f"""(SELECT {by}, n_files, lines_changed, p_human, p_ai, CASE WHEN p_human >= p_ai THEN 'human' ELSE 'ai' END AS predicted FROM (
 SELECT {by}, count(*) AS n_files, sum(lines_changed) AS lines_changed, round(sum(lines_changed * (1 - p_ai)) / sum(lines_changed), 6) AS p_human,
 round(sum(lines_changed * p_ai) / sum(lines_changed), 6) AS p_ai FROM f GROUP BY {by}))"""


C, CL = _agg('"commit"'), _agg('"commit", language')
HISTORY = f"""WITH {FILES}, c AS {C}, cl AS {CL},
h AS (SELECT o_orderkey AS "commit", strftime(o_orderdate, '%Y-%m') AS month, o_orderkey % 97 = 0 AS bad, predicted FROM orders LEFT JOIN c ON o_orderkey = "commit"),
axis AS (SELECT strftime(unnest(generate_series(min(strptime(month || '-01', '%Y-%m-%d')), max(strptime(month || '-01', '%Y-%m-%d')), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM h)"""
MONTHLY = """SELECT axis.month, count(*) FILTER (NOT bad AND predicted = 'human') AS human, count(*) FILTER (NOT bad AND predicted = 'ai') AS ai,
 count(*) FILTER (NOT bad AND predicted IS NULL) AS skipped, count(*) FILTER (bad) AS errors FROM axis LEFT JOIN h USING (month) GROUP BY 1"""
SNIPPETS = """s AS (SELECT doc_id, text AS code, source, CASE WHEN quality = 1 THEN 'human' ELSE 'ai' END AS cls,
 CASE lang WHEN 'en' THEN 'Python' WHEN 'de' THEN 'Java' WHEN 'fr' THEN 'Go' WHEN 'es' THEN 'C' END AS language
 FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '\\S')), u AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS first FROM s)"""
SCORED = "s AS (SELECT doc_id, quality AS label, CAST(n_chars AS DOUBLE) AS score, source, lang FROM documents JOIN labels USING (doc_id))"
PRED = f"{SCORED}, p AS (SELECT CAST(label AS INT) AS y_true, CASE WHEN score % 7 > 1 THEN 1 ELSE 0 END AS y_pred, lang AS language FROM s)"
AUC = """sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*)"""


def _auc(groups: str, key: str) -> str:
    return f"""SELECT {key} count(DISTINCT a.doc_id) + count(DISTINCT b.doc_id) AS n, count(DISTINCT a.doc_id) AS n_pos, count(DISTINCT b.doc_id) AS n_neg,
 round({AUC}, 9) AS auc FROM {groups} GROUP BY ALL"""


def _seed(key: str, seed: int) -> str:
    return f"sha256('{seed}|' || CAST({key} AS VARCHAR))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} * 1.0::DOUBLE / {b} ELSE 0 END"


REPORT = f"""SELECT label, tp, n_pred, support, {_ratio('tp', 'n_pred')} AS precision, {_ratio('tp', 'support')} AS recall, {_ratio('2 * tp', '(n_pred + support)')} AS f1"""
SIGN = {
    "claude-code": r"regexp_matches(body, '(?im)^\s*Co-Authored-By:\s*Claude\b') OR regexp_matches(body, '(?im)Generated with .{0,20}Claude Code') OR regexp_matches(identity, '(?im)^claude\[bot\]\s*<') OR regexp_matches(identity, '(?im)<[^>]*@anthropic\.com>')",
    "cursor": r"regexp_matches(body, '(?im)^\s*Co-Authored-By:\s*Cursor\b') OR regexp_matches(identity, '(?im)<cursoragent@cursor\.com>') OR regexp_matches(identity, '(?im)^Cursor Agent\s*<') OR regexp_matches(identity, '(?im)\bcursor\[bot\]')",
    "copilot": r"regexp_matches(body, '(?im)^\s*Co-Authored-By:\s*Copilot\b') OR regexp_matches(identity, '(?im)^copilot(-swe-agent)?\[bot\]\s*<')",
    "devin": r"regexp_matches(identity, '(?im)devin-ai-integration\[bot\]') OR regexp_matches(identity, '(?im)^Devin AI\s*<') OR regexp_matches(body, '(?im)^\s*Co-Authored-By:\s*Devin\b')",
    "codex": r"regexp_matches(body, '(?im)https://chatgpt\.com/codex/') OR regexp_matches(body, '(?im)^\s*Co-Authored-By:\s*Codex\b')",
    "aider": r"regexp_matches(subject, '(?im)\(aider\)\s*$')",
}
LOG = f"l AS (SELECT *, author || chr(10) || committer AS identity FROM {_values(COMMITS)} t(sha, author, committer, subject, body))"
BOT = r"regexp_matches(identity, '(?im)\[bot\]\s*<|\[bot\]@users\.noreply\.github\.com|^Vercel Release Bot\s*<|release[- ]bot\s*<')"
GLOBS = ["vendor/%", "%/vendor/%", "node_modules/%", "%/node_modules/%", "dist/%", "build/%", "%.min.js", "%.d.ts", "%.generated.%", "%.gen.ts"]
SUFFIX = r"lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\.[^.]+)$', 1))"

SQL = {
    "commit_weighted_aggregate": f"WITH {FILES} SELECT * FROM {C}",
    "commit_language_aggregate": f"WITH {FILES} SELECT * FROM {CL}",
    "topk_files_per_commit": f"""WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY "commit" ORDER BY lines_changed DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rank,
 count(*) OVER (PARTITION BY "commit") AS n FROM f) SELECT "commit", rank, l_linenumber, l_partkey, l_suppkey, lines_changed, greatest(n - 5, 0) AS n_over FROM r WHERE rank <= 5""",
    "timeline_monthly": f"{HISTORY} {MONTHLY}",
    "timeline_by_language": f"""{HISTORY}, x AS (SELECT h.*, cl.predicted AS cls FROM h LEFT JOIN cl ON cl."commit" = h."commit" AND cl.language = 'A')
SELECT axis.month, count(*) FILTER (NOT bad AND cls = 'human') AS human, count(*) FILTER (NOT bad AND cls = 'ai') AS ai, 0::BIGINT AS skipped, 0::BIGINT AS errors FROM axis LEFT JOIN x USING (month) GROUP BY 1""",
    "timeline_language_totals": f"""{HISTORY} SELECT language, count(*) FILTER (cl.predicted = 'human') AS human, count(*) FILTER (cl.predicted = 'ai') AS ai, count(*) AS n_classified
 FROM h JOIN cl ON cl."commit" = h."commit" WHERE NOT bad GROUP BY 1""",
    "timeline_percent": f"{HISTORY}, m AS ({MONTHLY}) SELECT month, CAST(CASE WHEN human + ai = 0 THEN 0 ELSE floor(100.0 * ai / (human + ai) + 0.5) END AS INT) AS pct_ai FROM m",
    "timeline_cache_todo": "SELECT o_orderkey AS sha FROM orders WHERE NOT (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)",
    "evenly_spaced_commits": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM o WHERE n <= 50 OR i IN (SELECT CAST(floor(k * (m / 50.0::DOUBLE)) AS BIGINT) FROM range(50) r(k), (SELECT count(*) AS m FROM orders))""",
    "prepare_dedup": r"SELECT min(doc_id) AS doc_id FROM documents WHERE regexp_matches(text, '\S') GROUP BY text",
    "prepare_uncapped": f"WITH {SNIPPETS} SELECT doc_id, CASE cls WHEN 'human' THEN 0 ELSE 1 END AS label, language FROM u WHERE first = 1",
    "prepare_class_cap": f"""WITH {SNIPPETS}, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY doc_id) AS k FROM u WHERE first = 1)
SELECT doc_id, CASE cls WHEN 'human' THEN 0 ELSE 1 END AS label, language FROM r WHERE k <= 40""",
    "prepare_balanced": f"""WITH {SNIPPETS}, r AS (SELECT *, row_number() OVER (PARTITION BY cls, language ORDER BY doc_id) AS k FROM u WHERE first = 1 AND language IN ('Python', 'Java', 'Go'))
SELECT doc_id, CASE cls WHEN 'human' THEN 0 ELSE 1 END AS label, language FROM r WHERE k <= 17""",
    "prepare_counts": f"""WITH {SNIPPETS} SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(cls) = 0 THEN 'class' ELSE 'language' END AS kind, cls, language, source, count(*) AS n
 FROM s GROUP BY GROUPING SETS ((cls), (language), (source, cls))""",
    "prepare_shortfall": f"""WITH {SNIPPETS} SELECT * FROM (SELECT c AS cls, x AS language, (SELECT count(*) FROM s WHERE cls = c AND language = x) AS n, 50::BIGINT AS cap
 FROM (VALUES ('human'), ('ai')) a(c), (VALUES ('Python'), ('Java'), ('Go'), ('C')) b(x)) WHERE n < cap""",
    "language_filter": f"""WITH n AS (SELECT * FROM {_values([*NAMES, None])} t(name)),
m AS (SELECT name, CASE lower(trim(name)) WHEN 'python' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'c++' THEN 'C++' WHEN 'csharp' THEN 'C#' WHEN 'golang' THEN 'Go' WHEN 'typescript' THEN 'TypeScript' WHEN 'rust' THEN 'Rust' END AS language FROM n)
SELECT name, language, coalesce(language IN ('Python', 'JavaScript', 'C#'), false) AS passes FROM m""",
    "repo_split": """WITH b AS (SELECT DISTINCT source, CAST('0x' || substr(sha1(source), 1, 8) AS BIGINT) % 100 AS b FROM documents)
SELECT source, CASE WHEN b < 15 THEN 'test' WHEN b < 25 THEN 'validation' ELSE 'train' END AS split FROM b""",
    "repo_share_cap": """WITH s AS (SELECT lang, source AS repo, count(*) AS n FROM documents GROUP BY ALL),
g AS (SELECT lang, greatest(0.05::DOUBLE, 2.0::DOUBLE / count(*)) AS share, count(*) AS k, max(n) AS top FROM s GROUP BY lang),
l AS (SELECT g.lang, c, share, (SELECT sum(least(n, c)) FROM s WHERE s.lang = g.lang) AS total FROM g, range(1, (SELECT max(top) + 1 FROM g)) r(c) WHERE c <= top),
best AS (SELECT lang, max(c) AS cap FROM l WHERE c <= greatest(1, floor(share * total + 1e-9)) GROUP BY lang)
SELECT s.lang, repo, n, CASE WHEN k * share < 1 THEN n ELSE least(n, cap) END AS keep FROM s JOIN g USING (lang) JOIN best USING (lang)""",
    "agent_signatures": f"""WITH {LOG}, a AS (SELECT sha, author, array_to_string(list_filter([{', '.join(f"CASE WHEN {w} THEN '{k}' END" for k, w in SIGN.items())}], lambda x: x IS NOT NULL), ',') AS agents FROM l)
SELECT sha, agents, CASE WHEN agents <> '' THEN CASE WHEN regexp_matches(author, '(?i)\\[bot\\]|devin-ai-integration|^Devin AI\\s*<') THEN 'autonomous' ELSE 'assisted' END END AS mode FROM a""",
    "bot_filter": f"WITH {LOG} SELECT sha, {BOT} AS is_bot FROM l",
    "path_filter": f"""SELECT path, {SUFFIX} IN ('.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs') AND NOT ({' OR '.join(f"path LIKE '{g}'" for g in GLOBS)} OR path LIKE '!_!_generated!_!_/%' ESCAPE '!' OR path LIKE '%/!_!_generated!_!_/%' ESCAPE '!') AS wanted,
 {SUFFIX} AS suffix FROM {_values(PATHS)} t(path)""",
    "license_filter": f"SELECT repo, spdx AS license, CASE WHEN spdx IN ('MIT', 'BSL-1.0') THEN 'permissive' ELSE 'copyleft' END AS license_group FROM {_values(SPDX)} t(repo, spdx) WHERE spdx IN ('MIT', 'BSL-1.0', 'AGPL-3.0', 'MPL-2.0')",
    "text_features_native": r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT *, list_filter(l, lambda s: regexp_matches(s, '\S')) AS solid FROM d)
SELECT doc_id, round(ln(1 + len(regexp_extract_all(text, '\b(TODO|FIXME|XXX|HACK)\b'))), 9) AS todo_count,
 round(len(list_filter(solid, lambda s: regexp_matches(s, '\s$'))) / greatest(1, len(solid))::DOUBLE, 9) AS trailing_ws_ratio,
 round(1 - len(solid) / greatest(1, len(l))::DOUBLE, 9) AS blank_line_ratio,
 round(ln(1 + len(regexp_extract_all(text, '[—–→←↔⇒•…“”‘’✓✗≈≤≥×]'))), 9) AS typographic_symbols,
 round(len(regexp_replace(text, '[\x00-\x7f]', '', 'g')) / greatest(1, len(text))::DOUBLE, 9) AS non_ascii_ratio FROM x""",
    "auc_overall": f"WITH {SCORED} {_auc('(SELECT * FROM s WHERE label = 1) a, (SELECT * FROM s WHERE label = 0) b', '')}",
    "auc_by_source": f"""WITH {SCORED}, e AS (SELECT doc_id, label, score, unnest(['all', source]) AS source FROM s)
{_auc('(SELECT * FROM e WHERE label = 1) a JOIN (SELECT * FROM e WHERE label = 0) b ON a.source = b.source', 'a.source AS source,')}""",
    "pair_aucs": f"""WITH {SCORED}, e AS (SELECT doc_id, source, CAST(substr(source, 4) AS INT) % 2 = 0 AS human, unnest([NULL, lang]) AS language, score % 100 AS score FROM s)
SELECT b.source AS human_repo, a.source AS ai_repo, a.language, round({AUC}, 9) AS auc FROM (SELECT * FROM e WHERE NOT human) a JOIN (SELECT * FROM e WHERE human) b ON a.language IS NOT DISTINCT FROM b.language GROUP BY ALL""",
    "confusion_matrix": f"WITH {PRED} SELECT y_true, count(*) FILTER (y_pred = 0) AS pred_0, count(*) FILTER (y_pred = 1) AS pred_1 FROM p GROUP BY 1",
    "class_report": f"""WITH {PRED}, k AS (SELECT label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_pred = label) AS n_pred, count(*) FILTER (y_true = label) AS support
 FROM p, (VALUES (0), (1), (2)) v(label) GROUP BY label), r AS ({REPORT} FROM k)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r""",
    "language_report": f"""WITH {PRED}, k AS (SELECT language, label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_pred = label) AS n_pred, count(*) FILTER (y_true = label) AS support
 FROM p, (VALUES (0), (1)) v(label) GROUP BY ALL), r AS ({REPORT}, language FROM k),
g AS (SELECT language, avg(f1) AS f, max(recall) FILTER (label = 0) AS r0, max(recall) FILTER (label = 1) AS r1 FROM r GROUP BY 1),
b AS (SELECT language, count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END) AS a FROM p GROUP BY 1)
SELECT language, n, round(a, 9) AS accuracy, round(f, 9) AS macro_f1, round(r0, 9) AS recall_0, round(r1, 9) AS recall_1 FROM b JOIN g USING (language)""",
    "known_repo_metrics": f"""WITH {FILES}, c AS {C}, e AS (SELECT *, 'repo' || ("commit" % 8) AS repo, CASE WHEN "commit" % 8 < 4 THEN 'human' ELSE 'ai' END AS expected FROM c)
SELECT repo, count(*) AS n, round(avg(CASE WHEN predicted = expected THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(CASE expected WHEN 'human' THEN p_human ELSE p_ai END), 6) AS mean_p_expected,
 round(avg(p_human), 6) AS mean_p_human, round(avg(p_ai), 6) AS mean_p_ai, count(*) FILTER (predicted = 'human') AS n_human, count(*) FILTER (predicted = 'ai') AS n_ai FROM e GROUP BY 1""",
    "language_breakdown": f"""WITH {FILES} SELECT language, count(*) AS n, round(avg(CASE WHEN predicted = 'human' THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(p_human), 6) AS mean_p_human, round(avg(p_ai), 6) AS mean_p_ai FROM {CL} GROUP BY 1""",
    "holdout_sample": rf"""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_seed('doc_id', 42)}, doc_id) AS k FROM documents WHERE regexp_matches(text, '\S') AND lang IN ('en', 'de', 'fr'))
SELECT doc_id, source FROM d WHERE source = 'src0' OR k <= 10""",
    "reservoir_split": f"""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_seed('doc_id', 0)}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN k <= floor(least(n, 60) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM d WHERE k <= 60""",
    "audit_sample": r"""WITH d AS (SELECT doc_id, CAST(quality AS INT) AS label, text, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id))
SELECT doc_id AS pos, label, replace(substr(text, 1, 200), chr(10), '\n') AS snippet FROM d WHERE k <= 15""",
    "repo_row_limit": f"""WITH d AS (SELECT l_returnflag AS repo, l_orderkey AS sha, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 row_number() OVER (PARTITION BY l_returnflag ORDER BY {_seed('l_orderkey', 42)}, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) SELECT * EXCLUDE (k) FROM d WHERE k <= 100""",
    "census_exact_match": """WITH k AS (SELECT text, arg_max(lang, doc_id) AS language FROM documents  GROUP BY text)
SELECT doc_id, language FROM documents LEFT JOIN k USING (text)""",
    "language_stats": """WITH d AS (SELECT lang AS language, doc_id % 3 > 0 AS exact, CAST('0x' || substr(sha1(source), 1, 8) AS BIGINT) % 100 AS b FROM documents)
SELECT CASE WHEN b < 15 THEN 'test' WHEN b < 25 THEN 'validation' ELSE 'train' END AS split, language, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT exact) AS classified, count(*) AS rows FROM d GROUP BY ALL""",
    "embedding_standardize": """WITH e AS (SELECT unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean, round(greatest(stddev_samp(x), 1e-6), 6) AS std FROM e GROUP BY 1""",
    "precision_check": """WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS a, [round(CAST(x AS DOUBLE), 2) FOR x IN embedding] AS b FROM embeddings)
SELECT count(*) AS n, round(min(list_cosine_similarity(a, b)), 6) AS min_cosine, min(list_cosine_similarity(a, b)) >= 0.999 AS matches FROM e""",
    "embed_documents": "SELECT DISTINCT sha256(text) AS content_hash, 'hashed-256' AS representation, 256 AS dimension FROM documents WHERE text IS NOT NULL",
    "batch_plan": "SELECT CAST(c AS INT) AS case_no, CAST(p AS INT) AS place, CAST(b AS INT) AS batch FROM (VALUES (0, 0, 0), (0, 4, 0), (0, 2, 1), (0, 7, 1), (0, 5, 1), (0, 3, 2), (0, 1, 2), (0, 6, 2), (1, 0, 0), (1, 1, 1)) t(c, p, b)",
    "latest_run": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY event_type) AS n_runs FROM events)
SELECT event_type, n_runs, event_id, value, CASE WHEN value / 100 >= 0.7 THEN 'good' WHEN value / 100 >= 0.4 THEN 'fair' ELSE 'poor' END AS band FROM r WHERE k = 1""",
    "metrics_keep_until": "SELECT event_id, event_id % 50 AS epoch FROM events WHERE event_id % 50 <= 20",
    "diff_post_image": r"""SELECT * FROM (VALUES ('d1', 'foo.py', false, false, E'def foo():\n    return 42\n    # trailing comment\n', 3::BIGINT), ('d2', 'x.sql', false, false, 'keep', 1),
 ('d2', 'i.png', true, true, '', 0), ('d2', 'w.py', true, false, E'a = 1\nb = \'x\ry\'\nc = 2\n', 3)) t("commit", path, is_added, is_binary, text, changed)""",
    "code_repos": "SELECT sha256(text) AS content_hash, min(source) AS repo FROM documents GROUP BY 1",
    "embed_todo": """SELECT doc_id, sha256(text) AS content_hash FROM documents d WHERE NOT EXISTS (
SELECT 1 FROM documents e WHERE e.doc_id IN (SELECT doc_id FROM labels) AND sha256(e.text) = sha256(d.text))""",
    "prediction_summary": f"""WITH {PRED}, k AS (SELECT label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_pred = label) AS n_pred, count(*) FILTER (y_true = label) AS support
 FROM p, (VALUES (0), (1), (2)) v(label) GROUP BY label), r AS ({REPORT} FROM k),
g AS (SELECT avg(f1) AS m, sum(f1 * support) / sum(support) AS w FROM r WHERE support > 0 OR f1 > 0 OR precision > 0), b AS (SELECT count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END) AS a FROM p)
SELECT n, round(a, 9) AS accuracy, round(m, 9) AS macro_f1, round(w, 9) AS weighted_f1 FROM b, g""",
    "split_summary": """WITH d AS (SELECT source, CAST('0x' || substr(sha1(source), 1, 8) AS BIGINT) % 100 AS b, coalesce(lang, 'none') AS language, quality, toxic FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, CASE WHEN b < 15 THEN 'test' WHEN b < 25 THEN 'validation' ELSE 'train' END AS split FROM d)
SELECT split, language, count(DISTINCT source) AS repos, count(*) FILTER (quality = 1) AS human, count(*) FILTER (quality IS DISTINCT FROM 1) AS ai, count(*) FILTER (toxic = 1) AS react FROM s GROUP BY GROUPING SETS ((split), (split, language))""",
    "first_per_language": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 300",
    "scored_languages": """WITH d AS (SELECT doc_id, 'src.d/f' || doc_id || ['.py', '.tsx', '.MJS', '.html', '', '.py.txt', '.ts'][doc_id % 7 + 1] AS path FROM documents)
SELECT doc_id, path, CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 6 THEN 'typescript' END AS language FROM d""",
    "reusable_results": "SELECT o_orderkey, o_orderstatus = 'O' OR (o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderkey % 2 = 0) AS reused FROM orders",
    "active_repos": """WITH i AS (SELECT source AS repo, lang AS language, count(*) AS agent_attributed_commits FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY agent_attributed_commits DESC, repo) AS r FROM i WHERE agent_attributed_commits >= CASE language WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 END)
SELECT repo, language, agent_attributed_commits FROM k WHERE r <= 6""",
    "stream_metrics": "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
