"""The operators as queries over a folder of tables. The tables hold no code and
no history, so each operator runs on a stand-in: line items are file changes,
orders are commits, documents are snippets, sources are repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CLASS_NAMES, CORPUS
from ..functions.text_features import raw_features, with_features
from ..ml import embed
from ..operators import commits, diff, languages, metrics, pairing, prepare, sampling, scoring, timeline

ALIASES = {"en": "Python", "de": "Java", "fr": "Go", "es": "C"}
STAND_IN = ["Python", "Java", "Go", "C"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def _p_ai() -> Column:
    return ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31) % 1000) / F.lit(999.0)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    p = _p_ai()
    return rows.select(
        F.col("l_orderkey").alias("commit"), F.col("l_returnflag").alias("language"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_extendedprice"), F.col("l_shipdate"), F.col("l_quantity").alias("lines_changed"), (1 - p).alias("p_human"), p.alias("p_ai"),
    )


def _commits(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("commit",)) -> DataFrame:
    out = scoring.aggregate_commits(_files(spark, sf_dir), CLASS_NAMES, by).select(*by, "n_files", "lines_changed", _r(F.col("p_human"), "p_human"), _r(F.col("p_ai"), "p_ai"))
    return out.withColumn("predicted", scoring.argmax_class([F.col("p_human"), F.col("p_ai")], CLASS_NAMES))


def commit_weighted_aggregate(spark, sf_dir):
    return _commits(spark, sf_dir)


def commit_language_aggregate(spark, sf_dir):
    return _commits(spark, sf_dir, ("commit", "language"))


def topk_files_per_commit(spark, sf_dir):
    order = [F.col("lines_changed").desc(), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return scoring.top_files(_files(spark, sf_dir), order, 5).select("commit", F.col("rank").cast("long").alias("rank"), "l_linenumber", "l_partkey", "l_suppkey", "lines_changed", "n_over")


def _history(spark, sf_dir) -> DataFrame:
    """Commits with month, predicted, error and the class by language."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(F.col("o_orderkey") % 97 == 0, F.lit("unreadable")).alias("error"))
    per = _commits(spark, sf_dir, ("commit", "language")).groupBy("commit").agg(F.map_from_entries(F.collect_list(F.struct("language", "predicted"))).alias("languages"))
    return orders.join(_commits(spark, sf_dir).select("commit", "predicted"), "commit", "left").join(per, "commit", "left")


def timeline_monthly(spark, sf_dir):
    return timeline.monthly(_history(spark, sf_dir), CLASS_NAMES)


def timeline_by_language(spark, sf_dir):
    return timeline.monthly(_history(spark, sf_dir), CLASS_NAMES, "A")


def timeline_language_totals(spark, sf_dir):
    return timeline.language_totals(_history(spark, sf_dir), CLASS_NAMES)


def timeline_percent(spark, sf_dir):
    n = F.col("human") + F.col("ai")
    return timeline_monthly(spark, sf_dir).select("month", timeline.percent(F.col("ai"), n).alias("pct_ai"))


def timeline_cache_todo(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"))
    cache = orders.where("sha % 3 <> 0").select("sha", F.when(F.col("sha") % 5 == 0, "failed").alias("error"), F.when(F.col("sha") % 7 != 0, F.create_map(F.lit("A"), F.lit("ai"))).alias("languages"))
    return timeline.todo(orders, cache)


def evenly_spaced_commits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sampling.evenly_spaced(rows, ["o_orderdate", "o_orderkey"], 50).select("o_orderkey")


def _snippets(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return docs.select(
        F.lit(0).alias("source_order"), F.col("doc_id").alias("pos"), F.col("text").alias("code"), F.when(F.col("quality") == 1, "human").when(F.col("toxic") == 1, "machine").otherwise("ai").alias("cls"),
        F.try_element_at(names, F.col("lang")).alias("language"), "source",
    )


def prepare_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(prepare.has_code(F.col("text")))
    return prepare.first_of_equal(docs, F.sha2("text", 256), ["doc_id"]).select("doc_id")


def _prepared(spark, sf_dir, **options) -> DataFrame:
    return prepare.prepare(_snippets(spark, sf_dir), CLASS_NAMES, {"machine": "ai"}, **options).select(F.col("pos").alias("doc_id"), "label", "language")


def prepare_uncapped(spark, sf_dir):
    return _prepared(spark, sf_dir)


def prepare_class_cap(spark, sf_dir):
    return _prepared(spark, sf_dir, cap=40)


def prepare_balanced(spark, sf_dir):
    return _prepared(spark, sf_dir, cap=50, include=["Python", "Java", "Go"], balance=True)


def prepare_counts(spark, sf_dir):
    rows = prepare.admissible(_snippets(spark, sf_dir), CLASS_NAMES, {"machine": "ai"})
    return prepare.counts(rows)


def prepare_shortfall(spark, sf_dir):
    rows = prepare.admissible(_snippets(spark, sf_dir), CLASS_NAMES, {"machine": "ai"})
    return prepare.shortfall(rows, CLASS_NAMES, STAND_IN, 200)


NAMES = ["python", " JS ", "c++", "CSharp", "golang", "Cobol", "TypeScript", "rUST", ""]


def language_filter(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in [*NAMES, None]], "name string").withColumn("language", languages.canonical(F.col("name")))
    return rows.withColumn("passes", languages.language_predicate(F.col("language"), ["python", "js", "C#", "ts"], ["TypeScript"]))


def repo_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", sampling.split_of(F.col("source")).alias("split"))


def repo_share_cap(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy("lang", F.col("source").alias("repo")).agg(F.count("*").alias("n"))
    size = F.count("*").over(Window.partitionBy("lang"))
    shared = sizes.withColumn("share", sampling.language_share(size.cast("double"), 0.05))
    return sampling.share_caps(shared, F.col("share"), ["lang"]).select("lang", "repo", "n", "keep")


def size_matched_pairs(spark, sf_dir):
    """Suppliers are repositories: their number grows with the table. The row limit
    of a repository is the only cap."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("repo"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.col("l_quantity").alias("lines_changed"), F.when(_p_ai() > 0.5, "ai").otherwise("human").alias("label"))
    order = Window.partitionBy("repo", "label").orderBy(F.xxhash64("id"), "id", "lines_changed")
    placed = rows.withColumn("pos", F.row_number().over(order).cast("long") - 1)
    limit, pool = CORPUS["rows_per_class_per_repo"], CORPUS["human_pool_factor"]
    return pairing.size_matched_pairs(*pairing.pools(placed, limit, pool), limit=limit * pool)


COMMITS = [
    ("c1", "Ann <ann@x.org>", "Ann <ann@x.org>", "fix", "text\n\nCo-Authored-By: Claude <noreply@x>"),
    ("c2", "Bob <bob@x.org>", "Bob <bob@x.org>", "fix", "Generated with [Claude Code]"),
    ("c3", "Eve <eve@x.org>", "Eve <eve@x.org>", "refactor (aider)", ""),
    ("c4", "devin-ai-integration[bot] <1+devin@users.noreply.github.com>", "GitHub <noreply@github.com>", "feat", ""),
    ("c5", "Dan <dan@x.org>", "Dan <dan@x.org>", "docs", "plain"),
    ("c6", "renovate[bot] <29139614+renovate[bot]@users.noreply.github.com>", "GitHub <noreply@github.com>", "deps", ""),
    ("c7", "Cursor Agent <cursoragent@cursor.com>", "Zed <z@x.org>", "ui", "Co-authored-by: Copilot <c@x>"),
    ("c8", "Jo <jo@x.org>", "release-bot <r@x.org>", "1.2.3", "see https://chatgpt.com/codex/tasks/1"),
]


def _log(spark) -> DataFrame:
    return spark.createDataFrame(COMMITS, "sha string, author string, committer string, subject string, body string")


def agent_signatures(spark, sf_dir):
    c = {k: F.col(k) for k in ("author", "committer", "subject", "body")}
    rows = _log(spark).withColumn("agents", commits.detect_agents(**c))
    return rows.select("sha", F.array_join("agents", ",").alias("agents"), commits.mode(F.col("author"), F.col("agents")).alias("mode"))


def bot_filter(spark, sf_dir):
    return _log(spark).select("sha", commits.is_excluded_bot(F.col("author"), F.col("committer")).alias("is_bot"))


PATHS = ["src/App.tsx", "src/types.d.ts", "vendor/x.ts", "a/vendor/b.js", "lib/util.MJS", "dist/main.js", "x.min.js", "README.md", "src/.ts", "deep/__generated__/q.ts", "plain.ts"]


def path_filter(spark, sf_dir):
    from ..constants import CORPUS_LANGUAGES, EXCLUDE_GLOBS

    extensions = CORPUS_LANGUAGES["TypeScript"]["extensions"] + CORPUS_LANGUAGES["JavaScript"]["extensions"]
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return rows.select("path", commits.wanted_path(F.col("path"), extensions, EXCLUDE_GLOBS).alias("wanted"), commits.suffix(F.col("path")).alias("suffix"))


SPDX = [("r1", "MIT"), ("r2", "AGPL-3.0"), ("r3", "NOASSERTION"), ("r4", None), ("r5", "BSL-1.0"), ("r6", "MPL-2.0")]


def license_filter(spark, sf_dir):
    rows = spark.createDataFrame(SPDX, "repo string, spdx string")
    return commits.redistributable(rows.select("repo"), rows)


def text_features_native(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[_r(c, n, 9) for n, c in raw_features(F.col("text")).items()])


def text_features_scanned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code"), F.when(F.col("lang") == "en", "Python").otherwise("TypeScript").alias("language"))
    return with_features(docs).drop("code")


def _scored(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"), "source", "lang")


def auc_overall(spark, sf_dir):
    out = metrics.auc(_scored(spark, sf_dir))
    return out.select("n", "n_pos", "n_neg", _r(F.col("auc"), "auc", 9))


def auc_by_source(spark, sf_dir):
    out = metrics.auc_table(_scored(spark, sf_dir), "source")
    return out.select("source", "n", "n_pos", "n_neg", _r(F.col("auc"), "auc", 9))


def pair_aucs(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("source").alias("repo"), F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "human").otherwise("ai").alias("expected"), F.col("lang").alias("language"), (F.col("score") % 100).alias("p_ai"))
    return metrics.pair_aucs(rows).withColumn("auc", F.round("auc", 9))


def _predicted(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).select(F.col("label").cast("int").alias("y_true"), (F.col("score") % 7 > 1).cast("int").alias("y_pred"), F.col("lang").alias("language"))


def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_predicted(spark, sf_dir), [0, 1])


def class_report(spark, sf_dir):
    out = metrics.class_report(_predicted(spark, sf_dir), [0, 1, 2])
    return out.select("label", *[_r(F.col(c), c, 9) for c in ("precision", "recall", "f1")], "support")


def language_report(spark, sf_dir):
    out = metrics.language_report(_predicted(spark, sf_dir), [0, 1])
    return out.select("language", "n", *[_r(F.col(c), c, 9) for c in ("accuracy", "macro_f1", "recall_0", "recall_1")])


def _known(spark, sf_dir, by=("commit",)) -> DataFrame:
    return _commits(spark, sf_dir, by).withColumn("repo", F.concat(F.lit("repo"), (F.col("commit") % 8).cast("string")))


def known_repo_metrics(spark, sf_dir):
    rows = _known(spark, sf_dir).withColumn("expected", F.when(F.col("commit") % 8 < 4, "human").otherwise("ai"))
    out = metrics.known_repo_metrics(rows, F.col("expected"), CLASS_NAMES, ["repo"])
    return out.select("repo", "n", *[_r(F.col(c), c) for c in ("accuracy", "mean_p_expected", "mean_p_human", "mean_p_ai")], "n_human", "n_ai")


def language_breakdown(spark, sf_dir):
    out = metrics.known_repo_metrics(_known(spark, sf_dir, ("commit", "language")), F.lit("human"), CLASS_NAMES, ["language"])
    return out.select("language", "n", _r(F.col("accuracy"), "accuracy"), _r(F.col("mean_p_human"), "mean_p_human"), _r(F.col("mean_p_ai"), "mean_p_ai"))


def holdout_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code"), F.col("lang").alias("language"), "source", F.when(F.col("source") == "src0", "human").otherwise("ai").alias("cls"))
    return sampling.holdout_sample(rows, 10, ["en", "de", "fr"], 42, "doc_id").select("doc_id", "source")


def reservoir_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.reservoir(rows, ["lang"], "doc_id", 60)


def audit_sample(spark, sf_dir):
    rows = _scored(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("pos"), F.col("label").cast("int").alias("label"), F.col("text").alias("code"))
    return sampling.audit_sample(rows, [0, 1]).select("pos", "label", "snippet")


def repo_row_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("repo"), F.col("l_orderkey").alias("sha"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return sampling.limited_rows(rows, 100, 42, order=["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def census_exact_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.col("text").alias("code"), F.col("lang").alias("language"), F.col("doc_id").alias("pos"))
    return languages.exact_match(docs.select("doc_id", F.col("text").alias("code")), known).select("doc_id", "language")


def language_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(sampling.split_of(F.col("source")).alias("split"), F.col("lang").alias("language"), (F.col("doc_id") % 3 > 0).alias("exact"))
    return languages.language_statistics(docs)


def embedding_standardize(spark, sf_dir):
    out = embed.standardized_moments(table(spark, sf_dir, "embeddings"))
    return out.select("dim", _r(F.col("mean"), "mean"), _r(F.col("std"), "std"))


def precision_check(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("reference"), F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("candidate"))
    return embed.precision_matches(rows).select("n", _r(F.col("min_cosine"), "min_cosine"), "matches")


def _training(spark, sf_dir, limit: int = 2000):
    """A bounded training set on the driver: a hashed sample of either class."""
    import numpy as np

    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null").select("vec_id", "embedding", (F.col("label") % 2).alias("y"))
    rows = sampling.collect_sample(rows, "y", limit // 2, F.xxhash64("vec_id"))
    rows.sort(key=lambda r: r["__key"])
    return np.array([r["embedding"] for r in rows]), np.array([r["y"] for r in rows])


def _head(spark, sf_dir):
    from ..ml import mlp

    x, y = _training(spark, sf_dir)
    cut = len(x) * 4 // 5
    return mlp.train(x[:cut], y[:cut], x[cut:], y[cut:], CLASS_NAMES, hidden=(32, 16), epochs=5)


def mlp_score(spark, sf_dir):
    from ..ml import mlp

    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return mlp.score(rows, _head(spark, sf_dir)).select("vec_id", "p_human", "p_ai")


def stage2_scores(spark, sf_dir):
    from ..ml import mlp, stage2

    rows = mlp.score(table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null"), _head(spark, sf_dir))
    rows = rows.select("vec_id", (F.col("label") % 2).cast("double").alias("label"), "p_ai", F.element_at("embedding", 1).cast("double").alias("token_entropy"), F.when(F.col("vec_id") % 3 == 0, "Go").otherwise("Python").alias("language"))
    model = stage2.fit(rows, ["token_entropy"], iterations=5)
    return stage2.apply(rows, model, ["token_entropy"], ["Python"])


def embed_documents(spark, sf_dir):
    return embed.embed_texts(table(spark, sf_dir, "documents").select(F.col("text").alias("code"))).select("content_hash", "representation", F.size("embedding").alias("dimension"))


def batch_plan(spark, sf_dir):
    cases = [([512, 10, 300, 40, 512, 90, 7, 200], 1024), ([5000, 3], 1024)]
    rows = [(c, i, b) for c, (lengths, budget) in enumerate(cases) for b, batch in enumerate(embed.plan_batches(lengths, budget)) for i in batch]
    return spark.createDataFrame(rows, "case_no int, place int, batch int")


def latest_run(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    out = metrics.latest_runs(rows, "event_type", ["ts", "event_id"])
    return out.select("event_type", "n_runs", "event_id", "value", metrics.accuracy_band(F.col("value") / 100).alias("band"))


def metrics_keep_until(spark, sf_dir):
    from ..sources.logs import keep_until

    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 50).alias("epoch"))
    return keep_until(rows, 20)


DIFFS = [
    ("d1", "diff --git a/foo.py b/foo.py\nindex e69de29..4b825dc 100644\n--- a/foo.py\n+++ b/foo.py\n@@ -1,2 +1,3 @@\n def foo():\n-    pass\n+    return 42\n+    # trailing comment\n"),
    ("d2", 'diff --git a/x.sql b/x.sql\n--- a/x.sql\n+++ b/x.sql\n@@ -1,2 +1 @@\n--- old note\n keep\n\\ No newline at end of file\ndiff --git a/i.png b/i.png\nnew file mode 100644\nBinary files /dev/null and b/i.png differ\ndiff --git a/w.py b/w.py\nnew file mode 100644\n--- /dev/null\n+++ b/w.py\n@@ -0,0 +1,3 @@\n+a = 1\r\n+b = \'x\ry\'\r\n+c = 2\r\n'),
]


def diff_post_image(spark, sf_dir):
    rows = spark.createDataFrame(DIFFS, "commit string, diff string")
    out = diff.post_images(diff.diff_lines(rows))
    return out.select("commit", "path", "is_added", "is_binary", "text", "changed")


def stream_metrics(spark, sf_dir):
    from ..streaming.monitor import latest_by_name

    return latest_by_name(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema, "event_type", "value")


def code_repos(spark, sf_dir):
    from .second_stage import code_repos as lookup

    return lookup(table(spark, sf_dir, "documents").select(F.col("text").alias("code"), F.col("source").alias("repo")))


def embed_todo(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code"))
    done = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(embed.content_key(F.col("code")).alias("content_hash"), F.lit("hashed-256").alias("representation"))
    return embed.missing(docs, done, "hashed-256").select("doc_id", "content_hash")


def prediction_summary(spark, sf_dir):
    out = metrics.summary(_predicted(spark, sf_dir), [0, 1, 2], present_only=True)
    return out.select("n", *[_r(F.col(c), c, 9) for c in ("accuracy", "macro_f1", "weighted_f1")])


def split_summary(spark, sf_dir):
    from .corpus import summary

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return summary(docs.select(F.col("source").alias("repo"), sampling.split_of(F.col("source")).alias("split"), F.coalesce("lang", F.lit("none")).alias("language"), F.when(F.col("quality") == 1, "human").otherwise("ai").alias("label"), (F.col("toxic") == 1).alias("react")))


def first_per_language(spark, sf_dir):
    return sampling.first_n(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 300)


NAMES_OF_FILES = [".py", ".tsx", ".MJS", ".html", "", ".py.txt", ".ts"]


def scored_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src.d/f"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, NAMES_OF_FILES)), (F.col("doc_id") % len(NAMES_OF_FILES)).cast("int") + 1)).alias("path"))
    return docs.select("doc_id", "path", scoring.scored_language(F.col("path")).alias("language"))


def reusable_results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", commits.reusable(F.col("o_orderstatus"), F.lit("O"), F.col("o_orderpriority"), F.col("o_orderkey") % 2 == 0, ["1-URGENT", "5-LOW"]).alias("reused"))


def active_repos(spark, sf_dir):
    from ..sources.snippets import select_repos

    index = table(spark, sf_dir, "documents").where("lang is not null and source is not null").groupBy(F.col("source").alias("repo"), F.col("lang").alias("language")).agg(F.count("*").alias("agent_attributed_commits"))
    return select_repos(index, {"en": 4, "de": 3, "fr": 2}, 6)


def queries() -> dict:
    names = [
        "code_repos", "embed_todo", "prediction_summary", "split_summary", "first_per_language", "scored_languages", "reusable_results", "active_repos",
        "commit_weighted_aggregate", "commit_language_aggregate", "topk_files_per_commit", "timeline_monthly", "timeline_by_language", "timeline_language_totals",
        "timeline_percent", "timeline_cache_todo", "evenly_spaced_commits", "prepare_dedup", "prepare_uncapped", "prepare_class_cap", "prepare_balanced", "prepare_counts", "prepare_shortfall",
        "language_filter", "repo_split", "repo_share_cap", "size_matched_pairs", "agent_signatures", "bot_filter", "path_filter", "license_filter",
        "text_features_native", "text_features_scanned", "auc_overall", "auc_by_source", "pair_aucs", "confusion_matrix", "class_report", "language_report",
        "known_repo_metrics", "language_breakdown", "holdout_sample", "reservoir_split", "audit_sample", "repo_row_limit", "census_exact_match", "language_stats",
        "embedding_standardize", "precision_check", "mlp_score", "stage2_scores", "embed_documents", "batch_plan", "latest_run", "metrics_keep_until", "diff_post_image", "stream_metrics",
    ]
    return {n: globals()[n] for n in names}
