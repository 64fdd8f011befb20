"""The ten operators as queries over a folder of tables, with SQL where it can
say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dup, exact_dup, language_id, line_dup, mixing, near_dup, quality, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dup.deduplicate_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text", F.sha2("text", 256).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_language_id": op3_language_id,
        "op4_bpe": op4_bpe,
        "op5_quality": op5_quality,
        "op6_toxicity": op6_toxicity,
        "op7_url_filter": op7_url_filter,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_mixing": op9_mixing,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
    }


WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i:i+2] AS k, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
u AS (SELECT *, first_value(doc_id) OVER o AS d0, first_value(i) OVER o AS i0 FROM w
      WHERE NOT regexp_full_match(array_to_string(k, ''), '\s*') WINDOW o AS (PARTITION BY k ORDER BY doc_id, i)),
r AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = d0 THEN greatest(i, i0 + 3) ELSE i END, i + 3)) AS j
      FROM u WHERE (doc_id, i) <> (d0, i0)),
x AS (SELECT doc_id, list(j) AS js FROM r GROUP BY doc_id),
t AS (SELECT d.doc_id, len(l) AS n_lines, coalesce(len(js), 0) AS n_removed,
      CASE WHEN js IS NULL THEN array_to_string(l, chr(10))
           ELSE coalesce(array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(js, i)], chr(10)), '') END AS text
      FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, text, sha256(text) AS text_sha256 FROM t""",
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({FOLD}) AS text_sha256, {FOLD} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)""",

    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
      WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op10_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, len(w) AS k, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, k, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS g
      FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, g FROM g WHERE i <= k - 4 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT documents.doc_id, count(g) AS n FROM documents LEFT JOIN e USING (doc_id) GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM n JOIN m ON a = doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
