"""Line deduplication over overlapping three-line windows, in built-in
functions only.

Every run of three consecutive lines is hashed. The first occurrence of a window
in the corpus stands; the lines that later occurrences cover are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialize

SPAN = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, body, pos, w): a row for each window, w its 128-bit hash. Windows
    of blank lines alone are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), F.split(text, "\n", -1).alias("lines"))
    hashed = let(
        F.transform("lines", lambda x: F.concat(F.when(x.rlike(r"\S"), F.lit("x")).otherwise(F.lit("")), F.md5(x))),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - SPAN + 1), lambda i: F.concat_ws(",", F.slice(h, i, SPAN))),
    )
    runs = lined.where(F.size("lines") >= SPAN).select("doc_id", "body", F.posexplode(hashed).alias("pos", "run"))
    return runs.where(F.contains("run", F.lit("x"))).select("doc_id", "body", "pos", F.unhex(F.md5("run")).alias("w"))


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with text rewritten and n_lines, n_removed added
    (replaced, where docs has columns of those names).

    Lines end at "\\n". A window is three consecutive lines, one of them at least
    not blank. Occurrences are ordered by doc_id (nulls first), text and line;
    lines covered by any occurrence but the first of its window are removed,
    except those that the same document's first occurrence of it covers, so that
    a line repeated many times in a row leaves three. Documents of fewer than
    three lines stay as they are. Null texts stay null, with no lines. Rows equal
    in doc_id and text are treated alike. An empty table gives no rows.
    """
    windows = materialize(_windows(docs), "windows")
    place = F.struct("doc_id", "body", "pos")
    firsts = materialize(
        windows.groupBy("w").agg(F.min(place).alias("f"), F.max(place).alias("l")).where(~F.col("f").eqNullSafe(F.col("l"))).select("w", "f"), "firsts"
    )
    later = windows.join(firsts, "w").where(~place.eqNullSafe(F.col("f")))
    own = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("body") == F.col("f.body"))
    start = F.when(own, F.greatest(F.col("pos"), F.col("f.pos") + SPAN)).otherwise(F.col("pos"))
    spans = later.select("doc_id", "body", start.alias("a"), (F.col("pos") + SPAN - 1).alias("b")).where("a <= b")
    covered = materialize(
        spans.groupBy("doc_id", "body").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
        .select("doc_id", "body", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"]))))).alias("gone")),
        "covered",
    )
    discard(windows, firsts)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    marked = docs.select(*keep, F.xxhash64(text).alias("__body"))
    # one plan for any size: the share of documents that lose lines isn't bounded
    joined = marked.join(
        covered.select(F.col("doc_id").alias("__doc"), F.col("body").alias("__b"), F.col("gone").alias("__gone")).hint("merge"),
        F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__body") == F.col("__b")), "left",
    )
    lines = F.split(F.col("text"), "\n", -1)
    rest = let(
        F.struct(lines.alias("l"), F.col("__gone").alias("g")),
        lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["g"]), lambda i: F.get(x["l"], i)), "\n"),
    )
    return joined.select(
        *[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in keep],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
