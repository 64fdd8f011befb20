"""Exact deduplication by deterministic block naming, in built-in functions only.

A normalised text is cut into fixed-size blocks of bytes. The distinct blocks
are sorted and numbered, which gives each an integer name. Adjacent names are
paired, the distinct pairs sorted and numbered in turn, until every document has
a single name. With its length, that name is an identity that can't collide: at
every level different strings have different names.

Only the first level moves text, once, after a partial aggregation that leaves a
block once per task however often it occurs. Names return to the documents by a
digest of the block; blocks whose digests collide, if any, return by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, let, materialize

BLOCK_BYTES = 4096


def _digest(block: Column) -> Column:
    return F.unhex(F.md5(block))


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """A unique integer for each row: its place in the sorted partition. The
    result is written, so that a lost executor can't change a name."""
    return materialize(distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def _block_names(blocks: DataFrame, digest) -> tuple[DataFrame, list[DataFrame]]:
    """blocks(key, i, block, h, ...) with name in place of block and h."""
    names = materialize(
        blocks.select("block").distinct().sortWithinPartitions("block").select(digest(F.col("block")).alias("h"), F.monotonically_increasing_id().alias("name")), "names"
    )
    per = names.groupBy("h").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    single = materialize(per.where("n = 1").select("h", "name"), "single")
    clash = materialize(per.where("n > 1").select("h"), "clash")
    out = blocks.drop("block").join(single, "h").drop("h")
    used = [names, single, clash]
    if not clash.isEmpty():  # different blocks, one digest: names by the bytes, below zero to differ from the rest
        again = blocks.join(clash, "h", "left_semi")
        own = _named(again.select("block").distinct(), ["block"]).withColumn("name", -1 - F.col("name"))
        out = out.union(again.join(own, "block").select(out.columns))
        used.append(own)
    return out, used


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest=_digest) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept,
    text_sha256. Texts are equal when identical after lower-casing A-Z; null
    counts as empty. The row with the largest doc_id stays; null ids sort below
    all others. Repeated rows with that doc_id all stay. Extra columns are
    ignored; an empty table gives no rows. `digest` only routes names back.
    """
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    blocks = cut.select(
        "doc_id",
        F.octet_length("norm").cast("long").alias("size"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.posexplode(
            let(
                F.col("norm").cast("binary"),
                lambda t: F.transform(
                    F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(t) - 1) / block_bytes).cast("int"))),
                    lambda i: F.substring(t, i * block_bytes + 1, F.lit(block_bytes)),
                ),
            )
        ).alias("i", "block"),
    )
    head = [F.when(F.col("i") == 0, F.col(c)).alias(c) for c in ("doc_id", "size", "text_sha256")]
    key = F.unhex(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text_sha256"), 256)).alias("key")
    named, used = _block_names(blocks.select(key, "i", "block", digest(F.col("block")).alias("h"), *head), digest)
    whole = materialize(named, "blocks")
    discard(*used)
    rows = whole.where("i = 0").select("key", "doc_id", "size", "text_sha256")
    level = whole.select("key", "i", "name")
    done = None
    while True:
        last = level.groupBy("key").agg(F.max("i").alias("top"))
        level = level.join(last, "key")
        ended = level.where("top = 0").groupBy("key").agg(F.min("name").alias("name"))
        done = materialize(ended if done is None else done.union(ended), "done")
        more = level.where("top > 0")
        pairs = more.groupBy("key", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.min(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.min(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("b")
        )
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            break
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        level = materialize(pairs.join(names, pairs.a.eqNullSafe(names.a) & pairs.b.eqNullSafe(names.b)).select("key", "i", "name"), "level")
    ids = materialize(rows.join(done, "key").select("doc_id", "size", "name", "text_sha256"), "ids")
    groups = materialize(ids.groupBy("size", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return ids.join(groups, ["size", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
