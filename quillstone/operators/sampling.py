"""Deterministic samples, splits and caps. Where a random order is wanted, a hash
of a seed and a key gives it, so results don't depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..scratch import small_table
from .ranks import sums_before


def seeded(seed: int, *keys: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def split_of(repo: Column, validation: int = 10, test: int = 15) -> Column:
    """train, validation or test from the first 32 bits of the repo's SHA-1."""
    bucket = F.conv(F.substring(F.sha1(repo), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < test, "test").when(bucket < test + validation, "validation").otherwise("train")


def first_n(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group. A group is first cut down within each input
    partition, then within 256 bundles of them, so that the task that sees what is
    left of a group has 256 * n rows of it at most, however large the group."""
    cut = rows.withColumn("__part", F.spark_partition_id()).withColumn("__bundle", F.col("__part") % 256)
    for part in (["__bundle", "__part"], ["__bundle"], []):
        rank = F.row_number().over(Window.partitionBy(*by, *part).orderBy(*order))
        cut = cut.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
    return cut.drop("__part", "__bundle")


def collect_sample(rows: DataFrame, by: str, n: int, key: Column, late: Column | None = None, groups: int = 64) -> list[Row]:
    """At most n rows of each of the `groups` largest groups (of equal ones, the
    first by name), in the order of a 64-bit hash; late rows only where the others
    don't suffice. Rows of equal key count once, so there may be fewer than n.

    A group's size gives a bound of the hash below which n rows lie but for a
    chance of 1e-12; only rows below it leave their task, so there is no sort and
    no task holds a group. The driver gets groups * (n + slack) rows at most."""
    span = 1 << 53
    marked = rows.where(F.col(by).isNotNull()).withColumn("__key", key).withColumn("__late", F.lit(False) if late is None else late)
    sizes = marked.groupBy(by).agg(F.count_if(~F.col("__late")).alias("a"), F.count_if("__late").alias("b"))
    sizes = sizes.orderBy((F.col("a") + F.col("b")).desc(), by).limit(groups).collect()
    if not sizes:
        return []
    most = n + 8 * math.sqrt(n) + 32
    limits = [(r[by], min(1.0, most / max(r["a"], 1)), 0.0 if r["a"] >= n else min(1.0, most / max(r["b"], 1))) for r in sizes]
    table = small_table(rows.sparkSession, limits, f"__by {rows.schema[by].dataType.simpleString()}, __a double, __b double")
    near = marked.join(F.broadcast(table), F.col(by) == F.col("__by"))  # a row a group, `groups` at most
    near = near.where(F.pmod("__key", F.lit(span)) / span <= F.when(F.col("__late"), F.col("__b")).otherwise(F.col("__a")))
    found: dict = {}
    for r in near.drop("__by", "__a", "__b").dropDuplicates([by, "__key"]).collect():
        found.setdefault(r[by], []).append(r)
    return [r for g in sorted(found, key=str) for r in sorted(found[g], key=lambda r: (r["__late"], r["__key"] % span, r["__key"]))[:n]]


def evenly_spaced(rows: DataFrame, order: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows at places floor(i * count / n), i below n, of the order (within each
    group); all rows where there are at most n."""
    placed = sums_before(rows, F.lit(1).cast("long"), order, by, "__i")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    return _evenly(placed.join(sizes, list(by)) if by else placed.crossJoin(F.broadcast(sizes)), n)  # without groups, sizes is one row


def _evenly(rows: DataFrame, n: int) -> DataFrame:
    # the first i with floor(i * count / n) >= place: a hit if it is equal
    step = F.col("__n") / F.lit(float(n))
    near = F.floor(F.col("__i") / step)
    hits = [((near + d) >= 0) & ((near + d) < n) & (F.floor((near + d) * step) == F.col("__i")) for d in (-1, 0, 1)]
    picked = rows.where((F.col("__n") <= n) | hits[0] | hits[1] | hits[2])
    return picked.drop("__i", "__n")


def share_caps(sizes: DataFrame, share: Column, by: Sequence[str]) -> DataFrame:
    """sizes(<by>, repo, n, ...) with keep: n, but at most L, the largest whole
    number with L <= max(1, floor(share * sum of min(n, L))). There is no cap where
    count * share is below one, as no L could then be met by all.

    The sum is piecewise linear in L, so the condition is checked at the sizes
    themselves and solved within the one interval where it turns false."""
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "repo")
    ranked = sizes.withColumn("__share", share).withColumn("__above", F.row_number().over(w)).withColumn("__k", F.count("*").over(Window.partitionBy(*by)))
    ranked = ranked.withColumn("__rest", F.sum("n").over(Window.partitionBy(*by)) - F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # with j sizes above L, the bound is floor(share * (rest_j + j * L))
    upper, lower = F.col("n"), F.coalesce(F.lead("n").over(w), F.lit(0))
    ranked = ranked.withColumn("__lower", lower)
    j, rest = F.col("__above"), F.col("__rest")
    free = F.col("__share") * j >= 1
    solved = F.floor(F.col("__share") * rest / (1 - F.col("__share") * j) + 1e-9)
    best = F.when(free, upper).otherwise(F.least(upper, solved))
    fits = F.when(best >= F.col("__lower"), best)
    limits = ranked.groupBy(*by).agg(F.greatest(F.lit(1), F.max(fits)).cast("long").alias("__limit"), F.max("__k").alias("__count"), F.max("__share").alias("__s"))
    out = sizes.join(limits, list(by))
    keep = F.when(F.col("__count") * F.col("__s") < 1, F.col("n")).otherwise(F.least("n", "__limit"))
    return out.withColumn("keep", keep.cast("long")).drop("__limit", "__count", "__s")


def language_share(group_size: Column, max_share: float) -> Column:
    return F.greatest(F.lit(max_share), F.lit(2.0) / group_size)


def reservoir(rows: DataFrame, by: Sequence[str], key: str, n: int, seed: int = 0, train: float = 0.8) -> DataFrame:
    """n rows a group in a seeded order, the first `train` of them for training."""
    w = Window.partitionBy(*by).orderBy(seeded(seed, F.col(key)), key)
    picked = first_n(rows, by, [seeded(seed, F.col(key)), key], n).withColumn("__rank", F.row_number().over(w))
    size = F.count("*").over(Window.partitionBy(*by))
    return picked.withColumn("part", F.when(F.col("__rank") <= F.floor(size * F.lit(train)), "train").otherwise("test")).drop("__rank")


def holdout_sample(rows: DataFrame, per_source: int, languages: Sequence[str], seed: int, key: str, human: str = "human") -> DataFrame:
    """rows(code, language, source, cls): all human rows, and a seeded sample of
    each generator's; blank code and other languages go."""
    from .prepare import has_code

    kept = rows.where(has_code(F.col("code")) & (F.col("language").isin(list(languages)) if languages else F.lit(True)))
    generated = first_n(kept.where(F.col("cls") != human), ["source"], [seeded(seed, F.col(key)), key], per_source)
    return kept.where(F.col("cls") == human).unionByName(generated)


def limited_rows(rows: DataFrame, limit: int, seed: int, by: str = "repo", unit: str = "sha", order: Sequence[str] = ("file_pos",)) -> DataFrame:
    """Rows of units (commits) in a seeded order until limit rows are reached,
    the last unit cut short."""
    return first_n(rows, [by], [seeded(seed, F.col(unit)), unit, *order], limit)


def audit_sample(rows: DataFrame, labels: Sequence[int], n: int = 15, width: int = 200, order: str = "pos") -> DataFrame:
    picked = first_n(rows.where(F.col("label").isin(list(labels))), ["label"], [order], n)
    return picked.withColumn("snippet", F.replace(F.substring("code", 1, width), F.lit("\n"), F.lit("\\n")))
