"""Building a labelled dataset: remap, filter, first-wins dedup, caps, counts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .languages import language_predicate, require_labelled
from .sampling import first_n


def has_code(code: Column) -> Column:
    """Not null and not blank. Blank in the wide sense: any Unicode space."""
    return code.isNotNull() & code.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")


def remap(cls: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return cls
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, cls), cls)


def label_of(cls: Column, names: Sequence[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, names)), cls) - 1).cast("int")


def first_of_equal(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key. The key goes through a partial aggregation with
    the smallest order, so a key held by many rows meets no single task."""
    place = F.struct(*order)
    first = rows.groupBy(key.alias("__key")).agg(F.min(place).alias("__first"))
    return rows.withColumn("__key", key).join(first, "__key").where(place == F.col("__first")).drop("__key", "__first")


def admissible(rows: DataFrame, names: Sequence[str], mapping: dict[str, str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """rows(code, cls, language, ...) after the empty check, remap, class
    membership and language filter, in this order."""
    kept = rows.where(has_code(F.col("code"))).withColumn("cls", remap(F.col("cls"), mapping)).where(F.col("cls").isin(list(names)))
    predicate = language_predicate(F.col("language"), include, exclude)
    if predicate is None:
        return kept
    return kept.withColumn("language", require_labelled(F.col("language"))).where(predicate)


def cell_cap(cap: int, balanced_languages: Sequence[str] = ()) -> int:
    return math.ceil(cap / len(balanced_languages)) if balanced_languages else cap


def _fold(cap: int):
    """Admission row by row where equal codes lie in several cells. A code counts
    as seen once a row of it is admitted, not before."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(groups), ignore_index=True)
        if frame.empty:
            return
        frame = frame.sort_values(["source_order", "pos"], kind="stable")
        filled: dict[tuple, int] = {}
        seen: set[str] = set()
        keep = []
        for key, cell in zip(frame["digest"], frame["cell"], strict=True):
            n = filled.get(cell, 0)
            ok = n < cap and key not in seen
            if ok:
                filled[cell] = n + 1
                seen.add(key)
            keep.append(ok)
        yield frame[keep]

    return run


def prepare(rows: DataFrame, names: Sequence[str], mapping: dict[str, str] | None = None, cap: int | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), balance: bool = False) -> DataFrame:
    """One split: rows(source_order, pos, code, cls, language) to the admitted
    (source_order, pos, code, label, cls, language).

    Uncapped: the first of equal codes. Capped: the first `cap` rows of each class
    (or, balanced, of each class and language), equal codes counting once. Where no
    code spans two cells, dedup and rank say this exactly. Codes that span cells
    make admission depend on its own history; then the narrow (place, digest, cell)
    rows are folded in order, as no set formulation gives the same rows.
    """
    if balance and cap is not None and not include:
        raise ValueError("balanced languages need an include list")
    kept = admissible(rows, names, mapping or {}, include, exclude).withColumn("digest", F.sha2("code", 256))
    first = first_of_equal(kept, F.col("digest"), ["source_order", "pos"])
    if cap is not None:
        cell = F.concat_ws("\x1f", "cls", F.coalesce("language", F.lit(""))) if balance else F.col("cls")
        limit = cell_cap(cap, include if balance else ())
        spans = kept.groupBy("digest").agg(F.min(cell).alias("a"), F.max(cell).alias("b")).where("a <> b")
        if spans.isEmpty():
            first = first_n(first.withColumn("cell", cell), ["cell"], ["source_order", "pos"], limit).drop("cell")
        else:
            # a code's later rows in a cell never change the outcome, nor do those
            # beyond the codes that all cells can take: the fold's input is bounded
            cells = kept.select(cell.alias("cell")).distinct().count()
            narrow = kept.groupBy("digest", cell.alias("cell")).agg(F.min(F.struct("source_order", "pos")).alias("p")).select("p.source_order", "p.pos", "digest", "cell")
            narrow = first_n(narrow, ["cell"], ["source_order", "pos"], cells * limit).coalesce(1)
            admitted = narrow.mapInPandas(_fold(limit), narrow.schema).select("source_order", "pos")
            first = kept.join(admitted, ["source_order", "pos"])
    return first.select("source_order", "pos", "code", label_of(F.col("cls"), names).alias("label"), "cls", "language")


def counts(rows: DataFrame) -> DataFrame:
    """rows(cls, language, source) counted by class, by language, and by source
    and class, in one pass: kind, cls, language, source, n."""
    sets = rows.select("cls", F.coalesce("language", F.lit("unknown")).alias("language"), "source")
    grouped = sets.groupingSets([["cls"], ["language"], ["source", "cls"]], "cls", "language", "source").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "class").when(F.col("g") == 5, "language").otherwise("source")
    return grouped.select(kind.alias("kind"), "cls", "language", "source", "n")


def shortfall(rows: DataFrame, names: Sequence[str], languages: Sequence[str], cap: int) -> DataFrame:
    """Cells of the class and language grid with fewer rows than their cap."""
    limit = cell_cap(cap, languages)
    spark = rows.sparkSession
    grid = spark.createDataFrame([(c, x) for c in names for x in languages], "cls string, language string")
    have = rows.groupBy("cls", "language").agg(F.count("*").alias("n"))
    out = grid.join(have, ["cls", "language"], "left").select("cls", "language", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(limit).cast("long").alias("cap"))
    return out.where("n < cap")
