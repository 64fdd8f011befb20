"""Labelled snippets from several sources, in one shape:
(source, source_order, split, pos, code, cls, language)."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SOURCE_A_LABELS
from ..operators.languages import canonical, checked_languages

ROWS = "code string, label string, language string"


def _shape(rows: DataFrame, source: str, order: int, split: str) -> DataFrame:
    return rows.select(F.lit(source).alias("source"), F.lit(order).alias("source_order"), F.lit(split).alias("split"), "pos", "code", "cls", "language")


def source_a(rows: DataFrame, index: DataFrame | None = None, checkpoints: DataFrame | None = None) -> DataFrame:
    """rows(split, row, code, label int): integer labels, unknown ones dropped;
    languages from an index by position, checked against the content."""
    table = F.create_map(*[F.lit(x) for pair in SOURCE_A_LABELS.items() for x in pair])
    if index is not None:
        rows = checked_languages(rows, index, checkpoints)
    else:
        rows = rows.withColumn("language", F.lit(None).cast("string"))
    out = rows.withColumn("cls", F.try_element_at(table, F.col("label").cast("int"))).where("cls is not null")
    return out.select(F.col("row").alias("pos"), "code", "cls", "language")


def source_b(rows: DataFrame) -> DataFrame:
    """rows(row, code, source, language): human where source is Human, else ai."""
    cls = F.when(F.col("source") == "Human", "human").otherwise("ai")
    return rows.select(F.col("row").alias("pos"), "code", cls.alias("cls"), canonical(F.col("language")).alias("language"))


def agent_commit_rows(spark: SparkSession, local: str, archives: Sequence[str], split: str) -> DataFrame:
    """A local build of the split wins; else all archives that hold it, in order;
    without either, an empty table."""
    own = os.path.join(local, f"{split}.jsonl")
    paths = [own] if os.path.exists(own) else [p for a in archives if os.path.exists(p := os.path.join(a, f"{split}.jsonl.gz"))]
    if not paths:
        return spark.createDataFrame([], f"pos long, {ROWS}")
    parts = [spark.read.schema(ROWS).json(p).select(F.monotonically_increasing_id().alias("line"), "*", F.lit(i).alias("file")) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a gzip file is one partition, so its lines are numbered in order
    return out.select((F.shiftleft(F.col("file").cast("long"), 55) + F.col("line")).alias("pos"), "code", "label", "language")


def source_agent(rows: DataFrame) -> DataFrame:
    return rows.select("pos", "code", F.col("label").alias("cls"), canonical(F.col("language")).alias("language"))


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"source_a": source_a, "source_b": source_b, "agent_commits": source_agent}


def union_sources(named: Sequence[tuple[str, DataFrame]], split: str) -> DataFrame:
    """Adapted rows of sources in their configured order."""
    out = None
    for order, (name, rows) in enumerate(named):
        part = _shape(rows, name, order, split)
        out = part if out is None else out.unionByName(part)
    return out


def select_repos(index: DataFrame, settings: dict[str, int], max_repos: int | None = None) -> DataFrame:
    """index(repo, github_url, language, agent_attributed_commits) to repositories
    with enough signed commits for their language, the most active first."""
    from ..operators.sampling import first_n

    least = F.create_map(*[F.lit(x) for pair in settings.items() for x in pair])
    kept = index.where(F.col("agent_attributed_commits") >= F.try_element_at(least, F.col("language")))
    return kept if max_repos is None else first_n(kept, ["language"], [F.col("agent_attributed_commits").desc(), "repo"], max_repos)
