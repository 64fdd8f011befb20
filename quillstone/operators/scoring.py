"""From file scores to commit verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_FILES_SCORED, SUPPORTED_EXTENSIONS
from .commits import suffix


def argmax_class(probabilities: Sequence[Column], names: Sequence[str]) -> Column:
    """The class of the largest probability, on ties the first in class order."""
    p = F.array(*probabilities)
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(p, F.array_max(p)).cast("int"))


def weighted_mean(weight: Column, names: Sequence[str], prefix: str = "p_") -> list[Column]:
    return [(F.sum(weight * F.col(prefix + n)) / F.sum(weight)).alias(prefix + n) for n in names]


def aggregate_commits(files: DataFrame, names: Sequence[str], by: Sequence[str] = ("commit",), weight: str = "lines_changed") -> DataFrame:
    """files(<by>, lines_changed, p_<class>...) to their line-weighted means and
    the predicted class."""
    out = files.groupBy(*by).agg(F.count("*").alias("n_files"), F.sum(weight).alias("lines_changed"), *weighted_mean(F.col(weight), names))
    return out.withColumn("predicted", argmax_class([F.col("p_" + n) for n in names], names))


def top_files(files: DataFrame, order: Sequence[Column | str], n: int = MAX_FILES_SCORED, by: str = "commit") -> DataFrame:
    """The first n files of each commit in the order, with how many were over."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    kept = files.withColumn("rank", rank).where(F.col("rank") <= n)
    over = files.groupBy(by).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n_over"))
    return kept.join(over, by)


def scored_language(path: Column, extensions: dict[str, str] | None = None) -> Column:
    """The language a file is scored as, by its extension; null if it isn't."""
    table = F.create_map(*[F.lit(x) for pair in (extensions or SUPPORTED_EXTENSIONS).items() for x in pair])
    return F.try_element_at(table, suffix(path))


def scorable(files: DataFrame) -> DataFrame:
    """files(path, is_removed, is_binary, changed, text) that can be scored."""
    fine = ~F.col("is_removed") & ~F.col("is_binary") & (F.col("changed") > 0) & F.col("text").rlike(r"\S")
    return files.withColumn("language", scored_language(F.col("path"))).where(fine & F.col("language").isNotNull())
