"""Monthly breakdowns of classified commits, and the cache of classified ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def todo(commits: DataFrame, cache: DataFrame, key: str = "sha") -> DataFrame:
    """Commits without a usable cached row: none, an error, or one written before
    languages were recorded."""
    good = cache.where(F.col("error").isNull() & F.col("languages").isNotNull())
    return commits.join(good.select(key).distinct(), key, "left_anti")


def month_axis(rows: DataFrame, month: str = "month") -> DataFrame:
    """All months from the first to the last of rows, YYYY-MM."""
    ends = rows.agg(F.min(month).alias("a"), F.max(month).alias("b")).where("a is not null")
    day = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    steps = F.sequence(day("a"), day("b"), F.expr("interval 1 month"))
    return ends.select(F.explode(steps).alias("day")).select(F.date_format("day", "yyyy-MM").alias(month))


def monthly(rows: DataFrame, names: Sequence[str], language: str | None = None) -> DataFrame:
    """rows(month, predicted, error, languages map) by month: counts by class,
    skipped, errors; months without commits have zeros. An error counts before a
    skip, a skip before a class. For a language, only its class counts, and nothing
    is skipped; the months are those of all rows."""
    if language is None:
        cls = F.when(F.col("error").isNull(), F.col("predicted"))
        errors, skipped = F.count_if(F.col("error").isNotNull()), F.count_if(F.col("error").isNull() & F.col("predicted").isNull())
    else:
        cls = F.when(F.col("error").isNull(), F.try_element_at("languages", F.lit(language)))
        errors = skipped = F.lit(0).cast("long")
    found = rows.groupBy("month").agg(*[F.count_if(cls == n).alias(n) for n in names], skipped.alias("skipped"), errors.alias("errors"))
    columns = [*names, "skipped", "errors"]
    return month_axis(rows).join(found, "month", "left").select("month", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns])


def language_totals(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    each = rows.where("error is null and languages is not null").select(F.explode("languages").alias("language", "cls"))
    return each.groupBy("language").agg(*[F.count_if(F.col("cls") == n).alias(n) for n in names], F.count("*").alias("n_classified"))


def percent(n: Column, d: Column) -> Column:
    """Whole percent, halves up, 0 of nothing."""
    return F.when(d == 0, F.lit(0)).otherwise(F.floor(100 * n / d + 0.5)).cast("int")
