"""Repositories of known authorship: sampled commits, metrics, pairs, a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASS_NAMES
from ..operators import metrics, sampling
from ..sources import git
from .classify import Scorer, classify

RESULTS = "timestamp double, name string, expected_class string, n long, accuracy double, mean_p_expected double"


def expected_class(cls: str, names: Sequence[str], mapping: dict[str, str]) -> str:
    found = mapping.get(cls, cls)
    if found not in names:
        raise ValueError(f"expected class {cls!r} is none of {list(names)}")
    return found


def evaluate(spark: SparkSession, repo: str, expected: str, score: Scorer, samples: int = 50, names: Sequence[str] = tuple(CLASS_NAMES), mapping: dict[str, str] | None = None, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, metrics, by language) of evenly spaced commits, newest first."""
    cls = expected_class(expected, names, mapping or {})
    log = git.git_log(spark, [repo], since, until).withColumn("__newest", -F.col("pos"))
    shown = git.git_show(sampling.evenly_spaced(log, ["__newest"], samples).select("repo", "sha"))
    files, commits = classify(shown.where("error is null"), score, names)
    commits = commits.withColumn("repo", F.lit(repo))
    from ..operators.scoring import aggregate_commits

    each = aggregate_commits(files, names, ("sha", "language"))
    return commits, metrics.known_repo_metrics(commits, F.lit(cls), names), metrics.known_repo_metrics(each, F.lit(cls), names, ["language"])


def log_result(results: DataFrame, name: str, expected: str, path: str) -> None:
    """Appends the logged columns of evaluate()'s metrics."""
    row = results.select(F.unix_micros(F.current_timestamp()).cast("double").alias("t"), "n", "accuracy", "mean_p_expected")
    row.select((F.col("t") / 1e6).alias("timestamp"), F.lit(name).alias("name"), F.lit(expected).alias("expected_class"), "n", "accuracy", "mean_p_expected").write.mode("append").json(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest result of each repository, with its band."""
    rows = metrics.latest_runs(spark.read.schema(RESULTS).json(path), "name", ["timestamp"])
    return rows.withColumn("band", metrics.accuracy_band(F.col("accuracy")))


