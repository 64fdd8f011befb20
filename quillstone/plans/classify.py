"""Commits to verdicts: diff, files, scores, aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_NAMES, MAX_FILES_SCORED
from ..operators import diff, scoring
from ..scratch import materialize

Scorer = Callable[[DataFrame], DataFrame]


def changed_files(diffs: DataFrame, key: str = "sha") -> DataFrame:
    """diffs(<key>, diff) to scorable files: <key>, file_no, path, language, changed, text."""
    files = diff.post_images(diff.diff_lines(diffs, key), key)
    return scoring.scorable(files.where("path is not null")).select(key, "file_no", "path", "language", "changed", "text")


def classify(diffs: DataFrame, score: Scorer, names: Sequence[str] = tuple(CLASS_NAMES), cap: int = MAX_FILES_SCORED, key: str = "sha") -> tuple[DataFrame, DataFrame]:
    """(files, commits). Files over the cap, by changed lines, aren't scored; score
    adds p_<class> to rows(code, language). Commits without a scorable file aren't
    in the second table. commits: <key>, aggregate p_<class>, predicted, languages
    (class by language), n_over. Scored files are written once, as each of the
    aggregates reads them."""
    files = scoring.top_files(changed_files(diffs, key), [F.col("changed").desc(), "file_no"], cap, key)
    files = materialize(score(files.withColumnRenamed("text", "code")).withColumnRenamed("changed", "lines_changed"), "files")
    whole = scoring.aggregate_commits(files, names, (key,))
    each = scoring.aggregate_commits(files, names, (key, "language")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("language", "predicted"))).alias("languages"))
    over = files.groupBy(key).agg(F.max("n_over").alias("n_over"))
    return files, whole.join(each, key).join(over, key)
