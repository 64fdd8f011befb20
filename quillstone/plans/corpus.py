"""The corpus of agent and human commits: rows by repository, pairs, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CORPUS, CORPUS_LANGUAGES, EXCLUDE_GLOBS
from ..operators import commits, diff, pairing, sampling
from ..sources import git


def candidates(log: DataFrame, since: str, until: str) -> DataFrame:
    """Commits with their label, by the commit date: ai if signed from `since` on;
    human if before `until`, unsigned and not by a bot."""
    agents = commits.detect_agents(F.col("author"), F.col("committer"), F.col("subject"), F.col("body"))
    marked = log.withColumn("agents", agents).withColumn("mode", commits.mode(F.col("author"), F.col("agents")))
    signed = F.size("agents") > 0
    ai = signed & (F.to_timestamp("committed") >= F.to_timestamp(F.lit(since)))
    human = ~signed & ~commits.is_excluded_bot(F.col("author"), F.col("committer")) & (F.to_timestamp("committed") < F.to_timestamp(F.lit(until)))
    return marked.withColumn("label", F.when(ai, "ai").when(human, "human")).where("label is not null")


def file_rows(labelled: DataFrame, language: str, settings: dict | None = None) -> DataFrame:
    """The changed files of commits(repo, sha, paths, ...) that are wanted, largest
    first, a few a commit. Paths are tested before any diff is read."""
    s = commits.language_settings({**CORPUS, "exclude": EXCLUDE_GLOBS}, {**CORPUS_LANGUAGES[language], **(settings or {})})
    wanted = F.filter("paths", lambda p: commits.wanted_path(p, s["extensions"], s["exclude"]))
    todo = labelled.withColumn("paths", wanted).where(F.size("paths") > 0)
    shown = git.git_show(todo, renames=False).where("error is null").withColumn("key", F.concat_ws("\x1f", "repo", "sha"))
    files = diff.post_images(diff.diff_lines(shown, "key"), "key")
    fine = ~F.col("is_removed") & ~F.col("is_binary") & (F.col("changed") >= s["min_changed_lines"]) & F.col("text").rlike(r"\S")
    files = files.where(fine & commits.wanted_path(F.col("path"), s["extensions"], s["exclude"]))
    files = sampling.first_n(files, ["key"], [F.col("changed").desc(), "file_no"], s["max_files_per_commit"])
    files = files.select(F.split("key", "\x1f")[0].alias("repo"), F.split("key", "\x1f")[1].alias("sha"), "file_no", "path", F.col("text").alias("code"), F.col("changed").alias("lines_changed"), F.col("is_added").alias("added"))
    rows = files.join(todo.select("repo", "sha", "date", "agents", "mode", "label"), ["repo", "sha"])
    return rows.withColumn("language", F.lit(language)).withColumn("react", commits.is_react(F.col("path"), F.col("language"), F.col("code")))


def repo_pairs(rows: DataFrame, limit: int = CORPUS["rows_per_class_per_repo"], pool: int = CORPUS["human_pool_factor"], seed: int = 0) -> DataFrame:
    """Equal numbers of AI and human rows of each repo, paired by size: rows with
    pair_rank. A repo with one side empty has none."""
    order = Window.partitionBy("repo", "label").orderBy(sampling.seeded(seed, F.col("sha")), "sha", "file_no")
    placed = rows.withColumn("id", F.concat_ws("\x1f", "sha", "file_no")).withColumn("pos", F.row_number().over(order).cast("long") - 1)
    ai, human = pairing.pools(placed, limit, pool)
    pairs = pairing.size_matched_pairs(ai, human, limit=limit * pool)
    both = pairs.select("repo", "pair_rank", F.explode(F.array(F.struct(F.lit("ai").alias("label"), F.col("ai_id").alias("id")), F.struct(F.lit("human").alias("label"), F.col("human_id").alias("id")))).alias("x"))
    return placed.join(both.select("repo", "pair_rank", "x.label", "x.id"), ["repo", "label", "id"]).drop("pos", "id")


def write_splits(rows: DataFrame, path: str, max_share: float = CORPUS["max_repo_share"], percent: dict | None = None) -> DataFrame:
    """Caps each repo's share of its language, splits by repo, writes split by
    split, and returns the summary."""
    percent = percent or CORPUS["split_percent"]
    sizes = rows.where("label = 'ai'").groupBy("language", "repo").agg(F.count("*").alias("n"))
    groups = F.count("*").over(Window.partitionBy("language")).cast("double")
    keeps = sampling.share_caps(sizes.withColumn("share", sampling.language_share(groups, max_share)), F.col("share"), ["language"])
    kept = rows.join(keeps.select("language", "repo", "keep"), ["language", "repo"]).where(F.col("pair_rank") <= F.col("keep")).drop("keep")
    kept = kept.withColumn("split", sampling.split_of(F.col("repo"), percent["validation"], percent["test"]))
    kept.write.mode("overwrite").partitionBy("split").parquet(path)
    return summary(rows.sparkSession.read.parquet(path))


def summary(rows: DataFrame) -> DataFrame:
    """By split, and by split and language (null: all): repos, human, ai, react."""
    grouped = rows.groupingSets([["split"], ["split", "language"]], "split", "language")
    return grouped.agg(F.countDistinct("repo").alias("repos"), F.count_if(F.col("label") == "human").alias("human"), F.count_if(F.col("label") == "ai").alias("ai"), F.count_if("react").alias("react"))
