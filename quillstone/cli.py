"""Command line: python -m quillstone.cli COMMAND ..."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .constants import FEATURES
from .functions.text_features import with_features
from .session import session


def _head(path: str):
    from .ml import mlp

    with open(path, encoding="utf-8") as f:
        return mlp.Head.from_json(f.read())


def _scorer(spark: SparkSession, a, cfg: dict):
    """(scorer, id): the head, and the second stage where --stage2 names one that
    was made for it. The id names both, as results of either may be cached."""
    from .plans import second_stage, train

    head = _head(a.model)
    digest = second_stage.head_digest(head, spark)
    loaded = second_stage.load(spark, a.stage2, cfg["classes"]["names"], digest) if a.stage2 else None
    return second_stage.scorer(train.scorer(head), loaded), digest + ("+" + os.path.basename(a.stage2.rstrip("/")) if loaded else "")


def train_stage2(spark: SparkSession, a, cfg: dict) -> None:
    from .plans import second_stage, train

    head = _head(a.model)
    rows, vectors = spark.read.parquet(a.rows), spark.read.parquet(a.vectors)
    languages = a.languages.split(",") if a.languages else None
    model, _ = second_stage.train(rows.where("split = 'train'"), rows.where("split = 'validation'"), spark.read.parquet(a.corpus), vectors, head)
    second_stage.save(model, a.out, list(FEATURES), languages, second_stage.head_digest(head, spark), spark)
    test = with_features(train.predictions(rows.where("split = 'test'"), vectors, head))
    second_stage.before_and_after(test, model, list(FEATURES), languages).show(100, truncate=False)


def prepare(spark: SparkSession, a, cfg: dict) -> None:
    from .operators import prepare as ops

    rows, d = spark.read.parquet(a.rows), cfg["dataset"]
    for split in ("train", "validation", "test"):
        languages = d.get("languages") or {}
        out = ops.prepare(rows.where(F.col("split") == split), cfg["classes"]["names"], cfg["classes"]["remap"], d["per_class_cap"].get(split), languages.get("include") or (), languages.get("exclude") or (), d["balance_languages"])
        out.write.mode("overwrite").parquet(os.path.join(a.out, f"split={split}"))


def embed(spark: SparkSession, a, cfg: dict) -> None:
    from .ml import embed as ml

    rows = spark.read.parquet(a.rows)
    done = spark.read.parquet(a.out) if os.path.exists(a.out) else None
    todo = rows if done is None else ml.missing(rows, done, a.representation)
    ml.embed_texts(todo, representation=a.representation).write.mode("append").parquet(a.out)


def train(spark: SparkSession, a, cfg: dict) -> None:
    from .plans import train as plan

    rows, vectors = spark.read.parquet(a.rows), spark.read.parquet(a.vectors)
    head = plan.train(rows.where("split = 'train'"), rows.where("split = 'validation'"), vectors, a.representation, cfg["classes"]["names"])
    with open(a.model, "w", encoding="utf-8") as f:
        f.write(head.to_json())
    print(head.history[-1])


def evaluate(spark: SparkSession, a, cfg: dict) -> None:
    from .plans import train as plan

    predicted = plan.predictions(spark.read.parquet(a.rows).where("split = 'test'"), spark.read.parquet(a.vectors), _head(a.model))
    for name, table in plan.evaluate(predicted, cfg["classes"]["names"]).items():
        print(name)
        table.show(truncate=False)


def classify_commit(spark: SparkSession, a, cfg: dict) -> None:
    from .plans import classify
    from .sources import git

    shown = git.git_show(spark.createDataFrame([(a.repo, a.sha)], "repo string, sha string"))
    files, commits = classify.classify(shown, _scorer(spark, a, cfg)[0], cfg["classes"]["names"], cfg["commit_classification"]["max_files_per_commit"])
    files.drop("code").show(100, truncate=False)
    commits.show(truncate=False)


def evaluate_repo(spark: SparkSession, a, cfg: dict) -> None:
    from .plans import known_repos

    score = _scorer(spark, a, cfg)[0]
    repos = cfg["known_repos"] if a.all else [{"name": a.repo, "path": a.repo, "expected_class": a.expected}]
    for r in repos:
        try:  # one failing repository doesn't stop the rest
            _, result, languages = known_repos.evaluate(spark, r["path"], r["expected_class"], score, a.samples, cfg["classes"]["names"], cfg["classes"]["remap"], r.get("since"), r.get("until"))
            result.show(truncate=False)
            languages.show(truncate=False)
            known_repos.log_result(result, r["name"], r["expected_class"], a.log)
        except Exception as e:
            print(f"{r['name']}: {e}")


def report(spark: SparkSession, a, cfg: dict) -> None:
    from .plans import report as plan

    names = cfg["classes"]["names"]
    score, digest = _scorer(spark, a, cfg)
    rows = plan.update(spark, a.repo, a.cache, digest, score, names, a.max_commits, a.since, a.until)
    data = plan.report(rows, a.repo, digest, names)
    out = a.out or f"{data['repo']}-authorship-timeline.html"
    with open(out, "w", encoding="utf-8") as f:
        f.write(plan.page(data))
    print(out)


def build_corpus(spark: SparkSession, a, cfg: dict) -> None:
    from .plans import corpus
    from .sources import git

    settings = cfg["agent_commits"]
    log = corpus.candidates(git.git_log(spark, a.repos), settings["ai_since"], settings["human_until"])
    rows = corpus.repo_pairs(corpus.file_rows(log, a.language))
    corpus.write_splits(rows, a.out, settings["max_repo_share"], settings["split_percent"]).show(100, truncate=False)


def audit(spark: SparkSession, a, cfg: dict) -> None:
    from .operators import sampling

    sampling.audit_sample(spark.read.parquet(a.rows), [0, 1, 2, 3], a.n).select("label", "snippet").orderBy("label").show(100, truncate=False)


def monitor(spark: SparkSession, a, cfg: dict) -> None:
    from .plans import known_repos

    known_repos.latest(spark, a.log).show(100, truncate=False)


def query(spark: SparkSession, a, cfg: dict) -> None:
    from .plans import queries

    queries.queries()[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)


COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {
    "prepare": (prepare, [("rows", {}), ("out", {})]),
    "embed": (embed, [("rows", {}), ("out", {}), ("--representation", {"default": "hashed-256"})]),
    "train": (train, [("rows", {}), ("vectors", {}), ("model", {}), ("--representation", {"default": "hashed-256"})]),
    "evaluate": (evaluate, [("rows", {}), ("vectors", {}), ("model", {})]),
    "train-stage2": (train_stage2, [("rows", {}), ("vectors", {}), ("corpus", {}), ("model", {}), ("out", {}), ("--languages", {})]),
    "classify-commit": (classify_commit, [("repo", {}), ("sha", {}), ("--model", {"required": True}), ("--stage2", {})]),
    "evaluate-repo": (evaluate_repo, [("--repo", {}), ("--expected", {}), ("--all", {"action": "store_true"}), ("--samples", {"type": int, "default": 50}), ("--model", {"required": True}), ("--stage2", {}), ("--log", {"default": "known_repo_results"})]),
    "report": (report, [("repo", {}), ("--model", {"required": True}), ("--stage2", {}), ("--cache", {"default": "timeline_cache"}), ("--out", {}), ("--max-commits", {"type": int}), ("--since", {}), ("--until", {})]),
    "build-corpus": (build_corpus, [("language", {}), ("out", {}), ("repos", {"nargs": "+"})]),
    "audit": (audit, [("rows", {}), ("--n", {"type": int, "default": 15})]),
    "monitor": (monitor, [("--log", {"default": "known_repo_results"})]),
    "query": (query, [("name", {}), ("tables", {}), ("out", {})]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillstone")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        sub = commands.add_parser(name)
        for flag, options in arguments:
            sub.add_argument(flag, **options)
    args = parser.parse_args(argv)
    COMMANDS[args.command][0](spark or session(), args, config.load(args.config))


if __name__ == "__main__":
    main()
