"""The second stage end to end: out-of-fold scores, trees, reports, application."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEATURES
from ..functions.text_features import with_features
from ..ml import embed, mlp, stage2
from ..operators import metrics
from .classify import Scorer

META = "features array<string>, languages array<string>, head string"


def code_repos(corpus: DataFrame) -> DataFrame:
    """corpus(code, repo) to (content_hash, repo): the repository of each code, the
    first by name where several hold it."""
    return corpus.groupBy(embed.content_key(F.col("code")).alias("content_hash")).agg(F.min("repo").alias("repo"))


def head_digest(head: mlp.Head, spark: SparkSession) -> str:
    return spark.range(1).select(F.substring(F.sha2(F.lit(head.to_json()), 256), 1, 12)).first()[0]


def _arrays(rows: DataFrame, vectors: DataFrame, representation: str, limit: int, seed: int) -> list:
    own = vectors.where(F.col("representation") == representation).select("content_hash", "embedding")
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("content_hash", F.lit(seed)), F.lit(1 << 20)) < (1 << 20) * min(1.0, limit / max(n, 1)))
    return sorted(chosen.join(own, "content_hash").collect(), key=lambda r: r["content_hash"])


def train(train_rows: DataFrame, val_rows: DataFrame, corpus: DataFrame, vectors: DataFrame, head: mlp.Head, features: Sequence[str] = tuple(FEATURES), iterations: int = 300, folds: int = 5, limit: int = 100_000, seed: int = 42, **options):
    """(model, scored training rows). Of train_rows(code, label, language) those
    whose code lies in the corpus take part, each with its repository; their scores
    come from heads that saw no row of that repository, stopped on val_rows. Heads
    are fitted on the driver, on about `limit` rows by a hash of the code."""
    keyed = train_rows.select("code", "label", "language").withColumn("content_hash", embed.content_key(F.col("code"))).join(code_repos(corpus), "content_hash").dropDuplicates(["content_hash"])
    got = _arrays(keyed.select("content_hash", "label", "repo"), vectors, head.representation, limit, seed)
    if len(got) < stage2.LEAST_ROWS:
        raise ValueError(f"the second stage needs {stage2.LEAST_ROWS} rows at least")
    val = _arrays(val_rows.withColumn("content_hash", embed.content_key(F.col("code"))).select("content_hash", "label"), vectors, head.representation, limit, seed)
    matrix = lambda rows: (np.array([r["embedding"] for r in rows], np.float64), np.array([r["label"] for r in rows], int))
    p = stage2.out_of_fold(*matrix(got), [r["repo"] for r in got], *matrix(val), head.class_names, folds, **options)
    scores = train_rows.sparkSession.createDataFrame([(r["content_hash"], float(v)) for r, v in zip(got, p, strict=True)], "content_hash string, p_ai double")
    rows = with_features(keyed.join(scores, "content_hash"), features).withColumn("label", F.col("label").cast("double"))
    return stage2.fit(rows, features, iterations, seed), rows


def before_and_after(scored: DataFrame, model, features: Sequence[str], languages: Sequence[str] | None = None) -> DataFrame:
    """language ("all": over everything), n, auc before and after, of rows(label,
    p_ai, language, <features>) that the model wasn't fitted on."""
    found = {}
    for name, rows in (("before", scored), ("after", stage2.apply(scored, model, features, languages))):
        given = rows.select(F.col("label").cast("int").alias("label"), F.col("p_ai").alias("score"), "language")
        found[name] = metrics.auc_table(given, "language").select("language", "n", F.col("auc").alias(name))
    return found["before"].join(found["after"].drop("n"), "language")


def save(model, path: str, features: Sequence[str], languages: Sequence[str] | None, digest: str, spark: SparkSession) -> None:
    """The trees, and beside them what they were made for."""
    model.write().overwrite().save(f"{path}/trees")
    row = [(list(features), list(languages) if languages else None, digest)]
    spark.createDataFrame(row, META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str, class_names: Sequence[str], digest: str):
    """(model, features, languages), or None where the classes aren't the default
    ones or the trees were made for another head."""
    meta = spark.read.schema(META).json(f"{path}/meta").first()
    if not stage2.active(class_names, meta["head"], digest):
        return None
    return GBTClassificationModel.load(f"{path}/trees"), meta["features"], meta["languages"]


def scorer(first: Scorer, loaded) -> Scorer:
    """A scorer that hands the first one's scores through the second stage."""
    if loaded is None:
        return first
    model, features, languages = loaded

    def score(rows: DataFrame) -> DataFrame:
        scored = first(rows)
        return stage2.apply(with_features(scored, features), model, features, languages).select(*scored.columns)

    return score


def report_json(table: DataFrame) -> str:
    """A row a language."""
    return json.dumps([r.asDict() for r in table.orderBy("language").collect()])

