"""Prepared rows to a trained head: embed, join by content, train, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_NAMES
from ..ml import embed, mlp
from ..operators import metrics
from .classify import Scorer


def training_arrays(rows: DataFrame, vectors: DataFrame, representation: str, limit: int = 200_000, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of rows(code, label), at most `limit` in a seeded order:
    training is on the driver, so its input is bounded. A row without a vector is
    an error."""
    keyed = rows.select(embed.content_key(F.col("code")).alias("content_hash"), "label")
    own = vectors.where(F.col("representation") == representation).select("content_hash", "embedding")
    joined = keyed.join(own, "content_hash", "left").orderBy(F.xxhash64("content_hash", F.lit(seed)), "content_hash").limit(limit).collect()
    if any(r["embedding"] is None for r in joined):
        raise ValueError("rows without a vector: embed them first")
    return np.array([r["embedding"] for r in joined], np.float64), np.array([r["label"] for r in joined], int)


def trained_languages(rows: DataFrame) -> list[str] | None:
    """The languages of the training rows; none if any row's is unknown."""
    found = [r[0] for r in rows.select("language").distinct().collect()]
    return None if None in found else sorted(found)


def train(train_rows: DataFrame, val_rows: DataFrame, vectors: DataFrame, representation: str = "hashed-256", names: Sequence[str] = tuple(CLASS_NAMES), **options) -> mlp.Head:
    x, y = training_arrays(train_rows, vectors, representation)
    if len(y) and (y.min() < 0 or y.max() >= len(names)):
        raise ValueError("labels outside the classes")
    return mlp.train(x, y, *training_arrays(val_rows, vectors, representation), names, representation=representation, **options)


def predictions(rows: DataFrame, vectors: DataFrame, head: mlp.Head) -> DataFrame:
    """rows(code, label, language) with y_true, y_pred and p_<class>."""
    own = vectors.where(F.col("representation") == head.representation).select("content_hash", "embedding")
    joined = rows.withColumn("content_hash", embed.content_key(F.col("code"))).join(own, "content_hash")
    p = F.array(*["p_" + n for n in head.class_names])
    return mlp.score(joined, head).withColumn("y_true", F.col("label").cast("int")).withColumn("y_pred", (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def evaluate(predicted: DataFrame, names: Sequence[str] = tuple(CLASS_NAMES)) -> dict[str, DataFrame]:
    labels = list(range(len(names)))
    out = {"report": metrics.class_report(predicted, labels), "summary": metrics.summary(predicted, labels, present_only=True), "confusion": metrics.confusion(predicted, labels), "languages": metrics.language_report(predicted.where("language is not null"), labels)}
    if len(names) == 2:
        out["auc"] = metrics.auc_table(predicted.select(F.col("y_true").alias("label"), F.col("p_" + names[1]).alias("score"), "language"), "language")
    return out


def scorer(head: mlp.Head, embed_factory: Callable = embed.hashed_embedder) -> Scorer:
    """A scorer of rows(code) that embeds and scores in one pass."""
    def score(rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(head)

        def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = embed_factory()
            for codes in parts:
                found = shared.value.probabilities(embed.with_fallback(own, codes.tolist())) if len(codes) else []
                yield pd.Series(list(found), dtype=object)

        apply.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        apply = F.pandas_udf(apply, "array<double>")
        out = rows.withColumn("__p", apply(F.col("code")))
        return out.withColumns({"p_" + n: F.element_at("__p", i + 1) for i, n in enumerate(head.class_names)}).drop("__p")

    return score

