"""The second stage: boosted trees over the head's logit and the text features,
trained on scores out of fold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURES
from . import mlp

LEAST_ROWS = 200


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def group_folds(sizes: dict[str, int], folds: int = 5) -> dict[str, int]:
    """Groups to folds: the largest to the lightest fold, by turns; ties by name."""
    load = [0] * folds
    out = {}
    for name in sorted(sizes, key=lambda g: (-sizes[g], g)):
        k = load.index(min(load))
        out[name] = k
        load[k] += sizes[name]
    return out


def out_of_fold(x: np.ndarray, y: np.ndarray, groups: Sequence[str], x_val: np.ndarray, y_val: np.ndarray, names: Sequence[str], folds: int = 5, **options) -> np.ndarray:
    """P(last class) of each row from a head that saw no row of its group. Each
    head is stopped on the validation rows, which are none of these."""
    size = {g: int((np.asarray(groups) == g).sum()) for g in set(groups)}
    placed = group_folds(size, folds)
    fold = np.array([placed[g] for g in groups])
    out = np.full(len(y), np.nan)
    for k in np.unique(fold):
        seen = fold != k
        if not seen.any():
            raise ValueError("out-of-fold scores need two groups at least")
        head = mlp.train(x[seen], y[seen], x_val, y_val, names, **options)
        out[~seen] = head.probabilities(x[~seen])[:, -1]
    return out


def fit(rows: DataFrame, features: Sequence[str] = tuple(FEATURES), iterations: int = 300, seed: int = 42):
    """rows(label, p_ai, <features>) to a boosted model; a tenth of the rows stops
    it early."""
    if rows.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"the second stage needs {LEAST_ROWS} rows at least")
    laid = rows.withColumn("logit", logit(F.col("p_ai"))).withColumn("held", F.pmod(F.xxhash64("p_ai", *features, F.lit(seed)), F.lit(10)) == 0)
    laid = VectorAssembler(inputCols=["logit", *features], outputCol="features").transform(laid)
    trees = GBTClassifier(maxIter=iterations, stepSize=0.05, maxDepth=4, maxBins=256, validationIndicatorCol="held", seed=seed, labelCol="label")
    return trees.fit(laid)


def apply(rows: DataFrame, model, features: Sequence[str] = tuple(FEATURES), languages: Sequence[str] | None = None) -> DataFrame:
    """rows with p_ai, and p_human with it, replaced by the second stage's, in the
    given languages."""
    laid = VectorAssembler(inputCols=["logit", *features], outputCol="features", handleInvalid="keep").transform(rows.withColumn("logit", logit(F.col("p_ai"))))
    scored = model.transform(laid).withColumn("__p", vector_to_array("probability")[1])
    kept = F.col("__p") if languages is None else F.when(F.col("language").isin(list(languages)), F.col("__p")).otherwise(F.col("p_ai"))
    scored = scored.withColumn("p_ai", kept)
    if "p_human" in rows.columns:
        scored = scored.withColumn("p_human", 1 - F.col("p_ai"))
    return scored.select(*rows.columns)


def active(class_names: Sequence[str], model_digest: str | None, current_digest: str) -> bool:
    """Only for the two default classes, and only with the head it was made for."""
    return list(class_names) == ["human", "ai"] and model_digest == current_digest
