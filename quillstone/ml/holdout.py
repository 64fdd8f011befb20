"""Leave-one-generator-out evaluation and the language classifier of the census."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mlp


def rank_auc(y: np.ndarray, s: np.ndarray) -> float:
    order = np.argsort(s, kind="stable")
    _, inverse, count = np.unique(s[order], return_inverse=True, return_counts=True)
    ranks = np.empty(len(s))
    ranks[order] = (np.cumsum(count) - (count - 1) / 2)[inverse]
    n1 = int(y.sum())
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


def fit_binary(x: np.ndarray, y: np.ndarray, seed: int) -> mlp.Head:
    """A class-weighted head, validated on a random tenth."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.1
    if held.all() or not held.any():
        held[:] = np.arange(len(y)) % 10 == 0
    weights = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))
    return mlp.train(x[~held], y[~held], x[held], y[held], ["human", "ai"], class_weights=weights, seed=seed)


def holdout_aucs(x: np.ndarray, source: np.ndarray, x_test: np.ndarray, source_test: np.ndarray, seed: int = 42, human: str = "human", fit: Callable = fit_binary) -> list[dict]:
    """For each generator: the AUC on its test rows of a model that has seen it,
    and of one that has not."""
    p_of = lambda head, rows: head.probabilities(rows)[:, 1]
    full = fit(x, (source != human).astype(int), seed)
    out = []
    for g in sorted(set(source) - {human}):
        test = (source_test == g) | (source_test == human)
        if not (source_test == g).any():
            continue
        y = (source_test[test] == g).astype(int)
        without = source != g
        blind = fit(x[without], (source[without] != human).astype(int), seed)
        out.append({"generator": g, "n_test": int(y.sum()), "seen_auc": rank_auc(y, p_of(full, x_test[test])), "unseen_auc": rank_auc(y, p_of(blind, x_test[test]))})
    return out


def language_classifier(rows: DataFrame, buckets: int = 1 << 18, first_chars: int = 3000):
    """rows(code, language) to a fitted pipeline that adds `predicted`: token uni-
    and bigrams, hashed, at unit length, one linear machine a language."""
    steps = Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, substring(code, 1, {first_chars}) AS head FROM __THIS__"),
        RegexTokenizer(gaps=False, toLowercase=False, pattern=r"[A-Za-z_]\w*|[^\w\s]{1,2}", inputCol="head", outputCol="one"),
        NGram(n=2, inputCol="one", outputCol="two"),
        SQLTransformer(statement="SELECT *, concat(one, two) AS grams FROM __THIS__"),
        HashingTF(numFeatures=buckets, inputCol="grams", outputCol="counts"),
        Normalizer(inputCol="counts", outputCol="features"),
    ])
    indexer = StringIndexer(inputCol="language", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    prepared = steps.fit(rows)
    ready = prepared.transform(indexer.transform(rows)).select("features", "label")
    model = OneVsRest(classifier=LinearSVC(regParam=1e-4, maxIter=50)).fit(ready)
    names = F.array(*map(F.lit, indexer.labels))

    def predict(new: DataFrame) -> DataFrame:
        found = model.transform(prepared.transform(new))
        return found.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1)).select(*new.columns, "predicted")

    return predict
