"""Toxicity scores from a convolutional text classifier, trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its
first STEM bytes. Filters one, two and three words wide slide over the text;
each keeps its largest response; a logistic layer scores these. Training reads a
bounded sample of four fifths of the labelled documents. Decision thresholds are
calibrated for each language on the scores of the other fifth, all of it; the
language itself never enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.sampling import collect_sample
from .common import Texts, Words, discard, materialize, pieces, releasing, small_table
from .language_id import held_out, sampled_text

BUCKETS = 1 << 15
STEM = 4
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Training reads at most so many documents of each label, short ones first; of a
#: document with more than FIT_BYTES characters, a run of that length at a hashed place.
FIT_DOCS = 2000
FIT_BYTES = 8192
#: One labelled document in so many is kept from training, for the thresholds.
CALIBRATION_SHARE = 5
EPOCHS, BATCH, RATE = 6, 32, 0.08
PREDICT_AT = 0.3
BINS = 1000
#: A language with fewer labelled toxic documents for calibration takes the pooled
#: threshold, as do all but the LANGUAGES with the most of them.
LEAST_POSITIVE = 20
LANGUAGES = 64


@dataclass
class Model:
    tables: list[np.ndarray]  # for words and for stems: responses of all filters at all offsets
    bias: np.ndarray
    out: np.ndarray
    base: float


def _indices(texts: Texts) -> tuple[np.ndarray, np.ndarray, Words]:
    words = Words(texts, prefix=STEM)
    return (words.hash % np.uint64(BUCKETS)).astype(np.int32), (words.stem % np.uint64(BUCKETS)).astype(np.int32) + BUCKETS, words


def fit(samples: list[tuple[str, int]], prior: float = 0.5, seed: int = 5) -> Model:
    """samples: (text, 0 or 1). Both labels weigh the same in training; scores are
    then moved to the prior, the share of 1 among all labels."""
    rng = np.random.default_rng(seed)
    one, two, words = _indices(Texts(pa.array([t for t, _ in samples], pa.string())))
    y = np.array([label for _, label in samples], np.float64)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    emb = rng.normal(0, 0.1, (2 * BUCKETS, DIMENSIONS))
    conv = [rng.normal(0, (2 / (w * DIMENSIONS)) ** 0.5, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    bias = [np.zeros(FILTERS) for _ in WIDTHS]
    out, base = rng.normal(0, 0.3, len(WIDTHS) * FILTERS), np.zeros(1)
    params = [emb, *conv, *bias, out, base]
    squares = [np.full(p.shape[0] if p is emb else p.shape, 1e-4) for p in params]

    def step(i: int, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            squares[i] += grad**2
            params[i] -= RATE * grad / np.sqrt(squares[i])
        else:
            squares[i][rows] += (grad**2).mean(axis=1)
            params[i][rows] -= RATE * grad / np.sqrt(squares[i][rows])[:, None]

    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            spans = [np.arange(words.lo[d], words.hi[d]) for d in docs]
            ends = np.cumsum([len(s) for s in spans])
            pick = np.concatenate(spans)
            a, b = one[pick], two[pick]
            x = emb[a] + emb[b]
            pooled, places = np.zeros((len(docs), len(WIDTHS), FILTERS)), np.zeros((len(docs), len(WIDTHS), FILTERS), np.int64)
            for k, w in enumerate(WIDTHS):
                if len(x) < w:
                    continue
                u = sum(x[j : len(x) - w + 1 + j] @ conv[k][j] for j in range(w)) + bias[k]
                for d, end in enumerate(ends):
                    lo, hi = end - len(spans[d]), end - w + 1
                    if hi > lo:
                        places[d, k] = lo + u[lo:hi].argmax(axis=0)
                        pooled[d, k] = np.maximum(0, u[lo:hi].max(axis=0))
            logit = pooled.reshape(len(docs), -1) @ out + base
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[docs]) * weight[docs] / len(docs)
            back = (err[:, None] * out).reshape(pooled.shape) * (pooled > 0)
            dx = np.zeros_like(x)
            for k, w in enumerate(WIDTHS):
                dconv = np.zeros_like(conv[k])
                for j in range(w):
                    hit = np.minimum(places[:, k] + j, max(len(x) - 1, 0))
                    if not len(x):
                        break
                    dconv[j] = np.einsum("bf,bfd->df", back[:, k], x[hit])
                    np.add.at(dx, hit, back[:, k][..., None] * conv[k][j].T[None])
                step(1 + k, dconv)
                step(1 + len(WIDTHS) + k, back[:, k].sum(axis=0))
            step(len(params) - 2, err @ pooled.reshape(len(docs), -1))
            step(len(params) - 1, np.array([err.sum()]))
            moved = np.flatnonzero(np.abs(dx).sum(axis=1))
            for index in (a, b):
                rows, back_to = np.unique(index[moved], return_inverse=True)
                grad = np.zeros((len(rows), DIMENSIONS))
                np.add.at(grad, back_to, dx[moved])
                step(0, grad, rows)
    flat = np.concatenate([conv[k][j] for k, w in enumerate(WIDTHS) for j in range(w)], axis=1)
    table = (emb @ flat).astype(np.float32)
    return Model([table[:BUCKETS], table[BUCKETS:]], np.concatenate(bias).astype(np.float32), out, float(base[0]) + float(np.log(prior / (1 - prior))))


def responses(model: Model, texts: Texts) -> np.ndarray:
    """The largest response of each filter, by text."""
    one, two, words = _indices(texts)
    pooled = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
    if words.n:
        x = model.tables[0][one]
        x += model.tables[1][two - BUCKETS]
        count = words.hi - words.lo
        full = np.flatnonzero(count)
        left = np.repeat(words.hi[full], count[full]) - np.arange(words.n)
        block = 0
        for k, w in enumerate(WIDTHS):
            u = np.zeros((words.n, FILTERS), np.float32)
            n = words.n - w + 1
            if n > 0:
                for j in range(w):
                    u[:n] += x[j : n + j, (block + j) * FILTERS : (block + j + 1) * FILTERS]
                u += model.bias[k * FILTERS : (k + 1) * FILTERS]
                u[left < w] = 0
            pooled[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(0, np.maximum.reduceat(u, words.lo[full], axis=0))
            block += w
    return pooled


def score_column(model: Model, column: pa.Array) -> np.ndarray:
    """Scores of whole texts. A long one is read in pieces that overlap by as many
    words as a filter can reach back; its responses are the largest of theirs."""
    pooled = np.zeros((len(column), len(WIDTHS) * FILTERS), np.float32)
    for a, b, texts, _ in pieces(column, words=max(WIDTHS) - 1):
        pooled[a:b] = np.maximum(pooled[a:b], responses(model, texts))
    return 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.base, -30, 30)))


def _known(labels: DataFrame, usable: Column) -> DataFrame:
    """(doc_id, toxic): null labels and ids don't count, and a document labelled
    twice is toxic if either label says so."""
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def for_calibration() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(29)), F.lit(CALIBRATION_SHARE)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, each: int = FIT_DOCS) -> list[tuple[str, int]]:
    """At most `each` labelled documents of either label, in the order of a hash of
    the id. Some more labels are drawn, as their documents may be missing or empty.
    Repeated rows count once."""
    drawn = collect_sample(_known(labels, usable & ~for_calibration()), "toxic", each + each // 4, F.xxhash64("doc_id"))
    if len({r["toxic"] for r in drawn}) < 2:
        return []
    wanted = small_table(docs.sparkSession, [(r["doc_id"], r["toxic"]) for r in drawn], "__id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    rows = rows.join(F.broadcast(wanted), F.col("doc_id") == F.col("__id"))  # 2.5 * FIT_DOCS rows at most
    key = F.xxhash64("doc_id", "text")
    rows = rows.select("doc_id", "toxic", key.alias("hash"), (F.length("text") > FIT_BYTES).alias("long"), sampled_text(F.col("text"), key, FIT_BYTES).alias("text"))
    return [(r["text"], r["toxic"]) for r in collect_sample(rows, "toxic", each, F.col("hash"), F.col("long"))]


def _scorer(model: Model | None, spark):
    """The function of a batch and the place of its text column that scores it."""
    if model is None:
        return lambda batch, at: np.zeros(batch.num_rows)
    shared = spark.sparkContext.broadcast(model)
    return lambda batch, at: score_column(shared.value, batch.column(at)).astype(np.float64)


def toxicity_scores(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) to doc_id, score (0 to 1), predicted (1 from PREDICT_AT
    on), and the columns named in keep. Null texts count as empty and are scored,
    too. Without a model (no labels of both kinds to learn from) scores are 0.
    Rows stand for themselves; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    score = _scorer(model, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch, 1)), *batch.columns[2:]], ["doc_id", "score", *keep])

    scored = rows.mapInArrow(releasing(run), "doc_id long, score double" + kinds)
    return scored.select("doc_id", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), *keep)


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | None:
    samples = training_sample(docs, labels, usable)
    if len({label for _, label in samples}) < 2:
        return None
    share = labels.where(F.col("toxic").isin(0, 1) & usable).agg(F.avg("toxic")).first()[0]
    return fit(samples, prior=min(max(share, 0.01), 0.99))


def calibrate(scored: DataFrame, labels: DataFrame, usable: Column) -> dict[str | None, float]:
    """Thresholds by language, None for all others: the bin edge with the best F1
    over the scores of labelled documents that the fit didn't see, the middle one
    of equally good neighbours. Reads a count a label and score bin, for each of at
    most LANGUAGES languages."""
    known = _known(labels, usable & for_calibration())
    bins = F.least(F.lit(BINS - 1), F.floor(F.col("score") * BINS)).cast("int")
    counted = materialize(scored.select("doc_id", "lang", bins.alias("bin")).join(known, "doc_id").groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n")), "bins")
    positive = counted.where("toxic = 1 and lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_POSITIVE)
    enough = positive.orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).select("lang")
    pooled = counted.groupBy("toxic", "bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "toxic", "bin", "n")
    tables: dict[str | None, np.ndarray] = {None: np.zeros((2, BINS))}
    for r in counted.join(F.broadcast(enough), "lang").select("lang", "toxic", "bin", "n").union(pooled).collect():
        tables.setdefault(r["lang"], np.zeros((2, BINS)))[r["toxic"], r["bin"]] += r["n"]
    discard(counted)
    found = {}
    for lang, t in tables.items():
        above = t[:, ::-1].cumsum(axis=1)[:, ::-1]
        f1 = 2 * above[1] / np.maximum(above[0] + above[1] + t[1].sum(), 1)
        best = np.flatnonzero(f1 == f1[1:].max())
        best = best[best > 0]
        found[lang] = float(best[len(best) // 2]) / BINS if t[1].sum() else PREDICT_AT
    return found


def judge(scored: DataFrame, thresholds: dict[str | None, float]) -> DataFrame:
    """Adds threshold and toxic (score at or above it) by the language of a row."""
    spark = scored.sparkSession
    rows = [(k, v) for k, v in thresholds.items() if k is not None]
    table = spark.createDataFrame(rows, "lang string, threshold double")  # a row a calibrated language
    out = scored.join(F.broadcast(table), "lang", "left") if rows else scored.withColumn("threshold", F.lit(None).cast("double"))
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(thresholds.get(None, PREDICT_AT))))
    return out.withColumn("toxic", F.col("score") >= F.col("threshold"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents from a model and thresholds that never see the held
    out labels (crc32 of doc_id mod 4 is 2): doc_id, held_out, score, predicted,
    threshold, toxic. Null texts count as empty; rows with a null doc_id are scored
    and never learnt from; repeated rows get equal scores; a score on a threshold
    counts as toxic. An empty table gives no rows."""
    usable = ~held_out(4, 2)
    scored = materialize(toxicity_scores(docs, learn(docs, labels, usable), keep=("lang",)), "scores")
    judged = judge(scored, calibrate(scored, labels, usable))
    return judged.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted", "threshold", "toxic")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches their language's threshold, or
    PREDICT_AT where that is lower. Without labels of both kinds none goes. Null
    texts count as empty; rows stand for themselves, repeated ones alike; an empty
    table gives no rows. Each text is scored once, and written with its score."""
    usable = ~held_out(4, 2)
    model = learn(docs, labels, usable)
    if model is None:
        return docs
    names, at = docs.columns, docs.columns.index("text")
    score = _scorer(model, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(batch, at))], [*names, "__score"])

    scored = materialize(docs.mapInArrow(releasing(run), StructType([*docs.schema.fields, StructField("__score", DoubleType())])), "scored")
    given = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("__score").alias("score"))
    limits = {k: min(v, PREDICT_AT) for k, v in calibrate(given, labels, usable).items()}
    rest = F.lit(limits.pop(None))
    limit = rest
    if limits:
        table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        limit = F.coalesce(F.try_element_at(table, F.col("lang").cast("string")), rest)
    return scored.where(F.col("__score") < limit).drop("__score")
