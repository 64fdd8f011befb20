"""Mixing documents to target weights with soft domain membership.

A naive Bayes classifier over hashed words, fitted on a bounded sample of a
labelled table, gives each document a posterior over domains. Documents then get
nonnegative rates, the expected numbers of their uses, such that the expected
tokens of each domain match the targets in the sense of least squares, by
projected gradient: w <- max(floor, w - p . y) with y = M^-1 (A w - T), where A w
are the expected domain tokens, T the targets and M the tokens' second moments
of the posteriors. An iteration is one pass that returns A w. The only state
between passes is the list of steps y, from which any task finds its rates
again, so a lost executor costs a task and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import collect_sample
from .common import Texts, Words, materialize, mix64, pieces, releasing
from .language_id import sampled_text

BUCKETS = 1 << 15
#: The fit reads at most so many documents a domain, short ones first; of a
#: document with more than FIT_BYTES characters, a run of that length at a hashed place.
FIT_DOCS = 256
FIT_BYTES = 8192
#: The domains that are told apart, those with the most documents.
DOMAINS = 64
#: A posterior weighs at most this many words: beyond, membership stays soft.
EVIDENCE = 16
TEMPERATURE = 0.7
ITERATIONS = 25
#: Rows of a batch of repeated documents.
REPEATED_ROWS = 512
TOLERANCE = 1e-6


@dataclass
class Model:
    domains: list[str]
    prior: np.ndarray
    table: np.ndarray  # log likelihood by word bucket and domain


@dataclass
class Mix:
    model: Model
    floor: float
    targets: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)
    totals: np.ndarray | None = None


def fit_classifier(samples: list[tuple[str, str]]) -> Model:
    domains = sorted({d for d, _ in samples})
    words = Words(Texts(pa.array([t for _, t in samples], pa.string())))
    counts = np.full((BUCKETS, len(domains)), 0.1)
    for i, (domain, _) in enumerate(samples):
        at = (words.hash[words.lo[i] : words.hi[i]] % np.uint64(BUCKETS)).astype(np.int64)
        counts[:, domains.index(domain)] += np.bincount(at, minlength=BUCKETS)
    share = np.array([sum(d == x for d, _ in samples) for x in domains], float)
    return Model(domains, np.log(share / share.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def posteriors(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its posterior; texts without words have the prior.
    Long texts are read in pieces."""
    n = np.zeros(len(column), np.int64)
    total = np.zeros((len(column), len(model.domains)))
    for a, b, texts, _ in pieces(column, words=0):
        words = Words(texts)
        count = (words.hi - words.lo).astype(np.int64)
        n[a:b] += count
        full = np.flatnonzero(count)
        if len(full):
            each = np.take(model.table, (words.hash % np.uint64(BUCKETS)).astype(np.int64), axis=0)
            total[a + full] += np.add.reduceat(each, words.lo[full], axis=0, dtype=np.float64)
    logit = model.prior + total * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
    p = np.exp(logit - logit.max(axis=1, keepdims=True))
    return n, p / p.sum(axis=1, keepdims=True)


def rates(mix: Mix, p: np.ndarray) -> np.ndarray:
    w = np.maximum(mix.floor, np.ones(len(p)))
    for y in mix.steps:
        w = np.maximum(mix.floor, w - p @ y)
    return w


def training_sample(docs: DataFrame, domain: str) -> list[tuple[str, str]]:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(domain).cast("string").alias("domain")).where(F.octet_length("text") > 0)
    key = F.xxhash64("doc_id", "text")
    rows = rows.select("domain", key.alias("hash"), (F.length("text") > FIT_BYTES).alias("long"), sampled_text(F.col("text"), key, FIT_BYTES).alias("text"))
    return [(r["domain"], r["text"]) for r in collect_sample(rows, "domain", FIT_DOCS, F.col("hash"), F.col("long"), DOMAINS)]


def fit_mix(table: DataFrame, model: Model, weights: dict[str, float] | None, floor: float, total_tokens: float | None) -> Mix:
    """table(n, p): tokens and posteriors of all documents. weights: targets by
    domain, in proportion; by default the natural shares to the power TEMPERATURE.
    total_tokens: of the mix; by default as many as there are, or with a floor as
    many as let every domain reach its target."""
    k = len(model.domains)
    mix = Mix(model, floor, np.zeros(k))

    def sums(with_moments: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + k * k)
            for batch in batches:
                n = np.asarray(batch.column(0)).astype(float)
                p = np.asarray(batch.column(1).flatten()).reshape(-1, k)
                out[:k] += (n * rates(mix, p)) @ p
                if with_moments:
                    out[k:] += ((n[:, None] * p).T @ p).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["cell", "value"])

        rows = table.select("n", "p").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        found = np.zeros(k + k * k)
        for r in rows:
            found[r["cell"]] = r["value"]
        return found

    first = sums(True)
    natural, moments = first[:k], first[k:].reshape(k, k)
    share = natural**TEMPERATURE if weights is None else np.array([float(weights.get(d, 0)) for d in model.domains])
    share = share / share.sum() if share.sum() else np.full(k, 1 / k)
    if total_tokens is None:
        ratio = [natural[i] / share[i] for i in range(k) if share[i]]
        total_tokens = max([natural.sum(), *ratio]) if floor >= 1 else natural.sum()
    mix.targets = share * total_tokens
    inverse = np.linalg.pinv(moments, rcond=1e-10, hermitian=True)
    best = None
    for _ in range(ITERATIONS):
        mix.totals = (first if not mix.steps else sums(False))[:k]
        gap = np.abs(mix.totals - mix.targets).sum() / max(mix.targets.sum(), 1)
        if gap < TOLERANCE or best is not None and gap > best * 0.999:
            break
        best = gap
        mix.steps.append(inverse @ (mix.totals - mix.targets))
    return mix


def _learn(docs: DataFrame, domain: str, weights, floor: float, total_tokens) -> tuple[Mix | None, DataFrame]:
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = training_sample(docs, domain)
    if not sample:
        return None, given
    model = fit_classifier(sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = posteriors(shared.value, batch.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), flat], ["doc_id", "n", "p"])

    table = materialize(given.mapInArrow(releasing(run), "doc_id long, n long, p array<double>"), "posteriors")
    return fit_mix(table, model, weights, floor, total_tokens), table


def document_rates(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, floor: float = 0.0, total_tokens: float | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, <domain>): doc_id, n_tokens, domains
    (the names), posterior (by domain), rate, targets (tokens by domain).

    Null and empty texts have no tokens and the prior as posterior. Rows without a
    domain are not learnt from, but get rates. Without any labelled row all rates
    are max(1, floor), without domains. Rows stand for themselves; an empty table
    gives no rows. Extra columns are ignored.
    """
    mix, table = _learn(docs, domain, weights, floor, total_tokens)
    if mix is None:
        none = F.array().cast("array<double>")
        return table.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<string>").alias("domains"), none.alias("posterior"), F.lit(max(1.0, floor)).alias("rate"), none.alias("targets"))
    k = len(mix.model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(2).flatten()).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(mix, p))], ["doc_id", "n_tokens", "posterior", "rate"])

    out = table.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>, rate double")
    names, targets = F.array(*map(F.lit, mix.model.domains)), F.array(*[F.lit(float(t)) for t in mix.targets])
    return out.select("doc_id", "n_tokens", names.alias("domains"), "posterior", "rate", targets.alias("targets"))


def mixed(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, floor: float = 1.0, total_tokens: float | None = None) -> DataFrame:
    """docs with each row as often as its rate says: the whole part, and once more
    if a hash of its id and length in words falls below the rest. With a floor of
    one, every document stays, and targets are met by repeating. Null and empty
    texts have no tokens and the prior as posterior; a null id counts as 0; rows
    stand for themselves, so repeated rows are repeated alike. An empty table gives
    no rows, and without any labelled row docs stays as it is."""
    mix, _ = _learn(docs, domain, weights, floor, total_tokens)
    if mix is None:
        return docs
    names = docs.columns
    text_at, id_at = names.index("text"), names.index("doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(mix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = posteriors(shared.value.model, batch.column(text_at))
            w = rates(shared.value, p)
            ids = np.asarray(batch.column(id_at).cast(pa.int64()).fill_null(0)).view(np.uint64)
            chance = (mix64(ids + n.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / 2.0**53
            times = np.floor(w).astype(np.int64) + (chance < w - np.floor(w))
            again = np.repeat(np.arange(len(times)), times)
            for k in range(0, len(again), REPEATED_ROWS):
                yield batch.take(pa.array(again[k : k + REPEATED_ROWS]))

    return docs.mapInArrow(releasing(run), docs.schema)
