"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes long is counted on a
bounded sample and frozen. A byte's probability comes from the longest known
context; a context that has not seen the byte pays its escape probability
(method C) and hands over to the next shorter one, with the bytes it has seen
excluded. Below order zero all 256 bytes are equal. A text's code length in a
language is the sum over all of its bytes; the shortest wins.

Statistics are sparse: sorted arrays of the contexts and of the (context, byte)
pairs that occur. What a shorter context has left once the longer one's bytes
are excluded is a constant of the longer one and kept with it, so a code length
takes two binary searches an order. A piece of text looks up each of its distinct
runs of ORDER + 1 bytes once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import collect_sample
from .common import _FOLD, Texts, pieces

ORDER = 3
#: The fit reads at most this many documents a language, short ones first; of a
#: document with more than FIT_BYTES characters, a run of that length at a hashed place.
FIT_DOCS = 256
FIT_BYTES = 8192
#: The languages learnt, those with the most documents; others aren't predicted.
LANGUAGES = 64
UNDETERMINED = "und"
BASE = 257
START = 256  # stands before a text's start


@dataclass
class Level:
    """Contexts of one order."""

    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    left_total: np.ndarray  # of the next shorter context, without the bytes seen here
    left_kinds: np.ndarray
    pairs: np.ndarray  # context * BASE + byte
    counts: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[list[Level]]  # by language, then order


def runs(texts: Texts, lead: int = 0) -> np.ndarray:
    """For each byte the number of the ORDER symbols before it and itself. The
    first lead bytes only stand before others."""
    data = _FOLD[texts.data].astype(np.int64)
    size = texts.ends - texts.starts
    place = np.arange(len(data)) - np.repeat(texts.starts[size > 0], size[size > 0])
    out = np.zeros(len(data), np.int64)
    for j in range(ORDER, -1, -1):
        symbol = np.full(len(data), START)
        symbol[j:] = data[: len(data) - j]
        symbol[place < j] = START
        out = out * BASE + symbol
    return out[lead:]


def _level(codes: np.ndarray, counts: np.ndarray, shorter: Level | None, span: int) -> Level:
    contexts, at = np.unique(codes // BASE, return_index=True)
    total, kinds = np.add.reduceat(counts, at), np.diff(np.append(at, len(codes)))
    left_total = left_kinds = np.zeros(len(contexts), np.int64)
    if shorter is not None:
        same = shorter.counts[np.searchsorted(shorter.pairs, codes % (span // BASE))]
        own = np.searchsorted(shorter.contexts, contexts % (span // BASE**2))
        left_total = shorter.total[own] - np.add.reduceat(same, at)
        left_kinds = shorter.kinds[own] - kinds
    return Level(contexts, total, kinds, left_total, left_kinds, codes, counts)


def fit(samples: list[tuple[str, bytes]]) -> Model:
    languages = sorted({lang for lang, _ in samples})
    levels = []
    for lang in languages:
        texts = Texts(pa.array([t for x, t in samples if x == lang], pa.binary()))
        codes, counts = np.unique(runs(texts), return_counts=True)
        own: list[Level] = []
        for order in range(ORDER + 1):
            span = BASE ** (order + 1)
            pairs, at = np.unique(codes % span, return_inverse=True)
            own.append(_level(pairs, np.bincount(at, counts, len(pairs)).astype(np.int64), own[-1] if own else None, span))
        levels.append(own)
    return Model(languages, levels)


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _bits(levels: list[Level], codes: np.ndarray) -> np.ndarray:
    """Code lengths of the last bytes of runs."""
    bits = np.zeros(len(codes))
    left = np.ones(len(codes), bool)
    longer = np.zeros(len(codes), bool)
    total = kinds = np.zeros(len(codes), np.int64)
    for order in range(ORDER, -1, -1):
        level = levels[order]
        pair = codes % BASE ** (order + 1)
        at, known = _find(level.contexts, pair // BASE)
        total = np.where(longer, total, np.where(known, level.total[at], 0))
        kinds = np.where(longer, kinds, level.kinds[at])
        one, seen = _find(level.pairs, pair)
        live = left & (total > 0)
        hit = live & seen
        miss = live & ~seen
        bits[hit] += np.log2((total + kinds)[hit] / level.counts[one[hit]])
        bits[miss] += np.log2((total + kinds)[miss] / kinds[miss])
        left &= ~hit
        total, kinds, longer = level.left_total[at], level.left_kinds[at], known
    bits[left] += np.log2(max(256 - len(levels[0].pairs), 1))
    return bits


def code_lengths(model: Model, texts: Texts, lead: int = 0) -> np.ndarray:
    """Bits of each text in each language."""
    size = texts.ends - texts.starts - lead
    out = np.zeros((len(texts), len(model.languages)))
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    which, codes = pd.factorize(runs(texts, lead))
    for k, levels in enumerate(model.levels):
        out[full, k] = np.add.reduceat(_bits(levels, codes)[which], texts.starts[full])
    return out


def sampled_text(text: Column, key: Column, most: int) -> Column:
    """A text of at most `most` characters: all of a shorter one, else a run at a
    place that the key gives."""
    n = F.length(text)
    return F.when(n <= most, text).otherwise(F.substring(text, (1 + F.pmod(key, n - most)).cast("int"), F.lit(most)))


def training_sample(docs: DataFrame, usable: Column, docs_per_language: int = FIT_DOCS) -> list[tuple[str, bytes]]:
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(usable & (F.octet_length("text") > 0))
    key = F.xxhash64("doc_id", "text")
    rows = rows.select("lang", key.alias("hash"), (F.length("text") > FIT_BYTES).alias("long"), sampled_text(F.col("text"), key, FIT_BYTES).alias("text"))
    return [(r["lang"], r["text"].encode()) for r in collect_sample(rows, "lang", docs_per_language, F.col("hash"), F.col("long"), LANGUAGES)]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) to doc_id, lang_pred, score. score is the posterior of
    the predicted language, all being equally likely beforehand; ties go to the
    first in alphabetical order. Null texts, texts without a letter and, without a
    model (nothing to learn from), all texts are `und` with score 0. Texts of any
    length are read in pieces. Rows stand for themselves, so repeated rows and null
    ids do no harm; extra columns are ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(m.languages)))
            for a, b, texts, lead in pieces(batch.column(1), back=ORDER):
                bits[a:b] += code_lengths(m, texts, lead)
            letters = np.asarray(batch.column(2).to_numpy(zero_copy_only=False))
            score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[np.where(letters, bits.argmin(axis=1), -1)], pa.string()), pa.array(np.where(letters, score, 0.0))],
                ["doc_id", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as
    an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def identify_languages(docs: DataFrame) -> DataFrame:
    """identify(), fitted on the rows of docs that have a lang and aren't held
    out (crc32 of doc_id mod 3 is 1), with the column held_out."""
    sample = training_sample(docs, ~held_out(3, 1))
    found = identify(docs, fit(sample) if sample else None)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
