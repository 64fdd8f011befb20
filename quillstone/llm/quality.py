"""Quality classification by the perplexity of an interpolated modified
Kneser-Ney model over word bigrams.

The model counts all pairs of successive words of all trusted text, so it grows with
the corpus. COMMON words, the most frequent of a sample, have numbers; what is known of
them is one array each, and goes to every task. Which words these are only changes the
way, not the result. A pair is placed at the rarer end: at its rare word, or, of
two common words, at a key of its own, and of two rare ones, at both. Keys are dealt to
buckets of bounded size, in which counts meet, packed by bytes; a document's words
meet the counts there, again packed, and nothing else holds a word's pairs together.
So a hot word has no row or task of its own. A score is the sum over words w of f(w), the
continuation log probability, g(v), the log back-off weight of the word before, and what
the pair's own log probability adds to these if the model has the pair. Words are
64-bit hashes; two with equal hashes would share counts. The most frequent pairs of
common words, of counted number, are broadcast. One trusted document in HELD_OUT isn't
counted: a language's upper limit is a quantile of the perplexities of these, its lower
one, as repetition is as poor as noise, of all trusted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, constants, discard, materialize, pieces, releasing, releasing_group

#: Words that have numbers, below SPAN, and bytes of text that they are chosen from.
COMMON, SAMPLE_BYTES = 65_000, 1 << 25
SPAN = 1 << 16
#: Pairs of common words that are broadcast at most, 12 bytes each.
BROADCAST_TERMS = 1 << 20
#: Occurrences of words that a task gathers before it hands them on.
GATHER = 1 << 21
#: Rows that share one numbering; a place among them takes two bytes.
RUN_ROWS = 1 << 16
#: Bytes of text whose words meet in one bucket, about.
BUCKET_BYTES = 1 << 24
#: Parts of the documents that meet the counts one after another, so that disk holds
#: the places of one part only.
SLICES = 3
#: Ids of trusted documents, 8 bytes each, that are broadcast; more are joined.
BROADCAST_IDS = 1_000_000
LOW, HIGH = 0.002, 0.995
HELD_OUT = 5
#: Perplexities are compared in steps of 1/STEPS bit.
STEPS = 256
#: A language with fewer trusted documents takes the limits of all.
LEAST_TRUSTED = 50
#: What stands before a text's first word and after its last, and for any context
#: beyond those that a caller names.
BEGIN, END, OTHER = constants(3, 31)


def word_pairs(column: pa.Array, contexts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, v, w): the words w of each row of a column in pieces and what stands before
    each, v, as hashes; BEGIN and END stand around a row's words. Rows without words
    have none. If contexts (hashes in order) are given, all others are OTHER."""

    def known(v: np.ndarray) -> np.ndarray:
        if contexts is None:
            return v
        return np.where(contexts[np.minimum(np.searchsorted(contexts, v), len(contexts) - 1)] == v, v, OTHER)

    last = np.full(len(column), BEGIN)
    for a, _, texts, _ in pieces(column, words=0):
        words = Words(texts)
        if not words.n:
            continue
        full = np.flatnonzero(words.hi > words.lo)
        v = np.empty_like(words.hash)
        v[1:] = words.hash[:-1]
        v[words.lo[full]] = last[a + full]
        last[a + full] = words.hash[words.hi[full] - 1]
        yield np.repeat(a + full, (words.hi - words.lo)[full]), known(v), words.hash
    full = np.flatnonzero(last != BEGIN)
    if len(full):
        yield full, known(last[full]), np.full(len(full), END)


# ---------------------------------------------------------------- packed tables
def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, by planes of bytes, so that sorted keys and small numbers take little."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return len(arrays[0]).to_bytes(8, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, sizes = int.from_bytes(blob[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    data = np.frombuffer(pa.decompress(blob[8:], n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    ends = np.cumsum(sizes) * n
    return [np.ascontiguousarray(data[end - n * size : end].reshape(size, n).T).view(k).reshape(-1) for k, size, end in zip(kinds, sizes, ends.tolist(), strict=True)]


#: A pair of common words; of a common word and a rare key, before or after it; of two
#: rare ones, at the first and at the second.
BOTH, LEFT, RIGHT, FIRST, SECOND = range(5)
#: What a packed table holds: counts, unmerged or merged; how many contexts the
#: second of two rare words has, for the first; places of documents; documents; sums.
COUNTS, CONTEXTS, PLACES, DOCS, SUMS = range(5)
_COLUMNS = {COUNTS: ["<u8", "u1", "<u8", "<i8"], CONTEXTS: ["<u8", "<u8", "<u4"], PLACES: ["<u8", "u1", "<u8", "<u2"], SUMS: ["<u2", "<f4"]}
_NAMES, _ROW = ["bucket", "kind", "run", "blob"], "bucket int, kind int, run long, blob binary"
_ODD = 0x9E3779B1
_EVEN_OUT, _BACK = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 32))
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def _numbers(common: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of hashes among the common ones, or -1."""
    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
    return np.where(common[at] == x, at, -1)


def _placed(i: np.ndarray, j: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, ref, at): where pairs (v, w) of numbers (i, j) belong; at is their index."""
    p, q = i >= 0, j >= 0
    both, left, right, rare = (np.flatnonzero(x) for x in (p & q, p & ~q, ~p & q, ~p & ~q))
    code = (i[both] * SPAN + j[both]).astype(np.uint64)  # 32 bits, dealt evenly by an invertible product
    key = [((code * _EVEN_OUT) & _LOW) << _HALF, w[left], v[right], v[rare], w[rare]]
    ref = [np.zeros(len(both), np.uint64), i[left].astype(np.uint64), j[right].astype(np.uint64), w[rare], v[rare]]
    at = [both, left, right, rare, rare]
    side = np.repeat(np.arange(5, dtype=np.uint8), [len(x) for x in at])
    return np.concatenate(key), side, np.concatenate(ref), np.concatenate(at)


def _code(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = (((key >> _HALF) * _BACK) & _LOW).astype(np.int64)
    return code // SPAN, code % SPAN


def _dealt(kind: int, buckets: int, run: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Packed tables of rows in the order of keys, the first column, one a bucket."""
    bucket = ((columns[0] >> _HALF) * np.uint64(buckets)) >> _HALF
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    full = np.flatnonzero(cut[1:] > cut[:-1])
    blobs = [_pack(*(c[cut[k] : cut[k + 1]] for c in columns)) for k in full.tolist()]
    return _rows(full, kind, run, blobs)


def _rows(bucket: np.ndarray, kind: int, run: int, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, run, np.int64)), pa.array(blobs, pa.binary())], _NAMES)


def _summed(n: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Rows of equal columns as one, in the order of the columns, and their sums of n."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(n), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [*(c[first] for c in columns), np.add.reduceat(n[order], first)]


# ------------------------------------------------------------------------ model
def common_words(docs: DataFrame, most: int, size: int) -> np.ndarray:
    """Hashes, in order, of BEGIN, END, OTHER and the `most` most frequent words of a
    sample of docs, whose texts have `size` bytes."""
    share = F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(1 + size // SAMPLE_BYTES)) == 0
    return np.unique(np.concatenate((np.array([BEGIN, END, OTHER], np.uint64), _frequent(docs.where(share), most))))


def _frequent(docs: DataFrame, most: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in word_pairs(batch.column(0)):
                w, n = np.unique(w[w != END], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(count, "w long, n long")
    top = found.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(most).toArrow()
    return np.asarray(top.column("w")).astype(np.int64).view(np.uint64)


def frequent_words(docs: DataFrame, most: int) -> np.ndarray:
    """BEGIN and the hashes of the `most` most frequent words of docs, in order."""
    return np.sort(np.concatenate((np.array([BEGIN], np.uint64), _frequent(docs, most))))


def count_pairs(docs: DataFrame, contexts: np.ndarray | None, common: np.ndarray, buckets: int) -> DataFrame:
    """Packed counts of the pairs of docs, merged by bucket, and how many contexts the
    second of two rare words has, in the bucket of the first."""
    shared = docs.sparkSession.sparkContext.broadcast((contexts, common))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, common = shared.value
        held, size = [], 0

        def out() -> pa.RecordBatch:
            v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            v, w, n = _summed(np.ones(len(v), np.uint32), v, w)
            key, side, ref, at = _placed(_numbers(common, v), _numbers(common, w), v, w)
            order = np.lexsort((ref, side, key))
            return _dealt(COUNTS, buckets, 0, key[order], side[order], ref[order], n[at[order]].astype("<i8"))

        for batch in batches:
            for _, v, w in word_pairs(batch.column(0), contexts):
                held.append((v, w))
                size += len(v)
                if size > GATHER:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), _COLUMNS[COUNTS]) for x in table.column("blob")]
        *columns, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, side, ref, n = _summed(n, *columns)
        found = [_rows(np.array([table.column("bucket")[0].as_py()]), COUNTS, 0, [_pack(key, side, ref, n)])]
        rare = np.flatnonzero(side == SECOND)
        if len(rare):
            words, many = np.unique(key[(side == LEFT) | (side == SECOND)], return_counts=True)
            first, second = ref[rare], key[rare]
            order = np.lexsort((second, first))
            found.append(_dealt(CONTEXTS, buckets, 0, first[order], second[order], many[np.searchsorted(words, second)][order].astype("<u4")))
        return pa.Table.from_batches(found)

    found = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(releasing(count), _ROW)
    return found.groupBy("bucket").applyInArrow(releasing_group(merge), _ROW)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """From the numbers of what was counted once, twice, three and four times."""
    n1, n2, n3, n4 = (int(x) for x in counts[:4])
    if not n1 or not n2:
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)])


def _spare(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    return d[np.clip(n, 1, 3) - 1]


@dataclass
class Model:
    """What every task knows: of common words in order, what probability is left below and
    above them; discounts of pairs and of words; and for unknown words the log probability.
    pairs: the most frequent of common words, and what their own probability adds."""

    common: np.ndarray
    below: np.ndarray
    spare: np.ndarray
    back: np.ndarray
    pair_cut: np.ndarray
    word_cut: np.ndarray
    all: float
    even: float
    pairs: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0))

    def below_of(self, contexts: np.ndarray) -> np.ndarray:
        """The continuation probability of words with so many contexts."""
        return np.where(contexts > 0, (contexts - _spare(self.word_cut, contexts)) / self.all, 0) + self.even

    def added(self, n: np.ndarray, spare: np.ndarray, below: np.ndarray) -> np.ndarray:
        return np.log1p((n - _spare(self.pair_cut, n)) / (spare * below))

    @property
    def unknown(self) -> float:
        return math.log(self.even)


def fit(counts: DataFrame, common: np.ndarray, broadcast_terms: int = BROADCAST_TERMS) -> Model:
    """The common part of the model of merged counts. Unknown words share one place of the
    vocabulary, over which the shortest context's spare weight is even."""
    size = len(common)
    rest, logs = 5 * size, 5 * size + 16

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(logs + 64, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                key, side, ref, n = _unpack(blob.as_py(), _COLUMNS[COUNTS])
                i, j = _code(key[side == BOTH])
                number = ref.astype(np.int64)
                seconds = np.concatenate((j, number[side == RIGHT]))
                firsts, m = np.concatenate((i, number[side == LEFT])), np.concatenate((n[side == BOTH], n[side == LEFT]))
                cells[:size] += np.bincount(seconds, minlength=size)
                np.add.at(cells, size * np.minimum(m, 3) + firsts, 1)
                np.add.at(cells, 4 * size + firsts, m)
                cells[rest : rest + 4] += np.bincount(n[(side != SECOND) & (n <= 4)], minlength=5)[1:]
                many = np.unique(key[(side == LEFT) | (side == SECOND)], return_counts=True)[1]
                cells[rest + 4 : rest + 9] += np.bincount(np.minimum(many, 5), minlength=6)[1:]
                cells[rest + 9] += many.sum()
                cells[logs:] += np.bincount(np.log2(n[side == BOTH]).astype(np.int64), minlength=64)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "value"])

    merged = counts.where(F.col("kind") == COUNTS).select("blob")
    got = merged.mapInArrow(releasing(sums), "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    cells = np.zeros(logs + 64, np.int64)
    cells[np.asarray(got.column("cell")).astype(np.int64)] = np.asarray(got.column("value"))
    contexts, once, twice, more, total = cells[:rest].reshape(5, size)
    pair_cut = _discounts(cells[rest : rest + 4])
    types = cells[rest + 4 : rest + 9] + np.bincount(np.minimum(contexts, 5), minlength=6)[1:]
    word_cut = _discounts(types)
    n = int(cells[rest + 9] + contexts.sum())
    even = (float(types @ word_cut[[0, 1, 2, 2, 2]]) / n if n else 1.0) / (int(types.sum()) + 1)
    spare = np.column_stack((once, twice, more)) @ pair_cut
    back = np.log(np.where(total > 0, spare, 1) / np.maximum(total, 1))
    model = Model(common, np.zeros(0), spare, back, pair_cut, word_cut, float(n or 1), even)
    model.below = model.below_of(contexts)
    fits = np.flatnonzero(np.cumsum(cells[logs:][::-1])[::-1] <= broadcast_terms)
    often = 1 << int(fits[0]) if len(fits) else 1 << 62

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                key, side, _, n = _unpack(blob.as_py(), _COLUMNS[COUNTS])
                own = (side == BOTH) & (n >= often)
                i, j = _code(key[own])
                yield pa.RecordBatch.from_arrays([pa.array(i * SPAN + j), pa.array(n[own])], ["code", "n"])

    top = merged.mapInArrow(releasing(pick), "code long, n long").toArrow().sort_by("code")
    code, n = np.asarray(top.column("code")).astype(np.int64), np.asarray(top.column("n")).astype(np.int64)
    model.pairs = code, model.added(n, spare[code // SPAN], model.below[code % SPAN])
    return model


def _bucket(model: Model, counts: list[bytes], contexts: list[bytes]) -> Callable[[bytes], tuple[np.ndarray, np.ndarray]]:
    """The function of a bucket that turns packed places into rows and what these get."""
    empty = [np.zeros(0, k) for k in _COLUMNS[COUNTS]]
    key, side, ref, n = _unpack(counts[0], _COLUMNS[COUNTS]) if counts else empty
    keys, at = np.unique(key, return_inverse=True)
    refs, to = np.unique(ref, return_inverse=True)

    def name(at: np.ndarray, side: np.ndarray, to: np.ndarray) -> np.ndarray:
        return (at * 5 + side) * max(len(refs), 1) + to

    def per(own: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(at[own], None if weight is None else weight[own], len(keys))

    follow = (side == RIGHT) | (side == FIRST)
    many = per((side == LEFT) | (side == SECOND))
    below, spare, total = model.below_of(many), per(follow, _spare(model.pair_cut, n)), per(follow, n)
    f = np.log(below) - model.unknown
    g = np.log(np.where(total > 0, spare, 1) / np.maximum(total, 1))
    score = np.zeros(len(key))
    number = ref.astype(np.int64)
    own = side == BOTH
    i, j = _code(key[own])
    score[own] = model.added(n[own], model.spare[i], model.below[j])
    own = side == LEFT
    score[own] = model.added(n[own], model.spare[number[own]], below[at[own]])
    own = side == RIGHT
    score[own] = model.added(n[own], spare[at[own]], model.below[number[own]])
    own = np.flatnonzero(side == FIRST)
    if len(own):
        first, second, each = (np.concatenate(x) for x in zip(*(_unpack(x, _COLUMNS[CONTEXTS]) for x in contexts), strict=True))
        each = each[np.lexsort((second, first))]  # the same pairs, in the order of counts
        score[own] = model.added(n[own], spare[at[own]], model.below_of(each.astype(np.int64)))
    names = name(at, side, to)  # in order, as counts are

    def look(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        key, side, ref, row = _unpack(blob, _COLUMNS[PLACES])
        if not len(keys):
            return row, np.zeros(len(row))
        at, to = _numbers(keys, key), _numbers(refs, ref)
        known = (side != BOTH) & (at >= 0)
        value = np.where(known & ((side == LEFT) | (side == SECOND)), f[at], 0) + np.where(known & ((side == RIGHT) | (side == FIRST)), g[at], 0)
        wanted = name(at, side.astype(np.int64), to)
        place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        hit = (at >= 0) & (to >= 0) & (side != SECOND) & (names[place] == wanted)
        return row, value + np.where(hit, score[place], 0)

    return look


def sum_scores(docs: DataFrame, contexts: np.ndarray | None, counts: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(doc_id, lang, n, total) of each row: predicted words, END included, and summed
    log probabilities of whole texts. docs should be a scan, as rows are numbered by
    task and place."""
    shared = docs.sparkSession.sparkContext.broadcast((contexts, model))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, model = shared.value
        known, score = model.pairs
        f = np.log(model.below) - model.unknown
        run = TaskContext.get().partitionId() << 20

        def out(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            key, side, ref, row = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            return _dealt(PLACES, buckets, run, key[order], side[order], ref[order], row[order].astype("<u2"))

        for whole in batches:
            for cut in range(0, whole.num_rows, RUN_ROWS):
                batch = whole.slice(cut, RUN_ROWS)
                size = batch.num_rows
                n, total = np.zeros(size, np.int64), np.zeros(size)
                held: list[tuple[np.ndarray, ...]] = []
                for row, v, w in word_pairs(batch.column(2), contexts):
                    i, j = _numbers(model.common, v), _numbers(model.common, w)
                    n += np.bincount(row, minlength=size)
                    total += np.bincount(row, np.where(i >= 0, model.back[i], 0) + np.where(j >= 0, f[j], 0), size)
                    if len(known):
                        code = np.where((i >= 0) & (j >= 0), i * SPAN + j, -1)
                        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                        hit = known[at] == code
                        total += np.bincount(row[hit], score[at[hit]], size)
                        row, v, w, i, j = (x[~hit] for x in (row, v, w, i, j))
                    key, side, ref, at = _placed(i, j, v, w)
                    held.append((key, side, np.where(side == SECOND, np.uint64(0), ref), row[at]))
                    if sum(len(x[0]) for x in held) > GATHER:
                        yield out(held)
                        held = []
                if any(len(x[0]) for x in held):
                    yield out(held)
                table = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total + n * model.unknown)], ["doc_id", "lang", "n", "total"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as stream:
                    stream.write_batch(table)
                yield _rows(np.array([(run ^ run >> 20) % buckets]), DOCS, run, [sink.getvalue().to_pybytes()])
                run += 1

    def meet(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "run", "blob")), strict=True))
        look = _bucket(shared.value[1], *([x for k, _, x in rows if k == kind] for kind in (COUNTS, CONTEXTS)))
        found = [_rows(np.array([0]), DOCS, run, [x]) for k, run, x in rows if k == DOCS]
        runs: dict[int, list[bytes]] = {}
        for k, run, x in rows:
            if k == PLACES:
                runs.setdefault(run, []).append(x)
        for run, blobs in runs.items():
            row, value = (np.concatenate(x) for x in zip(*map(look, blobs), strict=True))
            total = np.bincount(row, value)
            at = np.flatnonzero(total)
            if len(at):
                found.append(_rows(np.array([0]), SUMS, run, [_pack(at.astype("<u2"), total[at].astype("<f4"))]))
        return pa.Table.from_batches(found or [_rows(np.zeros(0, np.int32), SUMS, 0, [])])

    def finish(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "blob")), strict=True))
        docs = pa.ipc.open_stream(next(x for k, x in rows if k == DOCS)).read_all().combine_chunks()
        total = np.asarray(docs.column("total")).copy()
        for k, x in rows:
            if k == SUMS:
                at, value = _unpack(x, _COLUMNS[SUMS])
                total[at] += value
        return docs.set_column(3, "total", pa.array(total))

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = given.mapInArrow(releasing(places), _ROW).union(counts).groupBy("bucket").applyInArrow(releasing_group(meet), _ROW)
    return parts.groupBy("run").applyInArrow(finish, "doc_id long, lang string, n long, total double")


def quantiles(scored: DataFrame, low: float, high: float) -> dict[str | None, tuple[float, float]]:
    """Limits in bits by language, None for all others, from a count of each
    language's bits in steps: exact over any number of trusted rows. The upper limit
    is of held-out rows. The lower one is of all: the model knows counted texts, and
    near copies of them, far better than others, and that doesn't make them poor."""
    step = F.round(F.col("bits") * STEPS).cast("int")
    rows = scored.where("held_out is not null and n > 0").groupBy("lang", "held_out", step.alias("step")).count().collect()
    by: dict[str | None, tuple[dict[int, int], dict[int, int]]] = {None: ({}, {})}
    for r in rows:
        for lang in {r["lang"], None}:
            every, apart = by.setdefault(lang, ({}, {}))
            for at in (every, apart) if r["held_out"] else (every,):
                at[r["step"]] = at.get(r["step"], 0) + r["count"]

    def pick(table: dict[int, int], q: float) -> float:
        steps = sorted(table)
        below = np.cumsum([table[s] for s in steps])
        return steps[min(int(np.searchsorted(below, q * below[-1])), len(steps) - 1)] / STEPS

    found = {}
    for lang, (every, apart) in by.items():
        if apart and (lang is None or sum(apart.values()) >= LEAST_TRUSTED):
            found[lang] = (pick(every, low) - 0.5 / STEPS, pick(apart, high) + 0.5 / STEPS)
    return found


def classify_quality(docs: DataFrame, labels: DataFrame, trusted: Column | None = None, low: float = LOW, high: float = HIGH, contexts: int | None = None, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """docs(doc_id, text, lang) judged by a model of the documents that labels mark
    as trusted (by default quality 1): doc_id, lang, n_words, perplexity, low,
    high, kept. low and high are the language's limits of perplexity a word, the
    end of a text counted as one. Every word is a context of its own; if contexts is
    given, only so many of the most frequent ones are, and the others are one.

    There is a row for each row of docs, repeated ones too. Texts without words
    have a null perplexity and aren't kept; a perplexity on a limit is kept.
    Without trusted text that is held out there are no limits and other texts are
    kept. Documents of no language have limits of their
    own, or those of all where few are trusted. Extra columns are ignored.
    """
    trusted = F.col("quality") == 1 if trusted is None else trusted
    ids = labels.where(trusted & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = materialize(ids, "trusted")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(HELD_OUT)) == 0
    counted = given.where(~apart).join(chosen, "doc_id", "left_semi")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    own = None if contexts is None else frequent_words(counted, contexts)
    common = common_words(counted, COMMON, size)
    counts = materialize(count_pairs(counted, own, common, buckets), "counts", drop_shuffles=True)
    model = fit(counts, common, broadcast_terms)
    slices = min(SLICES, buckets)
    part = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(slices))
    sums = [materialize(sum_scores(given.where(part == k), own, counts, model, buckets), "sums", drop_shuffles=True) for k in range(slices)]
    summed = reduce(DataFrame.union, sums)
    scored = summed.withColumn("bits", -F.col("total") / F.when(F.col("n") > 0, F.col("n")) / math.log(2))
    scored = materialize(scored.join(ids.withColumn("held_out", apart), "doc_id", "left"), "scored")
    discard(counts, *sums)
    limits = quantiles(scored, low, high)
    rest = limits.pop(None, (None, None))
    table = docs.sparkSession.createDataFrame([(k, *v) for k, v in limits.items()] or [("", None, None)], "known string, a double, b double")
    out = scored.join(F.broadcast(table), F.col("lang").eqNullSafe(F.col("known")), "left")  # a row a language
    a, b = (F.when(F.col("known").isNotNull(), F.col(c)).otherwise(F.lit(x).cast("double")) for c, x in zip("ab", rest, strict=True))
    steps = F.round(F.col("bits") * STEPS) / STEPS
    inside = F.coalesce((steps >= a) & (steps <= b), F.col("bits").isNotNull())
    return out.select("doc_id", "lang", F.greatest(F.col("n") - 1, F.lit(0)).alias("n_words"), F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), a).alias("low"), F.pow(F.lit(2.0), b).alias("high"), inside.alias("kept"))
