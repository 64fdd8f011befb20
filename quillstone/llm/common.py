"""Shared pieces of the training-data operators: graph components, expressions,
and whole-batch text arithmetic on Arrow buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize, small_table

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

# ------------------------------------------------------------------ expressions
def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def let(value: Column, body) -> Column:
    """Evaluate value once and bind it inside a lambda, so that the optimizer
    can't inline it at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------------- workers
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow. A worker outlives its task and goes from stage to stage; at
    the end of one, the memory that it has freed goes back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def releasing_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a group of applyInArrow."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            _give_back()

    return wrapped


# ------------------------------------------------------------------- components
def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each u of edges(u, v) has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    met = ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("down"))
    return met.where("ups > 1 or (ups = 1 and down = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of edges(a, b): component is the smallest
    id reachable. Alternates large-star and small-star rounds until each node hangs
    on one smaller root; each round is written to the shared folder, nothing is
    collected, and node degrees never meet in one task: the minima are partially
    aggregated and the joins back can be split by adaptive execution."""
    star = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    star = materialize(star, "edges")
    while not _is_forest_of_stars(star):
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = materialize(
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            "large",
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        small = materialize(small, "small")
        discard(star, large)
        star = small
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).union(star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# ------------------------------------------------------------- batch arithmetic
class Texts:
    """The UTF-8 bytes of a string column: data, and the start and end of each
    row (null rows are empty). part: a piece of a longer row."""

    part = False

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        n, skip = len(column), column.offset
        valid, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[skip : skip + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
        self.data, self.starts, self.ends = whole[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]
        if column.null_count:
            gone = ~np.asarray(column.is_valid())
            self.ends = np.where(gone, self.starts, self.ends)

    @classmethod
    def one(cls, data: np.ndarray) -> Texts:
        """A piece of a single row."""
        out = cls.__new__(cls)
        out.part = True
        out.data, out.starts, out.ends = data, np.zeros(1, np.int64), np.full(1, len(data), np.int64)
        return out

    def __len__(self) -> int:
        return len(self.starts)


#: Bytes of text that are worked on at once.
PIECE = 1 << 18


def slices(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes of text each, one row at least."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if len(sizes) > first:
        yield first, len(sizes)


def _lead_of_words(data: np.ndarray, at: int, words: int) -> int:
    """Bytes before `at`, which follows a word, that hold the last `words` words."""
    back = 256
    while True:
        low = max(0, at - back)
        inside = ~_SPACE[data[low:at]]
        first = np.flatnonzero(inside & ~np.concatenate(([low > 0], inside[:-1])))  # a word cut at low doesn't count
        if len(first) >= words:
            return at - low - int(first[len(first) - words])
        if low == 0:
            return at
        back *= 4


def pieces(column: pa.Array, limit: int = PIECE, back: int = 0, words: int | None = None) -> Iterator[tuple[int, int, Texts, int]]:
    """(a, b, texts, lead): the rows a..b of a column in pieces of about limit
    bytes. A longer row comes in several pieces, one row each, of which the first
    `lead` bytes were part of the piece before: `back` bytes, or, if `words` is
    given, so many whole words; such pieces end between words."""
    for a, b in slices(column, limit):
        texts = Texts(column.slice(a, b - a))
        n = len(texts.data)
        if b - a > 1 or n <= limit:
            yield a, b, texts, 0
            continue
        at = 0
        while at < n:
            end = min(at + limit, n)
            while words is not None and end < n:
                gap = np.flatnonzero(_SPACE[texts.data[end : end + limit]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + limit, n)
            lead = (min(back, at) if words is None else _lead_of_words(texts.data, at, words) if words else 0) if at else 0
            yield a, b, Texts.one(texts.data[at - lead : end]), lead
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)  # the first i bytes of eight


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch of texts, A-Z lower-cased, as
    64-bit hashes in reading order; words of row i are lo[i]..hi[i]. A word is
    hashed by blocks of eight bytes, each mixed with its place before they are
    added, so that no pattern of letters cancels out."""

    def __init__(self, texts: Texts, prefix: int = 0):
        data, n = texts.data, len(texts.data)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[texts.starts] = True
        edge[texts.ends] = True
        begins = inside & edge[:n]
        ends = inside & edge[1:]
        if n:
            begins[1:] |= inside[1:] & ~inside[:-1]
            begins[0] = inside[0]
            ends[:-1] |= inside[:-1] & ~inside[1:]
            ends[-1] = inside[-1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first, self.last, self.n = first, last, len(first)
        self.lo = np.searchsorted(first, texts.starts)
        self.hi = np.maximum(np.searchsorted(first, texts.ends), self.lo)
        if not self.n:
            self.hash, self.stem = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = _FOLD[data]
        eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        size = last - first
        count = (size + 7) >> 3
        at = np.cumsum(count) - count
        step = np.arange(int(count.sum())) - np.repeat(at, count)
        value = eight[np.repeat(first, count) + 8 * step] & _KEEP[np.minimum(np.repeat(size, count) - 8 * step, 8)]
        mixed = mix64(value + (step + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.hash = mix64(np.add.reduceat(mixed, at) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if prefix:
            self.stem = mix64((value[at] & _KEEP[np.minimum(size, prefix)]) + np.uint64(0x5DEECE66D))


def shingle_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of each run of `width` words, of rows whose word hashes stand
    from begin to end; a row with fewer words, but some, has its whole sequence as
    one. Returns hashes, and per row lo and hi."""
    count = end - begin
    n = np.where((count > 0) & (count < width), 1, np.maximum(count - width + 1, 0))
    hi = np.cumsum(n)
    lo = hi - n
    row = np.repeat(np.arange(len(n)), n)
    at = begin[row] + (np.arange(len(row)) - lo[row])
    size = np.minimum(count, width)[row]
    acc = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(width if len(row) else 0):
        h = hashes[np.minimum(at + j, len(hashes) - 1)]
        acc = np.where(size > j, mix64(acc + h + np.uint64(j + 1)), acc)
    return acc, lo, hi
