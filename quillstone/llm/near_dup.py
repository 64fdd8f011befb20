"""MinHash near-duplicate detection by a chosen-path set similarity join.

Documents with equal word sequences, by a cryptographic digest of all words, are
first folded into classes. Each class has a minwise signature. A tree sends every class down the node named by one
signature token; a node too heavy to compare branches again on one or two
further tokens chosen by a hash of the node (4/3 in the mean, one over the
similarity). Light nodes are compared exhaustively. Each tree has signature
tokens of its own, so that trees are independent; they repeat this until pairs at
the threshold are met with the target recall. Every link is
confirmed on the full shingle sets.

Trees run in two rounds. After the first the links found are merged into
components, and the second drops nodes that lie within one component, so a
large group of near copies is compared once and not once a tree. A comparison
task takes many nodes together, up to a weight.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, Texts, Words, connected_components, constants, discard, materialize, pieces, releasing, releasing_group, shingle_hashes, small_table

WIDTH = 5
THRESHOLD = 0.75
#: Coordinates that a comparison looks at.
COORDINATES = 32
#: Coordinates that each tree has to branch on, beside that of its root.
BRANCHES = 8
#: Pairs whose signatures agree on fewer coordinates than this aren't compared:
#: five standard deviations below what a pair at the threshold has.
LEAST_AGREE = max(1, math.floor(COORDINATES * THRESHOLD - 5 * math.sqrt(COORDINATES * THRESHOLD * (1 - THRESHOLD))))
#: Rows of signatures, 200 bytes each, that a task looks through, about.
TASK_ROWS = 5_000
#: Shingles that one comparison task may hold, about.
NODE_WEIGHT = 300_000
DEPTH = 5
#: Words of a long text whose shingles are hashed at once.
BLOCK_WORDS = 1 << 18
#: Document ids, 8 bytes each, that are broadcast to pick texts; more are joined.
BROADCAST_IDS = 1_000_000
TARGET_RECALL = 0.999
#: Chance that one tree brings a pair at the threshold together if its nodes stay
#: heavy at every level: 0.4307 by simulation.
TREE_RECALL = 0.43
PIVOTS = 4


def tree_rounds(target: float = TARGET_RECALL) -> list[int]:
    """Numbers of trees by round: few at first, which merge the large groups. As
    they compare the heaviest nodes in part only, the others reach the target."""
    return [2, max(2, math.ceil(math.log(1 - target) / math.log(1 - TREE_RECALL)))]


def _spelled(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of all words, a space after each, and where each word begins."""
    size = words.last - words.first
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + words.n, 0x20, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + step] = _FOLD[texts.data[np.repeat(words.first, size) + step]]
    return out, np.append(begin, len(out))


def _signatures(width: int, coordinates: int):
    odd = constants(coordinates, 101) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            mins = np.full((batch.num_rows, coordinates), 0xFFFFFFFF, np.uint32)
            digests = [hashlib.sha256() for _ in range(batch.num_rows)]
            long: dict[int, list[np.ndarray]] = {}  # word hashes of rows in several pieces

            def least(hashes: np.ndarray, lo: np.ndarray, rows: np.ndarray, mins: np.ndarray) -> None:
                for k in range(coordinates if len(rows) else 0):
                    mins[rows, k] = np.minimum(mins[rows, k], np.minimum.reduceat((hashes * odd[k]) >> np.uint64(32), lo))

            for a, b, texts, _ in pieces(batch.column(1), words=0):
                words = Words(texts)
                spelled, begin = _spelled(texts, words)
                for i, (x, y) in enumerate(zip(words.lo.tolist(), words.hi.tolist(), strict=True)):
                    digests[a + i].update(spelled[begin[x] : begin[y]])
                if texts.part:
                    long.setdefault(a, []).append(words.hash)
                    continue
                hashes, lo, hi = shingle_hashes(words.hash, words.lo, words.hi, width)
                n[a:b] = [len(np.unique(hashes[i:j])) if j - i > 1 else j - i for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                full = np.flatnonzero(hi > lo)
                least(hashes, lo[full], a + full, mins)
            for a, found in long.items():
                every, kinds = np.concatenate(found), []
                for at in range(0, max(len(every) - width + 1, 1), BLOCK_WORDS):
                    block = every[at : at + BLOCK_WORDS + width - 1]
                    hashes, lo, _ = shingle_hashes(block, np.zeros(1, np.int64), np.full(1, len(block)), width)
                    kinds.append(np.unique(hashes))
                    least(hashes, lo[: len(hashes)], np.full(min(1, len(hashes)), a), mins)
                n[a] = len(np.unique(np.concatenate(kinds)))
            mins[n == 0] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array([d.digest() for d in digests], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(mins) * coordinates + 1, coordinates, dtype=np.int32)), pa.array(mins.view(np.int32).reshape(-1))),
                ],
                ["doc_id", "n_shingles", "digest", "mins"],
            )

    return run


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The full set of each text, as a sorted array of numbers. Words, then pairs
    of a run and its next word are numbered in turn, so that equal numbers mean
    equal runs: nothing is hashed that could collide."""
    texts = Texts(column)
    words = Words(texts)
    if not words.n:
        return [np.zeros(0, np.int64)] * len(texts)
    spelled, begin = _spelled(texts, words)
    flat = pa.Array.from_buffers(pa.large_binary(), words.n, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(spelled)])
    ids = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
    count = words.hi - words.lo
    n = np.where((count > 0) & (count < width), 1, np.maximum(count - width + 1, 0))
    hi = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    at = words.lo[row] + (np.arange(len(row)) - (hi - n)[row])
    size = np.minimum(count, width)[row]
    span = words.n + 1
    run = ids[at]
    for j in range(1, width):  # a short text's missing words are the last number
        run = pd.factorize(run * span + np.where(size > j, ids[np.minimum(at + j, words.n - 1)], words.n))[0]
    return [np.unique(run[i:j]) for i, j in zip((hi - n).tolist(), hi.tolist(), strict=True)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common numbers of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    return int((b[at] == a).sum()) if len(b) else 0


def _near(i: int, mins: np.ndarray, size: np.ndarray, side: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Which of the rows after i may reach the threshold with it."""
    rest = slice(i + 1, len(mins))
    near = (mins[rest] == mins[i]).sum(axis=1) >= least
    near &= 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
    return near if side[i] else near & (side[rest] > 0)


def _signed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mins = np.asarray(table.column("mins").combine_chunks().flatten()).reshape(table.num_rows, -1)
    return mins, np.asarray(table.column("n_shingles")), np.asarray(table.column("side"))


def _by_node(table: pa.Table) -> tuple[pa.Table, Iterator[tuple[int, int]]]:
    """A task's rows in the order of nodes, and where each node begins and ends."""
    table = table.sort_by("key").combine_chunks()
    key = np.asarray(table.column("key"))
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist()
    return table, zip(cut[:-1], cut[1:], strict=True)


def _candidates(percent: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        """The rows that have a possible partner of another component in their node;
        the texts of the others needn't be fetched."""
        table, nodes = _by_node(table)
        mins, size, side = _signed(table)
        comp, met = np.asarray(table.column("comp")), np.zeros(table.num_rows, bool)
        for x, y in nodes:
            for i in range(x, y - 1):
                near = _near(i - x, mins[x:y], size[x:y], side[x:y], percent, least) & (comp[i + 1 : y] != comp[i])
                if near.any():
                    met[i] = True
                    met[i + 1 : y] |= near
        return table.filter(pa.array(met))

    return run


def _compare(width: int, percent: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of a task's nodes, as stars over the components known before: each
        one found to be linked, and the smallest of those that it is linked with.
        side 1 rows meet each other and side 0 rows; side 0 rows don't meet."""
        table, nodes = _by_node(table)
        mins, size, side = _signed(table)
        comp = table.column("comp").to_pylist()
        root = {c: c for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        sets = shingle_sets(table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string()), width)
        for x, y in nodes:
            for i in range(x, y - 1):
                near = _near(i - x, mins[x:y], size[x:y], side[x:y], percent, least)
                for j in (np.flatnonzero(near) + i + 1).tolist():
                    p, q = find(comp[i]), find(comp[j])
                    if p == q:
                        continue
                    both = overlap(sets[i], sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        root[max(p, q)] = min(p, q)
        stars = [(c, find(c)) for c in root if find(c) != c]
        return pa.table({"a": pa.array([a for a, _ in stars], pa.int64()), "b": pa.array([b for _, b in stars], pa.int64())})

    return run


def _nodes(classes: DataFrame, known: DataFrame, trees: range, weight: int, depth: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(light nodes, heavy nodes or None, frames to discard). A node is a key
    over rows (id, comp, w); nodes within one component are dropped. at is where
    a tree's coordinates begin among those of the round."""
    own = BRANCHES + 1
    paths = classes.select("id", F.slice("mins", trees.start * own + 1, len(trees) * own).alias("mins"))
    roots = [F.struct(F.xxhash64(F.lit(t), F.element_at("mins", t * own + 1)).alias("key"), F.lit((t - trees.start) * own).alias("at")) for t in trees]
    frontier = (
        classes.join(known, "id", "left")
        .select("id", F.coalesce("comp", "id").alias("comp"), "w", F.explode(F.array(*roots)).alias("n"))
        .select("id", "comp", "w", "n.key", "n.at")
    )
    light, used = [], []
    for level in range(depth):
        stats = frontier.groupBy("key").agg(F.sum("w").alias("total"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        stats = stats.where("low < high").select("key", "total")
        live = materialize(frontier.join(stats, "key"), f"nodes{level}")
        used.append(live)
        light.append(live.where(F.col("total") <= weight))
        heavy = live.where(F.col("total") > weight)
        if heavy.isEmpty():
            heavy = None
            break
        if level == depth - 1:
            break
        one = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(BRANCHES)).cast("int")
        other = F.pmod(one + 1 + F.pmod(F.xxhash64("key", F.lit(12)), F.lit(BRANCHES - 1)).cast("int"), F.lit(BRANCHES))
        second = F.pmod(F.xxhash64("key", F.lit(13)), F.lit(3)) == 0
        child = [F.xxhash64("key", p, F.element_at("mins", F.col("at") + p + 2)) for p in (one, other)]
        frontier = heavy.select("key", "id", "comp", "w", "at").join(paths, "id").select(
            "id", "comp", "w", F.explode(F.when(second, F.array(*child)).otherwise(F.array(child[0]))).alias("key"), "at"
        )
    out = light[0]
    for x in light[1:]:
        out = out.union(x)
    return out.select("key", "id", "comp"), heavy, used


def _blocks(heavy: DataFrame, weight: int, first_round: bool) -> DataFrame:
    """Comparison tasks (key, id, comp, side) for nodes that stay heavy at full
    depth. In the first round: hashed blocks that share a few pivots, which
    merge a tight group. Later: an exact way, every block against the blocks
    that lie outside the node's largest component."""
    count = F.ceil(F.col("total") / weight).cast("int")
    if first_round:
        pivots = heavy.groupBy("key", "total").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(s)).alias("h"), "id", "comp")).alias(f"p{s}") for s in range(PIVOTS)])
        pivots = (
            pivots.select("key", count.alias("n"), F.array_distinct(F.array(*[F.struct(F.col(f"p{s}.id"), F.col(f"p{s}.comp")) for s in range(PIVOTS)])).alias("ps"))
            .select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b"), "ps")
            .select("key", "b", F.explode("ps").alias("p"))
        )
        own = heavy.select("key", F.pmod(F.xxhash64("id", "key"), count).cast("int").alias("b"), "id", "comp")
        both = own.union(pivots.select("key", "b", "p.id", "p.comp")).distinct()
        return both.select(F.xxhash64("key", "b").alias("key"), "id", "comp", F.lit(1).alias("side"))
    parts = heavy.groupBy("key", "comp").agg(F.sum("w").alias("part"))
    main = parts.groupBy("key").agg(F.max(F.struct("part", "comp")).alias("top"), F.sum("part").alias("whole"))
    main = main.select("key", F.col("top.comp").alias("main"), F.ceil(F.col("top.part") / weight).cast("int").alias("nm"), F.greatest(F.lit(1), F.ceil((F.col("whole") - F.col("top.part")) / weight)).cast("int").alias("nq"))
    rows = heavy.select("key", "id", "comp").join(main, "key").withColumn("inner", F.col("comp") == F.col("main"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id", "key"), F.when(F.col("inner"), F.col("nm")).otherwise(F.col("nq"))).cast("int"))
    against_main = rows.select(
        "key", "id", "comp", "inner",
        F.explode(F.when(F.col("inner"), F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: F.struct(F.col("b").alias("m"), q.alias("q"))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda m: F.struct(m.alias("m"), F.col("b").alias("q"))))).alias("t"),
    ).select(F.xxhash64("key", F.lit("main"), "t.m", "t.q").alias("key"), "id", "comp", F.when(F.col("inner"), 0).otherwise(1).alias("side"))
    among = rows.where(~F.col("inner") & (F.col("nq") > 1)).select(
        "key", "id", "comp", F.explode(F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: F.struct(F.least("b", q).alias("x"), F.greatest("b", q).alias("y")))).alias("t")
    ).select(F.xxhash64("key", F.lit("rest"), "t.x", "t.y").alias("key"), "id", "comp", F.lit(1).alias("side"))
    return against_main.union(among)


def _tasks(rows: DataFrame, weight: int, each: Column, texts: DataFrame | None = None):
    """rows grouped into tasks of about `weight`, a node always as a whole."""
    total = rows.agg(F.sum(each.cast("long"))).first()[0] or 0
    task = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(max(1, math.ceil(total / weight))))
    return (rows if texts is None else rows.join(texts, "id")).groupBy(task.alias("task"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, target_recall: float = TARGET_RECALL, node_weight: int = NODE_WEIGHT, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id,
    kept. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set
    is its distinct runs of `width` words, or its whole sequence if shorter.

    Null or wordless texts have an empty set and link with nothing. Rows that
    repeat a doc_id share its component. A null doc_id has a null component and
    is kept. Extra columns are ignored; an empty table gives no rows. Ties don't
    arise: the smallest doc_id of a component is kept.
    """
    percent = round(threshold * 100)
    coordinates = max(COORDINATES, sum(tree_rounds(target_recall)) * (BRANCHES + 1))
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, n_shingles long, digest binary, mins array<int>"
    signed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(_signatures(width, coordinates)), schema), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    folded = materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.min("mins").alias("mins")), "classes")
    if folded.isEmpty():
        return signed.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    # a doc_id with several texts stands for all of them: each is a class of its own
    classes = folded.select("id", "n_shingles", "mins", F.greatest(F.col("n_shingles"), F.lit(64)).alias("w"))
    known = small_table(docs.sparkSession, [], "id long, comp long")
    compare = releasing_group(_compare(width, percent, LEAST_AGREE))
    first = 0
    for turn, trees in enumerate(tree_rounds(target_recall)):
        light, heavy, used = _nodes(classes, known, range(first, first + trees), node_weight, depth)
        first += trees
        tasks = light.select("key", "id", "comp", F.lit(1).alias("side"))
        if heavy is not None:
            tasks = tasks.union(_blocks(heavy, node_weight, turn == 0))
        columns = ["key", "id", "comp", "side", "n_shingles", "mins"]
        signs = classes.select("id", "n_shingles", F.slice("mins", 1, COORDINATES).alias("mins"))
        rows = materialize(tasks.join(signs, "id").select(columns), "rows")
        met = materialize(_tasks(rows, TASK_ROWS * 350, F.lit(350)).applyInArrow(releasing_group(_candidates(percent, LEAST_AGREE)), rows.schema), "candidates")
        wanted = materialize(met.select("id").distinct(), "wanted")
        small = wanted.count() <= BROADCAST_IDS
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted) if small else wanted, "id", "left_semi")
        found = materialize(_tasks(met, node_weight / 4, F.col("n_shingles"), texts).applyInArrow(compare, "a long, b long"), "links")
        merged = materialize(connected_components(found), "merged")
        # what was known moves on with its component, and the rest is new
        moved = known.join(merged.select(F.col("id").alias("comp"), F.col("component").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        fresh = merged.join(known.select("id"), "id", "left_anti").select("id", F.col("component").alias("comp"))
        now = materialize(moved.union(fresh), "known")
        discard(*used, rows, met, wanted, found, merged, known)
        known = now
    given = folded.select(F.col("digest").alias("__digest"), "id").join(known, "id", "left").select("__digest", F.coalesce("comp", "id").alias("component_id"))
    placed = signed.select("doc_id", "n_shingles", "digest").join(given, (F.col("digest") == F.col("__digest")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component_id", "doc_id")
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _pick(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A semi or anti join on id; few ids, by count, are broadcast."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(few, F.col("doc_id").cast("long") == F.col("__id"), how)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest doc_id.
    Documents without words and rows without a doc_id stay. Rows that share a
    doc_id are documents of their own: of equal ones the first stays, different
    ones stay unless they are near copies. An empty table gives no rows."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():  # ids of our own, in the order of doc_id
        order = ["doc_id", "text"]
        unique = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__own", F.monotonically_increasing_id())
        unique = materialize(unique, "unique")
        rows = unique.select(F.when(F.col("doc_id").isNotNull(), F.col("__own")).alias("doc_id"), "text")
        return _pick(unique, _gone(rows, options), "__own").drop("__own")
    return _pick(docs, _gone(docs, options), "doc_id")


def _gone(docs: DataFrame, options: dict) -> DataFrame:
    judged = near_duplicates(docs, **options).where("not kept and n_shingles > 0")
    return materialize(judged.select(F.col("doc_id").alias("__id")).distinct(), "gone")


def _pick(docs: DataFrame, ids: DataFrame, by: str) -> DataFrame:
    """docs but for the ids; few, by count, are broadcast."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(few, F.col(by).cast("long") == F.col("__id"), "left_anti")
