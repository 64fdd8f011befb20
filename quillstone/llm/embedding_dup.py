"""Near-duplicate embeddings by collision-counting projections.

Vectors are projected on random unit directions. The first few projections cut
each label's vectors into cells; a vector is at home in one cell and a guest in
those that its query window reaches. In a cell the vectors are sorted by the next
projection; a query's window of it gives the candidates, and the windows of the
others are counted for each pair. Pairs with enough collisions are verified by
cosine in double precision.

Window and count are calibrated to the target recall: a pair at the threshold is
at most r apart, its difference in one projection has deviation r / sqrt(d), and
its collisions are binomial.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, let, materialize

THRESHOLD = 0.98
PROJECTIONS = 16
#: Half a window, in deviations of a pair at the threshold.
WINDOW = 2.0
#: The same for the projections that cut cells, where one miss loses the pair.
REACH = 5.0
MISS = 1e-6
#: Vectors that a comparison task may hold, about.
BLOCK = 2048


def least_collisions(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches but for a chance of
    `miss`."""
    p = math.erf(window / math.sqrt(2))
    below, k = 0.0, 0
    while k < projections:
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            break
        k += 1
    return k


def directions(dimension: int, count: int, seed: int = 17) -> np.ndarray:
    out = np.random.default_rng(seed).normal(size=(count, dimension))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return np.asarray(values.flatten()).reshape(len(values), -1)


def _compare(threshold: float, dimension: int, cuts: int):
    axes = directions(dimension, cuts + PROJECTIONS)[cuts:]
    half = WINDOW * math.sqrt(2 - 2 * threshold) / math.sqrt(dimension)
    enough = least_collisions()

    def run(table: pa.Table) -> pa.Table:
        """Links of one task: for each vector the weight of its partners here, and
        a forest over the links. home: the row is at home in this cell; block: rows
        of equal blocks meet in the task of that block alone."""
        x = _matrix(table.column("v"))
        ids, weight = np.asarray(table.column("id")), np.asarray(table.column("n"))
        home, own = np.asarray(table.column("home")), np.asarray(table.column("b"))
        diagonal = bool(np.asarray(table.column("diagonal"))[0])
        p = x @ axes.T
        order = np.argsort(p[:, 0], kind="stable")
        x, ids, weight, home, own, p = x[order], ids[order], weight[order], home[order], own[order], p[order]
        stop = np.searchsorted(p[:, 0], p[:, 0] + REACH / WINDOW * half, side="right")
        links = np.zeros(len(ids), np.int64)
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i in range(len(ids) - 1):
            rest = slice(i + 1, max(stop[i], i + 1))
            near = (np.abs(p[rest] - p[i]) <= half).sum(axis=1) >= enough
            near &= home[rest] | home[i]  # two guests meet elsewhere
            if not diagonal:
                near &= own[rest] != own[i]
            found = np.flatnonzero(near) + i + 1
            if not len(found):
                continue
            found = found[x[found] @ x[i] >= threshold]
            links[i] += weight[found].sum()
            links[found] += weight[i]
            for j in found.tolist():
                r, s = find(i), find(j)
                if r != s:
                    root[max(r, s)] = min(r, s)
                    a.append(ids[i])
                    b.append(ids[j])
        some = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array([*ids[some].tolist(), *a], pa.int64()),
                "b": pa.array([None] * len(some) + b, pa.int64()),
                "links": pa.array([*links[some].tolist(), *([0] * len(a))], pa.int64()),
            }
        )

    return run


def embedding_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cuts: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): vec_id, n_links,
    component_id, kept. Vectors of the same non-null label link when their cosine
    is at least threshold.

    Vectors that are null, empty, zero or hold a null or non-finite component, and
    those without a label, link with nothing. Equal vectors are folded before the
    search and counted in n_links. Vectors of different lengths don't link. Rows
    that repeat a vec_id share the links of all of them; rows with a null
    vec_id are kept, with a null component and no links. Components of any size
    are scaled before they are squared. An empty table gives no
    rows. Extra columns are ignored.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").alias("label"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("e") > 0) & finite, F.lit(False))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    # by the largest component first: squares of extreme ones would over- or underflow
    scaled = let(F.col("e"), lambda e: let(F.array_max(F.transform(e, F.abs)), lambda m: F.transform(e, lambda x: x / m)))
    marked = given.select("vec_id", F.when(fine, F.col("label")).alias("label"), F.when(fine & F.exists("e", lambda x: x != 0), scaled).alias("e"))
    marked = marked.select("vec_id", "label", F.when(norm > 0, F.transform("e", lambda x: x / norm)).alias("v"))
    rows = materialize(marked.select("vec_id", F.when(F.col("v").isNotNull(), F.col("label")).alias("label"), "v"), "vectors")
    usable = rows.where("v is not null and label is not null")
    folded = materialize(usable.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "folded")
    shape = folded.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()  # a row a vector length
    found = None
    for d, n in sorted((r["d"], r["n"]) for r in shape):
        k = cuts if cuts is not None else max(1, min(6, math.ceil(math.log(max(n, 1) / (8 * block), 3)))) if n > 8 * block else 1
        part = _search(folded.where(F.size("v") == d), threshold, d, k, block)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "found")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("b is not null").select("a", "b"))
    classes = folded.select("label", "v", "id", "n").join(links, "id", "left").join(comps, "id", "left")
    classes = materialize(classes.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component")), "classes")
    placed = rows.join(classes, ["label", "v"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id")
    )
    discard(found)
    return placed.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _search(folded: DataFrame, threshold: float, d: int, cuts: int, block: int) -> DataFrame:
    radius = math.sqrt(2 - 2 * threshold) / math.sqrt(d)
    reach, width = REACH * radius, max(2 * REACH * radius, 1.2 / math.sqrt(d))
    axes = directions(d, cuts + PROJECTIONS)[:cuts]
    project = [F.aggregate(F.zip_with("v", F.array(*[F.lit(float(c)) for c in axis]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for axis in axes]
    placed = folded.select("label", "id", "n", "v", *[p.alias(f"p{i}") for i, p in enumerate(project)])
    cell = [F.floor(F.col(f"p{i}") / width).cast("int") for i in range(cuts)]
    options = [F.array_distinct(F.array(*[F.floor((F.col(f"p{i}") + s) / width).cast("int") for s in (-reach, 0.0, reach)])) for i in range(cuts)]
    visits = placed.withColumn("at", F.array(*cell))
    for i in range(cuts):
        visits = visits.withColumn(f"c{i}", F.explode(options[i]))
    cells = F.array(*[F.col(f"c{i}") for i in range(cuts)])
    # a pair with different homes meets in the lower one only
    visits = visits.withColumn("cell", cells).where(F.col("cell") <= F.col("at"))
    visits = visits.select("label", "cell", "id", "n", "v", (F.col("cell") == F.col("at")).alias("home"))
    full = visits.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    visits = visits.join(full, ["label", "cell"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tasks = visits.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "b").alias("x"), F.greatest(o, "b").alias("y")))))
    tasks = tasks.select("label", "cell", "t", "id", "n", "v", "home", "b", (F.col("t.x") == F.col("t.y")).alias("diagonal"))
    return tasks.groupBy("label", "cell", "t").applyInArrow(_compare(threshold, d, cuts), "a long, b long, links long")
