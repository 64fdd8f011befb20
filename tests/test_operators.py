"""Small cases with known results."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import commits, diff, languages, metrics, pairing, sampling, scoring, timeline


def test_language_names(spark):
    rows = spark.createDataFrame([("python",), ("JS",), ("c++",), ("CSharp",), ("cobol",), (None,)], "x string")
    found = [r[0] for r in rows.select(languages.canonical(F.col("x"))).collect()]
    assert found == ["Python", "JavaScript", "C++", "C#", None, None]
    with pytest.raises(ValueError, match="valid names"):
        languages.language_predicate(F.col("x"), ["Klingon"])


def test_language_index(spark):
    index = spark.createDataFrame([("train", 0, 7), ("train", 1, -1), ("train", 2, 5)], "split string, row long, code byte")
    rows = spark.createDataFrame([("train", 0, "a"), ("train", 1, "b"), ("train", 2, None)], "split string, row long, code string")
    good = rows.select("split", "row", languages.fingerprint(F.col("code")).alias("hash"))
    found = {r["row"]: r["language"] for r in languages.checked_languages(rows, index, good).collect()}
    assert found == {0: "Python", 1: None, 2: "JavaScript"}
    bad = spark.createDataFrame([("train", 1, "0000")], "split string, row long, hash string")
    with pytest.raises(Exception, match="doesn't belong"):
        languages.checked_languages(rows, index, bad).collect()


def test_share_caps_match_the_definition(spark):
    rng = random.Random(1)
    for _ in range(8):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 30))]
        share = rng.choice([0.05, 0.1, 0.2, 0.34])
        want = sizes
        if len(sizes) * share >= 1:
            limit = max(c for c in range(1, max(sizes) + 1) if c <= max(1, int(share * sum(min(n, c) for n in sizes) + 1e-9)))
            want = [min(n, limit) for n in sizes]
        frame = spark.createDataFrame([("x", f"r{i:02}", n) for i, n in enumerate(sizes)], "lang string, repo string, n long")
        got = [r["keep"] for r in sampling.share_caps(frame, F.lit(share), ["lang"]).orderBy("repo").collect()]
        assert got == want, (sizes, share)


def test_pairs():
    assert pairing.match([100, 6], [5, 7, 30, 90, 400]) == [(0, 3), (1, 1)]
    assert pairing.match([100, 6], [5]) == [(1, 0)]
    rng = random.Random(2)
    for _ in range(50):
        a, h = ([rng.randint(1, 9) for _ in range(rng.randint(1, 7))] for _ in range(2))
        left, pairs = sorted((abs(math.log(x) - math.log(y)), i, j) for i, x in enumerate(a) for j, y in enumerate(h)), []
        for _, i, j in left:
            if all(i != p and j != q for p, q in pairs):
                pairs.append((i, j))
        assert pairing.match(a, h) == pairs


def test_pairs_by_repo(spark):
    schema = "repo string, id string, pos long, lines_changed int"
    ai = spark.createDataFrame([("r", "x", 0, 100), ("r", "y", 1, 6)], schema)
    human = spark.createDataFrame([("r", f"h{n}", i, n) for i, n in enumerate([5, 7, 30, 90, 400])], schema)
    found = pairing.size_matched_pairs(ai, human).orderBy("pair_rank").collect()
    assert [(r["ai_id"], r["human_id"]) for r in found] == [("x", "h90"), ("y", "h7")]


def test_auc_and_ties(spark):
    rows = spark.createDataFrame([("h", 0.1), ("h", 0.2), ("h", 0.6), ("a", 0.5), ("a", 0.9)], "c string, score double")
    scored = rows.select((F.col("c") == "a").cast("int").alias("label"), "score")
    assert metrics.auc(scored).first()["auc"] == pytest.approx(5 / 6)
    assert metrics.auc(scored.where("label = 1")).count() == 0


def test_weighted_mean_and_first_class_on_ties(spark):
    files = spark.createDataFrame([("c", 30, 1.0, 0.0), ("c", 10, 0.0, 1.0), ("d", 5, 0.5, 0.5)], "commit string, lines_changed int, p_human double, p_ai double")
    found = {r["commit"]: (r["p_human"], r["predicted"]) for r in scoring.aggregate_commits(files, ["human", "ai"]).collect()}
    assert found == {"c": (0.75, "human"), "d": (0.5, "human")}


def test_timeline_fills_months(spark):
    schema = "month string, predicted string, error string, languages map<string,string>"
    rows = spark.createDataFrame([("2023-01", "ai", None, {"Python": "ai"}), ("2023-01", None, None, {}), ("2023-03", "human", None, {"Python": "human", "Go": "ai"}), ("2023-03", None, "bad", None)], schema)
    found = [tuple(r) for r in timeline.monthly(rows, ["human", "ai"]).orderBy("month").collect()]
    assert found == [("2023-01", 0, 1, 1, 0), ("2023-02", 0, 0, 0, 0), ("2023-03", 1, 0, 0, 1)]
    own = [tuple(r) for r in timeline.monthly(rows, ["human", "ai"], "Go").orderBy("month").collect()]
    assert own == [("2023-01", 0, 0, 0, 0), ("2023-02", 0, 0, 0, 0), ("2023-03", 0, 1, 0, 0)]


def test_globs_cross_slashes(spark):
    rows = spark.createDataFrame([("a/vendor/x.ts",), ("src/x.ts",), ("x.d.ts",)], "path string")
    found = [r[0] for r in rows.select(commits.wanted_path(F.col("path"), [".ts"], ["*/vendor/*", "*.d.ts"])).collect()]
    assert found == [False, True, False]


def test_diff_shapes():
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n--- gone\n+++ here\n keep\ndiff --git \"a/t\\303\\251.py\" \"b/t\\303\\251.py\"\ndeleted file mode 100644\nBinary files a/x and /dev/null differ\n"
    rows = list(diff.parse_diff(text))
    assert [(r[1], r[7], r[8]) for r in rows[:3]] == [("x", "removed", "-- gone\n"), ("x", "added", "++ here\n"), ("x", "context", "keep\n")]
    assert rows[3][1:5] == ("té.py", False, True, True) and rows[3][5] is None
    assert list(diff.parse_diff("")) == [] and list(diff.parse_diff(None)) == []


def test_evenly_spaced(spark):
    rows = spark.range(10).select(F.col("id"))
    assert sorted(r[0] for r in sampling.evenly_spaced(rows, ["id"], 4).collect()) == [0, 2, 5, 7]
    assert sampling.evenly_spaced(rows, ["id"], 20).count() == 10


def test_pairs_query_takes_whole_tables(spark, tmp_path):
    """Against brute force: no key is left out, and the row limits are the only cap."""
    from quillstone.constants import CORPUS
    from quillstone.plans import queries

    rng = random.Random(9)
    many = 3 * CORPUS["rows_per_class_per_repo"] // 2
    rows = [(n, 1, rng.randint(1, 999), supplier, float(n), float(rng.randint(1, 50))) for n, supplier in enumerate([1] * 2 * many + [2] * 40 + [3] * 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    sides = {}
    keyed = spark.createDataFrame([("-".join(map(str, r[:5])), *r[2:4], r[5]) for r in rows], "id string, part long, supplier long, size double")
    for r in keyed.withColumn("h", F.xxhash64("id")).orderBy("h", "id").collect():
        side = (r["part"] * 7919 + r["supplier"] * 31) % 1000 / 999 > 0.5
        sides.setdefault((str(r["supplier"]), side), []).append((r["id"], r["size"]))
    want = set()
    for repo in "123":
        ai = sides.get((repo, True), [])[: CORPUS["rows_per_class_per_repo"]]
        human = sides.get((repo, False), [])[: len(ai) * CORPUS["human_pool_factor"]]
        left = sorted((abs(math.log(x[1]) - math.log(y[1])), i, j) for i, x in enumerate(ai) for j, y in enumerate(human))
        used_ai, used_human, rank = set(), set(), 0
        for _, i, j in left:
            if i not in used_ai and j not in used_human:
                used_ai.add(i)
                used_human.add(j)
                rank += 1
                want.add((repo, rank, ai[i][0], human[j][0]))
    assert len(sides["1", True]) > CORPUS["rows_per_class_per_repo"]
    assert {tuple(r) for r in queries.size_matched_pairs(spark, str(tmp_path)).collect()} == want


def test_first_rows_and_samples_of_groups(spark):
    from pyspark.sql import functions as F

    from quillstone.operators import sampling

    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 20, "b").when(F.col("id") % 7 == 1, None).otherwise("c").alias("g")).repartition(9)
    want = {}
    for r in sorted(rows.collect(), key=lambda r: -r["id"]):
        want.setdefault(r["g"], []).append(r["id"])
    got = sampling.first_n(rows, ["g"], [F.col("id").desc()], 30)
    assert got.columns == ["id", "g"] and sorted((str(r["g"]), r["id"]) for r in got.collect()) == sorted((str(g), i) for g, ids in want.items() for i in ids[:30])
    key = F.xxhash64("id")
    order = {r["id"]: (r["late"], r["k"] % (1 << 53), r["k"]) for r in rows.select("id", key.alias("k"), (F.col("id") % 2 == 0).alias("late")).collect()}
    found = sampling.collect_sample(rows.union(rows), "g", 25, key, F.col("id") % 2 == 0)
    for g, ids in want.items():
        own = [r["id"] for r in found if r["g"] == g]
        assert own == ([] if g is None else sorted(ids, key=order.__getitem__)[:25])
    assert {r["g"] for r in sampling.collect_sample(rows, "g", 5, key, groups=1)} == {"c"}
    assert sampling.collect_sample(rows.limit(0), "g", 5, key) == []
