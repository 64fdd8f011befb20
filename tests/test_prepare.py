"""Dataset building: the small cases, and the capped fold against a plain loop."""

from __future__ import annotations

import random

import pytest

from quillstone.operators import prepare

SCHEMA = "source_order int, pos long, code string, cls string, language string"


def frame(spark, rows):
    return spark.createDataFrame([(s, i, c, k, x) for i, (s, c, k, x) in enumerate(rows)], SCHEMA)


def codes(df):
    return sorted(r["code"] for r in df.collect())


def test_uncapped_keeps_all_of_the_classes(spark):
    rows = frame(spark, [(0, "h1", "human", None), (0, "h2", "human", None), (0, "a1", "ai", None), (1, "h3", "human", None), (1, "c1", "co_authored", None)])
    assert codes(prepare.prepare(rows, ["human", "ai", "co_authored"])) == ["a1", "c1", "h1", "h2", "h3"]
    assert codes(prepare.prepare(rows, ["human", "ai"])) == ["a1", "h1", "h2", "h3"]


def test_cap_runs_across_sources(spark):
    rows = frame(spark, [(0, "h1", "human", None), (0, "h2", "human", None), (1, "h3", "human", None), (1, "h4", "human", None)])
    assert codes(prepare.prepare(rows, ["human", "ai"], cap=3)) == ["h1", "h2", "h3"]


def test_blank_code_goes(spark):
    rows = frame(spark, [(0, None, "ai", None), (0, " \t \n", "ai", None), (0, " \x1c", "ai", None), (0, "real code", "ai", None)])
    assert codes(prepare.prepare(rows, ["human", "ai"])) == ["real code"]


def test_remap_then_cap(spark):
    rows = frame(spark, [(0, "h1", "human", None), (0, "c1", "co_authored", None), (0, "a1", "ai", None), (0, "c2", "co_authored", None)])
    out = prepare.prepare(rows, ["human", "ai"], {"co_authored": "human"}, cap=2)
    assert {(r["code"], r["label"]) for r in out.collect()} == {("h1", 0), ("c1", 0), ("a1", 1)}


def test_balanced_languages(spark):
    rows = [(0, f"{x}{c}{i}", c, x) for x in ("TypeScript", "JavaScript") for c in ("human", "ai") for i in range(10)]
    out = prepare.prepare(frame(spark, rows), ["human", "ai"], cap=4, include=["ts", "js"], balance=True)
    assert {tuple(r) for r in out.groupBy("language", "label").count().collect()} == {(x, k, 2) for x in ("TypeScript", "JavaScript") for k in (0, 1)}


def test_unlabelled_row_with_a_filter_raises(spark):
    rows = frame(spark, [(0, "x", "ai", None)])
    with pytest.raises(Exception, match="no language"):
        prepare.prepare(rows, ["human", "ai"], include=["Python"]).collect()


def test_capped_admission_matches_a_plain_loop(spark):
    rng = random.Random(3)
    for _ in range(6):
        rows = [(0, rng.choice("abcdefg"), rng.choice(["human", "ai"]), None) for _ in range(25)]
        cap = rng.randint(1, 4)
        filled, seen, want = {"human": 0, "ai": 0}, set(), []
        for i, (_, code, cls, _) in enumerate(rows):
            if filled[cls] < cap and code not in seen:
                filled[cls] += 1
                seen.add(code)
                want.append(i)
        got = sorted(r["pos"] for r in prepare.prepare(frame(spark, rows), ["human", "ai"], cap=cap).collect())
        assert got == want
