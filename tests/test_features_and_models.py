from __future__ import annotations

import math

import numpy as np
import pytest

from quillstone.functions.scanner import scan
from quillstone.functions.text_features import with_features
from quillstone.ml import embed, holdout, mlp, stage2

TYPESCRIPT = "// Load the user record\nconst a = '// no comment';  \n/* one\n * two */\nreturn a; // → done"


def test_scanner():
    code, notes = scan("x = '#no' # yes\n'''doc\nmore''' \ny = '''text # kept\nz # c", "Python")
    assert code == ["x = '#no' ", "", " ", "y = '''text # kept", "z "]
    assert notes == ["yes", "doc", "more", "", "c"]
    code, notes = scan(TYPESCRIPT, "TypeScript")
    assert code[1] == "const a = '// no comment';  " and notes == ["Load the user record", "", "one", "two", "→ done"]


def test_features(spark):
    rows = spark.createDataFrame([(TYPESCRIPT, "TypeScript"), ("# TODO: x\nif a is None:\n\tpass\n", "Python"), (None, None)], "code string, language string")
    one, two, none = with_features(rows).collect()
    assert one["comment_line_ratio"] == pytest.approx(3 / 5) and one["typographic_symbols"] == pytest.approx(math.log(2))
    assert one["trailing_ws_ratio"] == pytest.approx(1 / 5) and one["mean_comment_words"] == pytest.approx((4 + 1 + 1 + 2) / 4)
    assert two["todo_count"] == pytest.approx(math.log(2)) and two["null_check_density"] == pytest.approx(1 / 2)
    assert two["blank_line_ratio"] == pytest.approx(1 / 4) and two["max_indent_depth"] == pytest.approx(math.log(2))
    assert two["token_entropy"] == pytest.approx(math.log2(6))
    assert none["token_entropy"] == 0
    with pytest.raises(ValueError, match="unknown features"):
        with_features(rows, ["shoe_size"])


def test_batches():
    assert embed.plan_batches([512, 10, 300, 40, 512, 90, 7, 200], 1024) == [[0, 4], [2, 7, 5], [3, 1, 6]]
    assert embed.plan_batches([5000, 3], 1024) == [[0], [1]]


def test_fallback_splits_and_redoes():
    def narrow(texts):
        if len(texts) > 2:
            raise MemoryError
        return np.array([[float("nan") if t == "x" else len(t)] for t in texts], float)

    got = embed.with_fallback(narrow, ["a", "x", "bbb", "cc", "d"], lambda ts: np.zeros((len(ts), 1)))
    assert got[:, 0].tolist() == [1, 0, 3, 2, 1]


def test_head_learns_and_refuses():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (90, 16)), rng.normal(2, 1, (60, 16))])
    y = np.repeat([0, 1], [90, 60])
    head = mlp.train(x, y, x, y, ["human", "ai"], epochs=30, patience=4)
    assert max(h["val_macro_f1"] for h in head.history) > 0.95
    again = mlp.Head.from_json(head.to_json(), "", ["human", "ai"])
    assert np.allclose(again.probabilities(x), head.probabilities(x))
    with pytest.raises(ValueError, match="classes"):
        mlp.Head.from_json(head.to_json(), "", ["ai", "human"])


def test_group_folds_and_auc():
    assert stage2.group_folds({"a": 5, "b": 4, "c": 3, "d": 1}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert holdout.rank_auc(np.array([0, 0, 0, 1, 1]), np.array([0.1, 0.2, 0.6, 0.5, 0.9])) == pytest.approx(5 / 6)
    assert stage2.active(["human", "ai"], "x", "x") and not stage2.active(["ai", "human"], "x", "x")


def test_out_of_fold_heads_stop_on_other_rows(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 4)), np.arange(60) % 2
    x_val, y_val = rng.normal(size=(20, 4)), np.arange(20) % 2
    groups = [f"g{i % 7}" for i in range(60)]
    calls = []

    class Fake:
        def probabilities(self, rows):
            return np.tile([0.4, 0.6], (len(rows), 1))

    def train(x1, y1, x2, y2, names, **options):
        calls.append(len(x1))
        assert x2 is x_val and y2 is y_val
        return Fake()

    monkeypatch.setattr(stage2.mlp, "train", train)
    p = stage2.out_of_fold(x, y, groups, x_val, y_val, ["human", "ai"], 5)
    assert len(calls) == 5 and sum(60 - n for n in calls) == 60 and (p == 0.6).all()
    with pytest.raises(ValueError, match="two groups"):
        stage2.out_of_fold(x, y, ["one"] * 60, x_val, y_val, ["human", "ai"])


def test_second_stage_end_to_end(spark, tmp_path):
    """Scores of the head say nothing here, comments say all: the trees find it."""
    from quillstone.plans import second_stage

    rows, vectors = [], []
    rng = np.random.default_rng(2)
    for i in range(700):
        ai, split = i % 2, "validation" if i // 2 % 10 == 9 else "test" if i // 2 % 10 == 8 else "train"
        mark = "#" if i % 4 < 2 else "//"
        code = f"{mark} Explain step {i} well\nreturn x_{i}\n" if ai else f"return y_{i}\nz = {i}\n"
        rows.append((code, ai, "Python" if i % 4 < 2 else "Go", split, f"r{i % 9}"))
        vectors.append((code, rng.normal(size=8).tolist()))
    rows.append(rows[0])
    frame = spark.createDataFrame(rows, "code string, label int, language string, split string, repo string")
    from pyspark.sql import functions as F

    own = spark.createDataFrame(vectors, "code string, embedding array<double>").select(embed.content_key(F.col("code")).alias("content_hash"), "embedding", F.lit("r").alias("representation"))
    head = mlp.train(np.array([v for _, v in vectors[:50]]), np.arange(50) % 2, np.array([v for _, v in vectors[50:90]]), np.arange(40) % 2, ["human", "ai"], hidden=(4,), epochs=2, representation="r")
    features = ["comment_char_ratio", "mean_comment_words"]
    model, scored = second_stage.train(frame.where("split = 'train'"), frame.where("split = 'validation'"), frame, own, head, features, iterations=10, hidden=(4,), epochs=2)
    assert scored.count() == 560 and scored.where("p_ai is null").count() == 0
    repos = {r["content_hash"]: r["repo"] for r in second_stage.code_repos(spark.createDataFrame([("a", "z"), ("a", "b"), ("c", "d")], "code string, repo string")).collect()}
    assert sorted(repos.values()) == ["b", "d"]
    from quillstone.functions.text_features import with_features
    from quillstone.plans import train

    test = with_features(train.predictions(frame.where("split = 'test'"), own, head), features)
    table = {r["language"]: (r["n"], r["before"], r["after"]) for r in second_stage.before_and_after(test, model, features).collect()}
    assert table["all"][0] == 70 and table["all"][2] > 0.99 > table["all"][1]
    digest = second_stage.head_digest(head, spark)
    second_stage.save(model, f"{tmp_path}/s2", features, ["Python"], digest, spark)
    assert second_stage.load(spark, f"{tmp_path}/s2", ["human", "ai"], "other") is None
    assert second_stage.load(spark, f"{tmp_path}/s2", ["human", "ai", "x"], digest) is None
    first = lambda r: r.withColumns({"p_human": F.lit(0.7), "p_ai": F.lit(0.3)})
    got = second_stage.scorer(first, second_stage.load(spark, f"{tmp_path}/s2", ["human", "ai"], digest))(frame).collect()
    assert all(abs(r["p_ai"] + r["p_human"] - 1) < 1e-9 for r in got) and all(r["p_ai"] == 0.3 for r in got if r["language"] == "Go")
    assert all((r["p_ai"] > 0.5) == bool(r["label"]) for r in got if r["language"] == "Python")
    assert second_stage.scorer(first, None) is first
