"""The commands in a row: prepare, embed, train, evaluate, classify, report."""

from __future__ import annotations

import os

from test_git_plans import commit  # noqa: F401
from test_git_plans import repo as repo  # noqa: PLC0414

from quillstone import cli
from quillstone.ml import embed


def test_commands_in_a_row(spark, repo, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    rows = []
    for split in ("train", "validation", "test"):
        for i in range(30):
            rows.append((0, len(rows), f"const x{i} = compute(value{i}, {split!r});", "human", "TypeScript", split))
            rows.append((0, len(rows), f"# Explain step {i} in {split}\nreturn result_{i}", "ai", "Python", split))
    spark.createDataFrame(rows, "source_order int, pos long, code string, cls string, language string, split string").write.parquet(at("raw"))
    run = lambda *args: cli.main(list(args), spark)
    run("prepare", at("raw"), at("rows"))
    run("embed", at("rows"), at("vectors"))
    run("embed", at("rows"), at("vectors"))  # nothing is left to do
    vectors = spark.read.parquet(at("vectors"))
    assert vectors.count() == 180 and embed.missing(spark.read.parquet(at("rows")), vectors, "hashed-256").count() == 0
    run("train", at("rows"), at("vectors"), at("head.json"))
    run("evaluate", at("rows"), at("vectors"), at("head.json"))
    assert "1.0" in capsys.readouterr().out
    sha = os.popen(f"git -C {repo} log --format=%H --reverse").read().split()[0]
    run("classify-commit", repo, sha, "--model", at("head.json"))
    assert "src/a.ts" in capsys.readouterr().out
    run("evaluate-repo", "--repo", repo, "--expected", "human", "--model", at("head.json"), "--log", at("log"))
    run("monitor", "--log", at("log"))
    assert "human" in capsys.readouterr().out
    run("report", repo, "--model", at("head.json"), "--cache", at("cache"), "--out", at("page.html"))
    with open(at("page.html"), encoding="utf-8") as f:
        assert "2020-03" in f.read()
