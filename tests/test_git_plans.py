"""Git sources and the plans on them, over a throwaway repository."""

from __future__ import annotations

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quillstone import config
from quillstone.plans import classify, corpus, report
from quillstone.sources import git, logs, snippets


def commit(repo, files, date, message="work", author="Ann <ann@x.org>", committed=None):
    for name, content in files.items():
        path = repo / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    name, mail = author.rstrip(">").split(" <")
    env = {**os.environ, "GIT_AUTHOR_NAME": name, "GIT_AUTHOR_EMAIL": mail, "GIT_COMMITTER_NAME": name, "GIT_COMMITTER_EMAIL": mail, "GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": committed or date}
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True, env=env)
    subprocess.run(["git", "-C", str(repo), "commit", "-qm", message], check=True, env=env)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    subprocess.run(["git", "init", "-q", str(path)], check=True)
    subprocess.run(["git", "-C", str(path), "config", "core.autocrlf", "false"], check=True)
    body = "\n".join(f"const x{i} = {i};" for i in range(8))
    commit(path, {"src/a.ts": body, "notes.md": "x"}, "2020-01-31T23:30:00-05:00")
    commit(path, {"src/b.ts": body + "\n" + body}, "2020-03-02T10:00:00+00:00")
    commit(path, {"win.py": b"a = 1\r\nb = 'x\ry'\r\nc = 2\r\n"}, "2023-01-05T10:00:00+00:00")
    commit(path, {"src/View.tsx": "import React from 'react';\n" + body}, "2024-05-01T10:00:00+00:00", "ui\n\nCo-Authored-By: Claude <n@x>")
    commit(path, {"README.md": "only text"}, "2024-06-01T10:00:00+00:00")
    return str(path)


def long_is_ai(files):
    p = F.when(F.col("changed") > 8, 0.9).otherwise(0.2)
    return files.withColumns({"p_ai": p, "p_human": 1 - p})


def test_log(spark, repo):
    rows = git.git_log(spark, [repo]).orderBy("pos").collect()
    assert [r["month"] for r in rows] == ["2020-01", "2020-03", "2023-01", "2024-05", "2024-06"]
    assert rows[0]["paths"] == ["notes.md", "src/a.ts"] and rows[0]["author"] == "Ann <ann@x.org>"
    assert git.git_log(spark, [repo], since="2024-01-01").count() == 2
    assert list(git.parse_log("junk\x1eonly\x1ftwo")) == []


def test_odd_paths_and_two_dates(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    odd = ["src/é.py", 'a "b".py', ":c.py", "tab\there.py"]
    commit(tmp_path, {x: "x = 1\n" for x in odd}, "2020-01-05T10:00:00+00:00", "one\n\nbody", committed="2024-02-05T10:00:00+00:00")
    commit(tmp_path, {"b.py": "y = 2\n"}, "2024-03-05T10:00:00+00:00")
    rows = git.git_log(spark, [str(tmp_path)]).orderBy("pos").collect()
    assert sorted(rows[0]["paths"]) == sorted(odd) and rows[0]["body"] == "body" and rows[1]["paths"] == ["b.py"]
    assert rows[0]["month"] == "2020-01" and rows[0]["committed"].startswith("2024-02-05")
    log = git.git_log(spark, [str(tmp_path)])
    # by the commit date no commit is older than 2021
    assert corpus.candidates(log, "2020-01-01", "2021-01-01").count() == 0 and corpus.candidates(log, "2020-01-01", "2024-03-01").count() == 1
    assert [r["month"] for r in git.in_range(log, since="2024-01-01", until="2024-03-01").collect()] == ["2020-01"]
    shown = git.git_show(log.select("repo", "sha", "paths"))
    files = classify.changed_files(shown.where("error is null")).collect()
    assert {r["path"] for r in files} == {*odd, "b.py"}


def test_classify_and_errors(spark, repo):
    log = git.git_log(spark, [repo]).select("repo", "sha", "month")
    shown = git.git_show(log.union(spark.createDataFrame([(repo, "0" * 40, "2024-01")], log.schema)))
    assert shown.where("error is not null").count() == 1
    files, commits = classify.classify(shown.where("error is null"), long_is_ai)
    by_path = {r["path"]: (r["lines_changed"], r["code"], r["language"]) for r in files.collect()}
    assert by_path["win.py"] == (3, "a = 1\nb = 'x\ry'\nc = 2\n", "python") and set(by_path) == {"src/a.ts", "src/b.ts", "win.py", "src/View.tsx"}
    assert commits.count() == 4


def test_report_is_incremental(spark, repo, tmp_path):
    cache = f"{tmp_path}/cache"
    rows = report.update(spark, repo, cache, "m1", long_is_ai)
    data = report.report(rows, repo, "m1")
    assert data["n_classified"] == 4 and data["n_skipped"] == 1 and data["months"][0]["month"] == "2020-01" and len(data["months"]) == 54
    assert data["scored_languages"] == ["python", "typescript"] and data["languages"]["python"]["n_classified"] == 1
    n = report.read_cache(spark, cache).count()
    assert report.update(spark, repo, cache, "m1", long_is_ai).count() == 5 and report.read_cache(spark, cache).count() == n
    report.update(spark, repo, cache, "m2", long_is_ai)
    assert report.read_cache(spark, cache).count() == 2 * n
    page = report.page({**data, "repo": "</script>&"})
    assert "</script>&" not in page and json.loads(page.split("const data = ")[1].split(";\n")[0])["repo"] == "</script>&"


def test_corpus(spark, repo, tmp_path):
    log = corpus.candidates(git.git_log(spark, [repo]), "2024-01-01", "2021-06-01")
    assert sorted(r["label"] for r in log.collect()) == ["ai", "human", "human"]
    rows = corpus.file_rows(log, "TypeScript")
    pairs = corpus.repo_pairs(rows)
    found = {r["label"]: (r["path"], r["react"], r["mode"]) for r in pairs.collect()}
    assert found == {"ai": ("src/View.tsx", True, "assisted"), "human": ("src/a.ts", False, None)}
    out = corpus.write_splits(pairs, f"{tmp_path}/splits").collect()
    assert {(r["language"], r["repos"], r["human"], r["ai"], r["react"]) for r in out} == {(None, 1, 1, 1, 1), ("TypeScript", 1, 1, 1, 1)}


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("train", 0, "a", 0), ("train", 1, "b", 3), ("train", 2, "c", 9)], "split string, row long, code string, label int")
    assert [(r["pos"], r["cls"]) for r in snippets.source_a(rows).orderBy("pos").collect()] == [(0, "human"), (1, "ai")]
    assert snippets.agent_commit_rows(spark, str(tmp_path), [], "train").count() == 0
    (tmp_path / "train.jsonl").write_text('{"code": "x", "label": "ai", "language": "py"}\n')
    own = snippets.source_agent(snippets.agent_commit_rows(spark, str(tmp_path), [], "train"))
    assert [(r["cls"], r["language"]) for r in snippets.union_sources([("agents", own)], "train").collect()] == [("ai", "Python")]
    assert logs.read_log(spark, f"{tmp_path}/none.jsonl", "epoch int").count() == 0


def test_config():
    found = config.merged(config.DEFAULTS, {"classes": {"names": ["a"]}, "known_repos": [{"name": "x"}]})
    assert found["classes"] == {"names": ["a"], "remap": {}} and len(found["known_repos"]) == 1
