"""Git history as tables: a log source, and diffs of commits."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RECORD, FIELD = "\x1e", "\x1f"
#: Bytes of diffs that are held before they are handed on.
SHOW_BYTES = 1 << 24
LOG_SCHEMA = "repo string, pos long, sha string, author string, committer string, date string, committed string, month string, subject string, body string, paths array<string>"
_FORMAT = RECORD + FIELD.join(["%H", "%an <%ae>", "%cn <%ce>", "%aI", "%cI", "%ad", "%s", "%b"]) + FIELD


def run_git(repo: str, *args: str) -> str:
    """Output as UTF-8, bad bytes replaced, line ends untouched."""
    out = subprocess.run(["git", "--literal-pathspecs", "-C", repo, *args], capture_output=True, check=False)
    if out.returncode:
        raise RuntimeError(out.stderr.decode("utf-8", "replace").strip() or "git failed")
    return out.stdout.decode("utf-8", "replace")


def parse_log(text: str) -> Iterator[tuple]:
    """Records of 8 fields, and the changed paths of the NUL-separated entries after
    them, as they are, without quotes; other records are dropped."""
    width = _FORMAT.count(FIELD)
    for *fields, entries in (r.split(FIELD) for r in text.split(RECORD)[1:]):
        if len(fields) != width:
            continue
        tail = iter(entries.split("\0"))
        paths = [next(tail, "") for entry in tail if entry.lstrip("\n").startswith(":")]
        yield (*fields[:-1], fields[-1].strip("\n"), paths)


class _Repo(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Repo]:
        return [_Repo(p) for p in self.options["path"].split(",") if p]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        args = ["log", "-z", "--no-merges", "--no-renames", "--raw", "--no-abbrev", "--reverse", "--date=format:%Y-%m", f"--format={_FORMAT}"]
        args += [f"--{k}={self.options[k]}" for k in ("since", "until") if self.options.get(k)]
        for pos, row in enumerate(parse_log(run_git(partition.path, *args))):
            yield (partition.path, pos, *row)


class GitLog(DataSource):
    """format("gitlog") with path (comma-separated repositories), since and until:
    a row a commit without merges, oldest first. A partition reads one repository.
    date and month are the author's own; committed, since and until are of the
    commit date."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))


def git_log(spark: SparkSession, repos: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    spark.dataSource.register(GitLog)
    options = {k: str(v) for k, v in {"since": since, "until": until}.items() if v}
    return spark.read.format("gitlog").options(path=",".join(repos), **options).load()


def git_show(commits: DataFrame, renames: bool = True) -> DataFrame:
    """commits(repo, sha) to (repo, sha, diff, error). With paths, only those. One
    unreadable commit doesn't stop the rest: its error is a column."""
    has_paths = "paths" in commits.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["repo", "sha", "diff", "error"]
        for frame in frames:
            rows, held = [], 0
            for row in frame.itertuples(index=False):
                args = ["show", "--format=", "--unified=3", "--no-color", "--no-ext-diff", "-m", "--first-parent", *([] if renames else ["--no-renames"]), row.sha]
                try:
                    rows.append((row.repo, row.sha, run_git(row.repo, *args, *(["--", *row.paths] if has_paths else [])), None))
                except Exception as e:
                    rows.append((row.repo, row.sha, None, f"{type(e).__name__}: {e}"))
                held += len(rows[-1][2] or "")
                if held > SHOW_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    columns = ["repo", "sha", *(["paths"] if has_paths else [])]
    return commits.select(columns).mapInPandas(run, "repo string, sha string, diff string, error string")


def in_range(rows: DataFrame, date: str = "committed", since: str | None = None, until: str | None = None) -> DataFrame:
    at = F.to_timestamp(date)
    if since:
        rows = rows.where(at >= F.to_timestamp(F.lit(str(since))))
    if until:
        rows = rows.where(at < F.to_timestamp(F.lit(str(until))))
    return rows
