"""Unified diffs: a parser that yields files and hunk lines, and post-images."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_ESCAPES = {"n": 10, "t": 9, "r": 13, '"': 34, "\\": 92, "a": 7, "b": 8, "f": 12, "v": 11}
LINES = "file_no int, path string, is_added boolean, is_removed boolean, is_binary boolean, hunk_no int, line_no int, kind string, value string"


def unquote(name: str) -> str:
    """A path as git quotes it: C escapes over UTF-8 bytes."""
    if not (len(name) > 1 and name[0] == name[-1] == '"'):
        return name
    out, i, body = bytearray(), 0, name[1:-1]
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            octal = re.match(r"[0-7]{3}", body[i + 1 :])
            if octal:
                out.append(int(octal[0], 8) & 255)
                i += 4
                continue
            out.append(_ESCAPES.get(body[i + 1], ord(body[i + 1]) & 255))
            i += 2
            continue
        out += c.encode("utf-8", "replace")
        i += 1
    return out.decode("utf-8", "replace")


def _side(name: str) -> str | None:
    name = unquote(name.split("\t")[0] if not name.startswith('"') else name.rstrip())
    if name == "/dev/null":
        return None
    return name[2:] if name[:2] in ("a/", "b/") else name


def parse_diff(text: str) -> Iterator[tuple]:
    """Rows of LINES. A file without hunks gives one row with null hunk_no. Hunk
    lengths decide what is content, so a removed line "--- x" is no header. Lines
    end at "\\n" only."""
    lines = (text or "").split("\n")
    i, file_no, n = 0, -1, len(lines)
    state: dict = {}
    emitted = True

    def head() -> tuple:
        path = state.get("new") or state.get("old") or state.get("name")
        return file_no, path, state.get("added", False), state.get("removed", False), state.get("binary", False)

    hunk = 0
    while i < n:
        line = lines[i]
        if line.startswith("diff --git "):
            if not emitted:
                yield (*head(), None, None, None, None)
            file_no, hunk, emitted = file_no + 1, 0, False
            m = re.match(r'diff --git ("?a/.*?"?) ("?b/.*"?)$', line)
            state = {"git": True, "name": _side(m[2]) if m else None}
        elif line.startswith("new file mode"):
            state["added"] = True
        elif line.startswith("deleted file mode"):
            state["removed"] = True
        elif line.startswith("rename to "):
            state["name"] = unquote(line[10:])
        elif line.startswith("Binary files ") or line.startswith("GIT binary patch"):
            state["binary"] = True
        elif line.startswith("--- ") and i + 1 < n and lines[i + 1].startswith("+++ "):
            if not state.get("git") or hunk:
                if not emitted:
                    yield (*head(), None, None, None, None)
                file_no, hunk, emitted, state = file_no + 1, 0, False, {}
            state["old"], state["new"] = _side(line[4:]), _side(lines[i + 1][4:])
            state["added"] = state.get("added", False) or state["old"] is None
            state["removed"] = state.get("removed", False) or state["new"] is None
            i += 1
        elif (m := _HUNK.match(line)) and not emitted or m and hunk:
            old, new = (int(x) if x is not None else 1 for x in m.groups())
            hunk, number, emitted = hunk + 1, 0, True
            while (old > 0 or new > 0) and i + 1 < n:
                i += 1
                mark, value = lines[i][:1] or " ", lines[i][1:]
                if mark == "\\":
                    continue
                number += 1
                old -= mark != "+"
                new -= mark != "-"
                ends = not (i + 1 < n and lines[i + 1].startswith("\\"))
                yield (*head(), hunk, number, {"+": "added", "-": "removed"}.get(mark, "context"), value + "\n" * ends)
        i += 1
    if not emitted:
        yield (*head(), None, None, None, None)


def diff_lines(diffs: DataFrame, key: str = "commit") -> DataFrame:
    """diffs(<key>, diff) to a row a hunk line, with <key>."""
    names = [c.split()[0] for c in LINES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, text in zip(frame[key], frame["diff"], strict=True):
                rows = list(parse_diff(text))
                if rows:
                    out = pd.DataFrame(rows, columns=names)
                    out.insert(0, key, k)
                    yield out.astype({"hunk_no": "Int32", "line_no": "Int32"})

    kind = diffs.schema[key].dataType.simpleString()
    return diffs.select(key, "diff").mapInPandas(run, f"{key} {kind}, {LINES}")


def post_images(lines: DataFrame, key: str = "commit") -> DataFrame:
    """The text of each file after the change, as far as hunks show it, and its
    numbers of added, removed and changed lines. CRLF becomes LF at the end; a lone
    CR stays."""
    kept = F.when(F.col("kind") != "removed", F.struct("hunk_no", "line_no", "value"))
    per = lines.groupBy(key, "file_no").agg(
        F.first("path").alias("path"), F.first("is_added").alias("is_added"), F.first("is_removed").alias("is_removed"), F.first("is_binary").alias("is_binary"),
        F.array_sort(F.collect_list(kept)).alias("lines"), F.count_if(F.col("kind") == "added").alias("n_added"), F.count_if(F.col("kind") == "removed").alias("n_removed"),
    )
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "")
    return per.select(
        key, "file_no", "path", "is_added", "is_removed", "is_binary", F.replace(text, F.lit("\r\n"), F.lit("\n")).alias("text"),
        "n_added", "n_removed", (F.col("n_added") + F.col("n_removed")).alias("changed"),
    )
