"""Predicates on commits, paths and licences."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AGENT_SIGNATURES, AUTONOMOUS_AUTHOR, EXCLUDED_BOTS, LICENSES, REACT_IMPORT, REACT_LANGUAGES

_FLAGS = "(?imU)"


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + pattern)


def identity(author: Column, committer: Column) -> Column:
    return F.concat_ws("\n", author, committer)


def detect_agents(author: Column, committer: Column, subject: Column, body: Column, signatures=None) -> Column:
    """Families with a matching signature, in their order."""
    texts = {"trailer": body, "footer": body, "subject": subject, "identity": identity(author, committer)}
    hits = []
    for family, rules in (signatures or AGENT_SIGNATURES).items():
        any_of = F.lit(False)
        for kind, pattern in rules:
            any_of = any_of | F.coalesce(_found(texts[kind], pattern), F.lit(False))
        hits.append(F.when(any_of, F.lit(family)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def is_excluded_bot(author: Column, committer: Column) -> Column:
    return _found(identity(author, committer), "(?:" + "|".join(EXCLUDED_BOTS) + ")")


def mode(author: Column, agents: Column) -> Column:
    """autonomous if a bot is the author, assisted if a person is; null without agents."""
    bot = author.rlike("(?iU)" + AUTONOMOUS_AUTHOR)
    return F.when(F.size(agents) > 0, F.when(bot, "autonomous").otherwise("assisted"))


def glob_pattern(globs: Sequence[str]) -> str:
    """One anchored pattern for shell globs; * and ? also match a slash."""
    def one(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            c = glob[i]
            close = glob.find("]", i + 2) if c == "[" else -1
            if c == "*":
                out += ".*"
            elif c == "?":
                out += "."
            elif close > 0:
                inner = glob[i + 1 : close]
                out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
                i = close
            else:
                out += re.escape(c)
            i += 1
        return out

    return "(?s)^(?:" + "|".join(map(one, globs)) + ")$"


def suffix(path: Column) -> Column:
    """The last extension of the file name, with its dot, lower-cased; empty where
    there is none. A leading dot starts no extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def wanted_path(path: Column, extensions: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    fits = suffix(path).isin(list(extensions))
    return fits & ~path.rlike(glob_pattern(exclude)) if exclude else fits


def is_react(path: Column, language: Column, code: Column) -> Column:
    marked = F.lower(path).rlike(r"\.(tsx|jsx)$") | code.rlike(REACT_IMPORT)
    return language.isin(REACT_LANGUAGES) & marked


def license_group(spdx: Column, groups=None) -> Column:
    """The first group that lists the id, else null."""
    out = F.lit(None).cast("string")
    for name, ids in reversed(list((groups or LICENSES).items())):
        out = F.when(spdx.isin(ids), F.lit(name)).otherwise(out)
    return out


def redistributable(repos: DataFrame, licenses: DataFrame, groups=None) -> DataFrame:
    """repos(repo, ...) with license and license_group; repos without a group go."""
    found = licenses.select("repo", F.col("spdx").alias("license"), license_group(F.col("spdx"), groups).alias("license_group"))
    return repos.join(found.where("license_group is not null"), "repo")


def language_settings(shared: dict, own: dict) -> dict:
    """A language's settings: the shared ones, its own over them, and its excludes
    after the shared ones."""
    return {**shared, **own, "exclude": [*shared.get("exclude", []), *own.get("exclude", [])]}


def reusable(saved: Column, current: Column, reason: Column, dates_equal: Column, date_reasons: Sequence[str]) -> Column:
    """Whether a stored result stands: equal settings, or a skip whose reason only
    depends on dates that are the same."""
    return F.coalesce(saved.eqNullSafe(current) | (reason.isin(list(date_reasons)) & dates_equal), F.lit(False))
