"""The thirteen text features. Those of the raw text are built-in expressions;
those of code and comments are read off the scanned lines, in one Arrow function."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ANY_TYPE, FEATURES, LOG_CALL, NULL_CHECK, TODO, TOKEN, TYPOGRAPHIC
from .scanner import scan

_ENDS = r"[\s\x1c-\x1f\x85\p{Z}]"
_SOLID = r"[^\s\x1c-\x1f\x85\p{Z}]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?U)" + pattern)).cast("double")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _solid(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(_SOLID))


def raw_features(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines, solid = _lines(text), _solid(_lines(text))
    n_solid = F.size(solid).cast("double")
    one = F.lit(1.0)
    ended = F.size(F.filter(solid, lambda x: x.rlike(_ENDS + "$(?!\n)")))
    return {
        "todo_count": F.log1p(_count(text, TODO)),
        "trailing_ws_ratio": ended.cast("double") / F.greatest(one, n_solid),
        "blank_line_ratio": one - n_solid / F.greatest(one, F.size(lines).cast("double")),
        "typographic_symbols": F.log1p(_count(text, TYPOGRAPHIC)),
        "non_ascii_ratio": F.char_length(F.regexp_replace(text, r"[\x00-\x7f]", "")).cast("double") / F.greatest(one, F.char_length(text).cast("double")),
    }


SCANNED = ["mean_comment_words", "comment_char_ratio", "comment_line_ratio", "null_check_density", "any_density", "log_call_density", "max_indent_depth", "token_entropy"]
_PATTERNS = {n: re.compile(p) for n, p in (("null", NULL_CHECK), ("any", ANY_TYPE), ("log", LOG_CALL), ("token", TOKEN))}
_INDENT = re.compile(r"[ \t]*")


def scanned_features(text: str | None, language: str | None) -> tuple[float, ...]:
    """The features of one text that need its code and comments apart, in the order
    of SCANNED. Each is read off the scanned lines once."""
    text = text or ""
    code, comments = scan(text, language)
    rows = [(line, c, n) for line, c, n in zip(text.split("\n"), code, comments, strict=True) if line.strip()]
    notes = [n for _, _, n in rows if n]
    with_code = [line for line, c, _ in rows if c.strip()]
    joined = "\n".join(code)
    count = {k: sum(1 for _ in _PATTERNS[k].finditer(joined)) / max(1, len(with_code)) for k in ("null", "any", "log")}
    indents = [_INDENT.match(line).end() for line in with_code]
    unit = min((i for i in indents if i), default=1)
    tokens = Counter(_PATTERNS["token"].findall(joined))
    n = sum(tokens.values())
    return (
        sum(len(x.split()) for x in notes) / len(notes) if notes else 0.0,
        sum(map(len, notes)) / max(1, len(text)),
        sum(1 for _, c, x in rows if x and not c.strip()) / max(1, len(rows)),
        count["null"], count["any"], count["log"],
        math.log1p(max(indents, default=0) / unit),
        math.log2(n) - math.fsum(k * math.log2(k) for k in sorted(tokens.values())) / n if n else 0.0,
    )


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SCANNED]))
def _scanned(text: pd.Series, language: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scanned_features(t, x) for t, x in zip(text, language, strict=True)], columns=SCANNED)


def with_features(rows: DataFrame, names: Sequence[str] = tuple(FEATURES), text: str = "code", language: str = "language") -> DataFrame:
    unknown = [n for n in names if n not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features {unknown}; available: {', '.join(FEATURES)}")
    found = raw_features(F.col(text))
    if any(n in SCANNED for n in names):
        rows = rows.withColumn("__scan", _scanned(F.col(text), F.col(language)))
        found |= {n: F.col("__scan")[n] for n in SCANNED}
    return rows.withColumns({n: found[n] for n in names}).drop("__scan")
