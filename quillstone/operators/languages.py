"""Language names: canonical form, filter, and checks of a language index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LANGUAGE_ALIASES, LANGUAGES, UNKNOWN_LANGUAGE_CODE

_NAMES = {name.lower(): name for name in LANGUAGES} | LANGUAGE_ALIASES


def canonical_name(name: str | None) -> str | None:
    return None if name is None else _NAMES.get(str(name).strip().lower())


def canonical(name: Column) -> Column:
    """The canonical name, or null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")))


def _resolve(names: Sequence[str]) -> list[str]:
    found = [canonical_name(n) for n in names]
    if None in found:
        bad = names[found.index(None)]
        raise ValueError(f"unknown language {bad!r}; valid names: {', '.join(LANGUAGES)}")
    return found


def language_predicate(language: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column | None:
    """None without any names; else a row passes if its language is known, in
    include (if any) and not in exclude."""
    if not include and not exclude:
        return None
    wanted, unwanted = _resolve(include), _resolve(exclude)
    passes = language.isNotNull()
    if wanted:
        passes &= language.isin(wanted)
    if unwanted:
        passes &= ~language.isin(unwanted)
    return F.coalesce(passes, F.lit(False))


def require_labelled(language: Column) -> Column:
    """The language, or an error where it is null: a filter is set, but the row
    has no label to filter by."""
    return F.when(language.isNull(), F.raise_error(F.lit("a language filter is set, but a row has no language")).cast("string")).otherwise(language)


def fingerprint(code: Column) -> Column:
    return F.when(code.isNull(), F.lit("none")).otherwise(F.substring(F.sha1(code), 1, 16))


def index_languages(index: DataFrame) -> DataFrame:
    """index(split, row, code tinyint) to (split, row, language)."""
    names = F.array(*map(F.lit, LANGUAGES))
    code = F.col("code").cast("int")
    code = F.when(code < 0, code + 256).otherwise(code)
    return index.select("split", "row", F.when(code != UNKNOWN_LANGUAGE_CODE, F.get(names, code)).alias("language"))


def checked_languages(rows: DataFrame, index: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """rows(split, row, code, ...) with language by position; any checkpoint
    (split, row, hash) that differs from its row's fingerprint raises."""
    found = rows.join(index_languages(index), ["split", "row"], "left").join(checkpoints, ["split", "row"], "left")
    wrong = F.col("hash").isNotNull() & (F.col("hash") != fingerprint(F.col("code")))
    checked = F.when(wrong, F.raise_error(F.lit("the language index doesn't belong to these rows")).cast("string")).otherwise(F.col("language"))
    return found.select(*rows.columns, checked.alias("language"))


def exact_match(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """rows(code, ...) with the language of the reference(code, language, pos) row
    of equal content, the last of several; null where there is none."""
    known = reference.groupBy(F.sha1("code").alias("digest")).agg(F.max_by("language", "pos").alias("language"))
    return rows.withColumn("digest", F.sha1("code")).join(known, "digest", "left").drop("digest")


def language_statistics(rows: DataFrame) -> DataFrame:
    """rows(split, language, exact) counted: split, language, exact, classified, rows."""
    return rows.groupBy("split", "language").agg(
        F.count_if("exact").alias("exact"), F.count_if(~F.col("exact")).alias("classified"), F.count("*").alias("rows")
    )


def statistics_table(counts: DataFrame, dataset: str = "dataset", language: str = "language", n: str = "n") -> str:
    """counts as a markdown table: languages by total, share of each dataset, a dash
    for none, and a total row. Reads one row a language."""
    names = sorted(r[0] for r in counts.select(dataset).distinct().collect())
    wide = counts.groupBy(language).pivot(dataset, names).agg(F.sum(n))
    rows = [(r[0], [r[1 + i] or 0 for i in range(len(names))]) for r in wide.collect()]
    rows.sort(key=lambda r: (-sum(r[1]), str(r[0])))
    totals = [sum(r[1][i] for r in rows) for i in range(len(names))]

    def cell(v: int, total: int) -> str:
        return f"{v:,} ({100 * v / total:.1f}%)" if v else "—"

    lines = ["| Language | " + " | ".join(names) + " | Combined |", "|---" * (len(names) + 2) + "|"]
    lines += [f"| {name or 'unknown'} | " + " | ".join(cell(v, t) for v, t in zip(vs, totals, strict=True)) + f" | {sum(vs):,} |" for name, vs in rows]
    lines.append("| **Total** | " + " | ".join(f"{t:,}" for t in totals) + f" | {sum(totals):,} |")
    return "\n".join(lines)
