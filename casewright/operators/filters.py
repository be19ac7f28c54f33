"""Row-level filters, flags and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import vocab


def normalize_text(df: DataFrame, lower: Sequence[str] = (), strings: Sequence[str] = ()) -> DataFrame:
    """Cast ``strings`` and ``lower`` columns to string, lower-casing the latter. Null stays null."""
    changed = {c: F.col(c).cast("string") for c in strings}
    changed.update({c: F.lower(F.col(c).cast("string")) for c in lower})
    return df.withColumns(changed)


def _in(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(c.isin(list(values)), F.lit(False))


def whole_word(c: Column, keywords: Sequence[str]) -> Column:
    """Any keyword as a whole word, ignoring case; null is no hit."""
    words = "|".join(rf"\Q{k}\E" for k in keywords)
    return F.coalesce(c.rlike(rf"(?iU)\b(?:{words})\b"), F.lit(False))


def is_specialty_note(
    types: Sequence[str] = vocab.NOTE_TYPES,
    titles: Sequence[str] = vocab.NOTE_TITLES,
    keywords: Sequence[str] = vocab.AUTHOR_KEYWORDS,
    columns: Sequence[str] = ("author", "linked_author"),
) -> Column:
    """A specialty keyword in any of ``columns``, ignoring case, and a known type or title."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | whole_word(F.col(c), keywords)
    known = _in(F.col("type"), types) | _in(F.col("title"), titles)
    return known & hit


def extract_notes(
    notes: DataFrame,
    types: Sequence[str] = vocab.NOTE_TYPES,
    titles: Sequence[str] = vocab.NOTE_TITLES,
    keywords: Sequence[str] = vocab.AUTHOR_KEYWORDS,
    columns: Sequence[str] = ("author", "linked_author"),
) -> DataFrame:
    """The specialty notes, with their text in lower case."""
    found = notes.filter(is_specialty_note(types, titles, keywords, columns))
    return normalize_text(found, lower=["text"], strings=["type", "title"])


def extract_reports(
    reports: DataFrame,
    types: Sequence[str] = vocab.REPORT_TYPES,
    titles: Sequence[str] = vocab.REPORT_TITLES,
    combine: str = "and",
) -> DataFrame:
    """Reports of a known type and title (``combine="or"``: type or title); text in lower case."""
    by_type, by_title = _in(F.col("type"), types), _in(F.col("title"), titles)
    known = by_type & by_title if combine == "and" else by_type | by_title
    return normalize_text(reports.filter(known), lower=["text"], strings=["type", "title"])


def code_in(
    code: Column, codes: Sequence[str], code_type: Column | None = None, system: str | None = vocab.CODE_SYSTEM
) -> Column:
    """The code is in the set and, when a code type is given, of that system (any case)."""
    hit = _in(code.cast("string"), codes)
    if code_type is None or system is None:
        return hit
    return hit & F.coalesce(F.upper(code_type) == system.upper(), F.lit(False))


def before_cutoff(date: Column, cutoff: Column) -> Column:
    """Strictly before the cutoff; without a cutoff everything counts, undated rows too."""
    return cutoff.isNull() | F.coalesce(date < cutoff, F.lit(False))


def has_items(c: Column) -> Column:
    """A nested list that is neither null nor empty."""
    return F.coalesce(F.size(c), F.lit(0)) > 0


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def is_insufficient(c: Column, patterns: Sequence[str] = vocab.INSUFFICIENT_PATTERNS) -> Column:
    """Any pattern as a substring, ignoring case; null and empty are not insufficient."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.lower(c).contains(p.lower())
    return F.coalesce(hit, F.lit(False))


def split_insufficient(
    df: DataFrame, patterns: Sequence[str] = vocab.INSUFFICIENT_PATTERNS, column: str = "reasoning"
) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by ``is_insufficient``."""
    mask = is_insufficient(F.col(column), patterns)
    return df.filter(~mask), df.filter(mask)


def to_binary(c: Column, mapping: Mapping | None = None, mode: str = "exact") -> Column:
    """1/0/null from a mapping (default Yes/No).

    ``mode="yes"``: 1 for any case of yes, 0 for everything else including null.
    """
    if mode == "yes":
        return F.when(F.lower(c) == "yes", 1).otherwise(0)
    result = None
    for value, number in (mapping or {"Yes": 1, "No": 0}).items():
        result = F.when(c == value, number) if result is None else result.when(c == value, number)
    return result


def outcome_label(actual: Column, pred: Column) -> Column:
    """TP, TN, FP or FN; null when either side is null."""
    return (
        F.when((actual == 1) & (pred == 1), "TP")
        .when((actual == 0) & (pred == 0), "TN")
        .when((actual == 0) & (pred == 1), "FP")
        .when((actual == 1) & (pred == 0), "FN")
    )


def is_correct(actual: Column, pred: Column) -> Column:
    return actual == pred


def range_bucket(c: Column, edges: Sequence[int] = vocab.CASE_RANGE_EDGES) -> Column:
    """Number (from 0) of the half-open range [edge, next edge) holding the value; the last has no end."""
    result = F.lit(None).cast("int")
    for n, lo in enumerate(edges):
        result = F.when(c >= lo, F.lit(n)).otherwise(result)
    return result


def between_cases(df: DataFrame, lo: int, hi: int, column: str = "llm_caseID") -> DataFrame:
    """Cases with lo <= id < hi."""
    return df.filter((F.col(column) >= lo) & (F.col(column) < hi))


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The frame itself, or an error naming the missing columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns absent: {missing}")
    return df


def fill_patient_defaults(df: DataFrame) -> DataFrame:
    """False flags and empty lists where an outer join left nulls."""
    changed = {}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "boolean":
            changed[field.name] = F.coalesce(F.col(field.name), F.lit(False))
        elif kind.startswith("array"):
            changed[field.name] = F.coalesce(F.col(field.name), F.array().cast(kind))
    return df.withColumns(changed) if changed else df
