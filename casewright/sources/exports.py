"""CSV exports of evaluation frames and of filtered-out rows."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame

from casewright import vocab
from casewright.operators.filters import split_insufficient


def _write_csv(df: DataFrame, path: str) -> None:
    # Texts hold line breaks and quotes; doubled quotes keep them readable elsewhere.
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, escape='"', **whole).csv(path)


def select_eval_columns(df: DataFrame, columns: Sequence[str] = vocab.EVAL_COLUMNS) -> DataFrame:
    """The wanted columns that exist; warns about missing ones and fails if none exists."""
    present = [c for c in columns if c in df.columns]
    missing = [c for c in columns if c not in df.columns]
    if not present:
        raise ValueError(f"no column to export among {list(columns)}")
    if missing:
        warnings.warn(f"not exported, absent: {missing}", stacklevel=2)
    return df.select(*present)


def export_eval_csv(df: DataFrame, path: str, columns: Sequence[str] = vocab.EVAL_COLUMNS) -> str:
    """Detailed evaluation data as a CSV folder; the path gets a .csv ending."""
    path = path if path.endswith(".csv") else f"{path}.csv"
    _write_csv(select_eval_columns(df, columns), path)
    return path


def export_insufficient(
    df: DataFrame, path: str, patterns: Sequence[str] = vocab.INSUFFICIENT_PATTERNS
) -> DataFrame:
    """Write the rows with insufficient information aside and return the rest."""
    kept, dropped = split_insufficient(df, patterns)
    _write_csv(dropped.select(*[c for c in vocab.EVAL_COLUMNS if c in dropped.columns]), path)
    return kept


def review_sample(df: DataFrame, n: int = 200, order: str = "llm_caseID") -> DataFrame:
    """The first n cases in id order, for human review."""
    return df.orderBy(order).limit(n)


def export_review_sample(
    df: DataFrame, full_path: str, sample_path: str, n: int = 200, order: str = "llm_caseID"
) -> None:
    """The full result and its review sample as CSV."""
    _write_csv(df, full_path)
    _write_csv(review_sample(df, n, order), sample_path)
