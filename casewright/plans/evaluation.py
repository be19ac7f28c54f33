"""Evaluation frame and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import vocab
from casewright.operators import metrics as M
from casewright.operators.filters import (
    complete_cases,
    has_items,
    is_correct,
    is_insufficient,
    outcome_label,
    require_columns,
    to_binary,
)
from casewright.session import materialize

RESULT_COLUMNS = ["llm_caseID", "decision", "confidence", "reasoning"]


def attach_results(
    cases: DataFrame, results: DataFrame, key: str = "llm_caseID", how: str = "left", **marks: Column
) -> DataFrame:
    """Cases with the decision, confidence and reasoning of their result, if any.

    ``marks`` are further columns computed on the results before the join.
    """
    found = require_columns(results, RESULT_COLUMNS).select(*RESULT_COLUMNS, *[c.alias(n) for n, c in marks.items()])
    return cases.join(found, key, how)


def build_evaluation(
    cases: DataFrame,
    results: DataFrame,
    patterns: Sequence[str] = vocab.INSUFFICIENT_PATTERNS,
    mode: str = "exact",
) -> tuple[DataFrame, DataFrame]:
    """(evaluation frame, dropped rows): complete cases with 0/1 columns.

    The dropped rows are those whose reasoning says the information was insufficient. That
    is judged before the join, so reports that do not show the reasoning never move it.
    """
    marked = attach_results(
        cases,
        results,
        how="left" if mode == "yes" else "inner",  # in that mode no result counts as No
        _insufficient=is_insufficient(F.col("reasoning"), patterns),
    ).withColumns(
        {
            "llm_surgery": to_binary(F.col("decision"), mode=mode),
            "actual_surgery": to_binary(F.col("had_surgery"), {True: 1, False: 0}),
        }
    )
    complete = complete_cases(marked, ["llm_surgery", "actual_surgery"])
    mask = F.coalesce(F.col("_insufficient"), F.lit(False))
    kept, dropped = complete.filter(~mask).drop("_insufficient"), complete.filter(mask).drop("_insufficient")
    if "has_radiology" not in kept.columns:
        kept = kept.withColumn("has_radiology", has_items(F.col("radiology_reports")))
    actual, pred = F.col("actual_surgery"), F.col("llm_surgery")
    return (
        kept.withColumns({"correct_prediction": is_correct(actual, pred), "outcome": outcome_label(actual, pred)}),
        dropped,
    )


def _statistics(eval_df: DataFrame, by: Sequence[str] = (M.STRATUM,)) -> DataFrame:
    """The few columns the report tables use, written once so that the joins run once."""
    return materialize(eval_df.select(*by, M.ACTUAL, M.PRED, M.CONFIDENCE))


def evaluation_report(eval_df: DataFrame) -> dict[str, DataFrame]:
    """The overall report tables."""
    source = _statistics(eval_df)
    return {
        "metrics": M.binary_metrics(source),
        "auc": M.roc_auc(source),
        "confidence_table": M.confidence_table(source),
        "confidence_corr": M.confidence_corr(source),
        "pearson_test": M.pearson_test(source),
        "confidence_pivot": M.confidence_pivot(source),
        "confusion": M.confusion_table(source),
        "distribution": M.value_distribution(source),
    }


def stratified_report(eval_df: DataFrame, by: str = M.STRATUM) -> dict[str, DataFrame]:
    """The tables with and without a boolean property."""
    source = _statistics(eval_df, [by])
    metrics = M.metrics_by(source, by)
    suffix = by.removeprefix("has_")
    return {
        "metrics": metrics,
        "confidence_table": M.confidence_table(source, [by]),
        "confidence_corr": M.confidence_corr(source, [by], min_n=5),
        "confidence_pivot": M.confidence_pivot(source, [by]),
        "confusion": M.confusion_table(source, [by]),
        "counts": M.stratum_counts(source, [by]),
        "difference": M.metric_difference(metrics, suffix=suffix),
        "findings": M.findings(metrics, suffix),
    }
