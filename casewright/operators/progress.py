"""Resume logic and run bookkeeping over result frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASE_ID = "llm_caseID"


def completed_ids(results: DataFrame, key: str = CASE_ID) -> DataFrame:
    return results.select(key).distinct()


def pending(cases: DataFrame, results: DataFrame, key: str = CASE_ID) -> DataFrame:
    """Cases without a stored result; completeness is by case id only."""
    return cases.join(completed_ids(results, key), key, "left_anti")


def missing_cases(cases: DataFrame, results: DataFrame, key: str = CASE_ID) -> DataFrame:
    """Ids of input cases that no result covers."""
    return pending(cases.select(key).distinct(), results, key)


def completed_batches(
    cases: DataFrame, results: DataFrame, batch: str = "batch_no", key: str = CASE_ID
) -> DataFrame:
    """Per batch: size, done count and whether every case has a result."""
    done = completed_ids(results, key).withColumn("_done", F.lit(True))
    marked = cases.select(batch, key).join(done, key, "left")
    return marked.groupBy(batch).agg(
        F.count("*").alias("n_cases"),
        F.count("_done").alias("n_done"),
        F.bool_and(F.col("_done").isNotNull()).alias("complete"),
    )


def combine_results(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def dedup_results(results: DataFrame, priority: list[str], key: str = CASE_ID) -> DataFrame:
    """One row per case: the lowest priority wins, i.e. earlier stored results stay."""
    first = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in priority])
    return results.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def run_summary(results: DataFrame) -> DataFrame:
    """Total, parsed, Yes, No, failed and the success rate of a result frame."""
    decision = F.col("decision")
    return results.agg(
        F.count("*").alias("total"),
        F.count(decision).alias("parsed"),
        F.count_if(decision == "Yes").alias("n_yes"),
        F.count_if(decision == "No").alias("n_no"),
    ).select(
        "*",
        (F.col("total") - F.col("parsed")).alias("failed"),
        _share(F.col("parsed"), F.col("total")).alias("success_rate"),
    )


def progress_status(cases: DataFrame, results: DataFrame, key: str = CASE_ID, sample: int = 10) -> DataFrame:
    """One row: total, done, remaining, their shares and the first done ids."""
    done = completed_ids(results, key)
    first = done.orderBy(key).limit(sample)
    counted = cases.agg(F.count("*").alias("total")).withColumns(
        {
            "done": done.agg(F.count("*").alias("n")).scalar(),
            "first_done": first.agg(F.array_sort(F.collect_list(key)).alias("ids")).scalar(),
        }
    )
    remaining = F.col("total") - F.col("done")
    return counted.select(
        "total",
        "done",
        remaining.alias("remaining"),
        _share(F.col("done"), F.col("total")).alias("done_share"),
        _share(remaining, F.col("total")).alias("remaining_share"),
        "first_done",
    )


def batch_manifest(results: DataFrame, batch: str = "batch_no", key: str = CASE_ID) -> DataFrame:
    """Rows, case id range and parsed count per batch."""
    return results.groupBy(batch).agg(
        F.count("*").alias("n_rows"),
        F.min(key).alias("min_case"),
        F.max(key).alias("max_case"),
        F.count("decision").alias("n_parsed"),
    )
