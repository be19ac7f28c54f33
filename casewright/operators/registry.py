"""Numbers and pages of ids that are kept between runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.numbering import _placed, row_index
from casewright.sources.tables import is_absent


def read_registry(spark: SparkSession, path: str, key: str = "patient_id", name: str = "llm_caseID", kind: str = "bigint") -> DataFrame | None:
    """The numbers given so far (key, number), or None before the first load."""
    try:
        return spark.read.schema(f"`{key}` {kind}, `{name}` bigint").parquet(path)
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return None


def number_with_registry(df: DataFrame, path: str, key: str = "patient_id", name: str = "llm_caseID") -> DataFrame:
    """Number the rows' keys so that a number, once given, never changes.

    Known keys get their number from the registry at ``path``. Only new, non-null keys are sorted and numbered, in
    key order after the highest number so far, and added as one committed write. The registry must be dense: numbers 1..n
    of n distinct keys, else an error says so before anything is added. A load that is stopped before its
    write gives the same numbers again; one load runs at a time.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    known = read_registry(spark, path, key, name, kind)
    keys, start = df.filter(F.col(key).isNotNull()).select(key).distinct(), 1
    if known is not None:
        n, distinct, top = known.agg(F.count("*"), F.countDistinct(key), F.coalesce(F.max(name), F.lit(0))).first()
        if not n == distinct == top:
            raise ValueError(f"the registry holds {n} rows of {distinct} keys with numbers up to {top}")
        keys, start = keys.join(known, key, "left_anti"), top + 1
    row_index(keys, [key], name, start).select(key, F.col(name).cast("bigint").alias(name)).write.mode("append").parquet(path)
    return df.join(read_registry(spark, path, key, name, kind), key)


def write_page_index(df: DataFrame, path: str, key: str = "patient_id") -> None:
    """Sort the distinct, non-null ids once and keep them in ranges, with the first place and the count of each range."""
    placed = _placed(df.filter(F.col(key).isNotNull()).select(key).distinct(), [key])
    placed.write.partitionBy("_slot").parquet(f"{path}/ids")
    bounds = placed.groupBy("_slot").agg(F.min(key).alias("first_id"), F.count("*").alias("n"))
    bounds.coalesce(1).write.parquet(f"{path}/bounds")  # one row for each range


def read_page(spark: SparkSession, path: str, size: int, page_no: int) -> DataFrame:
    """Page ``page_no`` (from 0) of the kept ids, in id order, from the one or few ranges that it touches.

    What ``page`` gives without an index, and without sorting: the ranges' counts tell which of them
    are read, and they are read alone.
    """
    bounds = spark.read.parquet(f"{path}/bounds").select("_slot", "n").orderBy("_slot").collect()  # one row a range
    first, last, before, slots = size * page_no, size * (page_no + 1), 0, {}
    for slot, n in bounds:
        if before < last and before + n > first:
            slots[slot] = before
        before += n
    ids = spark.read.parquet(f"{path}/ids")
    inside = F.lit(False)
    for slot, upto in slots.items():
        inside |= (F.col("_slot") == slot) & (F.col("_pos") >= first - upto) & (F.col("_pos") < last - upto)
    names = [c for c in ids.columns if c not in ("_slot", "_pos")]
    return ids.filter(F.col("_slot").isin(list(slots)) & inside).orderBy(*names).select(*names)
