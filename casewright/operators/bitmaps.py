"""Sets of whole-number ids as bitmaps: one row for each 32,768 neighbouring ids.

A bitmap row has 4 KB whatever ids it holds, so the ids of a billion finished cases are a table of
some 30,000 rows, and asking whether cases are finished is a join on the bucket number. The answer
is exact. Bitmaps of several rounds are merged bit by bit, so a round adds its own rows only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.progress import CASE_ID
from casewright.sources.tables import is_absent

SCHEMA = "bucket bigint, bits binary"


def id_bitmap(ids: DataFrame, key: str = CASE_ID) -> DataFrame:
    """``bucket``, ``bits``: the distinct, non-null whole-number ids of a frame."""
    known = ids.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"))
    return known.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    )


def merge_bitmaps(*bitmaps: DataFrame) -> DataFrame:
    """The union of several sets of ids."""
    every = bitmaps[0]
    for one in bitmaps[1:]:
        every = every.unionByName(one)
    return every.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_size(bitmap: DataFrame) -> DataFrame:
    """One row: how many ids the set holds."""
    return bitmap.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_ids"))


def _holds(bits: Column, position: Column) -> Column:
    """Whether the bit at a place is set."""
    byte = F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int")) == 1


def mark_done(cases: DataFrame, bitmap: DataFrame, key: str = CASE_ID, name: str = "done") -> DataFrame:
    """The cases with a flag that tells whether their id is in the set; null ids are not."""
    id_ = F.col(key).cast("bigint")
    joined = cases.withColumn("_bucket", F.bitmap_bucket_number(id_)).join(
        bitmap.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")), "_bucket", "left"
    )
    held = F.coalesce(_holds(F.col("_bits"), F.bitmap_bit_position(id_)), F.lit(False))
    return joined.withColumn(name, held).drop("_bucket", "_bits")


def pending_by_bitmap(cases: DataFrame, bitmap: DataFrame, key: str = CASE_ID) -> DataFrame:
    """Cases whose id is not in the set: what ``pending`` gives, without reading a result row."""
    return mark_done(cases, bitmap, key, "_done").filter(~F.col("_done")).drop("_done")


def completed_by_bitmap(cases: DataFrame, bitmap: DataFrame, batch: str = "batch_no", key: str = CASE_ID) -> DataFrame:
    """Per batch: size, done count and whether every case is in the set."""
    return mark_done(cases.select(batch, key), bitmap, key, "_done").groupBy(batch).agg(
        F.count("*").alias("n_cases"), F.count_if("_done").alias("n_done"), F.bool_and("_done").alias("complete")
    )


def read_bitmap(spark: SparkSession, path: str) -> DataFrame | None:
    """The set kept at ``path``, all rounds merged; None if none was ever kept there."""
    try:
        return merge_bitmaps(spark.read.schema(SCHEMA).parquet(path))
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return None


def add_to_bitmap(ids: DataFrame, path: str, key: str = CASE_ID) -> None:
    """Add a round's ids to the set kept at ``path``, as one committed write."""
    id_bitmap(ids, key).write.mode("append").parquet(path)
