"""Dense numbering, batches, pages, position splits and history parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import shared_dir

_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above this bit
BROADCAST_KEYS = 100_000
MAX_ITEMS = 100_000
PART_BYTES = 64 << 20


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows sorted over the tasks, with the number of their partition and their place in it.

    A range-partitioned sort spreads any key distribution. The sorted rows are
    checkpointed, so places cannot change if an executor is lost.
    """
    shared_dir(df.sparkSession)
    return (
        df.orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_at", F.monotonically_increasing_id())
        .checkpoint()
        .withColumns(
            {
                "_slot": F.shiftright("_at", _PARTITION_BITS),
                "_pos": F.col("_at").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1)),
            }
        )
        .drop("_at")
    )


def row_index(keys: DataFrame, order: Sequence[str], name: str = "row_no", start: int = 1) -> DataFrame:
    """Dense numbers in the order of unique ``order`` columns, without a single-task window.

    Each partition of the sorted keys adds the count of the partitions before it. These
    offsets are one row per partition, hence the broadcast.
    """
    placed = _placed(keys, order)
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slot")
        .agg(F.count("*").alias("_n"))
        .select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_slot")
        .withColumn(name, F.col("_offset") + F.col("_pos") + F.lit(start))
        .drop("_slot", "_pos", "_offset")
    )


def total_before(df: DataFrame, by: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over the group's rows before this one, for groups of any size.

    Sums within a partition of the sorted rows, plus the group's total of the partitions
    before; the latter is one row per group and partition that meet. ``order`` is unique in a group.
    """
    placed = _placed(df, [by, *order])
    ahead = [F.col(c).asc_nulls_first() for c in order]
    earlier = Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(by, "_slot").orderBy(*ahead).rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.groupBy(by, "_slot").agg(F.sum(value).alias("_n"))
    offsets = slots.select(by, "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    local = placed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, [by, "_slot"]).withColumn(name, F.col(name) + F.col("_offset")).drop("_slot", "_pos", "_offset")


def number_cases(
    df: DataFrame, order: Sequence[str] = ("patient_id",), start: int = 1, name: str = "llm_caseID"
) -> DataFrame:
    """Number the distinct, non-null keys 1..n in key order; rows of one key share its number.

    Only the keys are sorted; the numbers join back to the rows.
    """
    numbered = row_index(df.select(*order).distinct(), order, name, start)
    return df.join(numbered, list(order))


def assign_batches(
    df: DataFrame, order: Sequence[str], size: int, name: str = "batch_no"
) -> DataFrame:
    """Fixed-size batch number (from 1) of the distinct keys in key order."""
    numbered = row_index(df.select(*order).distinct(), order, "_no", 0)
    batches = numbered.withColumn(name, F.floor(F.col("_no") / size) + 1).drop("_no")
    return df.join(batches, list(order))


def train_test_split_ordered(
    cases: DataFrame, n: int | None, order: Sequence[str] = ("llm_caseID",), label: str = "had_surgery"
) -> tuple[DataFrame, DataFrame]:
    """The first n cases with their label, the rest without; both renumbered by position."""
    keyed = cases.withColumnsRenamed({c: f"_{c}" for c in order})
    numbered = number_cases(keyed, [f"_{c}" for c in order], name="llm_caseID").drop(*[f"_{c}" for c in order])
    numbered = numbered.withColumn(label, F.coalesce(F.col(label), F.lit(False)))
    if n is None:
        return numbered, numbered.filter(F.lit(False)).drop(label)
    return numbered.filter(F.col("llm_caseID") <= n), numbered.filter(F.col("llm_caseID") > n).drop(label)


def distinct_ids(df: DataFrame, key: str = "patient_id", rows: str | None = None) -> DataFrame:
    """The distinct ids and, if named, how many rows each has."""
    return df.select(key).distinct() if rows is None else df.groupBy(key).agg(F.count("*").alias(rows))


def _first(ids: DataFrame, n: int, key: str, skip: int = 0, direct: int = BROADCAST_KEYS) -> DataFrame:
    """Ids skip+1 .. skip+n in id order: a top-k while that is short, numbered ids beyond."""
    if skip + n <= direct:
        return ids.orderBy(key).offset(skip).limit(n)
    numbered = row_index(ids, [key], "_no").filter((F.col("_no") > skip) & (F.col("_no") <= skip + n))
    return numbered.orderBy("_no").drop("_no")


def first_ids(df: DataFrame, n: int, key: str = "patient_id") -> DataFrame:
    """The first n distinct ids in id order."""
    return _first(distinct_ids(df, key), n, key)


def page(df: DataFrame, size: int, page_no: int, key: str = "patient_id") -> DataFrame:
    """Page ``page_no`` (from 0) of the ordered distinct ids; for all pages use ``assign_batches``."""
    return _first(distinct_ids(df, key), size, key, size * page_no)


def _small(keys: DataFrame, n: int) -> DataFrame:
    """One row per key, broadcast when the counted keys are few."""
    return F.broadcast(keys) if n <= BROADCAST_KEYS else keys


def group_in_parts(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    seq: str,
    aggregate: Column,
    max_items: int | None = MAX_ITEMS,
) -> DataFrame:
    """The aggregate per (key, part), over at most ``max_items`` rows at a time.

    Rows go to parts in the given order, the unique, non-null ``seq`` breaking ties.
    Nearly every key has the one part 0. Keys over the limit are found by a count on the
    key column alone; only their rows are positioned, by a distributed sort, so a key
    with a large share of all rows is spread over tasks and its history stays whole.
    """
    single = F.lit(0).cast("bigint")
    heavy, n = None, 0
    if max_items is not None:
        sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
        heavy = sizes.filter(F.col("_n") > max_items).select(key, F.lit(True).alias("_heavy"))
        n = heavy.count()
    if n == 0:
        return df.groupBy(key).agg(aggregate).withColumn("part", single)
    shared_dir(df.sparkSession)
    marked = df.join(_small(heavy.checkpoint(), n), key, "left")
    light = marked.filter(F.col("_heavy").isNull()).drop("_heavy").withColumn("part", single)
    rows = marked.filter(F.col("_heavy")).drop("_heavy")
    placed = row_index(rows.select(key, *order, seq), [key, *order, seq], "_no")
    first = placed.groupBy(key).agg(F.min("_no").alias("_first"))
    parts = placed.join(_small(first, n), key).select(
        key, seq, F.floor((F.col("_no") - F.col("_first")) / max_items).alias("part")
    )
    return light.unionByName(rows.join(parts, [key, seq])).groupBy(key, "part").agg(aggregate)


def group_whole(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    seq: str,
    size: Column,
    aggregate: Column,
    merge: Callable[[Column], Column],
    name: str,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The aggregate of each key in one row, however large the key, by way of parts of bounded bytes.

    ``aggregate`` makes the value ``name`` of some rows, sorting them itself; ``merge`` joins an array of
    such values. Keys of more than ``part_bytes`` (``size`` gives a row's) are found by a sum; only their
    rows are placed by a distributed sort and cut into parts by the bytes before them, in the given order,
    the unique, non-null ``seq`` breaking ties. Parts are aggregated in tasks of their own, so before the
    final value no task holds more than a part and one row. Without large keys the plan is one shuffle.
    """
    sizes = df.groupBy(key).agg(F.sum(size).alias("_n"))
    heavy = sizes.filter(F.col("_n") > part_bytes).select(key, F.lit(True).alias("_heavy"))
    n = heavy.count()
    if n == 0:
        return df.groupBy(key).agg(aggregate.alias(name))
    shared_dir(df.sparkSession)
    marked = df.join(_small(heavy.checkpoint(), n), key, "left")
    light = marked.filter(F.col("_heavy").isNull()).groupBy(key).agg(aggregate.alias(name))
    rows = marked.filter(F.col("_heavy")).drop("_heavy")
    placed = total_before(rows.select(key, *order, seq, F.coalesce(size, F.lit(0)).alias("_b")), key, [*order, seq], "_b", "_before")
    parts = placed.select(key, seq, F.floor(F.col("_before") / part_bytes).alias("_part"))
    pieces = rows.join(parts, [key, seq]).groupBy(key, "_part").agg(aggregate.alias(name))
    ordered = F.array_sort(F.collect_list(F.struct("_part", F.col(name).alias("value"))))
    whole = pieces.groupBy(key).agg(merge(F.transform(ordered, lambda p: p["value"])).alias(name))
    return light.unionByName(whole)
