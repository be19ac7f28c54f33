"""Distinct ids over shards by mergeable sketches, beside the exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_ENTRIES = 14  # a sketch keeps up to 2^14 hashes: a standard error under 0.8 % of its own count


def shard_sketches(df: DataFrame, shard: str, key: str, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """``shard``, ``sketch``, ``estimate``: a theta sketch of each shard's distinct, non-null ids.

    Built before the shuffle on every task; a stored sketch serves later unions and overlaps, so a
    new shard needs no other shard's rows.
    """
    made = df.groupBy(shard).agg(F.theta_sketch_agg(key, lg_entries).alias("sketch"))
    return made.withColumn("estimate", F.theta_sketch_estimate("sketch"))


def total_estimate(sketches: DataFrame) -> DataFrame:
    """One row: about how many distinct ids all shards have together."""
    return sketches.agg(F.theta_sketch_estimate(F.theta_union_agg("sketch")).alias("estimate"))


def overlap_estimates(pairs: DataFrame, sketches: DataFrame, shard: str, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """For each pair (a, b) of shards: about how many ids either and both have, and the bound of the latter.

    The sketches join the pairs asked for by the shards' names. ``both_error`` is two standard errors: of the
    size of the union, which the overlap's own size does not lessen.
    """
    a = sketches.select(F.col(shard).alias("a"), F.col("sketch").alias("_a"))
    b = sketches.select(F.col(shard).alias("b"), F.col("sketch").alias("_b"))
    pairs = pairs.select("a", "b").join(a, "a").join(b, "b")
    either = F.theta_sketch_estimate(F.theta_union("_a", "_b"))
    both = F.theta_sketch_estimate(F.theta_intersection("_a", "_b"))
    error = 2.0 / 2 ** (lg_entries / 2)
    exact = either < (1 << lg_entries)
    return pairs.select(
        "a", "b", either.alias("either"), both.alias("both"), F.when(exact, 0.0).otherwise(either * error).alias("both_error")
    )


def relative_error(estimate: Column, exact: Column) -> Column:
    return F.try_divide(F.abs(estimate - exact), exact)
