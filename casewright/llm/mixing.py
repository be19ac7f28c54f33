"""Mixing sources to target weights by thresholds on a hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.text import WORD
from casewright.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
BITS = 12  # hash bits that one histogram resolves
LEVELS = 5  # 60 bits in all


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix_hash(key: str, text: str, seed: str) -> Column:
    """60 bits from the seed, the key and the text; null and empty text count the same."""
    parts = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(parts), 1, BITS * LEVELS // 4), 16, 10).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row (source, source_size) per source.

    Sources in code point order, null last, weigh ``weights`` in turn. A source's target is
    its share of the rest after sources at their cap, ``most`` times their size: the limit
    of resharing the excess by weight. In the order of cap per weight the capped ones come
    first, so one running sum finds the level. The sources' totals are few rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    weighed = sizes.withColumn("w", weigh).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    levelled = weighed.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") >= F.col("level"))
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return levelled.withColumn("level", final).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target")
    )


def _cut(hist: DataFrame) -> DataFrame:
    """The bucket of each source where the running size passes the budget, and what is left for it.

    A source with no such bucket takes all that was counted.
    """
    upto = Window.partitionBy("sid").orderBy("bucket")
    running = hist.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") > F.col("budget"))
    return running.groupBy("sid").agg(
        F.min("bucket").alias("bucket"),
        F.min_by(F.col("budget") - (F.col("upto") - F.col("n")), F.col("bucket")).alias("left"),
    )


def _refine(rows: DataFrame, state: DataFrame, hash_: str) -> DataFrame:
    """``sid``, ``bucket`` (a whole hash), ``left``: where each source's budget ends among the rows by that hash.

    ``state`` (sid, budget) is of the sources that have such a place among ``rows``.
    """
    total_bits = BITS * LEVELS
    state = state.select("sid", F.lit(0).cast("bigint").alias("prefix"), "budget")  # and the leading bits so far
    narrow = rows.select("sid", "size", F.col(hash_).alias("h"))
    for level in range(1, LEVELS + 1):
        shift = total_bits - BITS * level
        inside = narrow.join(state, "sid").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy("sid", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("n"), F.first("budget").alias("budget")
        )
        state = materialize(_cut(hist).select("sid", F.col("bucket").alias("prefix"), F.col("left").alias("budget")))
    return state.select("sid", F.col("prefix").alias("bucket"), F.col("budget").alias("left"))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: str = "mix",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row: ``row`` (struct of the key and carried columns), ``size``, ``source_size``,
    ``target``, ``copies``.

    A source at r times its size takes every row floor(r) times, and for the rest once more
    the rows whose hash lies below the source's threshold. The threshold comes from
    histograms: sizes by source and leading hash bits; then only the bucket in which the
    budget ends is counted by its next bits, until the bits are used up. Where several rows share the
    last bucket (rows of one key and text), they are cut in the same way by a hash of the carried columns, and
    if these are the same too, by a hash of the row's number: which of identical rows is taken
    makes no difference to the result. Null and empty texts have size 0 and are taken as often as others; null is a
    source of its own; a source without words has target 0. A very long text may keep a source that much
    below its target. An empty table gives no rows; columns not carried are ignored, whatever they are named.
    """
    sized = docs.select(
        F.struct(*[F.col(c) for c in dict.fromkeys([key, *carry])]).alias("row"),
        F.col(source).alias("source"),
        F.xxhash64(F.coalesce(F.col(source), F.lit("")), F.col(source).isNull()).alias("sid"),
        n_words(text).alias("size"),
        mix_hash(key, text, seed).alias("h"),
    )
    sized = materialize(
        sized.withColumns(
            {"h2": F.shiftrightunsigned(F.xxhash64("row"), 4), "h3": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)}
        )
    )
    per_source = sized.groupBy("source", "sid").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source.select("source", "source_size"), weights, most).withColumn(
        "sid", F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())
    )
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = materialize(
        targets.withColumn("full", ratio.cast("bigint")).withColumn(
            "budget", F.col("target") - F.col("full") * F.col("source_size")
        )
    )

    state = plan.select("sid", "budget")
    limits = ["h", "h2", "h3"]
    same = sized.select("sid", "size", *limits)
    for hash_ in limits:
        state = _refine(same, state, hash_)
        plan = plan.join(state.select("sid", F.col("bucket").alias(f"{hash_}_limit")), "sid", "left")
        left = state.select("sid", F.col("bucket").alias(hash_), "left")
        same = same.join(left, ["sid", hash_], "left_semi")
        state = left.select("sid", F.col("left").alias("budget"))
        if same.groupBy("sid").count().filter("count > 1").isEmpty():  # no two rows left to choose from
            break
    plan = plan.select("sid", "source_size", "target", "full", *[c for c in plan.columns if c.endswith("_limit")])
    # no limit: the whole source fits, which is so only where nothing is left to take
    below = F.lit(False)
    for hash_ in reversed([h for h in limits if f"{h}_limit" in plan.columns]):
        limit = F.col(f"{hash_}_limit")
        below = (F.col(hash_) < limit) | ((F.col(hash_) == limit) & below)
    return sized.join(plan, "sid").select(
        "row",
        "size",
        "source_size",
        "target",
        (F.col("full") + F.when(below, 1).otherwise(0)).alias("copies"),
    )
