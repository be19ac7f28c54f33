"""Evaluation tables.

Every table derives from counts per (stratum, actual, predicted, confidence), so the
evaluation frame is aggregated once, map-side first, and the rest works on a handful
of rows whatever the number of cases. Confidence is an ordinal score with few values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.answers import confidence_score
from casewright.functions.render import has_valid_text
from casewright.functions.stats import p_value
from casewright.operators.filters import range_bucket

ACTUAL = "actual_surgery"
PRED = "llm_surgery"
CONFIDENCE = "confidence"
STRATUM = "has_radiology"
METRICS = ["accuracy", "precision", "recall", "f1_score", "specificity"]
CLASS_NAMES = ["No Surgery", "Surgery"]
AUC_BITS = (21, 10)  # leading bits by which scores are dealt, level by level
CELLS = ["true_positives", "true_negatives", "false_positives", "false_negatives", "total_cases"]


def eval_counts(
    df: DataFrame, by: Sequence[str] = (), actual: str = ACTUAL, pred: str = PRED, confidence: str | None = CONFIDENCE
) -> DataFrame:
    """Case counts ``n`` per stratum, actual, predicted and confidence."""
    level = [F.col(confidence).alias(CONFIDENCE)] if confidence else []
    return df.groupBy(*by, F.col(actual).alias(ACTUAL), F.col(pred).alias(PRED), *level).agg(
        F.count("*").alias("n")
    )


def _total(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint").alias(name)


def _cells() -> list[Column]:
    a, p = F.col(ACTUAL), F.col(PRED)
    return [
        _total((a == 1) & (p == 1), "true_positives"),
        _total((a == 0) & (p == 0), "true_negatives"),
        _total((a == 0) & (p == 1), "false_positives"),
        _total((a == 1) & (p == 0), "false_negatives"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_cases"),
    ]


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _ratio0(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def _with_metrics(cells: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    tp, tn, fp, fn = (
        F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives")
    )
    return cells.select(
        *keep,
        ratio(tp + tn, F.col("total_cases")).alias("accuracy"),
        _ratio0(tp, tp + fp).alias("precision"),
        _ratio0(tp, tp + fn).alias("recall"),
        _ratio0(tp * 2, tp * 2 + fp + fn).alias("f1_score"),
        _ratio0(tn, tn + fp).alias("specificity"),
        _ratio0(tn, tn + fn).alias("negative_predictive_value"),
        "true_positives",
        "true_negatives",
        "false_positives",
        "false_negatives",
        "total_cases",
        ratio(tp + fn, F.col("total_cases")).alias("actual_surgery_rate"),
        ratio(tp + fp, F.col("total_cases")).alias("predicted_surgery_rate"),
    )


def binary_metrics(df: DataFrame, actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """One row of accuracy, precision, recall, F1, specificity, NPV and counts.

    Undefined ratios are 0, classes that do not occur count 0.
    """
    return _with_metrics(eval_counts(df, (), actual, pred, None).agg(*_cells()))


def leading_bits(score: Column, bits: int) -> Column:
    """A whole number that never falls as the score rises: sign, magnitude and the next ``bits`` of it.

    The score times a power of two is cut to a whole number v (values beyond 2^31 share a number),
    v is written as its length in bits and its first ones. Null counts as the lowest, NaN as the highest.
    """
    double = score.cast("double")
    limit = float(1 << 62)
    scaled = F.greatest(F.least(double * float(1 << 31), F.lit(limit)), F.lit(-limit))
    v = F.when(F.isnan(double), F.lit(limit)).otherwise(scaled).cast("bigint")
    size = F.length(F.bin(F.abs(v)))
    magnitude = size * F.lit(1 << bits).cast("bigint") + F.call_function("shiftright", F.abs(v), F.greatest(size - bits, F.lit(0)))
    return F.when(double.isNull(), F.lit(-(1 << 62))).when(v < 0, -magnitude).otherwise(magnitude)


def _auc(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mann-Whitney AUC from a score histogram (columns by..., score, pos, neg, rated).

    Scores are dealt by their leading bits, first many of them, then fewer. Inside a group each score's
    wins over the lower ones are exact; a group then counts as one score among the groups of the next
    level, and the last level has a few thousand groups at most. Nothing is sorted as a whole,
    checkpointed or run before the result is asked for.
    """
    levels = [leading_bits(F.col("score"), bits).alias(f"_b{bits}") for bits in AUC_BITS]
    rows = histogram.select(*by, F.col("score").alias("_at"), *levels, "pos", "neg", "rated", (F.col("pos") * F.col("neg") / 2).alias("wins"))
    keys = [f"_b{bits}" for bits in AUC_BITS]
    for n in range(len(keys) + 1):
        below = Window.partitionBy(*by, *keys[n:]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        won = F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0))
        sums = [F.sum(c).alias(c) for c in ("pos", "neg", "rated", "wins")]
        rows = rows.withColumn("wins", won).groupBy(*by, *keys[n:]).agg(*sums)
        if n < len(keys):
            rows = rows.withColumnRenamed(keys[n], "_at")
    pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    return rows.select(*by, F.when(F.col("rated") > 0, F.try_divide(F.col("wins"), pairs)).alias("auc_roc"))


def roc_auc(
    df: DataFrame,
    actual: str = ACTUAL,
    score: Column | str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """ROC-AUC with ties counted half; null when one class is absent or no case is rated.

    The score defaults to confidence/10 with missing confidence as the middle. It is
    grouped first; the distinct scores are ranked by histograms over their leading bits.
    """
    value = confidence_score(F.col(CONFIDENCE)) if score is None else F.col(score) if isinstance(score, str) else score
    rated = F.count(CONFIDENCE) if score is None else F.count("*")
    histogram = df.groupBy(*by, value.alias("score")).agg(
        rated.alias("rated"), F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg")
    )
    return _auc(histogram, by)


def directional_score(pred: str = PRED) -> Column:
    """The score for the positive class: 1 - score when the prediction is No.

    Flipped before scaling, so that 9 under No ties exactly with 1 under Yes.
    """
    c = F.col(CONFIDENCE)
    return F.when(F.col(pred) == 1, confidence_score(c)).otherwise(confidence_score(10 - c))


def metrics_by(df: DataFrame, stratum: str = STRATUM, actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """Metrics overall, with and without a boolean property; always three rows.

    A stratum without cases has null metrics. One aggregate over the cases serves all
    rows and the AUC.
    """
    counts = eval_counts(df, [stratum], actual, pred)
    # Each count row goes to the overall group and to its own stratum.
    name = stratum.removeprefix("has_")
    with_name, without_name = f"with_{name}", f"without_{name}"
    own = F.when(F.col(stratum), with_name).otherwise(without_name)
    per_score = (
        counts.withColumn("group", F.explode(F.array(F.lit("overall"), own)))
        .groupBy("group", confidence_score(F.col(CONFIDENCE)).alias("score"))
        .agg(*_cells(), F.count(CONFIDENCE).alias("_rated"))
    )
    pos = F.col("true_positives") + F.col("false_negatives")
    neg = F.col("true_negatives") + F.col("false_positives")
    below = Window.partitionBy("group").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per_score.withColumn("_below", F.coalesce(F.sum(neg).over(below), F.lit(0)))
    sums = [F.sum(c).alias(c) for c in [*CELLS, "_rated"]]
    totals = ranked.groupBy("group").agg(*sums, F.sum(pos * (F.col("_below") + neg / 2)).alias("_wins"))
    auc = F.try_divide(F.col("_wins"), pos.cast("double") * neg.cast("double"))
    scored = _with_metrics(totals, ["group", F.when(F.col("_rated") > 0, auc).alias("auc_roc")])
    names = F.explode(F.array(F.lit("overall"), F.lit(with_name), F.lit(without_name)))
    groups = df.sparkSession.range(1).select(names.alias("group"))
    return groups.join(scored, "group", "left")


def metrics_grouped(df: DataFrame, by: Sequence[str], actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """Metrics overall and for every value of each column in ``by`` (grouping sets on counts)."""
    counts = eval_counts(df, by, actual, pred, None)
    sets = counts.groupingSets([[]] + [[F.col(c)] for c in by], *by).agg(*_cells(), F.grouping_id().alias("_gid"))
    stratum, value = F.lit("overall"), F.lit(None).cast("string")
    for position, c in enumerate(by):
        kept = F.col("_gid") == (1 << len(by)) - 1 - (1 << (len(by) - 1 - position))
        stratum = F.when(kept, c).otherwise(stratum)
        value = F.when(kept, F.col(c).cast("string")).otherwise(value)
    return _with_metrics(sets.select("*", stratum.alias("stratum"), value.alias("value")), ["stratum", "value"])


def confidence_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cases, accuracy, predicted and actual rate per confidence level; unrated cases are left out."""
    counts = eval_counts(df.filter(F.col(CONFIDENCE).isNotNull()), by)
    return (
        counts.groupBy(*by, CONFIDENCE)
        .agg(
            F.sum("n").alias("n_cases"),
            _total(F.col(ACTUAL) == F.col(PRED), "_correct"),
            _total(F.col(PRED) == 1, "_pred"),
            _total(F.col(ACTUAL) == 1, "_actual"),
        )
        .select(
            *by,
            CONFIDENCE,
            "n_cases",
            ratio(F.col("_correct"), F.col("n_cases")).alias("accuracy"),
            ratio(F.col("_pred"), F.col("n_cases")).alias("predicted_surgery_rate"),
            ratio(F.col("_actual"), F.col("n_cases")).alias("actual_surgery_rate"),
        )
    )


def _correlation(counts: DataFrame, by: Sequence[str], x: Column) -> DataFrame:
    """(by..., n_all, n, r): weighted Pearson correlation of x and correctness from counts."""
    y = F.when(F.col(ACTUAL) == F.col(PRED), 1).otherwise(0)
    w, pair = F.col("n"), x.isNotNull()
    weighted = lambda c: F.sum(F.when(pair, c * w).cast("double"))
    sums = counts.groupBy(*by).agg(
        F.sum("n").alias("n_all"),
        _total(pair, "n"),
        weighted(x).alias("sx"),
        weighted(y).alias("sy"),
        weighted(x * x).alias("sxx"),
        weighted(x * y).alias("sxy"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread_x = F.greatest(n * F.col("sxx") - sx * sx, F.lit(0.0))
    spread_y = F.greatest(n * sy - sy * sy, F.lit(0.0))
    r = F.try_divide(n * F.col("sxy") - sx * sy, F.sqrt(spread_x) * F.sqrt(spread_y))
    return sums.select(*by, "n_all", "n", r.alias("r"))


def confidence_corr(df: DataFrame, by: Sequence[str] = (), min_n: int = 0) -> DataFrame:
    """Correlation of confidence with correctness over rated cases.

    Null when either is constant or a group has no more than ``min_n`` cases.
    """
    r = _correlation(eval_counts(df, by), by, F.col(CONFIDENCE).cast("double"))
    enough = F.when(F.col("n_all") > min_n, F.col("r"))
    return r.select(*by, F.col("n_all").alias("n_cases"), enough.alias("correlation"))


def pearson_test(df: DataFrame, by: Sequence[str] = (), min_n: int = 10, fill: float = 5.0) -> DataFrame:
    """Pearson r and two-sided p of confidence (missing = middle) and correctness, for n > min_n."""
    x = F.coalesce(F.col(CONFIDENCE).cast("double"), F.lit(fill))
    r = _correlation(eval_counts(df, by), by, x)
    tested = r.select(*by, F.col("n_all").alias("n_cases"), F.when(F.col("n_all") > min_n, F.col("r")).alias("r"))
    return tested.withColumn("p_value", p_value(F.col("r"), F.col("n_cases")))


def confidence_pivot(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Incorrect and correct counts per confidence level, zero-filled."""
    counts = eval_counts(df.filter(F.col(CONFIDENCE).isNotNull()), by)
    right = F.col(ACTUAL) == F.col(PRED)
    return counts.groupBy(*by, CONFIDENCE).agg(_total(~right, "incorrect"), _total(right, "correct"))


def confusion_table(df: DataFrame, by: Sequence[str] = (), actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """The four (actual, predicted) counts, zeros included, overall or per stratum."""
    cells = eval_counts(df, by, actual, pred, None).groupBy(*by).agg(*_cells())
    grid = [(0, 0, "true_negatives"), (0, 1, "false_positives"), (1, 0, "false_negatives"), (1, 1, "true_positives")]
    rows = F.array(
        *[F.struct(F.lit(a).alias(ACTUAL), F.lit(p).alias(PRED), F.col(c).alias("n")) for a, p, c in grid]
    )
    return cells.select(*by, F.inline(rows))


def value_distribution(df: DataFrame, cols: Sequence[str] = (ACTUAL, PRED, STRATUM)) -> DataFrame:
    """Count and share of every value of each column."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    values = counts.select(F.explode(entries).alias("e"), "n").groupBy("e.column", "e.value").agg(F.sum("n").alias("n"))
    # every column's values add up to all cases
    whole = F.sum("n").over(Window.partitionBy("column"))
    return values.select("column", "value", "n", ratio(F.col("n"), whole).alias("share"))


def stratum_counts(df: DataFrame, by: Sequence[str] = (STRATUM,)) -> DataFrame:
    """Total, actual, predicted and correct cases per stratum, with rates."""
    counts = eval_counts(df, by, confidence=None)
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("total_cases"),
        _total(F.col(ACTUAL) == 1, "actual_surgery"),
        _total(F.col(PRED) == 1, "predicted_surgery"),
        _total(F.col(ACTUAL) == F.col(PRED), "correct_predictions"),
    )
    return totals.select(
        "*",
        ratio(F.col("actual_surgery"), F.col("total_cases")).alias("actual_rate"),
        ratio(F.col("predicted_surgery"), F.col("total_cases")).alias("predicted_rate"),
    )


def metric_difference(metrics: DataFrame, names: Sequence[str] = METRICS, suffix: str = "radiology") -> DataFrame:
    """(metric, with, without, difference) from the rows of ``metrics_by``.

    An empty stratum counts as 0, as in the comparison table.
    """
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    long = metrics.select("group", F.inline(entries))
    pick = lambda g: F.coalesce(F.max(F.when(F.col("group") == g, F.col("value"))), F.lit(0.0))
    sides = long.groupBy("metric").agg(
        pick(f"with_{suffix}").alias("with_value"), pick(f"without_{suffix}").alias("without_value")
    )
    return sides.withColumn("difference", F.col("with_value") - F.col("without_value"))


# The sentences of the findings.
SMALL_SAMPLE = "Small sample size may limit statistical significance"
POSITIVE_IMPACT = "Radiology reports appear to positively impact LLM performance"
NEGATIVE_IMPACT = "Radiology reports appear to negatively impact LLM performance"
MINIMAL_IMPACT = "Minimal difference suggests limited impact of radiology reports"
RECALL_WITH = "LLM shows better sensitivity (recall) when radiology is available"
RECALL_WITHOUT = "LLM shows better sensitivity (recall) without radiology reports"
SPECIFICITY_WITH = "LLM shows better specificity when radiology is available"
SPECIFICITY_WITHOUT = "LLM shows better specificity without radiology reports"
# End of fixed values.


def findings(
    metrics: DataFrame,
    suffix: str = "radiology",
    *,
    small_n: int = 30,
    large: float = 0.1,
    small: float = 0.05,
) -> DataFrame:
    """Findings from comparing the strata of ``metrics_by``; none if a stratum is empty."""
    side = lambda g, m: F.max(F.when(F.col("group") == f"{g}_{suffix}", F.col(m)))
    wanted = ["accuracy", "recall", "specificity", "total_cases"]
    wide = metrics.agg(*[side(g, m).alias(f"{g}_{m}") for g in ("with", "without") for m in wanted])
    w = lambda m: F.col(f"with_{m}")
    wo = lambda m: F.col(f"without_{m}")
    gap = w("accuracy") - wo("accuracy")
    rules = [
        F.when((w("total_cases") < small_n) | (wo("total_cases") < small_n), SMALL_SAMPLE),
        F.when(gap > large, POSITIVE_IMPACT).when(gap < -large, NEGATIVE_IMPACT).when(F.abs(gap) < small, MINIMAL_IMPACT),
        F.when(w("recall") > wo("recall") + small, RECALL_WITH).when(wo("recall") > w("recall") + small, RECALL_WITHOUT),
        F.when(w("specificity") > wo("specificity") + small, SPECIFICITY_WITH).when(
            wo("specificity") > w("specificity") + small, SPECIFICITY_WITHOUT
        ),
    ]
    numbered = F.array(*[F.struct(F.lit(n).alias("rule"), r.alias("finding")) for n, r in enumerate(rules, start=1)])
    both = wide.filter(w("accuracy").isNotNull() & wo("accuracy").isNotNull())
    return both.select(F.inline(numbered)).filter(F.col("finding").isNotNull())


def classification_report(df: DataFrame, actual: str = ACTUAL, pred: str = PRED) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    cells = eval_counts(df, (), actual, pred, None).agg(*_cells())
    tp, tn, fp, fn = (
        F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives")
    )

    def row(name, hit, false_hit, miss):
        return F.struct(
            F.lit(name).alias("label"),
            _ratio0(hit, hit + false_hit).alias("precision"),
            _ratio0(hit, hit + miss).alias("recall"),
            _ratio0(hit * 2, hit * 2 + false_hit + miss).alias("f1_score"),
            (hit + miss).alias("support"),
        )

    per_class = cells.select(
        row(CLASS_NAMES[0], tn, fn, fp).alias("c0"), row(CLASS_NAMES[1], tp, fp, fn).alias("c1"),
        ratio(tp + tn, F.col("total_cases")).alias("accuracy"),
    )
    support = F.col("c0.support") + F.col("c1.support")

    def average(name, weigh):
        return F.struct(
            F.lit(name).alias("label"),
            *[weigh(F.col(f"c0.{m}"), F.col(f"c1.{m}")).alias(m) for m in ("precision", "recall", "f1_score")],
            support.alias("support"),
        )

    macro = average("macro avg", lambda a, b: (a + b) / 2)
    weighted = average(
        "weighted avg",
        lambda a, b: F.coalesce(
            F.try_divide(a * F.col("c0.support") + b * F.col("c1.support"), support.cast("double")), F.lit(0.0)
        ),
    )
    accuracy = F.struct(
        F.lit("accuracy").alias("label"),
        *[F.col("accuracy").alias(m) for m in ("precision", "recall", "f1_score")],
        support.alias("support"),
    )
    return per_class.select(F.inline(F.array(F.col("c0"), F.col("c1"), accuracy, macro, weighted)))


def confidence_by_outcome(df: DataFrame) -> DataFrame:
    """Rated cases and mean confidence for correct/incorrect and for TP/TN/FP/FN; always six rows."""
    a, p, w = F.col(ACTUAL), F.col(PRED), F.col("n")
    groups = {
        "correct": a == p,
        "incorrect": a != p,
        "TP": (a == 1) & (p == 1),
        "TN": (a == 0) & (p == 0),
        "FP": (a == 0) & (p == 1),
        "FN": (a == 1) & (p == 0),
    }
    rated = F.col(CONFIDENCE).isNotNull()
    sums = []
    for name, member in groups.items():
        sums.append(_total(member & rated, f"n_{name}"))
        sums.append(F.sum(F.when(member, F.col(CONFIDENCE) * w)).alias(f"s_{name}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(g).alias("outcome"),
                F.col(f"n_{g}").alias("n_rated"),
                ratio(F.col(f"s_{g}"), F.col(f"n_{g}")).alias("mean_confidence"),
            )
            for g in groups
        ]
    )
    return eval_counts(df).agg(*sums).select(F.inline(rows))


def coverage_report(
    cases: DataFrame,
    edges: Sequence[int] = vocab.CASE_RANGE_EDGES,
    key: str = "llm_caseID",
    text: str = "formatted_radiology_text",
    placeholder: str = vocab.NO_REPORTS,
) -> DataFrame:
    """Imaging coverage overall (range_lo null) and per non-empty id range."""
    valid = F.coalesce(has_valid_text(F.col(text), placeholder), F.lit(False))
    marked = cases.select(F.col(key).alias("id"), valid.alias("valid"), range_bucket(F.col(key), edges).alias("bucket"))
    per_bucket = marked.groupBy("bucket").agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("with_imaging"),
        F.min(F.when(F.col("valid"), F.col("id"))).alias("first_valid"),
        F.max(F.when(F.col("valid"), F.col("id"))).alias("last_valid"),
    )
    lows = F.array(*[F.lit(e).cast("bigint") for e in edges])
    sets = per_bucket.groupingSets([[], [F.col("bucket")]], "bucket").agg(
        F.grouping("bucket").alias("_all"),
        F.sum("total").alias("total"),
        F.sum("with_imaging").alias("with_imaging"),
        F.min("first_valid").alias("first_valid"),
        F.max("last_valid").alias("last_valid"),
    )
    return sets.filter((F.col("_all") == 1) | F.col("bucket").isNotNull()).select(
        F.get(lows, F.col("bucket")).alias("range_lo"),
        F.get(lows, F.col("bucket") + 1).alias("range_hi"),
        "total",
        "with_imaging",
        (F.col("total") - F.col("with_imaging")).alias("without_imaging"),
        "first_valid",
        "last_valid",
        ratio(F.col("with_imaging"), F.col("total")).alias("share"),
    )


def coverage_agreement(cases: DataFrame, prepared: DataFrame, key: str = "llm_caseID") -> DataFrame:
    """Imaging counts of the rendered and the prepared frame side by side; they must agree."""
    text = F.col("formatted_radiology_text")
    rendered = cases.agg(F.count_if(text != vocab.NO_REPORTS).alias("rendered"))
    stored = prepared.agg(F.count_if(STRATUM).alias("n")).scalar()
    return rendered.withColumn("prepared", stored).withColumn("agree", F.col("rendered") == F.col("prepared"))
