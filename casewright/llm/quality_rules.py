"""Quality rules whose cutoffs carry a guarantee on false rejection. Native expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.text import GAP
from casewright.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20  # per cent of words

#: Share of good documents per stratum that all rules together may reject, and the risk of
#: choosing any cutoff that breaks this.
LIMIT = 0.03
RISK = 0.05

#: Rules reject above a cutoff; candidates were fixed before any label was seen.
RULES: Mapping[str, Sequence[float]] = {
    "symbol_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_share": (0.02, 0.05, 0.1, 0.15),
    "capital_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "exclamation_share": (0.05, 0.1, 0.2, 0.4, 0.7),
    "mean_length": (8.0, 9.0, 10.0, 12.0, 15.0),
}


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def base_metrics(df: DataFrame, text: str = "_text") -> DataFrame:
    """The rows with the counts that the rules read; null texts count as empty.

    A repeated window is found by its hash within the row: only rows with equal hashes sort
    theirs. Words covered by several repeated windows count once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    missing = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    df = df.withColumns(
        {
            "_words": F.filter(F.split(body, GAP), lambda w: w != ""),
            "_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "word_chars": F.length(F.regexp_replace(body, GAP, "")).cast("bigint"),
            "n_symbols": missing(body, SYMBOLS).cast("bigint"),
            "_capitals": missing(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_exclamations": missing(body, "!"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_n_lines": F.size("_lines"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    df = df.withColumn(
        "_windows",
        F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int")),
                lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)),
            )
        ),
    ).drop("_hashes")
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_windows")
    near = lambda k: F.get("_sorted", k).getField("h")
    df = df.withColumn(
        "_starts",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        "_sorted",
                        lambda x, k: F.struct(
                            x["i"].alias("i"),
                            F.coalesce((near(k - 1) == x["h"]) | (near(k + 1) == x["h"]), near(k - 1) == x["h"], near(k + 1) == x["h"]).alias("again"),
                        ),
                    ),
                    lambda y: y["again"],
                ),
                lambda y: y["i"],
            )
        ),
    ).drop("_sorted")
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("end")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["end"])).alias("n"), i.alias("end")),
        lambda s: s["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_starts")
    return df.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
            "symbol_share": _per("n_symbols", "word_chars"),
            "dup_line_share": _per("n_dup_lines", "_n_lines"),
            "repeat_share": _per("n_repeat_words", "n_words"),
            "capital_share": _per("_capitals", "word_chars"),
            "exclamation_share": _per("_exclamations", "n_words"),
            "mean_length": _per("word_chars", "n_words"),
        }
    ).drop("_capitals", "_exclamations", "_n_lines")


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p): sum of exact terms in logarithms; 1 from k > n * p on, where no test passes."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    steps = F.when((k >= 1) & (k <= n * p), F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        larger = F.greatest(s["sum"], term)
        total = larger + F.log1p(F.exp(F.least(s["sum"], term) - larger))
        return F.struct(term.alias("term"), total.alias("sum"))

    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda s: F.exp(s["sum"]))
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def choose_cutoffs(
    labelled: DataFrame, rules: Mapping[str, Sequence[float]] = RULES, limit: float = LIMIT, risk: float = RISK
) -> DataFrame:
    """``stratum`` and a cutoff per rule (null: the rule rejects nothing there).

    ``labelled`` has stratum, y (1 good) and the rules' metrics. A rule may falsely reject
    limit / rules of a stratum's good documents. Each cutoff is tested by the exact binomial
    bound at risk / (rules * strata): Bonferroni over rules and strata, and from lenient to
    strict up to the first failure over cutoffs, so the risk that any chosen cutoff breaks
    its limit is at most ``risk``. Of the cutoffs that pass, the one that rejects most bad
    documents net of good ones is taken, the lenient one of equals.
    """
    n_rules = len(rules)
    sums = [F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")]
    for rule, cutoffs in rules.items():
        for i, c in enumerate(sorted(cutoffs, reverse=True)):
            over = (F.col(rule) > c).cast("bigint")
            sums += [F.sum(over * F.col("y")).alias(f"g_{rule}_{i}"), F.sum(over * (1 - F.col("y"))).alias(f"b_{rule}_{i}")]
    counted = labelled.groupBy("stratum").agg(*sums).withColumn("strata", F.count("*").over(Window.partitionBy()))
    tests = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(i).alias("step"),
                F.lit(float(c)).alias("cutoff"),
                F.col(f"g_{rule}_{i}").alias("g"),
                F.col(f"b_{rule}_{i}").alias("b"),
            )
            for rule, cutoffs in rules.items()
            for i, c in enumerate(sorted(cutoffs, reverse=True))
        ]
    )
    rows = counted.select("stratum", "good", "strata", F.explode(tests).alias("t")).select("stratum", "good", "strata", "t.*")
    passed = rows.withColumn(
        "passes", at_most(F.col("g"), F.col("good"), limit / n_rules) <= F.lit(risk / n_rules) / F.col("strata")
    )
    lenient = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    allowed = passed.withColumn("passes", F.min("passes").over(lenient)).filter(F.col("passes") & (F.col("b") > F.col("g")))
    best = allowed.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("b") - F.col("g"), -F.col("step"))).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules])


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    carry: Sequence[str] = (),
    rules: Mapping[str, Sequence[float]] = RULES,
    limit: float = LIMIT,
    risk: float = RISK,
) -> DataFrame:
    """Per row: ``row`` (struct of the key and carried columns), the base counts, ``base_failed``,
    ``failed`` (names of the rules that reject it) and ``kept``.

    Null texts are empty and fail the base rules. A null stratum counts as the empty string;
    strata with too few labelled good documents for a bound reject by the base rules alone.
    A key with several labels is good if at least half of them say so. Repeated rows are
    judged alike.
    """
    names = [F.col(c) for c in dict.fromkeys([key, *carry])]
    picked = docs.select(
        F.struct(*names).alias("row"), F.col(key).alias("_key"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.col(text).alias("_text")
    )
    measured = materialize(base_metrics(picked).drop("_text"))
    truth = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("y"))
        .dropna()
        .groupBy("_key")
        .agg((F.avg("y") >= 0.5).cast("bigint").alias("y"))
    )
    held = measured.filter(~F.col("base_failed")).select("_key", "stratum", *rules).join(truth, "_key")
    cutoffs = materialize(choose_cutoffs(held, rules, limit, risk))
    failed = F.filter(
        F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in rules]), lambda r: r.isNotNull()
    )
    judged = measured.join(cutoffs, "stratum", "left").withColumn("failed", failed)
    return judged.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
    )
