"""Evaluation tables against plain Python on hand-made and generated frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.stats import incomplete_beta, pearson_p
from casewright.operators import filters as R
from casewright.operators import metrics as M
from casewright.plans.evaluation import build_evaluation, evaluation_report, stratified_report

SCHEMA = "llm_caseID bigint, actual_surgery int, llm_surgery int, confidence double, has_radiology boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def generated(n=400, seed=5):
    pick = random.Random(seed)
    return [
        (int(pick.random() < 0.4), int(pick.random() < 0.5), pick.choice([None] + [float(i) for i in range(1, 11)]), pick.random() < 0.7)
        for _ in range(n)
    ]


def auc(rows):
    score = lambda r: (5.0 if r[2] is None else r[2]) / 10
    pairs = [(score(p), score(n)) for p in rows if p[0] == 1 for n in rows if n[0] == 0]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs) if pairs else None


def pearson(xs, ys):
    n, mx, my = len(xs), sum(xs) / len(xs), sum(ys) / len(ys)
    cov = sum((x - mx) * (y - my) for x, y in zip(xs, ys))
    return cov / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))


def test_metrics_and_strata(spark):
    rows = generated()
    df = frame(spark, rows).repartition(6)
    total = M.binary_metrics(df).first()
    tp = sum(a == p == 1 for a, p, *_ in rows)
    tn = sum(a == p == 0 for a, p, *_ in rows)
    assert total["accuracy"] == (tp + tn) / len(rows) and total["total_cases"] == len(rows)
    by = {r["group"]: r for r in M.metrics_by(df).collect()}
    assert set(by) == {"overall", "with_radiology", "without_radiology"}
    for c in M.CELLS:
        assert by["overall"][c] == by["with_radiology"][c] + by["without_radiology"][c] == total[c]
    for name, keep in [("overall", (True, False)), ("with_radiology", (True,)), ("without_radiology", (False,))]:
        assert by[name]["auc_roc"] == pytest.approx(auc([r for r in rows if r[3] in keep]), abs=1e-12)
    grouped = {(r["stratum"], r["value"]): r["total_cases"] for r in M.metrics_grouped(df, ["has_radiology"]).collect()}
    assert grouped == {("overall", None): 400, **{("has_radiology", str(k).lower()): sum(r[3] is k for r in rows) for k in (True, False)}}


def test_one_class_only(spark):
    df = frame(spark, [(0, 0, 5.0, True), (0, 0, None, True)])
    row = M.binary_metrics(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"]) == (1.0, 0.0, 0.0, 0.0)
    assert M.roc_auc(df).first()["auc_roc"] is None
    by = {r["group"]: r for r in M.metrics_by(df).collect()}
    assert by["without_radiology"]["accuracy"] is None and by["without_radiology"]["total_cases"] is None
    assert M.findings(M.metrics_by(df)).count() == 0
    cells = {(r[0], r[1]): r[2] for r in M.confusion_table(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_empty_frame(spark):
    row = M.binary_metrics(frame(spark, []).filter("false")).first()
    assert row["accuracy"] is None and row["total_cases"] == 0


def test_auc(spark):
    rows = generated(seed=9)
    df = frame(spark, rows)
    assert M.roc_auc(df).first()[0] == pytest.approx(auc(rows), abs=1e-12)
    negated = M.roc_auc(df, score=-F.coalesce("confidence", F.lit(5.0))).first()[0]
    assert negated == pytest.approx(1 - auc(rows), abs=1e-12)
    unrated = frame(spark, [(1, 1, None, True), (0, 0, None, False)])
    assert M.roc_auc(unrated).first()[0] is None
    assert {r["auc_roc"] for r in M.metrics_by(unrated).collect()} == {None}
    flipped = [(a, p, (10 - (5.0 if c is None else c) if p == 0 else c), r) for a, p, c, r in rows]
    assert M.roc_auc(df, score=M.directional_score()).first()[0] == pytest.approx(auc(flipped), abs=1e-9)


def test_auc_of_many_scores(spark):
    pick = random.Random(21)
    rows = [(int(pick.random() < 0.5), 0, round(pick.random(), 3), pick.choice([True, True, False, None])) for _ in range(600)]
    df = frame(spark, rows).repartition(5)
    assert M.roc_auc(df, score="confidence").first()[0] == pytest.approx(auc([(a, 0, c * 10, r) for a, _, c, r in rows]), abs=1e-12)
    got = {r["has_radiology"]: r["auc_roc"] for r in M.roc_auc(df, score="confidence", by=["has_radiology"]).collect()}
    for side in (True, False, None):
        assert got[side] == pytest.approx(auc([(a, 0, c * 10, r) for a, _, c, r in rows if r is side]), abs=1e-12)


def test_confidence_tables(spark):
    rows = generated(seed=11)
    df = frame(spark, rows)
    table = {r["confidence"]: r for r in M.confidence_table(df).collect()}
    pivot = {r["confidence"]: (r["incorrect"], r["correct"]) for r in M.confidence_pivot(df).collect()}
    assert None not in table and set(table) == set(pivot)
    for level, r in table.items():
        at = [x for x in rows if x[2] == level]
        right = sum(a == p for a, p, *_ in at)
        assert r["n_cases"] == len(at) and r["accuracy"] == right / len(at)
        assert pivot[level] == (len(at) - right, right)


def test_correlation(spark):
    rows = generated(seed=13)
    df = frame(spark, rows)
    rated = [r for r in rows if r[2] is not None]
    want = pearson([r[2] for r in rated], [float(r[0] == r[1]) for r in rated])
    assert M.confidence_corr(df).first()["correlation"] == pytest.approx(want, abs=1e-12)
    filled = pearson([5.0 if r[2] is None else r[2] for r in rows], [float(r[0] == r[1]) for r in rows])
    test = M.pearson_test(df).first()
    assert test["r"] == pytest.approx(filled, abs=1e-12)
    assert test["p_value"] == pytest.approx(pearson_p(filled, len(rows)), abs=1e-12)


@pytest.mark.parametrize("n,corr,test", [(5, False, False), (6, True, False), (10, True, False), (11, True, True)])
def test_minimum_sizes(spark, n, corr, test):
    df = frame(spark, [(1, i % 2, float(i + 1), True) for i in range(n)])
    assert (M.confidence_corr(df, min_n=5).first()["correlation"] is not None) == corr
    row = M.pearson_test(df).first()
    assert (row["r"] is not None) == test and (row["p_value"] is not None) == test


def test_constant_confidence(spark):
    df = frame(spark, [(1, i % 2, 7.0, True) for i in range(20)])
    assert M.confidence_corr(df).first()["correlation"] is None
    assert M.pearson_test(df).first()["p_value"] is None


def test_p_values():
    # Published two-sided t tails: t(10)=2.228, t(20)=2.845, t(5)=4.032
    for df, t, p in [(10, 2.228139, 0.05), (20, 2.845340, 0.01), (5, 4.032143, 0.01), (60, 2.000298, 0.05)]:
        r = t / math.sqrt(df + t * t)
        assert pearson_p(r, df + 2) == pytest.approx(p, rel=1e-5)
        assert pearson_p(-r, df + 2) == pytest.approx(p, rel=1e-5)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert pearson_p(0.3, 2) is None and pearson_p(None, 9) is None


def metrics_rows(spark, **sides):
    rows = [(f"{g}_radiology", *v) for g, v in sides.items()]
    return spark.createDataFrame(rows, "group string, accuracy double, recall double, specificity double, total_cases bigint")


@pytest.mark.parametrize(
    "gap,text", [(0.04, M.MINIMAL_IMPACT), (-0.04, M.MINIMAL_IMPACT), (0.07, None), (0.11, M.POSITIVE_IMPACT), (-0.11, M.NEGATIVE_IMPACT)]
)
def test_accuracy_finding(spark, gap, text):
    df = metrics_rows(spark, **{"with": (0.5 + gap, 0.5, 0.5, 40), "without": (0.5, 0.5, 0.5, 40)})
    assert [r["finding"] for r in M.findings(df).collect()] == ([text] if text else [])


def test_other_findings(spark):
    df = metrics_rows(spark, **{"with": (0.57, 0.7, 0.4, 29), "without": (0.5, 0.6, 0.5, 40)})
    assert [r["finding"] for r in M.findings(df).orderBy("rule").collect()] == [M.SMALL_SAMPLE, M.RECALL_WITH, M.SPECIFICITY_WITHOUT]


def test_class_report_and_outcomes(spark):
    rows = [(1, 1, 8.0, True)] * 3 + [(1, 0, 4.0, True)] + [(0, 0, 6.0, True)] * 4 + [(0, 1, None, True)] * 2
    report = {r["label"]: tuple(r)[1:] for r in M.classification_report(frame(spark, rows)).collect()}
    assert report["Surgery"] == (3 / 5, 3 / 4, 6 / 9, 4)
    assert report["No Surgery"] == (4 / 5, 4 / 6, 8 / 11, 6)
    assert report["accuracy"][0] == 0.7 and report["macro avg"][1] == (4 / 6 + 3 / 4) / 2
    means = {r["outcome"]: (r["n_rated"], r["mean_confidence"]) for r in M.confidence_by_outcome(frame(spark, rows)).collect()}
    assert means == {"correct": (7, 48 / 7), "incorrect": (1, 4.0), "TP": (3, 8.0), "TN": (4, 6.0), "FP": (0, None), "FN": (1, 4.0)}


def test_evaluation_frame(spark):
    cases = spark.createDataFrame(
        [(i, s, [("x",)] if i % 2 else []) for i, s in [(1, True), (2, False), (3, None), (4, True), (5, True), (6, False), (7, True)]],
        "llm_caseID bigint, had_surgery boolean, radiology_reports array<struct<text:string>>",
    )
    results = spark.createDataFrame(
        [(1, "Yes", 8.0, "fine"), (2, "Yes", None, None), (3, "No", 1.0, "x"), (4, "yes", 1.0, "x"), (5, "No", 2.0, "INSUFFICIENT Data, insufficient information"), (6, "No", 3.0, "")],
        "llm_caseID bigint, decision string, confidence double, reasoning string",
    )
    kept, dropped = build_evaluation(cases, results)
    got = {r["llm_caseID"]: (r["outcome"], r["correct_prediction"], r["has_radiology"]) for r in kept.collect()}
    assert got == {1: ("TP", True, True), 2: ("FP", False, False), 6: ("TN", True, False)}
    assert [r["llm_caseID"] for r in dropped.collect()] == [5]
    any_case, _ = build_evaluation(cases, results, mode="yes")
    assert {r["llm_caseID"]: r["llm_surgery"] for r in any_case.collect()} == {1: 1, 2: 1, 4: 1, 6: 0, 7: 0}
    assert set(evaluation_report(kept)) >= {"metrics", "auc", "confusion"}
    assert stratified_report(kept)["difference"].count() == 5


def test_buckets_and_coverage(spark):
    df = spark.createDataFrame(
        [(i, t) for i, t in [(0, "x"), (4999, vocab.NO_REPORTS), (5000, " "), (19999, None), (20000, "y"), (7000, "z")]],
        "llm_caseID bigint, formatted_radiology_text string",
    )
    got = {r["range_lo"]: (r["total"], r["with_imaging"], r["first_valid"], r["last_valid"]) for r in M.coverage_report(df).collect()}
    assert got == {None: (6, 3, 0, 20000), 0: (2, 1, 0, 0), 5000: (2, 1, 7000, 7000), 15000: (1, 0, None, None), 20000: (1, 1, 20000, 20000)}
    assert [r[0] for r in df.select(R.range_bucket(F.col("llm_caseID")), "llm_caseID").orderBy("llm_caseID").collect()] == [0, 0, 1, 1, 3, 4]


def test_distribution(spark):
    rows = {(r["column"], r["value"]): (r["n"], r["share"]) for r in M.value_distribution(frame(spark, [(1, 0, 1.0, True), (1, 1, 2.0, None)])).collect()}
    assert rows[("actual_surgery", "1")] == (2, 1.0) and rows[("has_radiology", None)] == (1, 0.5)
