"""Evaluation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright import vocab
from casewright.catalog import adapters as A
from casewright.catalog import sql as S
from casewright.catalog import text_queries as T
from casewright.functions.display import fmt_num, fmt_pct, round_even
from casewright.operators import metrics as M
from casewright.operators.filters import is_insufficient, range_bucket, split_insufficient
from casewright.plans.evaluation import (
    build_evaluation,
    evaluation_report,
    stratified_report,
)
from casewright.plans.prepare import prepare_cases
from casewright.plans.profile import legacy_profile
from casewright.sources.exports import review_sample, select_eval_columns


def _evaluation(spark, d):
    return build_evaluation(A.document_cases(spark, d), A.document_results(spark, d), A.DOC_INSUFFICIENT)


def _eval(spark, d):
    return _evaluation(spark, d)[0]


def _table(build):
    return lambda spark, d: build(_eval(spark, d))


def eval_frame(spark, d):
    return _eval(spark, d).select(
        "llm_caseID", "llm_surgery", "actual_surgery", "confidence", "has_radiology", "correct_prediction", "outcome"
    )


def insufficient_split(spark, d):
    kept, dropped = split_insufficient(A.document_results(spark, d), A.DOC_INSUFFICIENT)
    mark = lambda df, side: df.select("llm_caseID", F.lit(side).alias("side"))
    return mark(kept, "kept").unionByName(mark(dropped, "dropped"))


def insufficient_mask(spark, d):
    docs = A.table(spark, d, "documents")
    flag = is_insufficient(F.col("text"), ["THBLE", "ouaux"])
    return docs.groupBy("lang", flag.alias("insufficient")).agg(F.count("*").alias("n"))


def auc_directional(spark, d):
    return M.roc_auc(_eval(spark, d), score=M.directional_score())


def auc_by_length(spark, d):
    """AUC of the text length as a score with many values."""
    lengths = A.table(spark, d, "documents").select(F.col("doc_id").alias("llm_caseID"), "n_chars")
    scored = A.document_cases(spark, d).join(lengths, "llm_caseID").filter(F.col("had_surgery").isNotNull())
    labelled = scored.withColumn("actual_surgery", F.col("had_surgery").cast("int"))
    return M.roc_auc(labelled, score="n_chars", by=["has_radiology"])


def metrics_display(spark, d):
    m = M.metrics_by(_eval(spark, d))
    return m.select(
        "group",
        fmt_pct(F.col("accuracy")).alias("accuracy_pct"),
        fmt_num(F.col("recall")).alias("recall_3"),
        fmt_num(F.col("precision") - F.col("recall"), signed=True).alias("gap_3"),
        round_even(F.col("total_cases") / 8, 2).alias("eighth"),
    )


def eval_export(spark, d):
    return select_eval_columns(_eval(spark, d).withColumn("reasoning", F.md5("reasoning")))


def sampled_review(spark, d):
    return review_sample(eval_frame(spark, d))


def _coverage_cases(spark, d):
    return A.document_cases(spark, d).select("llm_caseID", "formatted_radiology_text", "has_radiology")


EDGES = [0, 250, 500, 750]  # the tables have ids beyond the last one


def coverage(spark, d):
    return M.coverage_report(_coverage_cases(spark, d), EDGES)


def coverage_agreement(spark, d):
    return M.coverage_agreement(*prepare_cases(A.clinical_tables(spark, d), T.CASES))


def pearson_p(spark, d):
    """The test per stratum, rounded: SQL has the tail as a finite series only."""
    tested = M.pearson_test(_eval(spark, d), ["has_radiology"])
    return tested.withColumns({"r": F.round("r", 6), "p_value": F.round("p_value", 6)})


def range_buckets(spark, d):
    docs = A.table(spark, d, "documents")
    bucket = range_bucket(F.col("n_chars"), vocab.CASE_RANGE_EDGES)
    return docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _long(tables, columns):
    """Report tables as (table_name, key, value) rows."""
    rows = None
    for name, (keys, value) in columns.items():
        key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
        one = tables[name].select(
            F.lit(name).alias("table_name"), key.alias("key"), F.col(value).cast("double").alias("value")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def overall_report(spark, d):
    tables = evaluation_report(_eval(spark, d))
    return _long(
        tables,
        {
            "metrics": ([], "accuracy"),
            "auc": ([], "auc_roc"),
            "confidence_table": ([M.CONFIDENCE], "accuracy"),
            "confidence_corr": ([], "correlation"),
            "pearson_test": ([], "r"),
            "confidence_pivot": ([M.CONFIDENCE], "incorrect"),
            "confusion": ([M.ACTUAL, M.PRED], "n"),
            "distribution": (["column", "value"], "n"),
        },
    )


def strata_report(spark, d):
    tables = stratified_report(_eval(spark, d))
    return _long(
        tables,
        {
            "metrics": (["group"], "recall"),
            "counts": ([M.STRATUM], "correct_predictions"),
            "difference": (["metric"], "difference"),
            "confidence_table": ([M.STRATUM, M.CONFIDENCE], "accuracy"),
            "confidence_corr": ([M.STRATUM], "correlation"),
            "confusion": ([M.STRATUM, M.ACTUAL, M.PRED], "n"),
            "findings": (["finding"], "rule"),
            "confidence_pivot": ([M.STRATUM, M.CONFIDENCE], "correct"),
        },
    )


def legacy_tables(spark, d):
    customers = A.table(spark, d, "customer")
    answers = customers.select(
        F.col("c_custkey").alias("patient_id"),
        F.when(F.col("c_acctbal") > 5000, "YES").when(F.col("c_acctbal") > 0, "no").alias("decision"),
        (F.col("c_custkey") % 10 + 1).alias("confidence"),
    )
    tables = legacy_profile(T.profile_tables(spark, d), answers, **T.PROFILE_OPTIONS)
    return _long(
        tables,
        {
            "confusion": ([M.ACTUAL, M.PRED], "n"),
            "class_report": (["label"], "recall"),
            "confidence_by_outcome": (["outcome"], "mean_confidence"),
        },
    )


QUERIES = {
    "eval_frame": eval_frame,
    "insufficient_split": insufficient_split,
    "insufficient_mask": insufficient_mask,
    "metrics": _table(M.binary_metrics),
    "metrics_by": _table(M.metrics_by),
    "metrics_grouped": _table(lambda e: M.metrics_grouped(e.withColumn("even", F.col("llm_caseID") % 2 == 0), ["has_radiology", "even"])),
    "auc": _table(M.roc_auc),
    "auc_by_stratum": _table(lambda e: M.roc_auc(e, by=["has_radiology"])),
    "auc_directional": auc_directional,
    "auc_by_length": auc_by_length,
    "confidence_table": _table(M.confidence_table),
    "confidence_by_stratum": _table(lambda e: M.confidence_table(e, ["has_radiology"])),
    "confidence_corr": _table(lambda e: M.confidence_corr(e, ["has_radiology"], min_n=5)),
    "pearson_test": _table(M.pearson_test),
    "pearson_p": pearson_p,
    "pearson_r": _table(lambda e: M.pearson_test(e, ["has_radiology"]).drop("p_value")),
    "confidence_pivot": _table(M.confidence_pivot),
    "confusion": _table(lambda e: M.confusion_table(e, ["has_radiology"])),
    "distribution": _table(M.value_distribution),
    "stratum_counts": _table(M.stratum_counts),
    "difference": _table(lambda e: M.metric_difference(M.metrics_by(e))),
    "findings": _table(lambda e: M.findings(M.metrics_by(e))),
    "class_report": _table(M.classification_report),
    "confidence_by_outcome": _table(M.confidence_by_outcome),
    "coverage": coverage,
    "coverage_agreement": coverage_agreement,
    "range_buckets": range_buckets,
    "display_formats": metrics_display,
    "eval_export": eval_export,
    "review_sample": sampled_review,
    "evaluation_report": overall_report,
    "stratified_report": strata_report,
    "legacy_profile": legacy_tables,
}

_HIT = " OR ".join(f"contains(lower(text), {S.quoted(p.lower())})" for p in A.DOC_INSUFFICIENT)
_EV = f"""ev AS (SELECT doc_id AS id, md5(text) AS reasoning_md5, CAST(n_chars > 900 AS INTEGER) AS p,
  CAST(quality = 1 AS INTEGER) AS a, CASE WHEN doc_id % 13 <> 0 THEN CAST(1 + doc_id % 10 AS DOUBLE) END AS c,
  lang = 'en' AS r FROM documents JOIN labels USING (doc_id) WHERE n_chars % 17 <> 0 AND NOT ({_HIT}))"""
_CELLS = """count(*) FILTER (WHERE a = 1 AND p = 1) AS tp, count(*) FILTER (WHERE a = 0 AND p = 0) AS tn,
  count(*) FILTER (WHERE a = 0 AND p = 1) AS fp, count(*) FILTER (WHERE a = 1 AND p = 0) AS fn, count(*) AS n"""
_METRICS = """(tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1_score,
  coalesce(tn / nullif(tn + fp, 0), 0.0) AS specificity,
  coalesce(tn / nullif(tn + fn, 0), 0.0) AS negative_predictive_value, tp AS true_positives, tn AS true_negatives,
  fp AS false_positives, fn AS false_negatives, n AS total_cases, (tp + fn) / n AS actual_surgery_rate,
  (tp + fp) / n AS predicted_surgery_rate"""


def _auc(name, source, by, score="coalesce(c, 5) / 10"):
    """CTEs ending in ``name`` (by, auc_roc)."""
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""hist_{name} AS (SELECT {group}{score} AS s, count(*) FILTER (WHERE a = 1) AS pos,
  count(*) FILTER (WHERE a = 0) AS neg FROM {source} GROUP BY {group}{score}),
below_{name} AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM hist_{name}),
{name} AS (SELECT {group}sum(pos * (below + neg / 2)) / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS auc_roc
  FROM below_{name} {f'GROUP BY {by}' if by else ''})"""


_BY = f"""spread AS (SELECT 'overall' AS grp, * FROM ev UNION ALL
  SELECT CASE WHEN r THEN 'with_radiology' ELSE 'without_radiology' END, * FROM ev),
cells AS (SELECT grp, {_CELLS}, count(c) AS rated FROM spread GROUP BY grp), {_auc('aucs', 'spread', 'grp')},
names AS (SELECT unnest(['overall', 'with_radiology', 'without_radiology']) AS grp),
strata AS (SELECT names.grp AS "group", {_METRICS}, CASE WHEN rated > 0 THEN auc_roc END AS auc_roc
  FROM names LEFT JOIN cells ON names.grp = cells.grp LEFT JOIN aucs ON names.grp = aucs.grp)"""
_RATES = """count(*) AS n_cases, count(*) FILTER (WHERE a = p) / count(*) AS accuracy,
  count(*) FILTER (WHERE p = 1) / count(*) AS predicted_surgery_rate,
  count(*) FILTER (WHERE a = 1) / count(*) AS actual_surgery_rate"""
_CORR = """sums AS (SELECT r, count(*) AS n_all, CAST(count(c) AS DOUBLE) AS n, sum(c) AS sx,
  sum(CASE WHEN a = p THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE c IS NOT NULL) AS sy, sum(c * c) AS sxx,
  sum(CASE WHEN a = p THEN c ELSE 0 END) FILTER (WHERE c IS NOT NULL) AS sxy FROM ev GROUP BY r)"""
_FILLED = "filled AS (SELECT * REPLACE (coalesce(c, 5) AS c) FROM ev)"
_CORR_FILLED = _CORR.replace("FROM ev", "FROM filled")
_WHOLE = _CORR.replace("SELECT r, ", "SELECT ").replace(" GROUP BY r", "")
_R = "(n * sxy - sx * sy) / nullif(sqrt(n * sxx - sx * sx) * sqrt(n * sy - sy * sy), 0)"
_RULES = f"""rules AS (
SELECT 1 AS rule, CASE WHEN w.total_cases < 30 OR wo.total_cases < 30 THEN '{M.SMALL_SAMPLE}' END AS finding FROM w, wo UNION ALL
SELECT 2, CASE WHEN w.accuracy - wo.accuracy > 0.1 THEN '{M.POSITIVE_IMPACT}' WHEN w.accuracy - wo.accuracy < -0.1
  THEN '{M.NEGATIVE_IMPACT}' WHEN abs(w.accuracy - wo.accuracy) < 0.05 THEN '{M.MINIMAL_IMPACT}' END FROM w, wo UNION ALL
SELECT 3, CASE WHEN w.recall > wo.recall + 0.05 THEN '{M.RECALL_WITH}' WHEN wo.recall > w.recall + 0.05
  THEN '{M.RECALL_WITHOUT}' END FROM w, wo UNION ALL
SELECT 4, CASE WHEN w.specificity > wo.specificity + 0.05 THEN '{M.SPECIFICITY_WITH}'
  WHEN wo.specificity > w.specificity + 0.05 THEN '{M.SPECIFICITY_WITHOUT}' END FROM w, wo)"""
_DIFF = """long AS (UNPIVOT (SELECT "group", accuracy, precision, recall, f1_score, specificity FROM strata)
  ON accuracy, precision, recall, f1_score, specificity INTO NAME metric VALUE value),
diff AS (SELECT metric, coalesce(max(value) FILTER (WHERE "group" = 'with_radiology'), 0.0) AS with_value,
  coalesce(max(value) FILTER (WHERE "group" = 'without_radiology'), 0.0) AS without_value FROM long GROUP BY metric)"""
_PAIR = """w AS (SELECT * FROM strata WHERE "group" = 'with_radiology'),
wo AS (SELECT * FROM strata WHERE "group" = 'without_radiology')"""
_REPORT_ROWS = """rep AS (SELECT tn / nullif(tn + fn, 0) AS p0, tn / nullif(tn + fp, 0) AS r0,
  2 * tn / nullif(2 * tn + fn + fp, 0) AS f0, tn + fp AS s0, tp / nullif(tp + fp, 0) AS p1, tp / nullif(tp + fn, 0) AS r1,
  2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp + fn AS s1, (tp + tn) / n AS acc FROM cells),
full_rep AS (SELECT coalesce(p0, 0.0) AS p0, coalesce(r0, 0.0) AS r0, coalesce(f0, 0.0) AS f0, s0,
  coalesce(p1, 0.0) AS p1, coalesce(r1, 0.0) AS r1, coalesce(f1, 0.0) AS f1, s1, acc FROM rep)"""
_CLASS = """report_rows AS (
SELECT 'No Surgery' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM full_rep UNION ALL
SELECT 'Surgery', p1, r1, f1, s1 FROM full_rep UNION ALL SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM full_rep UNION ALL
SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM full_rep UNION ALL
SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1),
  s0 + s1 FROM full_rep)"""
_OUTCOMES = """outcomes AS (SELECT unnest(CASE WHEN a = 1 AND p = 1 THEN ['correct', 'TP'] WHEN a = 0 AND p = 0 THEN ['correct', 'TN']
  WHEN a = 0 THEN ['incorrect', 'FP'] ELSE ['incorrect', 'FN'] END) AS outcome, c FROM ev),
means AS (SELECT o.outcome, count(c) AS n_rated, sum(c) / nullif(count(c), 0) AS mean_confidence
  FROM (SELECT unnest(['correct', 'incorrect', 'TP', 'TN', 'FP', 'FN']) AS outcome) o LEFT JOIN outcomes USING (outcome)
  GROUP BY o.outcome)"""
_GRID = "grid AS (SELECT ra.a, rp.p FROM (VALUES (0), (1)) ra(a), (VALUES (0), (1)) rp(p))"
_ROW = 'id AS "llm_caseID", p AS llm_surgery, a AS actual_surgery, c AS confidence, r AS has_radiology, a = p AS correct_prediction'
_OUTCOME = "CASE WHEN a = 1 THEN CASE WHEN p = 1 THEN 'TP' ELSE 'FN' END WHEN p = 1 THEN 'FP' ELSE 'TN' END AS outcome"
_DIST = """values_of AS (SELECT 'actual_surgery' AS "column", CAST(a AS VARCHAR) AS value FROM ev UNION ALL
  SELECT 'llm_surgery', CAST(p AS VARCHAR) FROM ev UNION ALL SELECT 'has_radiology', CAST(r AS VARCHAR) FROM ev)"""
_VALID = "SELECT doc_id AS id, lang = 'en' AS valid FROM documents"


def _range(lo, hi, rule):
    return f"""SELECT {lo} AS range_lo, {hi} AS range_hi, count(*) AS total, count(*) FILTER (WHERE valid) AS with_imaging,
  count(*) FILTER (WHERE NOT valid) AS without_imaging, min(id) FILTER (WHERE valid) AS first_valid,
  max(id) FILTER (WHERE valid) AS last_valid, count(*) FILTER (WHERE valid) / nullif(count(*), 0) AS share
  FROM ({_VALID}) v {rule}"""


_LEGACY = f"""WITH {T.PROFILE},
ev AS (SELECT CAST(had_surgery AS INTEGER) AS a, CAST(coalesce(c_acctbal > 5000, false) AS INTEGER) AS p,
  c_custkey % 10 + 1 AS c FROM profile JOIN customer ON c_custkey = patient_id),
cells AS (SELECT {_CELLS} FROM ev), {_REPORT_ROWS}, {_CLASS}, {_OUTCOMES}, {_GRID}
SELECT 'confusion' AS table_name, CAST(a AS VARCHAR) || '/' || CAST(p AS VARCHAR) AS key, CAST(count(ev.c) AS DOUBLE) AS value
  FROM grid LEFT JOIN ev USING (a, p) GROUP BY a, p
UNION ALL SELECT 'class_report', label, recall FROM report_rows
UNION ALL SELECT 'confidence_by_outcome', outcome, mean_confidence FROM means"""


ORACLE = {
    "eval_frame": f"WITH {_EV} SELECT {_ROW}, {_OUTCOME} FROM ev",
    "insufficient_split": f"""SELECT doc_id AS "llm_caseID", CASE WHEN {_HIT} THEN 'dropped' ELSE 'kept' END AS side FROM documents""",
    "insufficient_mask": """SELECT lang, contains(lower(text), 'thble') OR contains(lower(text), 'ouaux') AS insufficient,
  count(*) AS n FROM documents GROUP BY ALL""",
    "metrics": f"WITH {_EV}, cells AS (SELECT {_CELLS} FROM ev) SELECT {_METRICS} FROM cells",
    "metrics_by": f"WITH {_EV}, {_BY} SELECT * FROM strata",
    "metrics_grouped": f"""WITH {_EV}, s AS (SELECT 'overall' AS stratum, NULL::VARCHAR AS value, * FROM ev
  UNION ALL SELECT 'has_radiology', CAST(r AS VARCHAR), * FROM ev UNION ALL SELECT 'even', CAST(id % 2 = 0 AS VARCHAR), * FROM ev),
cells AS (SELECT stratum, value, {_CELLS} FROM s GROUP BY stratum, value) SELECT stratum, value, {_METRICS} FROM cells""",
    "auc": f"WITH {_EV}, {_auc('aucs', 'ev', '')} SELECT auc_roc FROM aucs",
    "auc_by_stratum": f"WITH {_EV}, {_auc('aucs', 'ev', 'r')} SELECT r AS has_radiology, auc_roc FROM aucs",
    "auc_directional": f"""WITH {_EV}, {_auc('aucs', 'ev', '', 'CASE WHEN p = 1 THEN coalesce(c, 5) / 10 ELSE (10 - coalesce(c, 5)) / 10 END')}
SELECT auc_roc FROM aucs""",
    "auc_by_length": f"""WITH lab AS (SELECT lang = 'en' AS r, n_chars, CAST(quality = 1 AS INTEGER) AS a
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), {_auc('aucs', 'lab', 'r', 'n_chars')}
SELECT r AS has_radiology, auc_roc FROM aucs""",
    "confidence_table": f"WITH {_EV} SELECT c AS confidence, {_RATES} FROM ev WHERE c IS NOT NULL GROUP BY c",
    "confidence_by_stratum": f"""WITH {_EV} SELECT r AS has_radiology, c AS confidence, {_RATES} FROM ev
WHERE c IS NOT NULL GROUP BY r, c""",
    "confidence_corr": f"""WITH {_EV}, {_CORR} SELECT r AS has_radiology, n_all AS n_cases, CASE WHEN n_all > 5 THEN
  (n * sxy - sx * sy) / nullif(sqrt(n * sxx - sx * sx) * sqrt(n * sy - sy * sy), 0) END AS correlation FROM sums""",
    "pearson_r": f"""WITH {_EV}, {_FILLED}, {_CORR_FILLED}
SELECT r AS has_radiology, n_all AS n_cases, CASE WHEN n_all > 10 THEN
  (n * sxy - sx * sy) / nullif(sqrt(n * sxx - sx * sx) * sqrt(n * sy - sy * sy), 0) END AS r FROM sums""",
    "pearson_p": f"""WITH {_EV}, {_FILLED}, {_CORR_FILLED}, rs AS (SELECT r AS side, n_all AS n_cases, n_all - 2 AS df, CASE WHEN n_all > 10 THEN
  (n * sxy - sx * sy) / nullif(sqrt(n * sxx - sx * sx) * sqrt(n * sy - sy * sy), 0) END AS r FROM sums),
-- the angle of Student's t; its cosine and sine are functions of r
angles AS (SELECT *, asin(r) AS angle, sqrt(1 - r * r) AS c FROM rs)
SELECT side AS has_radiology, n_cases, round(r, 6) AS r, round(1 - abs(CASE WHEN df % 2 = 1
  THEN 2 / pi() * (angle + r * coalesce(list_sum([exp(lgamma(k) + lgamma(1.5) - lgamma(k + 0.5)) * c ** (2 * k - 1) FOR k IN range(1, (df + 1) // 2)]), 0))
  ELSE r * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * c ** (2 * k) FOR k IN range(0, df // 2)]) END), 6) AS p_value
FROM angles""",
    "confidence_pivot": f"""WITH {_EV} SELECT c AS confidence, count(*) FILTER (WHERE a <> p) AS incorrect,
  count(*) FILTER (WHERE a = p) AS correct FROM ev WHERE c IS NOT NULL GROUP BY c""",
    "confusion": f"""WITH {_EV}, {_GRID}, sides AS (SELECT DISTINCT r FROM ev)
SELECT s.r AS has_radiology, g.a AS actual_surgery, g.p AS llm_surgery, count(ev.id) AS n
FROM sides s CROSS JOIN grid g LEFT JOIN ev ON ev.r = s.r AND ev.a = g.a AND ev.p = g.p GROUP BY ALL""",
    "distribution": f"""WITH {_EV}, {_DIST} SELECT "column", value, count(*) AS n, count(*) / (SELECT count(*) FROM ev) AS share
FROM values_of GROUP BY "column", value""",
    "stratum_counts": f"""WITH {_EV} SELECT r AS has_radiology, count(*) AS total_cases, count(*) FILTER (WHERE a = 1) AS actual_surgery,
  count(*) FILTER (WHERE p = 1) AS predicted_surgery, count(*) FILTER (WHERE a = p) AS correct_predictions,
  count(*) FILTER (WHERE a = 1) / count(*) AS actual_rate, count(*) FILTER (WHERE p = 1) / count(*) AS predicted_rate
FROM ev GROUP BY r""",
    "difference": f"""WITH {_EV}, {_BY}, {_DIFF} SELECT metric, with_value, without_value, with_value - without_value AS difference FROM diff""",
    "findings": f"""WITH {_EV}, {_BY}, {_PAIR}, {_RULES} SELECT rule, finding FROM rules WHERE finding IS NOT NULL""",
    "class_report": f"""WITH {_EV}, cells AS (SELECT {_CELLS} FROM ev), {_REPORT_ROWS}, {_CLASS} SELECT * FROM report_rows""",
    "confidence_by_outcome": f"WITH {_EV}, {_OUTCOMES} SELECT * FROM means",
    "coverage": "\nUNION ALL\n".join(
        [_range("NULL::BIGINT", "NULL::BIGINT", "")]
        + [
            _range(f"{lo}::BIGINT", f"{hi}::BIGINT", f"WHERE id >= {lo} AND id < {hi} HAVING count(*) > 0")
            for lo, hi in zip(EDGES, EDGES[1:])
        ]
        + [_range(f"{EDGES[-1]}::BIGINT", "NULL::BIGINT", f"WHERE id >= {EDGES[-1]} HAVING count(*) > 0")]
    ),
    "coverage_agreement": f"""SELECT *, rendered = prepared AS agree FROM (
  SELECT count(*) FILTER (WHERE report_md5 <> md5({S.quoted(vocab.NO_REPORTS)})) AS rendered,
    count(*) FILTER (WHERE has_radiology) AS prepared FROM ({T.ORACLE["prepare_cases"]}) cases)""",
    "range_buckets": """SELECT CASE WHEN n_chars >= 0 AND n_chars < 5000 THEN 0 WHEN n_chars >= 5000 AND n_chars < 10000 THEN 1
  WHEN n_chars >= 10000 AND n_chars < 15000 THEN 2 WHEN n_chars >= 15000 AND n_chars < 20000 THEN 3 WHEN n_chars >= 20000 THEN 4 END AS bucket,
  count(*) AS n FROM documents GROUP BY ALL""",
    "display_formats": f"""WITH {_EV}, {_BY} SELECT "group", format('{{:.1f}}%', accuracy * 100) AS accuracy_pct,
  format('{{:.3f}}', recall) AS recall_3, format('{{:+.3f}}', precision - recall) AS gap_3,
  round_even(total_cases / 8, 2) AS eighth FROM strata""",
    "eval_export": f"""WITH {_EV} SELECT id AS "llm_caseID", c AS confidence, p AS llm_surgery, a AS actual_surgery,
  reasoning_md5 AS reasoning FROM ev""",
    "review_sample": f"WITH {_EV} SELECT {_ROW}, {_OUTCOME} FROM ev ORDER BY id LIMIT 200",
    "evaluation_report": f"""WITH {_EV}, cells AS (SELECT {_CELLS} FROM ev), {_auc('aucs', 'ev', '')}, {_GRID}, {_DIST}
SELECT 'metrics' AS table_name, '' AS key, (tp + tn) / n AS value FROM cells
UNION ALL SELECT 'auc', '', auc_roc FROM aucs
UNION ALL SELECT 'confusion', CAST(a AS VARCHAR) || '/' || CAST(p AS VARCHAR), count(id) FROM grid LEFT JOIN ev USING (a, p) GROUP BY a, p
UNION ALL SELECT 'distribution', "column" || '/' || value, count(*) FROM values_of GROUP BY "column", value
UNION ALL SELECT 'confidence_table', CAST(c AS VARCHAR), count(*) FILTER (WHERE a = p) / count(*) FROM ev WHERE c IS NOT NULL GROUP BY c
UNION ALL SELECT 'confidence_pivot', CAST(c AS VARCHAR), count(*) FILTER (WHERE a <> p) FROM ev WHERE c IS NOT NULL GROUP BY c
UNION ALL (WITH {_WHOLE} SELECT 'confidence_corr', '', {_R} FROM sums)
UNION ALL (WITH {_FILLED}, {_WHOLE.replace("FROM ev", "FROM filled")} SELECT 'pearson_test', '', CASE WHEN n_all > 10 THEN {_R} END FROM sums)""",
    "stratified_report": f"""WITH {_EV}, {_BY}, {_DIFF}, {_CORR}, {_GRID}, {_PAIR}, {_RULES}
SELECT 'metrics' AS table_name, "group" AS key, recall AS value FROM strata
UNION ALL SELECT 'counts', CAST(r AS VARCHAR), count(*) FILTER (WHERE a = p) FROM ev GROUP BY r
UNION ALL SELECT 'difference', metric, with_value - without_value FROM diff
UNION ALL SELECT 'confidence_pivot', CAST(r AS VARCHAR) || '/' || CAST(c AS VARCHAR), count(*) FILTER (WHERE a = p)
  FROM ev WHERE c IS NOT NULL GROUP BY r, c
UNION ALL SELECT 'confidence_table', CAST(r AS VARCHAR) || '/' || CAST(c AS VARCHAR), count(*) FILTER (WHERE a = p) / count(*)
  FROM ev WHERE c IS NOT NULL GROUP BY r, c
UNION ALL SELECT 'confidence_corr', CAST(r AS VARCHAR), CASE WHEN n_all > 5 THEN {_R} END FROM sums
UNION ALL SELECT 'confusion', CAST(s.r AS VARCHAR) || '/' || CAST(g.a AS VARCHAR) || '/' || CAST(g.p AS VARCHAR), count(ev.id)
  FROM (SELECT DISTINCT r FROM ev) s CROSS JOIN grid g LEFT JOIN ev ON ev.r = s.r AND ev.a = g.a AND ev.p = g.p GROUP BY ALL
UNION ALL SELECT 'findings', finding, rule FROM rules WHERE finding IS NOT NULL""",
    "legacy_profile": _LEGACY,
}
