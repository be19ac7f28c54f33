"""Source, cohort and selection queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.catalog import adapters as A
from casewright.catalog.sql import EVENT_SQL, ordered_days
from casewright.functions.dates import day_str, parse_ts
from casewright.operators import cohort as C
from casewright.operators.filters import before_cutoff, extract_notes, extract_reports
from casewright.operators.numbering import (
    assign_batches,
    distinct_ids,
    number_cases,
    page,
)
from casewright.plans.patient_table import build_patient_table
from casewright.sources.tables import pilot_sample, profile_tables, union_all

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _flags(spark, d):
    return C.index_event_flags(A.event_procedures(spark, d), A.EVENT_CODES)


def shard_union_count(spark, d):
    orders = A.table(spark, d, "orders")
    shards = [orders.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    united = union_all(shards)
    return C.count_patients(united, "o_custkey", ids="n_distinct", rows="n_rows")


def table_profile(spark, d):
    return profile_tables({name: A.table(spark, d, name) for name in TABLES})


def note_filter(spark, d):
    docs = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("note_seq"),
        F.col("source").alias("author"),
        F.col("lang").alias("type"),
        F.col("source").alias("title"),
        "text",
    )
    found = extract_notes(docs, ["de", "fr"], ["src0", "src1", "src2"], A.DOC_KEYWORDS, ("author", "text"))
    return found.select("note_seq", "type", "title", F.md5("text").alias("text_md5"))


def report_filter(spark, d):
    docs = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("note_seq"), F.col("lang").alias("type"), F.col("source").alias("title"), "text"
    )
    both = extract_reports(docs, ["en", "es"], ["src0", "src1", "src2", "src3"])
    return both.select("note_seq", "type", "title", F.md5("text").alias("text_md5"))


def pilot_rows(spark, d):
    tables = {"clinical_note": A.event_items(spark, d, "view"), "radiology_report": A.event_items(spark, d, "error")}
    picked, _ = pilot_sample(tables, 20)
    return union_all(
        df.select(F.lit(name).alias("table_name"), "patient_id", "note_seq") for name, df in picked.items()
    )


def id_page(spark, d):
    return page(A.event_items(spark, d), 25, 3)


def index_flags(spark, d):
    return _flags(spark, d)


def reports_before_index(spark, d):
    return C.reports_before_index(A.event_items(spark, d, "error"), _flags(spark, d)).select(
        "patient_id", "note_seq", "date"
    )


def patient_table(spark, d):
    patients = build_patient_table(
        A.event_items(spark, d, "view"), A.event_items(spark, d, "error"), _flags(spark, d)
    )
    days = lambda c: F.array_join(F.transform(F.col(c), lambda i: F.concat(day_str(i["date"]), i["text"])), "|")
    return patients.select(
        "patient_id",
        "part",
        "had_surgery",
        "had_endoscopy",
        "first_surgery_date",
        F.size("ent_notes").cast("bigint").alias("n_notes"),
        F.size("radiology_reports").cast("bigint").alias("n_reports"),
        days("ent_notes").alias("notes"),
        days("radiology_reports").alias("reports"),
    )


def patient_labels(spark, d):
    """Labels of the older join order: patients with French reports but no English note get none."""
    tables = A.clinical_tables(spark, d)
    patients = build_patient_table(
        extract_notes(tables["clinical_note"], keywords=["en"]),
        extract_reports(tables["radiology_report"]),
        C.index_event_flags(tables["procedures"], A.EVENT_CODES),
        label_join="reference",
    )
    return patients.select("patient_id", "had_surgery", "had_endoscopy", "first_surgery_date")


def history_parts(spark, d):
    history = C.collect_history(A.event_items(spark, d), "items", max_items=16)
    days = F.array_join(F.transform("items", lambda i: F.concat(day_str(i["date"]), i["text"])), "|")
    return history.select("patient_id", "part", F.size("items").cast("bigint").alias("n_items"), days.alias("items"))


def patient_text(spark, d):
    return C.collect_text(A.event_items(spark, d, "view"), "summary")


def last_note_before_index(spark, d):
    notes = A.event_items(spark, d, "view")
    chosen = C.last_note(notes, _flags(spark, d), title="view")
    return chosen.select(
        "patient_id",
        "note_seq",
        day_str(F.col("last_progress_note.date")).alias("note_day"),
        F.col("last_progress_note.text").alias("note_text"),
        "cutoff_missing",
    )


def last_note_excluding_day(spark, d):
    notes = A.event_items(spark, d, "view")
    chosen = C.last_note(notes, _flags(spark, d), title="view", same_day="exclude")
    return chosen.select("patient_id", "note_seq", day_str(F.col("last_progress_note.date")).alias("note_day"))


def previous_note(spark, d):
    notes = A.event_items(spark, d, "view")
    last = C.last_note(notes, _flags(spark, d), title="view")
    refs = last.select("patient_id", F.col("last_progress_note.date").cast("timestamp_ntz").alias("ref_date"))
    found = C.previous_note(notes, refs, title="view")
    return found.select("patient_id", "note_seq", day_str(F.col("previous_note.date")).alias("note_day"))


def note_candidates(spark, d):
    found = C.note_candidates(A.event_items(spark, d, "view"), _flags(spark, d), title="view", back=5)
    return found.withColumn("first_day", day_str(F.col("first_day")))


def case_numbers(spark, d):
    return number_cases(distinct_ids(A.event_items(spark, d)), ["patient_id"])


def case_batches(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id")
    return assign_batches(rows, ["doc_id"], 200)


def latest_rows(spark, d):
    orders = A.table(spark, d, "orders")
    latest = C.latest_per_key(orders, "o_orderkey", "o_custkey")
    return latest.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


def parsed_timestamps(spark, d):
    events = A.table(spark, d, "events")
    kind = F.col("event_id") % 5
    written = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == 2, F.date_format("ts", "MM/dd/yyyy"))
        .when(kind == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.concat(F.lit("about "), F.date_format("ts", "yyyy")))
    )
    parsed = events.select("event_id", parse_ts(written).alias("parsed"))
    return parsed.select("event_id", "parsed", day_str(F.col("parsed")).alias("day"))


def events_before_cutoff(spark, d):
    flags = _flags(spark, d).select("patient_id", "first_surgery_date")
    rows = A.event_items(spark, d).join(flags, "patient_id", "left")
    mark = before_cutoff(F.col("date"), F.col("first_surgery_date"))
    return rows.groupBy("patient_id").agg(F.count_if(mark).alias("n_before"), F.count("*").alias("n_all"))


QUERIES = {
    "shard_union_count": shard_union_count,
    "table_profile": table_profile,
    "note_filter": note_filter,
    "report_filter": report_filter,
    "pilot_sample": pilot_rows,
    "id_page": id_page,
    "index_flags": index_flags,
    "reports_before_index": reports_before_index,
    "events_before_cutoff": events_before_cutoff,
    "patient_table": patient_table,
    "patient_labels": patient_labels,
    "history_parts": history_parts,
    "patient_text": patient_text,
    "last_note_before_index": last_note_before_index,
    "last_note_excluding_day": last_note_excluding_day,
    "previous_note": previous_note,
    "note_candidates": note_candidates,
    "number_cases": case_numbers,
    "batches": case_batches,
    "latest_per_key": latest_rows,
    "parse_timestamps": parsed_timestamps,
}

_PROFILE_ROW = """SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows,
  (SELECT count(*) FROM duckdb_columns() WHERE table_name = '{t}') AS n_columns,
  (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{t}') AS columns"""

_LAST = f"""{EVENT_SQL}, eligible AS (
  SELECT n.*, f.had_surgery, f.first_surgery_date FROM notes n LEFT JOIN flags f USING (patient_id)
  WHERE {{rule}}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY day DESC, note_seq DESC) AS rn FROM eligible)"""
_BEFORE = "f.first_surgery_date IS NULL OR CAST(n.day AS TIMESTAMP) < f.first_surgery_date"

ORACLE = {
    "shard_union_count": """SELECT count(DISTINCT o_custkey) AS n_patients, count(DISTINCT o_custkey) AS n_distinct,
  count(*) AS n_rows FROM orders""",
    "table_profile": "\nUNION ALL\n".join(_PROFILE_ROW.format(t=t) for t in TABLES),
    "note_filter": f"""SELECT doc_id AS note_seq, lang AS type, source AS title, md5(lower(text)) AS text_md5
FROM documents WHERE (lang IN ('de','fr') OR source IN ('src0','src1','src2'))
AND (regexp_matches(source, '(^|[^\\p{{L}}\\p{{N}}_])({"|".join(A.DOC_KEYWORDS)})($|[^\\p{{L}}\\p{{N}}_])', 'i')
  OR regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])({"|".join(A.DOC_KEYWORDS)})($|[^\\p{{L}}\\p{{N}}_])', 'i'))""",
    "report_filter": """SELECT doc_id AS note_seq, lang AS type, source AS title, md5(lower(text)) AS text_md5
FROM documents WHERE lang IN ('en','es') AND source IN ('src0','src1','src2','src3')""",
    "pilot_sample": """WITH ids AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' ORDER BY user_id LIMIT 20)
SELECT CASE event_type WHEN 'view' THEN 'clinical_note' ELSE 'radiology_report' END AS table_name,
  user_id AS patient_id, event_id AS note_seq
FROM events WHERE event_type IN ('view','error') AND user_id IN (SELECT user_id FROM ids)""",
    "id_page": "SELECT DISTINCT user_id AS patient_id FROM events ORDER BY user_id LIMIT 25 OFFSET 75",
    "index_flags": f"{EVENT_SQL} SELECT * FROM flags",
    "reports_before_index": f"""{EVENT_SQL} SELECT r.patient_id, r.note_seq, r.date
FROM reports r LEFT JOIN flags f USING (patient_id)
WHERE f.first_surgery_date IS NULL OR r.date < f.first_surgery_date""",
    "events_before_cutoff": f"""{EVENT_SQL} SELECT e.user_id AS patient_id,
  count(*) FILTER (WHERE f.first_surgery_date IS NULL OR e.ts < f.first_surgery_date) AS n_before, count(*) AS n_all
FROM events e LEFT JOIN flags f ON e.user_id = f.patient_id GROUP BY e.user_id""",
    "patient_table": f"""{EVENT_SQL},
n AS (SELECT patient_id, count(*) AS n_notes, {ordered_days('notes')} FROM notes GROUP BY patient_id),
r AS (SELECT r.patient_id, count(*) FILTER (WHERE keep) AS n_reports, {ordered_days('reports', 'keep')}
  FROM (SELECT r.*, f.first_surgery_date IS NULL OR r.date < f.first_surgery_date AS keep
        FROM reports r LEFT JOIN flags f USING (patient_id)) r GROUP BY r.patient_id)
SELECT patient_id, CAST(0 AS BIGINT) AS part, coalesce(had_surgery, false) AS had_surgery,
  coalesce(had_endoscopy, false) AS had_endoscopy, first_surgery_date, coalesce(n_notes, 0) AS n_notes,
  coalesce(n_reports, 0) AS n_reports, coalesce(notes, '') AS notes, coalesce(reports, '') AS reports
FROM n FULL JOIN r USING (patient_id) LEFT JOIN flags USING (patient_id)""",
    "patient_labels": f"""{EVENT_SQL}, docs AS (SELECT 'p' || CAST(doc_id // 8 AS VARCHAR) AS patient_id, lang FROM documents),
noted AS (SELECT DISTINCT patient_id FROM docs WHERE lang = 'en'),
people AS (SELECT patient_id FROM noted UNION SELECT patient_id FROM docs WHERE lang = 'fr'),
labels_of AS (SELECT 'p' || CAST(patient_id AS VARCHAR) AS patient_id, had_surgery, had_endoscopy, first_surgery_date FROM flags)
SELECT p.patient_id, coalesce(had_surgery, false) AS had_surgery, coalesce(had_endoscopy, false) AS had_endoscopy,
  first_surgery_date FROM people p
LEFT JOIN (SELECT * FROM labels_of WHERE patient_id IN (SELECT patient_id FROM noted)) f USING (patient_id)""",
    "history_parts": f"""WITH p AS (SELECT user_id AS patient_id, event_id AS note_seq, CAST(ts AS DATE) AS day, props AS text,
  (row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) - 1) // 16 AS part FROM events)
SELECT patient_id, part, count(*) AS n_items, {ordered_days('items')} FROM p GROUP BY patient_id, part""",
    "patient_text": """SELECT user_id AS patient_id, CAST(0 AS BIGINT) AS part, string_agg(props, chr(10) || '---' || chr(10) ORDER BY ts, event_id) AS summary
FROM events WHERE event_type = 'view' GROUP BY user_id""",
    "last_note_before_index": f"""{_LAST.format(rule=_BEFORE)}
SELECT patient_id, note_seq, strftime(day, '%Y-%m-%d') AS note_day, text AS note_text,
  coalesce(had_surgery AND first_surgery_date IS NULL, false) AS cutoff_missing FROM ranked WHERE rn = 1""",
    "last_note_excluding_day": f"""{_LAST.format(rule="f.first_surgery_date IS NULL OR n.day < CAST(f.first_surgery_date AS DATE)")}
SELECT patient_id, note_seq, strftime(day, '%Y-%m-%d') AS note_day FROM ranked WHERE rn = 1""",
    "previous_note": f"""{_LAST.format(rule=_BEFORE)},
refs AS (SELECT patient_id, day AS ref_day FROM ranked WHERE rn = 1),
earlier AS (SELECT n.patient_id, n.note_seq, n.day,
  row_number() OVER (PARTITION BY n.patient_id ORDER BY n.day DESC, n.note_seq DESC) AS rn
  FROM notes n JOIN refs USING (patient_id) WHERE n.day < refs.ref_day)
SELECT patient_id, note_seq, strftime(day, '%Y-%m-%d') AS note_day FROM earlier WHERE rn = 1""",
    "note_candidates": f"""{_LAST.format(rule=_BEFORE)},
days AS (SELECT patient_id, day, max(note_seq) AS note_seq FROM eligible GROUP BY patient_id, day),
placed AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY day DESC) - 1 AS k,
  max(day) OVER (PARTITION BY patient_id) AS first_day FROM days)
SELECT patient_id, note_seq, CAST(k AS INTEGER) AS k, strftime(first_day, '%Y-%m-%d') AS first_day FROM placed WHERE k <= 5""",
    "number_cases": """SELECT user_id AS patient_id, row_number() OVER (ORDER BY user_id) AS "llm_caseID"
FROM (SELECT DISTINCT user_id FROM events)""",
    "batches": """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 + 1 AS batch_no FROM documents""",
    "latest_per_key": """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
    "parse_timestamps": """WITH p AS (SELECT event_id, CASE event_id % 5
  WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts)
  WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('second', ts) END AS parsed FROM events)
SELECT event_id, CAST(parsed AS TIMESTAMP) AS parsed, strftime(parsed, '%Y-%m-%d') AS day FROM p""",
}
