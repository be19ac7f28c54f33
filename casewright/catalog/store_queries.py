"""Queries that write shards, results and exports to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright import schemas
from casewright.catalog import adapters as A
from casewright.catalog import answer_queries as Q
from casewright.catalog import eval_queries as E
from casewright.operators import metrics as M
from casewright.operators.cohort import collect_history, collect_text
from casewright.operators.registry import number_with_registry, read_page, write_page_index
from casewright.operators.sketches import overlap_estimates, relative_error, shard_sketches
from casewright.plans.scoring_run import run_scoring
from casewright.session import shared_dir
from casewright.sources.exports import export_eval_csv, export_insufficient, export_review_sample
from casewright.sources.results import (
    append_results,
    compact_results,
    final_path,
    read_results,
    read_version,
    unreadable_files,
)
from casewright.sources.tables import load_tables, profile_tables, read_shards, union_all


def _folder(spark):
    return f"{shared_dir(spark).rstrip('/')}/casewright/{uuid.uuid4().hex}"


def shard_read(spark, d):
    """Orders dealt to two shards, the second without one column, read as one table."""
    orders, root = A.table(spark, d, "orders"), _folder(spark)
    done = F.col("o_orderstatus") == "F"
    orders.filter(done).write.parquet(f"{root}/a/orders.parquet")
    orders.filter(~done).drop("o_orderpriority").write.parquet(f"{root}/b/orders.parquet")
    united = read_shards(spark, [f"{root}/a", f"{root}/b"], "orders")
    return united.groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"), F.count("o_orderpriority").alias("n_priority"), F.max("o_orderkey").alias("last_order")
    )


def tables_loaded(spark, d):
    """Notes and procedures in two shards; imaging is optional and absent."""
    given, root = A.clinical_tables(spark, d), _folder(spark)
    for name in ("clinical_note", "procedures"):
        names = schemas.TABLES[name].fieldNames()
        side = F.pmod(F.xxhash64("patient_id"), F.lit(2))
        for n, shard in enumerate("ab"):
            given[name].select(*names).filter(side == n).write.parquet(f"{root}/{shard}/{name}.parquet")
    tables = load_tables(
        spark, [f"{root}/a", f"{root}/b"], ["clinical_note", "radiology_report", "procedures"], ["radiology_report"]
    )
    return profile_tables(tables)


def _refuse(prompt):
    raise ValueError("offline")


def _run(spark, d, store, responder, run_id, **options):
    cases = A.document_cases(spark, d).select(*schemas.CASE.fieldNames())
    return run_scoring(
        cases,
        store,
        responder,
        provider="stub",
        model_name="length/1",
        run_id=run_id,
        build_prompts=lambda share: share.withColumn("prompt", F.col("formatted_progress_text")),
        concurrency=8,
        **options,
    )


def run_snapshots(spark, d):
    """What the last snapshots and the final file of a run hold."""
    root = _folder(spark)
    store, latest, final = f"{root}/store", f"{root}/latest", f"{root}/final"
    _run(spark, d, store, A.respond, "run-1", rounds=3, latest=latest, latest_every=2, final=final)
    places = {
        "latest": latest,
        "last batch": f"{latest}_after_batch_003",
        "final": final_path(final, "stub", "length/1", "run-1"),
    }
    rows = None
    for name, path in places.items():
        one = spark.read.parquet(path).select(F.lit(name).alias("place"), "llm_caseID", "decision", "confidence", "reasoning")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def scoring_retry(spark, d):
    """A run in which every call fails, then one that asks again."""
    store = _folder(spark)
    _run(spark, d, store, _refuse, "run-1")
    found = _run(spark, d, store, A.respond, "run-2", retry_failed=True)
    stored = read_results(spark, store).groupBy("llm_caseID").agg(F.count("*").alias("n_stored"))
    return found.select("llm_caseID", "decision", "confidence", "reasoning", "run_id").join(stored, "llm_caseID")


_CSV = "llm_caseID bigint, confidence double, llm_surgery int, actual_surgery int, reasoning string"


def _read_csv(spark, path, schema):
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def csv_export(spark, d):
    path = export_eval_csv(E._eval(spark, d), f"{_folder(spark)}/eval")
    return _read_csv(spark, path, _CSV).withColumn("reasoning", F.md5("reasoning"))


def csv_dropped(spark, d):
    """The rows written aside and those returned."""
    path = f"{_folder(spark)}/dropped.csv"
    kept = export_insufficient(A.document_results(spark, d), path, A.DOC_INSUFFICIENT)
    aside = _read_csv(spark, path, "llm_caseID bigint, confidence double, reasoning string")
    mark = lambda df, side: df.select(
        "llm_caseID", "confidence", F.md5("reasoning").alias("reasoning_md5"), F.lit(side).alias("side")
    )
    return mark(aside, "dropped").unionByName(mark(kept, "kept"))


def csv_review(spark, d):
    """The full result and its first 200 cases, read back."""
    root = _folder(spark)
    frame = E.eval_frame(spark, d).select("llm_caseID", M.PRED, M.ACTUAL, "outcome")
    export_review_sample(frame, f"{root}/full.csv", f"{root}/sample.csv")
    read = lambda name: _read_csv(spark, f"{root}/{name}.csv", frame.schema).withColumn("file", F.lit(name))
    return read("full").unionByName(read("sample"))


def store_compacted(spark, d):
    """Twenty rounds, compacted, one round more, compacted again: what readers of each version find."""
    store = _folder(spark)
    answers = A.document_results(spark, d).select("llm_caseID", "confidence", "reasoning")
    for name in schemas.RESULT.fieldNames():
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit("p" if name == "provider" else None).cast(schemas.RESULT[name].dataType))
    turn = F.pmod(F.xxhash64("llm_caseID"), F.lit(21))
    for n in range(20):
        append_results(answers.filter(turn == n), store, f"run-{n:02d}")
    first = compact_results(spark, store)
    append_results(answers.filter(turn == 20), store, "run-20")
    old = read_version(spark, store, first)
    second = compact_results(spark, store)
    readers = {"plain": read_results(spark, store), "first": old, "second": read_version(spark, store, second)}
    files = lambda df: df.select("_metadata.file_name").distinct().count()
    fewer = files(spark.read.parquet(f"{store}_compacted/rows").filter(F.col("version") == second)) < files(spark.read.parquet(store))
    rows = [df.select(F.lit(name).alias("reader"), "llm_caseID", "confidence", F.md5("reasoning").alias("reasoning_md5"), F.lit(fewer).alias("fewer_files")) for name, df in readers.items()]
    return union_all(rows)


def unreadable_report(spark, d):
    """A store with one damaged file: its name is reported, the rows of the other files are read."""
    store = _folder(spark)
    answers = A.document_results(spark, d).select("llm_caseID", "confidence", "reasoning")
    for name in schemas.RESULT.fieldNames():
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit("p" if name == "provider" else None).cast(schemas.RESULT[name].dataType))
    append_results(answers, store, "run-0")
    fs = spark._jvm.org.apache.hadoop.fs
    target = fs.Path(f"{store}/provider=p/run_id=run-0/damaged.parquet")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(b"no parquet"))
    out.close()
    found = read_results(spark, store, skip_unreadable=True).agg(F.count("*").alias("n")).scalar()
    return unreadable_files(spark, store).withColumn("n_rows", found)


def case_registry(spark, d):
    """Documents in two loads: numbers of the first stay, new ones follow."""
    registry = _folder(spark)
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("patient_id"))
    number_with_registry(docs.filter("patient_id % 2 = 0"), registry).count()
    return number_with_registry(docs, registry)


def indexed_pages(spark, d):
    """Three pages of users from a kept index of ranges."""
    index = _folder(spark)
    users = A.table(spark, d, "events").select(F.col("user_id").alias("patient_id"))
    write_page_index(users, index)
    return union_all([read_page(spark, index, 7, n).withColumn("page_no", F.lit(n)) for n in (0, 1, 3)])


def customer_sketches(spark, d):
    """Distinct customers of order shards: exact, and whether the sketches are within 3 %."""
    orders = A.table(spark, d, "orders")
    sketches = shard_sketches(orders, "o_orderstatus", "o_custkey")
    exact = orders.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n_customers"))
    close = relative_error(F.col("estimate"), F.col("n_customers")) < 0.03
    return exact.join(sketches, "o_orderstatus").select("o_orderstatus", "n_customers", close.alias("close"))


def customer_overlaps(spark, d):
    """Customers that two order shards share: exact, and whether the sketches keep their bound."""
    orders = A.table(spark, d, "orders")
    held = orders.select("o_orderstatus", "o_custkey").distinct()
    pairs = held.toDF("a", "o_custkey").join(held.toDF("b", "o_custkey"), "o_custkey").filter("a < b")
    exact = pairs.groupBy("a", "b").agg(F.count("*").alias("n_both"))
    found = overlap_estimates(exact.select("a", "b"), shard_sketches(orders, "o_orderstatus", "o_custkey"), "o_orderstatus")
    bounded = F.abs(F.col("both") - F.col("n_both")) <= F.col("both_error") + 0.5
    return exact.join(found, ["a", "b"]).select("a", "b", "n_both", bounded.alias("bounded"))


def whole_texts(spark, d):
    """All documents of a source as one text, joined in parts of 64 KB."""
    notes = A.table(spark, d, "documents").select(F.col("source").alias("patient_id"), F.col("doc_id").alias("note_seq"), "text", A.doc_date().alias("date"))
    joined = collect_text(notes, "summary", max_items=None, part_bytes=1 << 16)
    return joined.select("patient_id", F.length("summary").alias("n_chars"), F.md5("summary").alias("summary_md5"))


def whole_histories(spark, d):
    """All documents of a source as one history, nested in parts of 64 KB."""
    notes = A.table(spark, d, "documents").select(
        F.col("source").alias("patient_id"), F.col("doc_id").alias("note_seq"), "text", A.doc_date().alias("date"),
        F.lit(None).cast("string").alias("type"), F.col("lang").alias("title"),
    )
    nested = collect_history(notes, "items", max_items=None, part_bytes=1 << 16)
    shown = F.array_join(F.transform("items", lambda i: F.concat(i["title"], F.lit(":"), F.md5(i["text"]))), "|")
    return nested.select("patient_id", "part", F.size("items").cast("bigint").alias("n_items"), F.md5(shown).alias("items_md5"))


QUERIES = {
    "store_compacted": store_compacted,
    "unreadable_report": unreadable_report,
    "case_registry": case_registry,
    "indexed_pages": indexed_pages,
    "customer_sketches": customer_sketches,
    "customer_overlaps": customer_overlaps,
    "whole_texts": whole_texts,
    "whole_histories": whole_histories,
    "shard_read": shard_read,
    "tables_loaded": tables_loaded,
    "run_snapshots": run_snapshots,
    "scoring_retry": scoring_retry,
    "csv_export": csv_export,
    "csv_dropped": csv_dropped,
    "csv_review": csv_review,
}

_ASKED = f"WITH {Q._DOC_PROMPTS}, {Q._stub('prompts')}"
_COLUMNS = {name: ",".join(schemas.TABLES[name].fieldNames()) for name in ("clinical_note", "radiology_report", "procedures")}
_COUNTS = {
    "clinical_note": "(SELECT count(*) FROM documents)",
    "radiology_report": "0::BIGINT",
    "procedures": "(SELECT count(*) FROM events WHERE event_type = 'purchase')",
}

_ANSWERS = """SELECT doc_id AS "llm_caseID", CASE WHEN doc_id % 13 <> 0 THEN CAST(1 + doc_id % 10 AS DOUBLE) END AS confidence,
  md5(text) AS reasoning_md5 FROM documents"""

ORACLE = {
    "store_compacted": f"""SELECT reader, answers.*, true AS fewer_files
FROM ({_ANSWERS}) answers, (SELECT unnest(['plain', 'first', 'second']) AS reader) readers""",
    "unreadable_report": """SELECT 'damaged.parquet' AS file_name, CAST(10 AS BIGINT) AS length, (SELECT count(*) FROM documents) AS n_rows""",
    "case_registry": """SELECT doc_id AS patient_id, row_number() OVER (ORDER BY doc_id % 2, doc_id) AS "llm_caseID" FROM documents""",
    "indexed_pages": """SELECT patient_id, CAST(no // 7 AS INTEGER) AS page_no
FROM (SELECT user_id AS patient_id, row_number() OVER (ORDER BY user_id) - 1 AS no FROM (SELECT DISTINCT user_id FROM events))
WHERE no // 7 IN (0, 1, 3)""",
    "customer_sketches": """SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers, true AS "close" FROM orders GROUP BY o_orderstatus""",
    "customer_overlaps": """WITH held AS (SELECT DISTINCT o_orderstatus AS s, o_custkey FROM orders)
SELECT x.s AS a, y.s AS b, count(*) AS n_both, true AS bounded FROM held x JOIN held y ON x.o_custkey = y.o_custkey AND x.s < y.s GROUP BY x.s, y.s""",
    "whole_texts": """SELECT source AS patient_id, CAST(length(s) AS INTEGER) AS n_chars, md5(s) AS summary_md5 FROM (
  SELECT source, string_agg(text, chr(10) || '---' || chr(10) ORDER BY doc_id % 97, doc_id) AS s FROM documents GROUP BY source)""",
    "whole_histories": """SELECT source AS patient_id, CAST(0 AS BIGINT) AS part, count(*) AS n_items,
  md5(string_agg(lang || ':' || md5(text), '|' ORDER BY doc_id % 97, doc_id)) AS items_md5 FROM documents GROUP BY source""",
    "shard_read": """SELECT o_orderstatus, count(*) AS n_rows,
  count(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS n_priority, max(o_orderkey) AS last_order
FROM orders GROUP BY o_orderstatus""",
    "tables_loaded": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, {_COUNTS[name]} AS n_rows, {len(columns.split(','))}::BIGINT AS n_columns, '{columns}' AS columns"
        for name, columns in _COLUMNS.items()
    ),
    "run_snapshots": f"""{_ASKED} SELECT place, id AS "llm_caseID", {Q._ANSWERED}
FROM asked, (SELECT unnest(['latest', 'last batch', 'final']) AS place) places""",
    "scoring_retry": f"""{_ASKED}, second AS (SELECT id, api_response, {Q._ANSWERED} FROM asked)
SELECT id AS "llm_caseID", decision, confidence,
  CASE WHEN api_response IS NULL THEN 'Error: offline' ELSE reasoning END AS reasoning,
  CASE WHEN api_response IS NULL THEN 'run-1' ELSE 'run-2' END AS run_id, 2::BIGINT AS n_stored FROM second""",
    "csv_export": f"""WITH {E._EV} SELECT id AS "llm_caseID", c AS confidence, p AS llm_surgery, a AS actual_surgery,
  reasoning_md5 AS reasoning FROM ev""",
    "csv_dropped": f"""SELECT doc_id AS "llm_caseID", CASE WHEN doc_id % 13 <> 0 THEN CAST(1 + doc_id % 10 AS DOUBLE) END AS confidence,
  md5(text) AS reasoning_md5, CASE WHEN {E._HIT} THEN 'dropped' ELSE 'kept' END AS side FROM documents""",
    "csv_review": f"""WITH {E._EV}, full_rows AS (SELECT id AS "llm_caseID", p AS llm_surgery, a AS actual_surgery, {E._OUTCOME} FROM ev)
SELECT *, 'full' AS file FROM full_rows
UNION ALL SELECT * FROM (SELECT *, 'sample' AS file FROM full_rows ORDER BY "llm_caseID" LIMIT 200)""",
}
