"""Answer parsing, scoring and run-bookkeeping queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright import schemas, vocab
from casewright.catalog import adapters as A
from casewright.catalog import sql as S
from casewright.catalog import text_queries as T
from casewright.functions.answers import (
    parse_answer,
    parse_json_answer,
    parse_labelled_answer,
    path_safe,
)
from casewright.operators import bitmaps as B
from casewright.operators import progress as P
from casewright.operators.filters import between_cases
from casewright.operators.numbering import assign_batches
from casewright.operators.scoring import attach_responses, score
from casewright.plans.scoring_run import run_few_shot, run_scoring
from casewright.session import shared_dir
from casewright.sources.results import PRIORITY, append_results, read_results
from casewright.streaming.pending import read_case_stream, score_stream


def _parsed(answers, parser):
    return answers.select("llm_caseID", parser(F.col("api_response")).alias("a")).select("llm_caseID", "a.*")


def parse_json(spark, d):
    return _parsed(A.json_answers(spark, d), parse_json_answer)


def parse_lines(spark, d):
    return _parsed(A.line_answers(spark, d), parse_labelled_answer)


def parse_any(spark, d):
    answers = A.json_answers(spark, d).unionByName(A.line_answers(spark, d))
    parsed = answers.select("llm_caseID", "api_response", parse_answer(F.col("api_response")).alias("a"))
    return parsed.groupBy("a.decision", "a.confidence", "a.parse_status", "a.decision_valid", "a.confidence_valid").agg(
        F.count("*").alias("n"), F.min("llm_caseID").alias("first_case")
    )


def _cases(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("llm_caseID"), "source", "n_chars")


def pending_cases(spark, d):
    return P.pending(_cases(spark, d), A.label_results(spark, d))


def missing_cases(spark, d):
    return P.missing_cases(_cases(spark, d), A.label_results(spark, d))


def completed_ids(spark, d):
    return P.completed_ids(A.label_results(spark, d))


def completed_batches(spark, d):
    batched = assign_batches(_cases(spark, d), ["llm_caseID"], 4)
    return P.completed_batches(batched, A.label_results(spark, d))


def _two_runs(spark, d):
    """Every document's result, then the labelled ones again in a later run."""
    first = A.document_results(spark, d).select("llm_caseID", "decision").withColumn("run_id", F.lit("run-2"))
    second = A.label_results(spark, d).select("llm_caseID", "decision").withColumn("run_id", F.lit("run-1"))
    return P.combine_results(first, second)


def combined_results(spark, d):
    stored = A.document_results(spark, d).select("llm_caseID", "decision", "confidence")
    new = A.label_results(spark, d)
    return P.combine_results(stored, new)


def dedup(spark, d):
    return P.dedup_results(_two_runs(spark, d), ["run_id"])


def run_summary(spark, d):
    return P.run_summary(A.document_results(spark, d))


def progress_status(spark, d):
    status = P.progress_status(_cases(spark, d), A.label_results(spark, d))
    return status.withColumn("first_done", F.array_join("first_done", ","))


def batch_manifest(spark, d):
    return P.batch_manifest(A.label_results(spark, d))


def case_range(spark, d):
    return between_cases(A.document_results(spark, d).select("llm_caseID", "decision", "confidence"), 100, 400)


def safe_names(spark, d):
    events = A.table(spark, d, "events")
    name = F.concat("event_type", F.lit("/v:"), (F.col("user_id") % 7).cast("string"), F.lit("@x"))
    return events.groupBy(name.alias("model_name")).agg(F.count("*").alias("n")).withColumn(
        "path_name", path_safe(F.col("model_name"))
    )


def score_stub(spark, d):
    prompts = A.document_cases(spark, d).select("llm_caseID", F.col("formatted_progress_text").alias("prompt"))
    return score(prompts, A.respond, provider="stub", model_name="length/1", concurrency=8)


def stored_answers(spark, d):
    prompts = _cases(spark, d).select("llm_caseID", F.col("source").alias("prompt"))
    return attach_responses(prompts, A.json_answers(spark, d))


def _store(spark):
    return f"{shared_dir(spark).rstrip('/')}/casewright/{uuid.uuid4().hex}"


def _earlier_run(spark, d, store):
    """The labelled documents as an earlier run's results."""
    earlier = A.label_results(spark, d).select(
        "llm_caseID",
        "decision",
        F.lit(9.0).alias("confidence"),
        F.lit("earlier").alias("reasoning"),
        F.lit(None).cast("string").alias("api_response"),
        F.lit("ok").alias("parse_status"),
        F.lit("stub").alias("provider"),
        F.lit("length/1").alias("model_name"),
    )
    append_results(earlier, store, "run-0")


def _seen(spark, d):
    """The finished ids of two rounds, kept as bitmaps that overlap."""
    seen, docs = _store(spark), A.table(spark, d, "documents").select(F.col("doc_id").alias("llm_caseID"))
    B.add_to_bitmap(docs.filter("llm_caseID % 3 = 0"), seen)
    B.add_to_bitmap(docs.filter("llm_caseID % 5 < 2 OR llm_caseID = 7"), seen)
    return docs, B.read_bitmap(spark, seen)


def pending_bitmap(spark, d):
    return B.pending_by_bitmap(*_seen(spark, d))


def batches_bitmap(spark, d):
    docs, seen = _seen(spark, d)
    return B.completed_by_bitmap(docs.withColumn("batch_no", F.floor(F.col("llm_caseID") / 4)), seen)


def scoring_seen(spark, d):
    """A run that keeps its finished ids as bitmaps, and the same run again, which finds nothing to ask."""
    store, seen = _store(spark), _store(spark)
    _earlier_run(spark, d, store)
    cases = A.document_cases(spark, d).select(*[f.name for f in schemas.CASE])
    for n in (1, 2):
        found = run_scoring(
            cases,
            store,
            A.respond,
            provider="stub",
            model_name="length/1",
            run_id=f"run-{n}",
            build_prompts=lambda share: share.withColumn("prompt", F.col("formatted_progress_text")),
            rounds=2,
            concurrency=8,
            seen=seen,
        )
    stored = read_results(spark, store).agg(F.count("*").alias("n")).scalar()
    kept = B.bitmap_size(B.read_bitmap(spark, seen)).select("n_ids").scalar()
    return found.groupBy("run_id").agg(F.count("*").alias("n_cases")).withColumns({"n_stored": stored, "n_ids": kept})


def scoring_resume(spark, d):
    store = _store(spark)
    _earlier_run(spark, d, store)
    cases = A.document_cases(spark, d).select(*[f.name for f in schemas.CASE])
    return run_scoring(
        cases,
        store,
        A.respond,
        provider="stub",
        model_name="length/1",
        run_id="run-1",
        build_prompts=lambda share: share.withColumn("prompt", F.col("formatted_progress_text")),
        rounds=2,
        concurrency=8,
    )


def few_shot_run(spark, d):
    cases = A.document_cases(spark, d).filter(F.col("had_surgery").isNotNull())
    return run_few_shot(
        cases, 3, _store(spark), A.respond, provider="stub", model_name="length/1", run_id="run-1", concurrency=8
    ).select("llm_caseID", "decision", "confidence", "reasoning", "parse_status")


def scoring_stream(spark, d, starts=1, **options):
    store, checkpoint = _store(spark), _store(spark)
    _earlier_run(spark, d, store)
    docs = A.table(spark, d, "documents").schema
    cases = read_case_stream(spark, f"{d}/documents.parque[t]", docs, "*").select(  # one file or a folder of parts
        F.col("doc_id").alias("llm_caseID"),
        F.lit(vocab.NO_REPORTS).alias("formatted_radiology_text"),
        F.col("text").alias("formatted_progress_text"),
    )
    for _ in range(starts):
        query = score_stream(
            cases,
            store,
            checkpoint,
            A.respond,
            run_id="stream",
            provider="stub",
            model_name="length/1",
            build_prompts=lambda share: share.withColumn("prompt", F.col("formatted_progress_text")),
            **options,
        )
        query.awaitTermination()
    return P.dedup_results(read_results(spark, store), PRIORITY).select(
        "llm_caseID", "decision", "confidence", "reasoning"
    )


def stream_ids_in_state(spark, d):
    """The same with the seen ids as the stream's state, over three starts."""
    return scoring_stream(spark, d, starts=3, ids_in_state=True)


QUERIES = {
    "parse_json": parse_json,
    "parse_lines": parse_lines,
    "parse_any": parse_any,
    "pending": pending_cases,
    "missing": missing_cases,
    "completed_ids": completed_ids,
    "completed_batches": completed_batches,
    "combine_results": combined_results,
    "dedup": dedup,
    "run_summary": run_summary,
    "status": progress_status,
    "batch_manifest": batch_manifest,
    "case_range": case_range,
    "path_safe_names": safe_names,
    "score_stub": score_stub,
    "attach_responses": stored_answers,
    "scoring_resume": scoring_resume,
    "few_shot_run": few_shot_run,
    "pending_bitmap": pending_bitmap,
    "batches_bitmap": batches_bitmap,
    "scoring_seen": scoring_seen,
    "scoring_stream": scoring_stream,
    "stream_ids_in_state": stream_ids_in_state,
}

_DECISION = "CASE WHEN n_chars > 900 THEN 'Yes' ELSE 'No' END"
_SCORE = "CAST(1 + doc_id % 10 AS VARCHAR)"
_BODY = f"""'{{"decision": "' || {_DECISION} || '", "confidence": ' || {_SCORE} || ', "reasoning": "' || source || ' text"}}'"""
_JSON_ANSWERS = f"""answers AS (SELECT doc_id AS id, CASE doc_id % 10
  WHEN 0 THEN {_BODY} WHEN 1 THEN '```json' || chr(10) || {_BODY} || chr(10) || '```'
  WHEN 2 THEN '```' || chr(10) || {_BODY} || '```' WHEN 3 THEN {_BODY} || ' Hope this helps.'
  WHEN 4 THEN {_BODY} || ', ' || {_BODY} WHEN 5 THEN '[' || {_BODY} || ']'
  WHEN 6 THEN '{{"decision": "' || {_DECISION} || '", "confidence": "' || {_SCORE} || '"}}'
  WHEN 7 THEN '{{"decision": "' || {_DECISION} || '", "confidence": 8.5, "reasoning": null}}'
  WHEN 8 THEN '  ' || chr(10) || upper({_BODY}) || ' ' END AS api_response FROM documents),
plain AS (SELECT id, api_response, trim(replace(replace(trim(api_response, {S.BLANKS}), '```json', ''), '```', ''), {S.BLANKS}) AS js
  FROM answers),
typed AS (SELECT *, CASE WHEN json_valid(js) THEN json_type(js) END AS kind FROM plain)"""
_LINE_ANSWERS = f"""line_answers AS (SELECT doc_id AS id, doc_id % 9 = 0 AS odd, CASE WHEN doc_id % 9 <> 0 THEN
  'DECISION: No' || chr(10) || '  DECISION: ' || CASE WHEN n_chars > 900 THEN 'Yes' ELSE 'Maybe' END || ' ' || chr(10)
  || 'CONFIDENCE: 3' || chr(10) || 'CONFIDENCE: ' || CAST(doc_id % 14 AS VARCHAR)
  || CASE doc_id % 3 WHEN 0 THEN ', high' WHEN 1 THEN '/10' ELSE '' END
  || CASE WHEN doc_id % 4 <> 0 THEN chr(10) || 'REASONING: ' || source ELSE '' END
  WHEN doc_id % 2 = 0 THEN 'nothing to say' END AS api_response FROM documents),
found AS (SELECT id, api_response,
  list_filter(regexp_extract_all(api_response, '(?m)^\\s*DECISION:\\s*(.*?)\\s*$', 1), lambda x: x IN ('Yes','No')) AS ds,
  list_filter(list_transform(regexp_extract_all(api_response, '(?m)^\\s*CONFIDENCE:\\s*([^,\\n]*?)\\s*(?:,.*)?$', 1),
    lambda x: TRY_CAST(x AS INTEGER)), lambda n: n BETWEEN 1 AND 10) AS cs,
  regexp_extract_all(api_response, '(?m)^\\s*REASONING:\\s*(.*?)\\s*$', 1) AS rs FROM line_answers)"""


def _answer_row(decision, raw, reasoning, status):
    number = f"TRY_CAST({raw} AS DOUBLE)"
    return f"""{decision} AS decision, {number} AS confidence, {raw} AS confidence_raw, {reasoning} AS reasoning,
  {status} AS parse_status, coalesce({decision} IN ('Yes','No'), false) AS decision_valid,
  coalesce({number} BETWEEN 1 AND 10 AND {number} = floor({number}), false) AS confidence_valid"""


_OK = "kind = 'OBJECT'"
_JSON_ROW = _answer_row(
    f"CASE WHEN {_OK} THEN json_extract_string(js, '$.decision') END",
    f"CASE WHEN {_OK} THEN json_extract_string(js, '$.confidence') END",
    f"""CASE WHEN api_response IS NULL THEN NULL WHEN {_OK} THEN CASE WHEN list_contains(json_keys(js), 'reasoning')
    THEN json_extract_string(js, '$.reasoning') ELSE '{vocab.NO_REASONING}' END ELSE '{vocab.UNPARSEABLE}' END""",
    f"CASE WHEN api_response IS NULL THEN 'no_response' WHEN {_OK} THEN 'ok' ELSE 'unparseable' END",
)
_LINE_ROW = _answer_row(
    "ds[-1]",
    "CAST(cs[-1] AS VARCHAR)",
    f"""CASE WHEN api_response IS NULL THEN '{vocab.NO_RESPONSE}' ELSE coalesce(rs[-1], '{vocab.UNPARSEABLE}') END""",
    """CASE WHEN api_response IS NULL THEN 'no_response' WHEN len(ds) + len(cs) + len(rs) > 0 THEN 'ok'
    ELSE 'unparseable' END""",
)
_ANY_KEY = lambda name: f"coalesce(json_extract_string(js, '$.{name}'), json_extract_string(js, '$.{name.upper()}'))"
_ANY_ROW = _answer_row(
    f"CASE WHEN {_OK} THEN {_ANY_KEY('decision')} END",
    f"CASE WHEN {_OK} THEN {_ANY_KEY('confidence')} END",
    "''",
    f"CASE WHEN api_response IS NULL THEN 'no_response' WHEN {_OK} THEN 'ok' ELSE 'unparseable' END",
)

_RESULTS = """results AS (SELECT doc_id AS id,
  CASE WHEN n_chars % 17 = 0 THEN NULL WHEN n_chars > 900 THEN 'Yes' ELSE 'No' END AS decision,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(1 + doc_id % 10 AS DOUBLE) END AS confidence FROM documents)"""
_LABELS = """stored AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'Yes' WHEN toxic = 0 THEN 'No' END AS decision,
  doc_id % 3 AS batch_no FROM labels)"""


def _stub(prompts):
    """CTEs ending in asked(id, n, api_response, error): what the length responder answers."""
    return f"""sized AS (SELECT id, length(prompt) AS n FROM {prompts}),
asked AS (SELECT id, n, CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN NULL ELSE '{{"decision": "' ||
  CASE WHEN n % 2 = 1 THEN 'Yes' ELSE 'No' END || '", "confidence": ' || CAST(1 + n % 10 AS VARCHAR)
  || ', "reasoning": "' || CAST(n AS VARCHAR) || ' characters"}}' END AS api_response,
  CASE WHEN n % 11 = 0 THEN 'Error: refused' END AS error FROM sized)"""


_ANSWERED = """CASE WHEN api_response IS NOT NULL THEN CASE WHEN n % 2 = 1 THEN 'Yes' ELSE 'No' END END AS decision,
  CASE WHEN api_response IS NOT NULL THEN CAST(1 + n % 10 AS DOUBLE) END AS confidence,
  CASE WHEN error IS NOT NULL THEN error WHEN api_response IS NOT NULL THEN CAST(n AS VARCHAR) || ' characters' END AS reasoning"""
_STATUS = "CASE WHEN api_response IS NULL THEN 'no_response' ELSE 'ok' END AS parse_status"
_DOC_PROMPTS = "prompts AS (SELECT doc_id AS id, text AS prompt FROM documents)"
_RESUMED = f"""WITH {_DOC_PROMPTS}, {_stub('prompts')}, {_LABELS},
fresh AS (SELECT id, {_ANSWERED}, api_response, {_STATUS}, 'run-1' AS run_id FROM asked
  WHERE id NOT IN (SELECT id FROM stored)),
every AS (SELECT * FROM fresh UNION ALL SELECT id, decision, 9.0, 'earlier', NULL, 'ok', 'run-0' FROM stored)"""


_FEW_SHOT_RUN = f"""WITH {T.SPLIT},
ex AS (SELECT trim(string_agg({T.EXAMPLE}, '' ORDER BY no), {S.BLANKS}) AS examples FROM numbered WHERE no <= 3),
prompts AS (SELECT no AS id, {T.FEW_SHOT} AS prompt FROM numbered, ex WHERE no > 3), {_stub('prompts')}
SELECT id AS "llm_caseID", {_ANSWERED}, {_STATUS} FROM asked"""


ORACLE = {
    "parse_json": f'WITH {_JSON_ANSWERS} SELECT id AS "llm_caseID", {_JSON_ROW} FROM typed',
    "parse_lines": f'WITH {_LINE_ANSWERS} SELECT id AS "llm_caseID", {_LINE_ROW} FROM found',
    "parse_any": f"""WITH {_JSON_ANSWERS}, {_LINE_ANSWERS},
parsed AS (SELECT id, {_ANY_ROW} FROM typed UNION ALL SELECT id, {_LINE_ROW} FROM found)
SELECT decision, confidence, parse_status, decision_valid, confidence_valid, count(*) AS n, min(id) AS first_case
FROM parsed GROUP BY ALL""",
    "pending": """SELECT doc_id AS "llm_caseID", source, n_chars FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "missing": """SELECT doc_id AS "llm_caseID" FROM documents EXCEPT SELECT doc_id FROM labels""",
    "completed_ids": 'SELECT DISTINCT doc_id AS "llm_caseID" FROM labels',
    "completed_batches": """WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 4 + 1 AS batch_no FROM documents)
SELECT batch_no, count(*) AS n_cases, count(l.doc_id) AS n_done, bool_and(l.doc_id IS NOT NULL) AS complete
FROM b LEFT JOIN labels l USING (doc_id) GROUP BY batch_no""",
    "combine_results": f"""WITH {_RESULTS}, {_LABELS}
SELECT id AS "llm_caseID", decision, confidence, NULL::BIGINT AS batch_no FROM results
UNION ALL SELECT id, decision, NULL, batch_no FROM stored""",
    "dedup": f"""WITH {_RESULTS}, {_LABELS}
SELECT r.id AS "llm_caseID", CASE WHEN s.id IS NULL THEN r.decision ELSE s.decision END AS decision,
  CASE WHEN s.id IS NULL THEN 'run-2' ELSE 'run-1' END AS run_id FROM results r LEFT JOIN stored s USING (id)""",
    "run_summary": f"""WITH {_RESULTS} SELECT count(*) AS total, count(decision) AS parsed,
  count(*) FILTER (WHERE decision = 'Yes') AS n_yes, count(*) FILTER (WHERE decision = 'No') AS n_no,
  count(*) - count(decision) AS failed, count(decision) / count(*) AS success_rate FROM results""",
    "status": """WITH c AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(DISTINCT doc_id) FROM labels) AS done)
SELECT total, done, total - done AS remaining, done / total AS done_share, (total - done) / total AS remaining_share,
  (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM
    (SELECT DISTINCT doc_id FROM labels ORDER BY doc_id LIMIT 10)) AS first_done FROM c""",
    "batch_manifest": f"""WITH {_LABELS} SELECT batch_no, count(*) AS n_rows, min(id) AS min_case, max(id) AS max_case,
  count(decision) AS n_parsed FROM stored GROUP BY batch_no""",
    "case_range": f"""WITH {_RESULTS} SELECT id AS "llm_caseID", decision, confidence FROM results WHERE id >= 100 AND id < 400""",
    "path_safe_names": """SELECT event_type || '/v:' || CAST(user_id % 7 AS VARCHAR) || '@x' AS model_name, count(*) AS n,
  event_type || '_v_' || CAST(user_id % 7 AS VARCHAR) || '_x' AS path_name FROM events GROUP BY ALL""",
    "score_stub": f"""WITH {_DOC_PROMPTS}, {_stub('prompts')}
SELECT id AS "llm_caseID", api_response, error, 'stub' AS provider, 'length/1' AS model_name FROM asked""",
    "attach_responses": f"""WITH {_JSON_ANSWERS}
SELECT doc_id AS "llm_caseID", source AS prompt, api_response FROM documents JOIN answers ON doc_id = id""",
    "scoring_resume": f"""{_RESUMED} SELECT id AS "llm_caseID", decision, CAST(confidence AS DOUBLE) AS confidence, reasoning,
  api_response, parse_status, 'stub' AS provider, 'length/1' AS model_name, run_id FROM every""",
    "few_shot_run": _FEW_SHOT_RUN,
    "pending_bitmap": """SELECT doc_id AS "llm_caseID" FROM documents WHERE NOT (doc_id % 3 = 0 OR doc_id % 5 < 2 OR doc_id = 7)""",
    "batches_bitmap": """SELECT CAST(doc_id // 4 AS BIGINT) AS batch_no, count(*) AS n_cases,
  count(*) FILTER (WHERE doc_id % 3 = 0 OR doc_id % 5 < 2 OR doc_id = 7) AS n_done,
  bool_and(doc_id % 3 = 0 OR doc_id % 5 < 2 OR doc_id = 7) AS complete FROM documents GROUP BY doc_id // 4""",
    "scoring_seen": f"""{_RESUMED} SELECT run_id, count(*) AS n_cases,
  (SELECT count(*) FROM fresh) + (SELECT count(*) FROM stored) AS n_stored, (SELECT count(DISTINCT id) FROM every) AS n_ids
FROM every GROUP BY run_id""",
    "stream_ids_in_state": f"""{_RESUMED} SELECT id AS "llm_caseID", decision, CAST(confidence AS DOUBLE) AS confidence, reasoning FROM every""",
    "scoring_stream": f"""{_RESUMED} SELECT id AS "llm_caseID", decision, CAST(confidence AS DOUBLE) AS confidence, reasoning FROM every""",
}
