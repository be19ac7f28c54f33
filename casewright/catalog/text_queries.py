"""Censoring, fallback, rendering and case-preparation queries with their SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from casewright import vocab
from casewright.catalog import adapters as A
from casewright.catalog import sql as S
from casewright.functions import render, templates
from casewright.functions import text as X
from casewright.functions.dates import day_str
from casewright.operators import cases as K
from casewright.operators import cohort as C
from casewright.operators.filters import has_items
from casewright.operators.numbering import train_test_split_ordered
from casewright.plans.prepare import CaseConfig, prepare_and_skip, prepare_cases
from casewright.plans.profile import patient_profile, profile_prompts

# The documents have line breaks where clinical notes have wide gaps.
BY_LINE = {"split_on": "\n", "joiner": "\n"}
SENTENCE_KEYWORDS = ["thble", "nicht", "ess", "the of"]


def _flags(spark, d):
    return C.index_event_flags(A.event_procedures(spark, d), A.EVENT_CODES)


def text_chunks(spark, d):
    chunks = X.chunks(F.col("text"), split_on="\n")
    docs = A.table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("pos", "chunk"))
    return docs.select("doc_id", "pos", F.length("chunk").alias("n_chars"), X.is_blank(F.col("chunk")).alias("blank"))


def first_phrase(spark, d):
    docs = A.table(spark, d, "documents")
    found = docs.select("doc_id", X.compute_once(X.first_phrase(F.col("text"), A.DOC_PHRASES)).alias("hit"))
    return found.filter(F.col("hit").isNotNull()).select("doc_id", "hit.priority", "hit.strength", "hit.matched")


def censor_plan(spark, d):
    cut = X.censor_plan(F.col("text"), A.DOC_PHRASES, **BY_LINE)
    docs = A.table(spark, d, "documents").select("doc_id", F.col("text").alias("original"), cut.alias("cut"))
    return docs.select("doc_id", "original", "cut.*").select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        "pattern",
        "matched",
        "cut_chunk",
        F.md5(X.removed_tail(F.col("original"), F.col("text"))).alias("removed_md5"),
    )


def _planted(docs):
    """The documents with wide gaps and phrases of the default vocabulary, both by the number of the document.

    A quarter into the text a gap of 5 or 9 blanks, the phrase and a second gap; in every third
    document halfway another phrase between gaps of the other width.
    """
    k = F.pmod(F.col("doc_id"), F.lit(len(A.PHRASE_TEXTS))).cast("int")
    other = F.pmod(F.col("doc_id") * 7 + 3, F.lit(len(A.PHRASE_TEXTS))).cast("int")
    texts = F.array(*[F.lit(t) for t in A.PHRASE_TEXTS])
    narrow, wide = F.lit(" " * 5), F.lit(" " * 9)
    gap = F.when(F.col("doc_id") % 2 == 0, narrow).otherwise(wide)
    turn = F.when(F.col("doc_id") % 2 == 0, wide).otherwise(narrow)
    quarter, half = F.floor(F.length("text") / 4).cast("int"), F.floor(F.length("text") / 2).cast("int")
    second = F.when(F.col("doc_id") % 3 == 0, F.concat(turn, F.get(texts, other), turn)).otherwise("")
    return docs.select(
        "doc_id",
        F.concat(
            F.substring("text", F.lit(1), quarter), gap, F.get(texts, k), gap,
            F.substring("text", quarter + 1, half - quarter), second, F.substring("text", half + 1, F.length("text")),
        ).alias("text"),
    )


def censor_default(spark, d):
    """The default phrases and gaps over all documents, each with a phrase of the vocabulary."""
    docs = _planted(A.table(spark, d, "documents"))
    docs = docs.select("doc_id", F.col("text").alias("original"), X.censor_plan(F.col("text")).alias("cut"))
    return docs.select("doc_id", "original", "cut.*").select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        "pattern",
        "matched",
        "cut_chunk",
        F.md5(X.removed_tail(F.col("original"), F.col("text"))).alias("removed_md5"),
    )


def default_chunks(spark, d):
    """The chunks that the default gaps make of the same texts."""
    chunks = _planted(A.table(spark, d, "documents")).select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("pos", "chunk"))
    return chunks.select("doc_id", "pos", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def default_first_phrase(spark, d):
    """The first default phrase of each of these chunks."""
    chunks = _planted(A.table(spark, d, "documents")).select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("pos", "chunk"))
    found = chunks.select("doc_id", "pos", X.compute_once(X.first_phrase(F.col("chunk"))).alias("hit"))
    return found.filter(F.col("hit").isNotNull()).select("doc_id", "pos", "hit.priority", "hit.strength", "hit.matched")


def censor_sentences(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", X.censor_sentences(F.col("text"), SENTENCE_KEYWORDS).alias("censored"))


def censor_fallback(spark, d):
    notes = A.document_notes(spark, d)
    chosen = C.censor_with_fallback(notes, None, A.DOC_PHRASES, **BY_LINE)
    return chosen.select(
        "patient_id",
        F.col("attempts").alias("k"),
        day_str(F.col("last_progress_note.date")).alias("note_day"),
        day_str(F.col("last_progress_note.original_date")).alias("original_day"),
        F.md5("last_progress_note_censored.text").alias("text_md5"),
        "matched_text",
        F.md5("censored_text").alias("removed_md5"),
    )


CASES = CaseConfig(
    keywords=("en", "fr"),
    keyword_columns=("author", "linked_author"),
    event_sets=A.EVENT_CODES,
    phrases=tuple(A.DOC_PHRASES),
    max_back=2,
    limits=BY_LINE,
)


def prepared_cases(spark, d):
    cases, prepared = prepare_cases(A.clinical_tables(spark, d), CASES)
    rendered = cases.select(
        "llm_caseID",
        F.md5("formatted_progress_text").alias("note_md5"),
        F.md5("formatted_radiology_text").alias("report_md5"),
    )
    return prepared.select(
        "llm_caseID",
        "patient_id",
        "had_surgery",
        "had_endoscopy",
        "first_surgery_date",
        "cutoff_missing",
        "n_notes",
        "has_radiology",
        day_str(F.col("last_progress_note.date")).alias("note_day"),
        day_str(F.col("last_progress_note.original_date")).alias("original_day"),
        "matched_text",
    ).join(rendered, "llm_caseID")


def skipped_cases(spark, d):
    """The patients that the preparation drops, as long as their last note only is tried."""
    cfg = dataclasses.replace(CASES, max_back=0, limits={**BY_LINE, "min_len": 1500})
    return prepare_and_skip(A.clinical_tables(spark, d), cfg)[2]


def _event_cases(spark, d):
    """One case per user: last view before the event and the errors before it."""
    flags = _flags(spark, d)
    last = C.last_note(A.event_items(spark, d, "view"), flags, title="view")
    imaging = C.collect_history(
        A.event_items(spark, d, "error"), "radiology_reports", cutoffs=flags.select("patient_id", "first_surgery_date"), max_items=None
    ).filter(has_items(F.col("radiology_reports")))
    return last.join(imaging, "patient_id", "full").select(
        F.col("patient_id").alias("llm_caseID"),
        F.col("last_progress_note").alias("last_progress_note_censored"),
        "radiology_reports",
    )


def format_cases(spark, d):
    cases = _event_cases(spark, d)
    return K.case_frame(cases, keep=(has_items(F.col("radiology_reports")).alias("has_radiology"),))


def _doc_prompt(build):
    def query(spark, d):
        cases = A.document_cases(spark, d)
        return K.with_prompt(cases, build).select("llm_caseID", "prompt")

    return query


def _examples(spark, d):
    labelled = A.document_cases(spark, d).filter(F.col("had_surgery").isNotNull())
    return train_test_split_ordered(labelled, 3)


def train_test(spark, d):
    training, rest = _examples(spark, d)
    return training.select("llm_caseID", "had_surgery", F.md5("formatted_progress_text").alias("note_md5")).unionByName(
        rest.select(
            "llm_caseID", F.lit(None).cast("boolean").alias("had_surgery"), F.md5("formatted_progress_text").alias("note_md5")
        )
    )


def few_shot_prompt(spark, d):
    training, rest = _examples(spark, d)
    return K.with_examples(rest, training).select("llm_caseID", F.md5("prompt").alias("prompt_md5"))


def chat_messages(spark, d):
    training, rest = _examples(spark, d)
    chat = K.messages(rest, training, confirmation="Reviewed.")
    return chat.select("llm_caseID", F.posexplode("messages").alias("pos", "m")).select(
        "llm_caseID", "pos", "m.role", F.md5("m.content").alias("content_md5")
    )


def conversation_trim(spark, d):
    turns = A.table(spark, d, "conversations")
    return K.trim_conversation(turns, max_len=5, head=1, tail=3)


def message_history(spark, d):
    history = K.message_history(A.table(spark, d, "conversations"), max_len=5, head=1, tail=3)
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return history.select("conv_id", F.array_join(shown, "\n").alias("history"))


def profile_tables(spark, d):
    """Customers as patients: orders are their notes, reports and procedures."""
    orders = A.table(spark, d, "orders")
    items = orders.select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderkey").alias("note_seq"),
        F.concat(F.lit("desk "), F.col("o_orderstatus")).alias("author"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderstatus").alias("title"),
        F.col("o_orderdate").alias("date"),
        F.concat(
            F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" has priority "), "o_orderpriority",
            F.lit(". Status is "), "o_orderstatus", F.lit("."),
        ).alias("text"),
    )
    customers = A.table(spark, d, "customer").join(
        A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    demographics = customers.select(
        F.col("c_custkey").alias("patient_id"),
        F.col("c_custkey").alias("seq"),
        F.col("c_nationkey").alias("age"),
        F.col("n_name").alias("race"),
        F.col("c_mktsegment").alias("ethnicity"),
        F.lit("F").alias("legal_sex"),
    )
    procedures = orders.select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderpriority").alias("code"),
        F.when(F.col("o_orderkey") % 2 == 0, "CPT").otherwise("ICD").alias("code_type"),
        F.col("o_orderdate").alias("date"),
    )
    return {"demographics": demographics, "clinical_note": items, "radiology_report": items, "procedures": procedures}


PROFILE_OPTIONS = {
    "note_filter": {"types": ["2-HIGH", "3-MEDIUM"], "titles": ["F"], "keywords": ["o", "f"], "columns": ("author",)},
    "report_filter": {"types": ["4-NOT SPECIFIED"], "titles": ["O", "P"]},
    "event_sets": {"surgery": ["1-URGENT"], "endoscopy": ["5-LOW"]},
    "keywords": ["high", "status is p"],
}


def profile_join(spark, d):
    return patient_profile(profile_tables(spark, d), **PROFILE_OPTIONS)


def profile_prompt(spark, d):
    return profile_prompts(profile_join(spark, d)).select("patient_id", "prompt")


QUERIES = {
    "text_chunks": text_chunks,
    "first_phrase": first_phrase,
    "censor_plan": censor_plan,
    "skipped_cases": skipped_cases,
    "censor_default": censor_default,
    "default_chunks": default_chunks,
    "default_first_phrase": default_first_phrase,
    "censor_sentences": censor_sentences,
    "censor_fallback": censor_fallback,
    "prepare_cases": prepared_cases,
    "format_cases": format_cases,
    "prompt_zero_shot": _doc_prompt(render.prompt_zero_shot),
    "prompt_scaled": _doc_prompt(render.prompt_scaled),
    "train_test": train_test,
    "few_shot_prompt": few_shot_prompt,
    "messages": chat_messages,
    "conversation_trim": conversation_trim,
    "message_history": message_history,
    "profile_join": profile_join,
    "prompt_profile": profile_prompt,
}

_REPORT = S.quoted(vocab.NO_REPORTS)
_CASES = f"""cases AS (SELECT doc_id AS id, text AS note, CASE WHEN lang = 'en' THEN source ELSE {_REPORT} END AS report,
  quality = 1 AS had_surgery FROM documents LEFT JOIN labels USING (doc_id))"""


def _section(filled=templates.REPORT_SECTION, empty=templates.REPORT_SECTION_EMPTY, report="report"):
    return f"CASE WHEN {report} <> {_REPORT} THEN {S.fill(filled, report=report)} ELSE {S.quoted(empty)} END"


def _prompt_sql(template):
    prompt = S.fill(template, case_id="CAST(id AS VARCHAR)", note="note", report_section=_section())
    return f'WITH {_CASES} SELECT id AS "llm_caseID", {prompt} AS prompt FROM cases'


SPLIT = f"""{_CASES}, numbered AS (SELECT row_number() OVER (ORDER BY id) AS no, * FROM cases WHERE had_surgery IS NOT NULL)"""
_OUTCOME = "CASE WHEN had_surgery THEN 'Yes' ELSE 'No' END"
EXAMPLE = S.fill(
    templates.EXAMPLE, case_id="CAST(no AS VARCHAR)", note="note", report_section=_section(), outcome=_OUTCOME
)
_CHAT_EXAMPLE = S.fill(
    templates.CHAT_EXAMPLE,
    case_id="CAST(no AS VARCHAR)",
    note="note",
    chat_report=_section(templates.CHAT_REPORT, templates.CHAT_REPORT_EMPTY),
    outcome=_OUTCOME,
)
FEW_SHOT = S.fill(
    templates.FEW_SHOT, examples="examples", case_id="CAST(no AS VARCHAR)", note="note", report_section=_section()
)
_CHAT_CASE = S.fill(
    templates.CHAT_CASE,
    case_id="CAST(no AS VARCHAR)",
    note="note",
    report_section=_section(empty=templates.CHAT_REPORT_SECTION_EMPTY),
)
_ENTRY = (
    "'Date: ' || strftime({day}, '%Y-%m-%d') || ', Type: ' || {type} || ', Title: ' || {title} "
    "|| chr(10) || 'Content: ' || {text}"
)

_CASE_DOCS = f"""src AS (SELECT doc_id, 'p' || CAST(doc_id // 8 AS VARCHAR) AS patient_id, lang, lower(text) AS text,
  CASE WHEN doc_id % 2 = 0 THEN 'Progress Notes' ELSE 'H&P' END AS title,
  DATE '2024-01-01' + CAST(doc_id * 37 % 180 AS INTEGER) AS day FROM documents),
pflags AS (SELECT 'p' || CAST(patient_id AS VARCHAR) AS patient_id, had_surgery, had_endoscopy, first_surgery_date FROM flags),
cn AS (SELECT * FROM src WHERE lang IN ('en','fr')),
rep AS (SELECT s.patient_id, s.doc_id, s.day, s.text,
  f.first_surgery_date IS NULL OR CAST(s.day AS TIMESTAMP) < f.first_surgery_date AS keep
  FROM src s LEFT JOIN pflags f USING (patient_id) WHERE lang = 'fr'),
reps AS (SELECT patient_id, count(*) FILTER (WHERE keep) AS n_reports,
  string_agg({_ENTRY.format(day="day", type="'CT'", title="'CT SINUS LIMITED'", text="text")}, chr(10) || chr(10)
    ORDER BY day, doc_id) FILTER (WHERE keep) AS report FROM rep GROUP BY patient_id),
elig AS (SELECT c.* FROM cn c LEFT JOIN pflags f USING (patient_id) WHERE title = 'Progress Notes'
  AND (f.first_surgery_date IS NULL OR CAST(c.day AS TIMESTAMP) < f.first_surgery_date)),
days AS (SELECT patient_id, day, max(doc_id) AS doc_id FROM elig GROUP BY patient_id, day),
cand AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY day DESC) - 1 AS k,
  max(day) OVER (PARTITION BY patient_id) AS first_day FROM days),
texts AS (SELECT doc_id, text FROM src)"""

_PATIENT_TEXT = """'Order ' || CAST(o_orderkey AS VARCHAR) || ' has priority ' || o_orderpriority || '. Status is ' || o_orderstatus || '.'"""
PROFILE = f"""cutoffs AS (SELECT o_custkey AS patient_id, min(o_orderdate) FILTER (WHERE o_orderpriority = '1-URGENT') AS cutoff,
  coalesce(bool_or(o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0), false) AS had_surgery,
  coalesce(bool_or(o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0), false) AS had_endoscopy FROM orders GROUP BY o_custkey),
items AS (SELECT o_custkey AS patient_id, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus,
  lower({_PATIENT_TEXT}) AS text FROM orders),
summaries AS (SELECT i.patient_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY o_orderdate, o_orderkey) AS summary
  FROM items i JOIN cutoffs USING (patient_id) WHERE o_orderstatus IN ('O','F')
  AND (o_orderpriority IN ('2-HIGH','3-MEDIUM') OR o_orderstatus = 'F') AND (cutoff IS NULL OR o_orderdate < cutoff)
  GROUP BY i.patient_id),
imaging AS (SELECT patient_id, string_agg(text, chr(10) || chr(10) ORDER BY o_orderdate, o_orderkey) AS radiology_text
  FROM items WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus IN ('O','P') GROUP BY patient_id),
profile AS (SELECT c_custkey AS patient_id, c_nationkey AS age, n_name AS race, c_mktsegment AS ethnicity, 'F' AS sex,
  summary AS longitudinal_summary_statement,
  array_to_string(list_filter(string_split(regexp_replace(lower(summary), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: NOT (contains(s, 'high') OR contains(s, 'status is p'))), ' ') AS censored_summary_statement,
  radiology_text, radiology_text IS NOT NULL AS has_radiology_report, had_surgery, had_endoscopy
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN summaries ON c_custkey = summaries.patient_id
  LEFT JOIN imaging ON c_custkey = imaging.patient_id JOIN cutoffs ON c_custkey = cutoffs.patient_id)"""

_TRIM = """counted AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
  FROM conversations WINDOW w AS (PARTITION BY conv_id)),
trimmed AS (SELECT conv_id, turn, role, text FROM counted WHERE n <= 5 OR rn <= 1 OR rn > n - 3)"""

_LIST = ", ".join(S.quoted(t) for t in A.PHRASE_TEXTS)
_GAP, _TURN = ["repeat(' ', CASE WHEN doc_id % 2 = 0 THEN {} ELSE {} END)".format(*n) for n in ((5, 9), (9, 5))]
_PLANTED = f"""listed AS (SELECT [{_LIST}] AS t),
planted AS (SELECT doc_id, substr(text, 1, length(text) // 4) || {_GAP} || t[doc_id % {len(A.PHRASE_TEXTS)} + 1] || {_GAP}
    || substr(text, length(text) // 4 + 1, length(text) // 2 - length(text) // 4)
    || CASE WHEN doc_id % 3 = 0 THEN {_TURN} || t[(doc_id * 7 + 3) % {len(A.PHRASE_TEXTS)} + 1] || {_TURN} ELSE '' END
    || substr(text, length(text) // 2 + 1) AS text
  FROM documents, listed)"""
_WIDE = r"string_split_regex(text, '\s{5,}')"
_WIDE_CHUNKS = f"""chunked AS (SELECT doc_id, unnest({_WIDE}) AS chunk, CAST(generate_subscripts({_WIDE}, 1) - 1 AS INTEGER) AS pos FROM planted)"""

ORACLE = {
    "text_chunks": f"""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(length(chunk) AS INTEGER) AS n_chars,
  length(trim(chunk, {S.BLANKS})) = 0 AS blank FROM c""",
    "first_phrase": f"""WITH n AS (SELECT doc_id, text, {S.phrase_no('text')} AS no FROM documents)
SELECT doc_id, CAST(no AS INTEGER) AS priority,
  CASE WHEN no <= {len(A.DOC_STRONG)} THEN 'strong' ELSE 'weak' END AS strength, {S.phrase_text('no', 'text')[1]} AS matched
FROM n WHERE no IS NOT NULL""",
    "censor_default": f"""WITH {_PLANTED}, {S.censored('planted', vocab.PHRASES, _WIDE, "repeat(' ', 5)")}
SELECT doc_id, md5(text) AS text_md5, pattern, matched, cut_chunk, md5({S.REMOVED}) AS removed_md5 FROM cut""",
    "default_chunks": f"""WITH {_PLANTED}, {_WIDE_CHUNKS}
SELECT doc_id, pos, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS chunk_md5 FROM chunked""",
    "default_first_phrase": f"""WITH {_PLANTED}, {_WIDE_CHUNKS},
numbered AS (SELECT *, {S.phrase_no('chunk', vocab.PHRASES)} AS priority FROM chunked)
SELECT doc_id, pos, CAST(priority AS INTEGER) AS priority, CASE WHEN priority <= {len(vocab.STRONG_PHRASES)} THEN 'strong' ELSE 'weak' END AS strength,
  {S.phrase_text('priority', 'chunk', vocab.PHRASES)[1]} AS matched FROM numbered WHERE priority IS NOT NULL""",
    "censor_plan": f"""WITH {S.censored('documents')}
SELECT doc_id, md5(text) AS text_md5, pattern, matched, cut_chunk, md5({S.REMOVED}) AS removed_md5 FROM cut""",
    "censor_sentences": """SELECT doc_id, array_to_string(list_filter(
  string_split(regexp_replace(lower(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: NOT (contains(s, 'thble') OR contains(s, 'nicht') OR contains(s, 'ess') OR contains(s, 'the of'))), ' ') AS censored
FROM documents""",
    "censor_fallback": f"""WITH {S.censored('documents')},
days AS (SELECT source, DATE '2024-01-01' + CAST(doc_id % 97 AS INTEGER) AS day, max(doc_id) AS doc_id
  FROM documents GROUP BY source, doc_id % 97),
cand AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) - 1 AS k,
  max(day) OVER (PARTITION BY source) AS first_day FROM days),
usable AS (SELECT cand.*, cut.original, cut.text, cut.matched,
  row_number() OVER (PARTITION BY source ORDER BY k) AS rn
  FROM cand JOIN cut USING (doc_id) WHERE k <= 5 AND length(trim(cut.text, {S.BLANKS})) > 0)
SELECT source AS patient_id, CAST(k AS INTEGER) AS k, strftime(day, '%Y-%m-%d') AS note_day,
  CASE WHEN k > 0 THEN strftime(first_day, '%Y-%m-%d') END AS original_day, md5(text) AS text_md5, matched AS matched_text,
  md5({S.REMOVED}) AS removed_md5 FROM usable WHERE rn = 1""",
    "skipped_cases": f"""WITH {S.FLAGS}, {_CASE_DOCS}, {S.censored('texts', min_len=1500)},
tried AS (SELECT cand.*, length(trim(cut.text, {S.BLANKS})) > 0 AS usable FROM cand JOIN cut USING (doc_id) WHERE k = 0)
SELECT patient_id, (SELECT count(*) FROM cn WHERE cn.patient_id = tried.patient_id) AS n_notes FROM tried WHERE NOT usable""",
    "prepare_cases": f"""WITH {S.FLAGS}, {_CASE_DOCS}, {S.censored('texts')},
tried AS (SELECT cand.*, cut.text, cut.matched, length(trim(cut.text, {S.BLANKS})) > 0 AS usable
  FROM cand JOIN cut USING (doc_id) WHERE k <= 2),
chosen AS (SELECT * FROM tried WHERE usable QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY k) = 1),
people AS (SELECT patient_id, count(*) FILTER (WHERE noted) AS n_notes FROM (
  SELECT patient_id, true AS noted FROM cn UNION ALL SELECT patient_id, false FROM rep) GROUP BY patient_id),
kept AS (SELECT * FROM people WHERE patient_id NOT IN (SELECT patient_id FROM tried)
  OR patient_id IN (SELECT patient_id FROM chosen)),
full_cases AS (SELECT row_number() OVER (ORDER BY kept.patient_id) AS case_no, kept.patient_id, kept.n_notes,
  coalesce(f.had_surgery, false) AS had_surgery, coalesce(f.had_endoscopy, false) AS had_endoscopy,
  f.first_surgery_date, coalesce(r.n_reports, 0) > 0 AS has_radiology, r.report, c.day, c.k, c.first_day, c.text, c.matched, s.lang
  FROM kept LEFT JOIN pflags f USING (patient_id) LEFT JOIN reps r USING (patient_id)
  LEFT JOIN chosen c USING (patient_id) LEFT JOIN src s ON c.doc_id = s.doc_id)
SELECT case_no AS "llm_caseID", patient_id, had_surgery, had_endoscopy, first_surgery_date,
  had_surgery AND first_surgery_date IS NULL AS cutoff_missing, n_notes, has_radiology, strftime(day, '%Y-%m-%d') AS note_day,
  CASE WHEN k > 0 THEN strftime(first_day, '%Y-%m-%d') END AS original_day, matched AS matched_text,
  md5(CASE WHEN text IS NULL THEN {S.quoted(vocab.NO_NOTE)} ELSE trim('Date: ' || strftime(day, '%Y-%m-%d')
    || CASE WHEN k > 0 THEN ' (originally from ' || strftime(first_day, '%Y-%m-%d') || ')' ELSE '' END
    || ', Type: Other, Title: Progress Notes' || chr(10) || 'Content: ' || text, {S.BLANKS}) END) AS note_md5,
  md5(CASE WHEN has_radiology THEN trim(report, {S.BLANKS}) ELSE {_REPORT} END) AS report_md5
FROM full_cases""",
    "format_cases": f"""{S.EVENT_SQL},
l AS (SELECT n.patient_id, {_ENTRY.format(day="day", type="'view'", title="'view'", text="text")} AS note
  FROM notes n LEFT JOIN flags f USING (patient_id)
  WHERE f.first_surgery_date IS NULL OR CAST(n.day AS TIMESTAMP) < f.first_surgery_date
  QUALIFY row_number() OVER (PARTITION BY n.patient_id ORDER BY day DESC, note_seq DESC) = 1),
r AS (SELECT r.patient_id, string_agg({_ENTRY.format(day="day", type="'error'", title="'error'", text="text")},
    chr(10) || chr(10) ORDER BY day, note_seq) AS report
  FROM reports r LEFT JOIN flags f USING (patient_id)
  WHERE f.first_surgery_date IS NULL OR r.date < f.first_surgery_date GROUP BY r.patient_id)
SELECT patient_id AS "llm_caseID", coalesce(report, {_REPORT}) AS formatted_radiology_text,
  coalesce(note, {S.quoted(vocab.NO_NOTE)}) AS formatted_progress_text, report IS NOT NULL AS has_radiology
FROM l FULL JOIN r USING (patient_id)""",
    "prompt_zero_shot": _prompt_sql(templates.ZERO_SHOT),
    "prompt_scaled": _prompt_sql(templates.SCALED),
    "train_test": f"""WITH {SPLIT} SELECT no AS "llm_caseID", CASE WHEN no <= 3 THEN had_surgery END AS had_surgery,
  md5(note) AS note_md5 FROM numbered""",
    "few_shot_prompt": f"""WITH {SPLIT},
ex AS (SELECT trim(string_agg({EXAMPLE}, '' ORDER BY no), {S.BLANKS}) AS examples FROM numbered WHERE no <= 3)
SELECT no AS "llm_caseID", md5({FEW_SHOT}) AS prompt_md5 FROM numbered, ex WHERE no > 3""",
    "messages": f"""WITH {SPLIT},
ex AS (SELECT {S.quoted(templates.CHAT_INTRO)} || string_agg({_CHAT_EXAMPLE}, '' ORDER BY no)
  || {S.quoted(templates.CHAT_INSTRUCTIONS)} AS examples FROM numbered WHERE no <= 3),
rest AS (SELECT * FROM numbered WHERE no > 3)
SELECT no AS "llm_caseID", 0 AS pos, 'system' AS role, md5({S.quoted(templates.CHAT_SYSTEM)}) AS content_md5 FROM rest
UNION ALL SELECT no, 1, 'user', md5(examples) FROM rest, ex
UNION ALL SELECT no, 2, 'assistant', md5('Reviewed.') FROM rest
UNION ALL SELECT no, 3, 'user', md5({_CHAT_CASE}) FROM rest""",
    "conversation_trim": f"WITH {_TRIM} SELECT * FROM trimmed",
    "message_history": f"""WITH {_TRIM} SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
FROM trimmed GROUP BY conv_id""",
    "profile_join": f"WITH {PROFILE} SELECT * FROM profile",
    "prompt_profile": f"""WITH {PROFILE}, p AS (SELECT *, coalesce(radiology_text, {_REPORT}) AS report FROM profile)
SELECT patient_id, {S.fill(templates.PROFILE, case_id="CAST(patient_id AS VARCHAR)", age="CAST(age AS VARCHAR)", sex="sex",
  note="censored_summary_statement", report_section=_section())} AS prompt FROM p""",
}
