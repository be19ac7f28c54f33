"""The given tables in the roles the operators expect.

events: patients are users, `view` rows are notes, `error` rows reports and `purchase`
rows procedures whose code is the number in ``props``. documents and labels: texts with a
binary outcome. Every adapter keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.vocab import phrase_rows

EVENT_CODES = {
    "surgery": [str(k) for k in range(10)],
    "endoscopy": [str(k) for k in range(10, 20)],
}

# Fragments that occur in the documents; plain enough to mean the same in any regex dialect.
DOC_STRONG = [r"with\s+the\s+[a-z]+tion", r"that\s+[a-z]+ing\s+of", r"\sthble[.,]"]
DOC_WEAK = [r"^the ", r"from.{0,20}this", r"erble\s+[a-z]+", r"\snicht\s+", r"ouaux"]
DOC_PHRASES = phrase_rows(
    DOC_STRONG, DOC_WEAK, ["with", "that", "thble"], ["the ", "from", "erble", "nicht", "ouaux"]
)
# One text for each of the default phrases, in their order.
PHRASE_TEXTS = [
    "surgical intervention for chronic sinusitis", "Surgical  treatment of acute sinusitis", "proceed with surgical intervention",
    "surgical management of the worst crs", "PLAN FOR her next sinus surgery", "schedule for sinus surgery", "candidate for nasal surgery",
    "patient was elected to proceed with sinus surgery", "recommend to do FESS", "ess is planned", "considering ESS",
    "surgical planning", "surgical review, discussion", "Assessment and plan: rest", "surgery was not discussed", "sinus surgery was discussed",
    "consider endoscopic surgery", "patient agrees with the plan", "we have discussed sinus surgery", "consented for surgery",
    "referred to ENT for evaluation and surgery", "ESS", "fess", "SEPT", "ESS/FESS", "endoscopic sinus surgery",
    "functional endoscopic sinus surgery", "septoplasty", "turbinate reduction", "turbinectomy", "balloon sinuplasty", "polypectomy",
]
DOC_KEYWORDS = ["thing", "nicht", "ouaux"]
DOC_INSUFFICIENT = ["thble ", "nicht ", "Queque"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_date():
    """A day for each document, which many share."""
    return F.expr("timestampadd(DAY, doc_id % 97, timestamp_ntz'2020-01-01 00:00:00')")


def event_items(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> DataFrame:
    """Events as notes or reports."""
    events = table(spark, sf_dir, "events")
    if event_type is not None:
        events = events.filter(F.col("event_type") == event_type)
    return events.select(
        F.col("user_id").alias("patient_id"),
        F.col("event_id").alias("note_seq"),
        F.col("event_type").alias("type"),
        F.col("event_type").alias("title"),
        F.col("ts").alias("date"),
        F.col("props").alias("text"),
    )


def event_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as procedure codes; the code system varies in case and is foreign for every fifth."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    system = (
        F.when(F.col("event_id") % 5 == 0, "ICD").when(F.col("event_id") % 2 == 0, "CPT").otherwise("cpt")
    )
    return events.select(
        F.col("user_id").alias("patient_id"),
        F.get_json_object("props", "$.k").alias("code"),
        system.alias("code_type"),
        F.col("ts").alias("date"),
    )


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes of the patient ``source``; several fall on one day."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("patient_id"),
        F.col("doc_id").alias("note_seq"),
        F.col("lang").alias("type"),
        F.lit("Progress Notes").alias("title"),
        _day(F.col("doc_id") % 97).alias("date"),
        "text",
    )


def _day(offset):
    return F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int")).cast("timestamp_ntz")


def clinical_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """documents and events as the source tables; eight consecutive documents make a patient."""
    docs = table(spark, sf_dir, "documents").withColumns(
        {
            "patient_id": F.concat(F.lit("p"), F.floor(F.col("doc_id") / 8).cast("string")),
            "note_seq": F.col("doc_id"),
            "date": _day(F.col("doc_id") * 37 % 180),
        }
    )
    notes = docs.select(
        "patient_id",
        "note_seq",
        F.concat(F.lit("Dr "), F.upper("lang"), F.lit(" clinic")).alias("author"),
        F.col("lang").alias("linked_author"),
        F.lit("Other").alias("type"),
        F.when(F.col("doc_id") % 2 == 0, "Progress Notes").otherwise("H&P").alias("title"),
        "date",
        "text",
    )
    reports = docs.select(
        "patient_id",
        "note_seq",
        F.lit("CT").alias("type"),
        F.when(F.col("lang") == "fr", "CT SINUS LIMITED").otherwise(F.col("lang")).alias("title"),
        "date",
        "text",
    )
    procedures = event_procedures(spark, sf_dir).withColumn(
        "patient_id", F.concat(F.lit("p"), F.col("patient_id").cast("string"))
    )
    return {"clinical_note": notes, "radiology_report": reports, "procedures": procedures}


def document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as case frames with their label as outcome; English ones have imaging."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("llm_caseID"),
        F.when(F.col("lang") == "en", F.col("source"))
        .otherwise("No radiology reports available.")
        .alias("formatted_radiology_text"),
        F.col("text").alias("formatted_progress_text"),
        (F.col("quality") == 1).alias("had_surgery"),
        (F.col("lang") == "en").alias("has_radiology"),
    )


def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result per document: decision from its length, confidence from its id."""
    decision = (
        F.when(F.col("n_chars") % 17 == 0, F.lit(None)).when(F.col("n_chars") > 900, "Yes").otherwise("No")
    )
    confidence = F.when(F.col("doc_id") % 13 != 0, 1 + F.col("doc_id") % 10).cast("double")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("llm_caseID"),
        decision.alias("decision"),
        confidence.alias("confidence"),
        F.col("text").alias("reasoning"),
    )


def label_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results for the labelled documents: quality as decision."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("llm_caseID"),
        F.when(F.col("quality") == 1, "Yes")
        .when(F.col("toxic") == 0, "No")
        .alias("decision"),
        (F.col("doc_id") % 3).alias("batch_no"),
    )


def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers made from the documents, well-formed and broken in turn."""
    docs = table(spark, sf_dir, "documents")
    decision = F.when(F.col("n_chars") > 900, "Yes").otherwise("No")
    score = (1 + F.col("doc_id") % 10).cast("string")
    body = F.concat(
        F.lit('{"decision": "'), decision, F.lit('", "confidence": '), score,
        F.lit(', "reasoning": "'), F.col("source"), F.lit(' text"}'),
    )
    kind = F.col("doc_id") % 10
    answer = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("```\n"), body, F.lit("```")))
        .when(kind == 3, F.concat(body, F.lit(" Hope this helps.")))
        .when(kind == 4, F.concat(body, F.lit(", "), body))
        .when(kind == 5, F.concat(F.lit("["), body, F.lit("]")))
        .when(kind == 6, F.concat(F.lit('{"decision": "'), decision, F.lit('", "confidence": "'), score, F.lit('"}')))
        .when(kind == 7, F.concat(F.lit('{"decision": "'), decision, F.lit('", "confidence": 8.5, "reasoning": null}')))
        .when(kind == 8, F.concat(F.lit("  \n"), F.upper(body), F.lit(" ")))
    )
    return docs.select(F.col("doc_id").alias("llm_caseID"), answer.alias("api_response"))


def line_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled-line answers made from the documents."""
    docs = table(spark, sf_dir, "documents")
    decision = F.when(F.col("n_chars") > 900, "Yes").otherwise("Maybe")
    answer = F.concat(
        F.lit("DECISION: No\n  DECISION: "), decision,
        F.lit(" \nCONFIDENCE: 3\nCONFIDENCE: "), (F.col("doc_id") % 14).cast("string"),
        F.when(F.col("doc_id") % 3 == 0, ", high").when(F.col("doc_id") % 3 == 1, "/10").otherwise(""),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("\nREASONING: "), F.col("source"))).otherwise(""),
    )
    given = F.when(F.col("doc_id") % 9 != 0, answer).when(F.col("doc_id") % 2 == 0, "nothing to say")
    return docs.select(F.col("doc_id").alias("llm_caseID"), given.alias("api_response"))


def respond(prompt: str) -> str | None:
    """A deterministic responder: its answer depends on the prompt's length only."""
    size = len(prompt)
    if size % 11 == 0:
        raise ValueError("refused")
    if size % 7 == 0:
        return None
    decision = "Yes" if size % 2 else "No"
    return f'{{"decision": "{decision}", "confidence": {1 + size % 10}, "reasoning": "{size} characters"}}'
