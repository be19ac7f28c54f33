"""Fixed schemas of the source tables and derived frames."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampNTZType,
)


def _strings(schema: StructType, *names: str) -> StructType:
    for name in names:
        schema = schema.add(name, StringType())
    return schema


NOTE = (
    _strings(
        StructType().add("patient_id", StringType()).add("note_seq", LongType()),
        "author", "linked_author", "type", "title",
    )
    .add("date", TimestampNTZType())
    .add("text", StringType())
)
REPORT = (
    _strings(StructType().add("patient_id", StringType()).add("note_seq", LongType()), "type", "title")
    .add("date", TimestampNTZType())
    .add("text", StringType())
)
PROCEDURE = _strings(StructType(), "patient_id", "code", "code_type").add("date", TimestampNTZType())
DEMOGRAPHICS = _strings(
    StructType().add("patient_id", StringType()).add("seq", LongType()).add("age", IntegerType()),
    "race", "ethnicity", "legal_sex",
)
CASE = _strings(StructType().add("llm_caseID", LongType()), "formatted_radiology_text", "formatted_progress_text")
RESULT = _strings(
    StructType().add("llm_caseID", LongType()).add("decision", StringType()).add("confidence", DoubleType()),
    "reasoning", "api_response", "parse_status", "provider", "model_name", "run_id",
)

TABLES = {
    "clinical_note": NOTE,
    "radiology_report": REPORT,
    "procedures": PROCEDURE,
    "demographics": DEMOGRAPHICS,
}

NOTE_ITEM = "struct<date:date,type:string,title:string,text:string,original_date:date>"
