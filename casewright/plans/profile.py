"""The older patient profile: demographics, pre-event summary, sentence censoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.render import prompt_profile
from casewright.functions.text import censor_sentences, is_blank
from casewright.operators import metrics as M
from casewright.operators.cohort import (
    EVENT_SETS,
    collect_text,
    event_aggregates,
    latest_per_key,
    reports_before_index,
)
from casewright.operators.filters import extract_notes, extract_reports, to_binary
from casewright.session import materialize


def patient_profile(
    tables: Mapping[str, DataFrame],
    *,
    note_filter: Mapping | None = None,
    report_filter: Mapping | None = None,
    event_sets: Mapping[str, Sequence[str]] = EVENT_SETS,
    system: str | None = vocab.CODE_SYSTEM,
    keywords: Sequence[str] = vocab.SENTENCE_KEYWORDS,
    key: str = "patient_id",
) -> DataFrame:
    """Latest demographics, notes before the event as one text, imaging text and flags.

    Patients without a qualifying note before the event are left out. The cutoff is the
    first event code whatever its code system; the flags check the system. Imaging is
    not cut at the event here. Each table is aggregated per patient before the joins; a
    patient is one row, as all texts go into one prompt. Flags and cutoff come from one pass
    over the procedures, written once to the shared folder.
    """
    latest = latest_per_key(tables["demographics"], "seq", key).drop("seq")
    _, any_system = event_aggregates({"any": event_sets["surgery"]}, None)
    flags = materialize(tables["procedures"].groupBy(key).agg(*event_aggregates(event_sets, system), any_system))
    cutoff = flags.select(key, F.col("first_any_date").alias("first_surgery_date"))
    notes = extract_notes(tables["clinical_note"], **(note_filter or {"columns": ("author", "text")}))
    before = reports_before_index(notes, cutoff, key=key)
    summary = collect_text(before, "summary", key, max_items=None).drop("part")
    reports = extract_reports(tables["radiology_report"], **(report_filter or {}))
    imaging = collect_text(reports, "radiology_text", key, sep="\n\n", max_items=None).drop("part")
    flag_columns = [c for c in flags.columns if c.startswith("had_")]
    joined = latest.join(summary, key).join(imaging, key, "left").join(flags.select(key, *flag_columns), key, "left")
    return joined.select(
        key,
        "age",
        "race",
        "ethnicity",
        F.col("legal_sex").alias("sex"),
        F.col("summary").alias("longitudinal_summary_statement"),
        censor_sentences(F.col("summary"), keywords).alias("censored_summary_statement"),
        "radiology_text",
        (~is_blank(F.col("radiology_text"))).alias("has_radiology_report"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flag_columns],
    )


def profile_prompts(profiles: DataFrame, key: str = "patient_id") -> DataFrame:
    return profiles.withColumn(
        "prompt",
        prompt_profile(
            F.col(key), F.col("age"), F.col("sex"), F.coalesce("censored_summary_statement", F.lit("")), F.col("radiology_text")
        ),
    )


def legacy_profile(
    tables: Mapping[str, DataFrame], answers: DataFrame, *, key: str = "patient_id", **options
) -> dict[str, DataFrame]:
    """Profiles, prompts and the report of answered profiles.

    ``answers`` has (key, decision, confidence); any answer but yes counts as no.
    """
    profiles = patient_profile(tables, key=key, **options)
    judged = profiles.join(answers.select(key, "decision", "confidence"), key).select(
        key,
        to_binary(F.col("had_surgery"), {True: 1, False: 0}).alias(M.ACTUAL),
        to_binary(F.col("decision"), mode="yes").alias(M.PRED),
        "confidence",
    )
    return {
        "profiles": profiles,
        "prompts": profile_prompts(profiles, key),
        "class_report": M.classification_report(judged),
        "confusion": M.confusion_table(judged),
        "confidence_by_outcome": M.confidence_by_outcome(judged),
    }
