"""From source tables to numbered, censored cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import vocab
from casewright.operators.cases import case_frame
from casewright.operators.cohort import (
    EVENT_SETS,
    collect_history,
    expand_choice,
    fallback_choice,
    index_event_flags,
)
from casewright.operators.filters import (
    extract_notes,
    extract_reports,
    fill_patient_defaults,
    has_items,
    is_specialty_note,
)
from casewright.operators.numbering import number_cases
from casewright.session import materialize
from casewright.vocab import Phrase


@dataclass(frozen=True)
class CaseConfig:
    """Vocabularies and options of case preparation."""

    note_types: Sequence[str] = tuple(vocab.NOTE_TYPES)
    note_titles: Sequence[str] = tuple(vocab.NOTE_TITLES)
    keywords: Sequence[str] = tuple(vocab.AUTHOR_KEYWORDS)
    keyword_columns: Sequence[str] = ("author", "linked_author")
    report_types: Sequence[str] = tuple(vocab.REPORT_TYPES)
    report_titles: Sequence[str] = tuple(vocab.REPORT_TITLES)
    event_sets: Mapping[str, Sequence[str]] = field(default_factory=lambda: EVENT_SETS)
    code_system: str | None = vocab.CODE_SYSTEM
    selected_title: str = vocab.SELECTED_TITLE
    phrases: Sequence[Phrase] = tuple(vocab.PHRASES)
    max_back: int = vocab.MAX_FALLBACK_NOTES
    same_day: str = "reference"
    limits: Mapping = field(default_factory=dict)


def select_cases(
    tables: Mapping[str, DataFrame], cfg: CaseConfig = CaseConfig(), flags: DataFrame | None = None, mark_skipped: bool = False
) -> DataFrame:
    """Unnumbered cases: one row per kept patient with flags, chosen note and reports.

    Patients come from the clinical notes. Those without a titled note stay, with a null
    note; those whose notes all come out blank are dropped. Histories are not collected
    for the selection: winners are picked on keys, and only their texts are joined. All
    reports before the cutoff are in the patient's one row, as they go into one prompt.
    Pass ``flags`` to use event flags that are already stored. ``mark_skipped`` keeps the dropped
    patients too and marks them in a column ``skipped``.
    """
    key = "patient_id"
    all_notes = tables["clinical_note"]
    vocabulary = (cfg.note_types, cfg.note_titles, cfg.keywords, cfg.keyword_columns)
    notes = extract_notes(all_notes, *vocabulary)
    if flags is None:
        flags = index_event_flags(tables["procedures"], cfg.event_sets, key, cfg.code_system)
    chosen = fallback_choice(
        notes,
        flags,
        cfg.phrases,
        max_back=cfg.max_back,
        title=cfg.selected_title,
        same_day=cfg.same_day,
        key=key,
        **cfg.limits,
    ).withColumn("_has_candidate", F.lit(True))
    # One row per patient of the notes table, whether or not any note is a specialty note.
    people = all_notes.groupBy(key).agg(F.count_if(is_specialty_note(*vocabulary)).alias("n_notes"))
    people = people.join(flags, key, "left").join(chosen, key, "left")
    people = people.withColumn("skipped", F.col("_has_candidate").isNotNull() & F.col("choice").isNull()).drop("_has_candidate")
    if not mark_skipped:
        people = people.filter(~F.col("skipped")).drop("skipped")
    imaging = collect_history(
        extract_reports(tables["radiology_report"], cfg.report_types, cfg.report_titles),
        "radiology_reports",
        key,
        cutoffs=flags.select(key, "first_surgery_date"),
        max_items=None,
    )
    kept = people.join(imaging, key, "left").filter((F.col("n_notes") > 0) | F.col("part").isNotNull()).drop("part")
    return fill_patient_defaults(expand_choice(kept)).withColumns(
        {
            "cutoff_missing": F.col("had_surgery") & F.col("first_surgery_date").isNull(),
            "has_radiology": has_items(F.col("radiology_reports")),
        }
    )


def prepare_cases(
    tables: Mapping[str, DataFrame], cfg: CaseConfig = CaseConfig()
) -> tuple[DataFrame, DataFrame]:
    """(case frame, prepared frame), numbered 1..n in patient order.

    The event flags and the selected cases are written once to the shared folder. Several
    joins use the flags, and reading them back gives those joins their true size; numbering
    needs the final set of patients, and must not censor every note a second time.
    """
    cases, prepared, _ = prepare_and_skip(tables, cfg)
    return cases, prepared


def prepare_and_skip(
    tables: Mapping[str, DataFrame], cfg: CaseConfig = CaseConfig()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``prepare_cases`` gives, and the patients (with their number of notes) whose notes all come out blank.

    All three come from the one written selection, so no note is censored again for the list.
    """
    flags = materialize(index_event_flags(tables["procedures"], cfg.event_sets, "patient_id", cfg.code_system))
    selected = materialize(select_cases(tables, cfg, flags, mark_skipped=True))
    prepared = number_cases(selected.filter(~F.col("skipped")).drop("skipped"), ["patient_id"])
    return case_frame(prepared), prepared, selected.filter("skipped").select("patient_id", "n_notes")
