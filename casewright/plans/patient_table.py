"""One row per patient with nested, date-ordered histories and event flags."""

from __future__ import annotations

from pyspark.sql import DataFrame

from casewright.operators.cohort import collect_history, restrict_to
from casewright.operators.filters import fill_patient_defaults
from casewright.operators.numbering import MAX_ITEMS


def build_patient_table(
    notes: DataFrame,
    reports: DataFrame,
    flags: DataFrame,
    *,
    label_join: str = "after",
    cutoff: str = "first_surgery_date",
    key: str = "patient_id",
    max_items: int | None = MAX_ITEMS,
) -> DataFrame:
    """Notes, reports before the cutoff, and flags per patient.

    Patients with reports only are kept. Flags join after the outer join, so such
    patients get their true labels; ``label_join="reference"`` labels the patients
    with notes only, which leaves the others with false flags and no dates. A history
    over ``max_items`` continues in further rows of the patient (``part`` 1, 2, ...).
    """
    histories = collect_history(notes, "ent_notes", key, max_items=max_items)
    imaging = collect_history(
        reports, "radiology_reports", key, cutoffs=flags.select(key, cutoff), max_items=max_items
    )
    labels = restrict_to(flags, notes, key) if label_join == "reference" else flags
    patients = histories.join(imaging, [key, "part"], "full").join(labels, key, "left")
    return fill_patient_defaults(patients)
