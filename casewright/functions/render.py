"""Case and prompt rendering as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions import templates
from casewright.functions.dates import day_str
from casewright.functions.text import is_blank, strip_ws


def fill(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by its column."""
    pieces = re.split("(" + "|".join(rf"\{{{name}\}}" for name in values) + ")", template)
    return F.concat(
        *[values[p[1:-1]].cast("string") if p[1:-1] in values else F.lit(p) for p in pieces if p]
    )


def has_valid_text(c: Column, placeholder: str = vocab.NO_REPORTS) -> Column:
    """Not null, not blank and not the placeholder."""
    return ~is_blank(c) & (c != placeholder)


def _entry(item: Column, day: Column) -> Column:
    return F.concat(
        F.lit("Date: "), day,
        F.lit(", Type: "), F.coalesce(item["type"], F.lit("Unknown type")),
        F.lit(", Title: "), F.coalesce(item["title"], F.lit("No title")),
        F.lit("\nContent: "), F.coalesce(item["text"], F.lit("No text")),
    )


def _day(c: Column) -> Column:
    return F.coalesce(day_str(c), F.lit("Unknown date"))


def format_note(note: Column) -> Column:
    """One note as text; names the first choice's date when a fallback was used.

    A null date renders as "Unknown date".
    """
    moved = note["original_date"].isNotNull() & ~note["original_date"].eqNullSafe(note["date"])
    origin = F.when(
        moved, F.concat(F.lit(" (originally from "), day_str(note["original_date"]), F.lit(")"))
    ).otherwise("")
    rendered = strip_ws(_entry(note, F.concat(_day(note["date"]), origin)))
    return F.when(note.isNull(), vocab.NO_NOTE).otherwise(rendered)


def format_reports(reports: Column) -> Column:
    """All reports in order with a blank line between, or the placeholder."""
    entries = F.transform(reports, lambda r: _entry(r, _day(r["date"])))
    rendered = strip_ws(F.array_join(entries, "\n\n"))
    return F.when(F.coalesce(F.size(reports), F.lit(0)) > 0, rendered).otherwise(vocab.NO_REPORTS)


def report_section(
    report: Column,
    filled: str = templates.REPORT_SECTION,
    empty: str = templates.REPORT_SECTION_EMPTY,
) -> Column:
    """The imaging line of a prompt."""
    return F.when(has_valid_text(report), fill(filled, report=report)).otherwise(empty)


def prompt_zero_shot(case_id: Column, note: Column, report: Column) -> Column:
    return fill(templates.ZERO_SHOT, case_id=case_id, note=note, report_section=report_section(report))


def prompt_scaled(case_id: Column, note: Column, report: Column) -> Column:
    return fill(templates.SCALED, case_id=case_id, note=note, report_section=report_section(report))


def prompt_profile(case_id: Column, age: Column, sex: Column, note: Column, report: Column) -> Column:
    """Demographic prompt; unknown age or sex renders as None."""
    return fill(
        templates.PROFILE,
        case_id=case_id,
        age=F.coalesce(age.cast("string"), F.lit("None")),
        sex=F.coalesce(sex, F.lit("None")),
        note=note,
        report_section=report_section(report),
    )


def _outcome(had_surgery: Column) -> Column:
    return F.when(F.coalesce(had_surgery, F.lit(False)), "Yes").otherwise("No")


def example_block(case_id: Column, note: Column, report: Column, had_surgery: Column) -> Column:
    return fill(
        templates.EXAMPLE,
        case_id=case_id,
        note=note,
        report_section=report_section(report),
        outcome=_outcome(had_surgery),
    )


def prompt_few_shot(case_id: Column, note: Column, report: Column, examples: Column) -> Column:
    return fill(
        templates.FEW_SHOT,
        examples=examples,
        case_id=case_id,
        note=note,
        report_section=report_section(report),
    )


def chat_example(case_id: Column, note: Column, report: Column, had_surgery: Column) -> Column:
    return fill(
        templates.CHAT_EXAMPLE,
        case_id=case_id,
        note=note,
        chat_report=report_section(report, templates.CHAT_REPORT, templates.CHAT_REPORT_EMPTY),
        outcome=_outcome(had_surgery),
    )


def chat_case(case_id: Column, note: Column, report: Column) -> Column:
    return fill(
        templates.CHAT_CASE,
        case_id=case_id,
        note=note,
        report_section=report_section(report, empty=templates.CHAT_REPORT_SECTION_EMPTY),
    )
