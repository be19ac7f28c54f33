"""Patient-level operators: event flags, histories, note selection and fallback censoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.text import censor_plan, compute_once, is_blank, let, removed_tail
from casewright.operators.filters import before_cutoff, code_in
from casewright.operators.numbering import MAX_ITEMS, PART_BYTES, distinct_ids, group_in_parts, group_whole
from casewright.schemas import NOTE_ITEM
from casewright.vocab import Phrase

CHOICE = f"struct<k:int,note:{NOTE_ITEM},text:string,pattern:string,matched:string>"
EVENT_SETS = {"surgery": vocab.SURGERY_CODES, "endoscopy": vocab.ENDOSCOPY_CODES}


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "patient_id") -> DataFrame:
    """Rows whose key is in the id list."""
    return df.join(ids.select(key), key, "left_semi")


def count_patients(
    df: DataFrame, key: str = "patient_id", name: str = "n_patients", ids: str | None = None, rows: str | None = None
) -> DataFrame:
    """One row: distinct non-null ids and, if named, distinct ids with null and all rows, from one pass."""
    if ids is None and rows is None:
        return df.agg(F.countDistinct(key).alias(name))
    extra = [F.count("*").alias(ids)] if ids else []
    extra += [F.coalesce(F.sum("_n"), F.lit(0)).alias(rows)] if rows else []
    return distinct_ids(df, key, "_n").agg(F.count(key).alias(name), *extra)


def event_aggregates(
    sets: Mapping[str, Sequence[str]] = EVENT_SETS, system: str | None = vocab.CODE_SYSTEM
) -> list[Column]:
    """had_<set> and first_<set>_date of every code set; ``system=None`` skips the code-system check."""
    aggregates = []
    for name, codes in sets.items():
        hit = code_in(F.col("code"), codes, F.col("code_type") if system else None, system)
        aggregates += [
            F.coalesce(F.bool_or(hit), F.lit(False)).alias(f"had_{name}"),
            F.min(F.when(hit, F.col("date"))).alias(f"first_{name}_date"),
        ]
    return aggregates


def index_event_flags(
    procedures: DataFrame,
    sets: Mapping[str, Sequence[str]] = EVENT_SETS,
    key: str = "patient_id",
    system: str | None = vocab.CODE_SYSTEM,
) -> DataFrame:
    """Per patient: had_<set> and first_<set>_date for every code set.

    The code filter sits inside the aggregate, so patients with other procedures only
    still get a row of false flags.
    """
    return procedures.groupBy(key).agg(*event_aggregates(sets, system))


def reports_before_index(
    reports: DataFrame, flags: DataFrame, cutoff: str = "first_surgery_date", key: str = "patient_id"
) -> DataFrame:
    """Reports strictly before the patient's cutoff, by full timestamp.

    Patients without a cutoff keep all reports, undated ones too.
    """
    joined = reports.join(flags.select(key, F.col(cutoff).alias("_cutoff")), key, "left")
    return joined.filter(before_cutoff(F.col("date"), F.col("_cutoff"))).drop("_cutoff")


def collect_history(
    df: DataFrame,
    name: str,
    key: str = "patient_id",
    seq: str = "note_seq",
    cutoffs: DataFrame | None = None,
    max_items: int | None = MAX_ITEMS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Date-ordered nested history per key and part: array of (date, type, title, text).

    Undated items come first and ``seq`` breaks ties. ``cutoffs`` (key, cutoff) keeps the
    items before the key's cutoff; a key left without items still has a row. Nearly all
    keys have the one part 0. A history over ``max_items`` continues in further rows, so
    that no row or task has to hold more than that many items. None keeps it in one row; a history of
    more than ``part_bytes`` of text is then nested in parts first.
    The cutoff applies first: parts hold only items before it, and later ones are not nested.
    """
    dated = df.withColumn("_day", F.to_date("date"))
    item = F.struct(
        F.col("_day").alias("day"), F.col(seq).alias("seq"), F.col("date").alias("at"),
        F.col("type"), F.col("title"), F.col("text"),
    )
    order = ["_day"]
    if cutoffs is not None:
        kept = before_cutoff(F.col("date"), F.col("_cutoff"))
        dated = dated.join(cutoffs.toDF(key, "_cutoff"), key, "left")
        dated = dated.withColumn("_late", ~F.coalesce(kept, F.lit(False))).drop("_cutoff")
        item, order = F.when(~F.col("_late"), item), ["_late", "_day"]
    ordered = F.array_sort(F.collect_list(item)).alias("_items")
    if max_items is None:
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
        if cutoffs is not None:
            size = F.when(F.col("_late"), 0).otherwise(size)
        nested = group_whole(dated, key, order, seq, size, ordered, F.flatten, "_items", part_bytes).withColumn("part", F.lit(0).cast("bigint"))
    else:
        nested = group_in_parts(dated, key, order, seq, ordered, max_items)
    nested = nested.filter((F.col("part") == 0) | (F.size("_items") > 0))
    items = F.col("_items")
    shown = F.transform(
        items,
        lambda i: F.struct(
            i["day"].alias("date"), i["type"].alias("type"), i["title"].alias("title"), i["text"].alias("text")
        ),
    )
    return nested.select(key, "part", shown.alias(name))


def collect_text(
    df: DataFrame,
    name: str,
    key: str = "patient_id",
    seq: str = "note_seq",
    sep: str = "\n---\n",
    text: str = "text",
    max_items: int | None = MAX_ITEMS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """A key's non-null texts in date order, undated last, joined with a separator.

    More than ``max_items`` texts continue in further rows (``part`` 0, 1, ...); None keeps a key in one
    row, whose texts are joined in parts of ``part_bytes`` first.
    """
    dated = df.filter(F.col(text).isNotNull()).withColumn("_undated", F.col("date").isNull())
    ordered = F.array_sort(
        F.collect_list(F.struct("_undated", "date", F.col(seq).alias("seq"), F.col(text).alias("text")))
    )
    joined = F.array_join(F.transform(ordered, lambda i: i["text"]), sep).alias(name)
    if max_items is None:
        size = F.octet_length(text).cast("bigint")
        whole = group_whole(dated, key, ["_undated", "date"], seq, size, joined, lambda parts: F.array_join(parts, sep), name, part_bytes)
        return whole.withColumn("part", F.lit(0).cast("bigint"))
    return group_in_parts(dated, key, ["_undated", "date"], seq, joined, max_items)


def _titled(notes: DataFrame, title: str | None) -> DataFrame:
    return notes if title is None else notes.filter(F.col("title") == title)


def note_candidates(
    notes: DataFrame,
    flags: DataFrame | None,
    *,
    title: str | None = vocab.SELECTED_TITLE,
    back: int = 0,
    cutoff: str = "first_surgery_date",
    same_day: str = "reference",
    need_cutoff: bool = False,
    carry: Sequence[str] = (),
    key: str = "patient_id",
    seq: str = "note_seq",
) -> DataFrame:
    """(key, seq, k, first_day, carry...): the last titled note before the cutoff and its fallbacks.

    k=0 is the last note before the cutoff, or overall without one; k=1..back are the
    last notes of the preceding distinct days. Works on keys and days only: a day's last
    note is pre-aggregated before any shuffle by patient, so a patient with many notes
    costs at most one row per day. Days are compared with the cutoff's full time, so a
    note of the cutoff's own day counts as before it unless ``same_day="exclude"``.
    ``carry`` names flag columns to keep.
    """
    per_day = _titled(notes, title).groupBy(key, F.to_date("date").alias("day")).agg(F.max(seq).alias(seq))
    if flags is not None:
        limit = F.col(cutoff) if same_day == "reference" else F.to_date(cutoff)
        cutoffs = flags.select(key, limit.alias("_cutoff"), *carry)
        if need_cutoff:
            cutoffs = cutoffs.filter(F.col("_cutoff").isNotNull())
        per_day = per_day.join(cutoffs, key, "inner" if need_cutoff else "left")
        per_day = per_day.filter(before_cutoff(F.col("day").cast("timestamp_ntz"), F.col("_cutoff")))
    newest = Window.partitionBy(key).orderBy(F.col("day").desc_nulls_last())
    ranked = per_day.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= back + 1)
    ranked = ranked.withColumn("k", F.col("_rn") - 1)
    if back == 0:
        return ranked.select(key, seq, "k", F.col("day").alias("first_day"), *carry)
    # An undated note cannot be a fallback, and has none.
    return (
        ranked.withColumn("first_day", F.max("day").over(Window.partitionBy(key)))
        .filter((F.col("k") == 0) | F.col("day").isNotNull())
        .select(key, seq, "k", "first_day", *carry)
    )


def _note_struct(original=None):
    return F.struct(
        F.to_date("date").alias("date"),
        F.col("type").alias("type"),
        F.col("title").alias("title"),
        F.col("text").alias("text"),
        (F.lit(None).cast("date") if original is None else original).alias("original_date"),
    )


def last_note(
    notes: DataFrame,
    flags: DataFrame | None,
    *,
    title: str | None = vocab.SELECTED_TITLE,
    cutoff: str = "first_surgery_date",
    had: str = "had_surgery",
    same_day: str = "reference",
    key: str = "patient_id",
    seq: str = "note_seq",
) -> DataFrame:
    """Per patient the last titled note before the event, else the last overall.

    ``cutoff_missing`` marks patients with an event but no date: their last note overall
    may lie after the event. Texts join the winners on (key, seq), which spreads a heavy
    patient's notes over all tasks.
    """
    if flags is not None:
        flags = flags.select(key, cutoff, (F.col(had) & F.col(cutoff).isNull()).alias("_undated"))
    carry = [] if flags is None else ["_undated"]
    winners = note_candidates(
        notes, flags, title=title, cutoff=cutoff, same_day=same_day, carry=carry, key=key, seq=seq
    ).select(key, seq, *carry)
    undated = F.coalesce(F.col("_undated"), F.lit(False)) if carry else F.lit(False)
    return _titled(notes, title).join(winners, [key, seq]).select(
        key, seq, _note_struct().alias("last_progress_note"), undated.alias("cutoff_missing")
    )


def previous_note(
    notes: DataFrame,
    refs: DataFrame,
    *,
    ref_date: str = "ref_date",
    title: str | None = vocab.SELECTED_TITLE,
    key: str = "patient_id",
    seq: str = "note_seq",
) -> DataFrame:
    """The last titled note strictly before each patient's reference date; none if it is null."""
    winners = note_candidates(
        notes, refs, title=title, cutoff=ref_date, need_cutoff=True, key=key, seq=seq
    ).select(key, seq)
    return _titled(notes, title).join(winners, [key, seq]).select(key, seq, _note_struct().alias("previous_note"))


def censor_note(df: DataFrame, note: str, phrases: Sequence[Phrase] = vocab.PHRASES, **limits) -> DataFrame:
    """Adds <note>_censored, matched_text and censored_text (the removed tail) for a note struct."""
    result = df.withColumn("_cut", censor_plan(F.col(note)["text"], phrases, **limits))
    present = F.col(note).isNotNull()
    return result.withColumns(
        {
            f"{note}_censored": F.when(present, F.col(note).withField("text", F.col("_cut.text"))),
            "matched_text": F.col("_cut.matched"),
            "censored_text": removed_tail(F.col(note)["text"], F.col("_cut.text")),
        }
    ).drop("_cut")


def fallback_choice(
    notes: DataFrame,
    flags: DataFrame | None,
    phrases: Sequence[Phrase] = vocab.PHRASES,
    *,
    max_back: int = vocab.MAX_FALLBACK_NOTES,
    title: str | None = vocab.SELECTED_TITLE,
    cutoff: str = "first_surgery_date",
    same_day: str = "reference",
    key: str = "patient_id",
    seq: str = "note_seq",
    **limits,
) -> DataFrame:
    """(key, choice): the first candidate note that is not blank once censored, else null.

    choice holds k, the note, its censored text and the matched phrase. At most max_back+1
    notes per patient are brought together, and each is censored only if the ones before it
    came out blank.
    """
    candidates = note_candidates(
        notes, flags, title=title, back=max_back, cutoff=cutoff, same_day=same_day, key=key, seq=seq
    )
    original = F.when(F.col("k") > 0, F.col("first_day"))
    texts = _titled(notes, title).join(candidates, [key, seq])
    tries = F.array_sort(F.collect_list(F.struct("k", _note_struct(original).alias("note"))))
    grouped = texts.groupBy(key).agg(tries.alias("tries"))

    def usable(attempt: Column) -> Column:
        return let(
            censor_plan(attempt["note"]["text"], phrases, **limits),
            lambda cut: F.when(
                ~is_blank(cut["text"]),
                F.struct(
                    attempt["k"].alias("k"),
                    attempt["note"].alias("note"),
                    cut["text"].alias("text"),
                    cut["pattern"].alias("pattern"),
                    cut["matched"].alias("matched"),
                ),
            ),
        )

    choice = F.aggregate(
        "tries", F.lit(None).cast(CHOICE), lambda best, attempt: F.when(best.isNotNull(), best).otherwise(usable(attempt))
    )
    return grouped.select(key, compute_once(choice).alias("choice"))


def expand_choice(df: DataFrame) -> DataFrame:
    """The choice as last_progress_note, its censored copy, matched_text and censored_text."""
    note = F.col("choice.note")
    return df.withColumns(
        {
            "last_progress_note": note,
            "last_progress_note_censored": F.when(
                note.isNotNull(), note.withField("text", F.col("choice.text"))
            ),
            "matched_text": F.col("choice.matched"),
            "censored_text": removed_tail(note["text"], F.col("choice.text")),
            "attempts": F.col("choice.k"),
        }
    ).drop("choice")


def censor_with_fallback(
    notes: DataFrame,
    flags: DataFrame | None,
    phrases: Sequence[Phrase] = vocab.PHRASES,
    *,
    key: str = "patient_id",
    **options,
) -> DataFrame:
    """Patients with a usable note: the chosen note (original_date set on a fallback) and its censoring.

    Patients whose candidates all come out blank are dropped; ``skipped_patients`` lists them.
    """
    chosen = fallback_choice(notes, flags, phrases, key=key, **options)
    return expand_choice(chosen.filter(F.col("choice").isNotNull()))


def skipped_patients(
    notes: DataFrame,
    flags: DataFrame | None,
    phrases: Sequence[Phrase] = vocab.PHRASES,
    *,
    key: str = "patient_id",
    **options,
) -> DataFrame:
    """The patients that ``censor_with_fallback`` drops: they have candidate notes, all blank once censored."""
    return fallback_choice(notes, flags, phrases, key=key, **options).filter("choice IS NULL").select(key)


def latest_per_key(df: DataFrame, order: str, key: str = "patient_id") -> DataFrame:
    """The row with the highest order value per key."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1).drop("_rn")
