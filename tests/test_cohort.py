"""Filters, flags, histories, note choice and fallback on hand-made rows."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from casewright import schemas, vocab
from casewright.functions.dates import day_str, parse_ts
from casewright.operators import cohort as C
from casewright.operators import filters as R
from casewright.operators import numbering as N
from casewright.plans.patient_table import build_patient_table
from casewright.plans.prepare import CaseConfig, prepare_cases
from casewright.plans.profile import patient_profile, profile_prompts

PROGRESS = "Progress Notes"
LONG = ("routine visit without findings " * 30).strip()
GAP = " " * 5


def day(d, hour=0):
    return datetime(2024, 1, d, hour)


def notes(spark, rows):
    """rows: (patient, seq, date, text[, title[, author]])"""
    full = [
        (r[0], r[1], r[5] if len(r) > 5 else "ENT clinic", None, "Other", r[4] if len(r) > 4 else PROGRESS, r[2], r[3])
        for r in rows
    ]
    return spark.createDataFrame(full, schemas.NOTE)


def reports(spark, rows):
    return spark.createDataFrame([(p, s, "CT", "CT SINUS LIMITED", d, t) for p, s, d, t in rows], schemas.REPORT)


def flags(spark, rows):
    return spark.createDataFrame(
        rows, "patient_id string, had_surgery boolean, first_surgery_date timestamp_ntz, had_endoscopy boolean, "
        "first_endoscopy_date timestamp_ntz"
    )


def test_note_filter(spark):
    rows = [
        ("hit", "Dr ENT", None, "Other", "?"),
        ("linked", None, "Otolaryngology Dept", "?", "H&P"),
        ("word bound", "patient", None, "Other", "H&P"),
        ("no author", None, None, "Other", "H&P"),
        ("neither", "ent", None, "?", "?"),
        ("null type", "ent", None, None, None),
        ("both", "ent", "ent", "Other", "H&P"),
    ]
    df = spark.createDataFrame([(r[0], i, *r[1:], None, "TEXT") for i, r in enumerate(rows)], schemas.NOTE)
    found = R.extract_notes(df)
    assert {r["patient_id"] for r in found.collect()} == {"hit", "linked", "both"}
    assert {r["text"] for r in found.collect()} == {"text"}


def test_report_filter(spark):
    rows = [("a", "CT", "CT SINUS LIMITED"), ("b", "CT", "x"), ("c", "MR", "CT SINUS LIMITED"), ("d", None, None)]
    df = spark.createDataFrame([(p, 1, t, l, None, "T") for p, t, l in rows], schemas.REPORT)
    assert {r["patient_id"] for r in R.extract_reports(df).collect()} == {"a"}
    assert {r["patient_id"] for r in R.extract_reports(df, combine="or").collect()} == {"a", "b", "c"}


def test_event_flags(spark):
    rows = [
        ("foreign", "31254", "ICD", day(1)),
        ("lower", "31254", "cpt", day(9)),
        ("lower", "31253", "CPT", day(3)),
        ("undated", "31255", "CPT", None),
        ("endo", "31231", "CPT", day(2)),
        ("endo", "99999", "CPT", day(1)),
        ("nocode", None, None, day(1)),
    ]
    df = spark.createDataFrame(rows, schemas.PROCEDURE)
    got = {r["patient_id"]: tuple(r)[1:] for r in C.index_event_flags(df).collect()}
    assert got == {
        "foreign": (False, None, False, None),
        "lower": (True, day(3), False, None),
        "undated": (True, None, False, None),
        "endo": (False, None, True, day(2)),
        "nocode": (False, None, False, None),
    }


def test_reports_before_cutoff(spark):
    df = reports(spark, [("s", 1, day(5), "a"), ("s", 2, day(5, 9), "b"), ("s", 3, None, "c"), ("n", 4, None, "d"), ("n", 5, day(9), "e")])
    f = flags(spark, [("s", True, day(5, 8), False, None), ("n", False, None, False, None)])
    assert {r["text"] for r in C.reports_before_index(df, f).collect()} == {"a", "d", "e"}


def test_history_order_and_parts(spark):
    rows = [("p", s, d, f"t{s}") for s, d in [(4, day(2)), (1, day(3)), (3, day(2, 5)), (2, None), (5, day(1))]]
    df = notes(spark, rows + [("q", 9, day(1), "only")]).repartition(5)
    whole = {r["patient_id"]: [i["text"] for i in r["h"]] for r in C.collect_history(df, "h").collect()}
    assert whole == {"p": ["t2", "t5", "t3", "t4", "t1"], "q": ["only"]}
    parts = {(r["patient_id"], r["part"]): [i["text"] for i in r["h"]] for r in C.collect_history(df, "h", max_items=2).collect()}
    assert parts == {("p", 0): ["t2", "t5"], ("p", 1): ["t3", "t4"], ("p", 2): ["t1"], ("q", 0): ["only"]}


def test_hot_patient_keeps_every_note(spark):
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 500)).alias("patient_id"),
        F.col("id").alias("note_seq"),
        F.lit("x").alias("type"),
        F.lit(PROGRESS).alias("title"),
        F.lit(day(1)).cast("timestamp_ntz").alias("date"),
        F.col("id").cast("string").alias("text"),
    )
    got = C.collect_history(hot, "h", max_items=64).select("patient_id", "part", F.transform("h", lambda i: i["text"]).alias("h")).collect()
    assert max(len(r["h"]) for r in got) <= 64
    parts = sorted((r["part"], r["h"]) for r in got if r["patient_id"] == "hot")
    assert [t for _, h in parts for t in h] == [str(i) for i in range(0, 3000, 3)]
    assert sum(len(r["h"]) for r in got) == 3000


def test_collect_text(spark):
    df = notes(spark, [("p", 1, None, "last"), ("p", 2, day(1), "first"), ("p", 3, day(2), None), ("p", 4, day(2), "mid")])
    assert C.collect_text(df, "t").first()["t"] == "first\n---\nmid\n---\nlast"


def test_patient_table_labels(spark):
    n = notes(spark, [("notes", 1, day(1), "n")])
    r = reports(spark, [("imaging", 2, day(1), "before"), ("imaging", 3, day(9), "after"), ("late", 4, day(9), "after")])
    f = flags(spark, [("imaging", True, day(5), False, None), ("late", True, day(5), True, day(1)), ("neither", True, day(1), True, None)])
    fixed = {x["patient_id"]: x for x in build_patient_table(n, r, f).collect()}
    assert set(fixed) == {"notes", "imaging", "late"}
    assert [i["text"] for i in fixed["imaging"]["radiology_reports"]] == ["before"]
    assert fixed["late"]["radiology_reports"] == [] and fixed["notes"]["radiology_reports"] == []
    assert fixed["imaging"]["had_surgery"] and fixed["imaging"]["first_surgery_date"] == day(5)
    assert fixed["notes"]["had_surgery"] is False and fixed["notes"]["had_endoscopy"] is False
    old = {x["patient_id"]: x for x in build_patient_table(n, r, f, label_join="reference").collect()}
    assert set(old) == set(fixed)
    assert old["imaging"]["had_surgery"] is False and old["imaging"]["first_surgery_date"] is None
    assert [i["text"] for i in old["imaging"]["radiology_reports"]] == ["before"]


def last(spark, rows, f, **options):
    return {r["patient_id"]: r for r in C.last_note(notes(spark, rows), f, **options).collect()}


def test_last_note(spark):
    rows = [
        ("timed", 1, day(4), "old"), ("timed", 2, day(5, 12), "same day"),
        ("midnight", 3, day(4), "old"), ("midnight", 4, day(5, 12), "same day"),
        ("tied", 6, day(3, 1), "later in list"), ("tied", 5, day(3, 9), "earlier in list"),
        ("undated event", 7, day(30), "after all"),
        ("no event", 8, day(1), "a"), ("no event", 9, None, "undated"), ("no event", 10, day(2), "b"),
        ("only undated", 11, None, "u1"), ("only undated", 12, None, "u2"),
        ("other title", 13, day(1), "x", "H&P"),
        ("none before", 14, day(9), "x"),
        ("undated dropped", 15, None, "x"),
    ]
    f = flags(spark, [
        ("timed", True, day(5, 8), False, None), ("midnight", True, day(5), False, None), ("tied", False, None, False, None),
        ("undated event", True, None, False, None), ("none before", True, day(5), False, None),
        ("undated dropped", True, day(5), False, None),
    ])
    got = last(spark, rows, f)
    texts = {p: r["last_progress_note"]["text"] for p, r in got.items()}
    assert texts == {
        "timed": "same day", "midnight": "old", "tied": "later in list", "undated event": "after all",
        "no event": "b", "only undated": "u2",
    }
    assert {p for p, r in got.items() if r["cutoff_missing"]} == {"undated event"}
    strict = last(spark, rows, f, same_day="exclude")
    assert strict["timed"]["last_progress_note"]["text"] == "old"


def test_previous_note(spark):
    df = notes(spark, [("p", 1, day(1), "a"), ("p", 2, day(2), "b"), ("p", 3, day(2), "c"), ("p", 4, day(3), "d"), ("q", 5, day(1), "e")])
    refs = spark.createDataFrame([("p", day(3)), ("q", None)], "patient_id string, ref_date timestamp_ntz")
    got = C.previous_note(df, refs).collect()
    assert [(r["patient_id"], r["previous_note"]["text"]) for r in got] == [("p", "c")]


def test_fallback(spark):
    cut = f"{LONG} plan for sinus surgery"
    usable = f"{LONG}{GAP}second chunk"
    rows = [("k0", 1, day(9), usable), ("k0", 2, day(8), usable)]
    rows += [("k1", 10, day(9), cut), ("k1", 11, day(8), usable), ("k1", 12, day(8, 3), usable + " tied")]
    rows += [("k5", 20 + i, day(20 - i), "short") for i in range(5)] + [("k5", 25, day(15), usable)]
    rows += [("six blank", 30 + i, day(20 - i), "short") for i in range(6)] + [("six blank", 36, day(14), usable)]
    rows += [("blank only", 40, day(1), "short"), ("undated", 41, None, "short"), ("undated", 42, None, "short")]
    rows += [("same day", 50, day(5), usable), ("same day", 51, day(5), "short")]
    rows += [("surgery", 60, day(9), usable), ("surgery", 61, day(3), f"{usable}{GAP}septoplasty")]
    f = flags(spark, [("surgery", True, day(5), False, None)])
    got = {r["patient_id"]: r for r in C.censor_with_fallback(notes(spark, rows), f).collect()}
    assert set(got) == {"k0", "k1", "k5", "surgery"}
    assert {p: r["attempts"] for p, r in got.items()} == {"k0": 0, "k1": 1, "k5": 5, "surgery": 0}
    assert got["k0"]["last_progress_note"]["original_date"] is None
    assert got["k1"]["last_progress_note"]["original_date"] == date(2024, 1, 9)
    assert got["k1"]["last_progress_note"]["text"].endswith("tied")
    assert got["k5"]["last_progress_note"]["date"] == date(2024, 1, 15)
    assert got["surgery"]["matched_text"] == "septoplasty"
    assert got["surgery"]["last_progress_note_censored"]["text"] == usable
    assert got["surgery"]["censored_text"] == "septoplasty"


def test_censor_note_passes_null(spark):
    df = C.last_note(notes(spark, [("p", 1, day(1), f"{LONG}{GAP}FESS is planned")]), None)
    both = df.unionByName(df.select(F.lit("q").alias("patient_id"), "note_seq", F.lit(None).cast(df.schema["last_progress_note"].dataType).alias("last_progress_note"), "cutoff_missing"))
    got = {r["patient_id"]: r for r in C.censor_note(both, "last_progress_note").collect()}
    assert got["p"]["last_progress_note_censored"]["text"] == LONG and got["p"]["matched_text"] == "FESS is planned"
    assert got["q"]["last_progress_note_censored"] is None and got["q"]["censored_text"] is None


def test_skipped_patients(spark):
    usable = f"{LONG}{GAP}More"
    rows = notes(spark, [("kept", 1, day(2), usable), ("back", 2, day(2), "short"), ("back", 3, day(1), usable), ("blank", 4, day(2), "short"), ("blank", 5, day(1), " ")])
    assert [r[0] for r in C.skipped_patients(rows, None).collect()] == ["blank"]
    assert {r["patient_id"] for r in C.censor_with_fallback(rows, None).collect()} == {"kept", "back"}


def clinical(spark):
    usable = f"{LONG}{GAP}More"
    n = notes(spark, [
        ("p10", 1, day(2), usable), ("p2", 2, day(2), "short"), ("p3", 3, day(3), usable + GAP + "Septoplasty"),
        ("p4", 4, day(1), usable, "H&P"), ("p5", 5, day(1), usable, PROGRESS, "cardiology"), ("p6", 6, day(1), usable),
    ])
    r = reports(spark, [("p10", 1, day(1), "CT One"), ("p10", 2, day(3), "CT Two"), ("p5", 3, day(1), "CT"), ("outside", 4, day(1), "CT"), ("p6", 5, day(8), "CT")])
    p = spark.createDataFrame([("p6", "31254", "CPT", day(5))], schemas.PROCEDURE)
    return {"clinical_note": n, "radiology_report": r, "procedures": p}


@pytest.mark.parametrize("partitions", [1, 8])
def test_prepare_cases(spark, partitions):
    tables = {k: v.repartition(partitions) for k, v in clinical(spark).items()}
    cases, prepared = prepare_cases(tables)
    got = {r["patient_id"]: r for r in prepared.collect()}
    # p2 is dropped (blank), "outside" has no clinical note at all, p5 stays with imaging only.
    assert {p: r["llm_caseID"] for p, r in got.items()} == {"p10": 1, "p3": 2, "p4": 3, "p5": 4, "p6": 5}
    assert got["p6"]["had_surgery"] and not got["p6"]["has_radiology"]
    assert got["p4"]["last_progress_note"] is None and got["p5"]["n_notes"] == 0
    text = {r["llm_caseID"]: r for r in cases.collect()}
    assert text[1]["formatted_radiology_text"] == (
        "Date: 2024-01-01, Type: CT, Title: CT SINUS LIMITED\nContent: ct one\n\n"
        "Date: 2024-01-03, Type: CT, Title: CT SINUS LIMITED\nContent: ct two"
    )
    assert text[2]["formatted_progress_text"].endswith(f"{GAP}more") and "eptoplasty" not in text[2]["formatted_progress_text"]
    assert text[3]["formatted_progress_text"] == vocab.NO_NOTE and text[5]["formatted_radiology_text"] == vocab.NO_REPORTS


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_cutoff_comes_before_parts(spark, size):
    reports = spark.createDataFrame(
        [("p", n, "CT", "T", None if n < 3 else datetime(2024, 1, n), f"r{n}") for n in range(7)],
        "patient_id string, note_seq bigint, type string, title string, date timestamp_ntz, text string",
    )
    cutoff = spark.createDataFrame([("p", datetime(2024, 1, 6))], "patient_id string, at timestamp_ntz")
    found = C.collect_history(reports, "items", cutoffs=cutoff, max_items=size).orderBy("part").collect()
    assert [i["text"] for r in found for i in r["items"]] == ["r3", "r4", "r5"]
    assert all(r["items"] for r in found)


def test_profile(spark):
    tables = clinical(spark)
    tables["demographics"] = spark.createDataFrame(
        [("p10", 1, 40, "a", "b", "F"), ("p10", 2, 41, "a", "b", "F"), ("p6", 1, 50, None, None, None), ("x", 1, 9, "a", "b", "M")],
        schemas.DEMOGRAPHICS,
    )
    got = {r["patient_id"]: r for r in profile_prompts(patient_profile(tables)).collect()}
    assert set(got) == {"p10", "p6"}
    assert got["p10"]["age"] == 41 and got["p10"]["has_radiology_report"]
    assert len(got["p10"]["radiology_text"].split("\n\n")) == 2 and "part" not in got["p10"]
    assert got["p6"]["had_surgery"] and "- Age: 50\n    - Sex: None\n" in got["p6"]["prompt"]


@pytest.mark.parametrize("partitions", [1, 8])
def test_numbering(spark, partitions):
    ids = spark.createDataFrame([(f"p{i}",) for i in range(500)], "patient_id string").repartition(partitions)
    got = {r["patient_id"]: r["llm_caseID"] for r in N.number_cases(ids).collect()}
    assert got == {p: n for n, p in enumerate(sorted(got), start=1)}
    batches = {r["patient_id"]: r["b"] for r in N.assign_batches(ids, ["patient_id"], 200, "b").collect()}
    assert all(batches[p] == (n - 1) // 200 + 1 for p, n in got.items())


def test_empty_numbering(spark):
    assert N.number_cases(spark.createDataFrame([], "patient_id string")).count() == 0


def test_pages(spark):
    ids = spark.range(10).selectExpr("id % 7 as patient_id")
    assert [r[0] for r in N.page(ids, 3, 2).collect()] == [6]
    assert N.page(ids, 3, 3).count() == 0
    numbered = N._first(N.distinct_ids(ids), 3, "patient_id", skip=2, direct=0)
    assert [r[0] for r in numbered.collect()] == [r[0] for r in N._first(N.distinct_ids(ids), 3, "patient_id", skip=2).collect()] == [2, 3, 4]


def test_split(spark):
    cases = spark.createDataFrame([(10 * i, bool(i % 2) if i != 3 else None) for i in range(1, 6)], "llm_caseID bigint, had_surgery boolean")
    for n, sizes in [(0, (0, 5)), (2, (2, 3)), (9, (5, 0)), (None, (5, 0))]:
        train, rest = N.train_test_split_ordered(cases, n)
        assert (train.count(), rest.count()) == sizes
        assert "had_surgery" not in rest.columns
    train, _ = N.train_test_split_ordered(cases, None)
    assert [(r["llm_caseID"], r["had_surgery"]) for r in train.orderBy("llm_caseID").collect()] == [
        (1, True), (2, False), (3, False), (4, False), (5, True),
    ]


def test_timestamps(spark):
    given = ["2024-02-03 04:05:06", "2024-02-03T04:05:06.123", "2024-02-03", "02/03/2024", "20240203", "soon", None, "2024-02-30"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "id int, t string")
    got = [r[0] for r in df.select(day_str(parse_ts(F.col("t"))), "id").orderBy("id").collect()]
    assert got == ["2024-02-03"] * 5 + [None] * 3
    with pytest.raises(Exception, match="not a timestamp"):
        df.select(parse_ts(F.col("t"), strict=True)).collect()


def test_defaults_and_columns(spark):
    df = spark.createDataFrame([(None, None, 1)], "flag boolean, items array<string>, n int")
    assert tuple(R.fill_patient_defaults(df).first()) == (False, [], 1)
    with pytest.raises(ValueError, match="columns absent: \\['x'\\]"):
        R.require_columns(df, ["n", "x"])


def brute_force_choice(items, cutoff, same_day):
    """(text, k, first day) of the first usable note by stepping back day by day, or None."""
    ordered = sorted(items, key=lambda n: (n[1] is not None, n[1].date() if n[1] else date.min, n[0]))
    if cutoff is not None:
        limit = cutoff if same_day == "reference" else datetime.combine(cutoff.date(), datetime.min.time())
        ordered = [n for n in ordered if n[1] and datetime.combine(n[1].date(), datetime.min.time()) < limit]
    if not ordered:
        return None
    current = ordered[-1]
    first = current[1].date() if current[1] else None
    for k in range(6):
        if len(current[2]) >= 500:
            return current[2], k, first if k else None
        earlier = [n for n in ordered if current[1] and n[1] and n[1].date() < current[1].date()]
        if not earlier:
            return None
        current = earlier[-1]
    return None


@pytest.mark.parametrize("same_day", ["reference", "exclude"])
def test_fallback_matches_brute_force(spark, same_day):
    pick = random.Random(17)
    rows, cutoffs, seq = [], [], 0
    for p in range(250):
        for _ in range(pick.randint(0, 9)):
            seq += 1
            at = None if pick.random() < 0.1 else day(pick.randint(1, 9), pick.choice([0, 6, 18]))
            rows.append((f"p{p}", seq, at, f"{LONG} note {seq}" if pick.random() < 0.35 else f"short {seq}"))
        if pick.random() < 0.6:
            at = None if pick.random() < 0.2 else day(pick.randint(2, 9), pick.choice([0, 12]))
            cutoffs.append((f"p{p}", True, at, False, None))
    pick.shuffle(rows)
    chosen = C.censor_with_fallback(notes(spark, rows).repartition(7), flags(spark, cutoffs), same_day=same_day)
    got = {
        r["patient_id"]: (r["last_progress_note_censored"]["text"], r["attempts"], r["last_progress_note"]["original_date"])
        for r in chosen.collect()
    }
    limits = {c[0]: c[2] for c in cutoffs}
    want = {}
    for p in {r[0] for r in rows}:
        best = brute_force_choice([r[1:] for r in rows if r[0] == p], limits.get(p), same_day)
        if best:
            want[p] = best
    assert got == want and {k for _, k, _ in want.values()} >= {0, 1, 2, 3}
