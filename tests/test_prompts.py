"""Rendering, prompts, few-shot text, chat messages and turn trimming."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions import render, templates
from casewright.functions.display import fmt_num, fmt_pct, round_even
from casewright.operators import cases as K

ITEM = "struct<date:date,type:string,title:string,text:string,original_date:date>"


def note(spark, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id int, n {ITEM}")
    return [r[0] for r in df.select(render.format_note(F.col("n")), "id").orderBy("id").collect()]


def test_note(spark):
    d, e = date(2024, 1, 2), date(2024, 3, 4)
    got = note(
        spark,
        (d, "Other", "Progress Notes", " text \n", None),
        (d, "Other", "Progress Notes", "text", e),
        (d, "Other", "Progress Notes", "text", d),
        (None, None, None, None, None),
        None,
    )
    assert got == [
        "Date: 2024-01-02, Type: Other, Title: Progress Notes\nContent:  text",
        "Date: 2024-01-02 (originally from 2024-03-04), Type: Other, Title: Progress Notes\nContent: text",
        "Date: 2024-01-02, Type: Other, Title: Progress Notes\nContent: text",
        "Date: Unknown date, Type: Unknown type, Title: No title\nContent: No text",
        vocab.NO_NOTE,
    ]


def test_reports(spark):
    df = spark.createDataFrame(
        [(0, []), (1, None), (2, [(date(2024, 1, 1), "CT", "a", "x "), (None, "CT", "b", "y\n")])],
        "id int, r array<struct<date:date,type:string,title:string,text:string>>",
    )
    got = [r[0] for r in df.select(render.format_reports(F.col("r")), "id").orderBy("id").collect()]
    assert got == [
        vocab.NO_REPORTS,
        vocab.NO_REPORTS,
        "Date: 2024-01-01, Type: CT, Title: a\nContent: x \n\nDate: Unknown date, Type: CT, Title: b\nContent: y",
    ]


def cases(spark):
    rows = [(1, "CT shows x", "note one", True), (2, vocab.NO_REPORTS, "note {case_id} two", False), (3, " \n", "note three", None)]
    return spark.createDataFrame(
        rows, "llm_caseID bigint, formatted_radiology_text string, formatted_progress_text string, had_surgery boolean"
    )


@pytest.mark.parametrize(
    "build,template", [(render.prompt_zero_shot, templates.ZERO_SHOT), (render.prompt_scaled, templates.SCALED)]
)
def test_prompts(spark, build, template):
    got = {r["llm_caseID"]: r["prompt"] for r in K.with_prompt(cases(spark), build).collect()}
    sections = {1: "- Radiology Report: CT shows x", 2: templates.REPORT_SECTION_EMPTY, 3: templates.REPORT_SECTION_EMPTY}
    notes = {1: "note one", 2: "note {case_id} two", 3: "note three"}
    for n, prompt in got.items():
        head, rest = template.split("{case_id}")
        middle, rest = rest.split("{note}")
        between, tail = rest.split("{report_section}")
        assert prompt == head + str(n) + middle + notes[n] + between + sections[n] + tail


def test_few_shot(spark):
    prompt = K.with_examples(cases(spark), cases(spark).repartition(3)).filter("llm_caseID = 3").first()["prompt"]
    assert prompt.index("Example Case ID: 1:") < prompt.index("Example Case ID: 2:") < prompt.index("Example Case ID: 3:")
    assert prompt.count("- Patient had surgery: Yes") == 1 and prompt.count("- Patient had surgery: No") == 2
    assert "    --- Example Case Details ---\n        - Example Case ID: 1:" in prompt
    assert "{" not in prompt.replace("note {case_id} two", "")


def test_messages(spark):
    row = K.messages(cases(spark), cases(spark), confirmation="ok").filter("llm_caseID = 2").first()
    assert [m["role"] for m in row["messages"]] == ["system", "user", "assistant", "user"]
    examples = row["messages"][1]["content"]
    assert examples.count("Please confirm") == 1 and examples.count("TRAINING CASE") == 3
    assert "Clinical Notes: note one\nRadiology: CT shows x\n" in examples
    assert "Case ID: 2" in row["messages"][3]["content"]
    assert len(K.messages(cases(spark), cases(spark)).first()["messages"]) == 3


def test_trim(spark):
    sizes = {"short": 50, "long": 51, "huge": 4000, "one": 1}
    rows = [(c, t, "user", f"{c}{t}") for c, n in sizes.items() for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string").repartition(7)
    kept = {}
    for r in K.trim_conversation(df).collect():
        kept.setdefault(r["conv_id"], []).append(r["turn"])
    for c, n in sizes.items():
        turns = list(range(n))
        assert sorted(kept[c]) == (turns if n <= 50 else turns[:3] + turns[-20:])
    history = {r["conv_id"]: r["messages"] for r in K.message_history(df).collect()}
    assert [m["content"] for m in history["long"]][:4] == ["long0", "long1", "long2", "long31"]


def test_trim_with_overlapping_ends(spark):
    df = spark.createDataFrame([(1, t, "user", "x") for t in range(4)], "conv_id bigint, turn bigint, role string, text string")
    got = sorted(r["turn"] for r in K.trim_conversation(df, max_len=3, head=3, tail=3).collect())
    assert got == sorted([0, 1, 2] + [1, 2, 3])


def test_display_matches_python(spark):
    values = [0.12345, -0.5, 2.0, 0.0625, 0.125, 2.675, -0.0004, 0.9995, 1234567.5, 0.0, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    got = df.select(v, fmt_pct(v), fmt_num(v), fmt_num(v, signed=True), fmt_num(v, 2)).collect()
    assert [tuple(r)[1:] for r in got] == [(f"{x:.1%}", f"{x:.3f}", f"{x:+.3f}", f"{x:.2f}") for x in values]
    assert spark.range(1).select(round_even(F.lit(0.0625)), fmt_num(F.lit(None))).first() == (0.062, None)
