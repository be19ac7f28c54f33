"""Answer parsing edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions import answers as P
from casewright.functions.answers import path_safe_name

GOOD = '{"decision": "Yes", "confidence": 8, "reasoning": "clear"}'


def parse(spark, values, parser):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")
    return [r["r"] for r in df.select("id", parser(F.col("t")).alias("r")).orderBy("id").collect()]


JSON_CASES = [
    # text, decision, confidence, reasoning, status
    (GOOD, "Yes", 8.0, "clear", "ok"),
    (f"```json\n{GOOD}\n```", "Yes", 8.0, "clear", "ok"),
    (f"```\n{GOOD}\n```", "Yes", 8.0, "clear", "ok"),
    (f"  \xa0{GOOD}\n", "Yes", 8.0, "clear", "ok"),
    (f"{GOOD} done", None, None, vocab.UNPARSEABLE, "unparseable"),
    (f"Sure: {GOOD}", None, None, vocab.UNPARSEABLE, "unparseable"),
    (f"{GOOD}, {GOOD}", None, None, vocab.UNPARSEABLE, "unparseable"),
    (f"[{GOOD}]", None, None, vocab.UNPARSEABLE, "unparseable"),
    ("8", None, None, vocab.UNPARSEABLE, "unparseable"),
    ("null", None, None, vocab.UNPARSEABLE, "unparseable"),
    ("{}", None, None, vocab.NO_REASONING, "ok"),
    ('{"decision": "No", "confidence": "8"}', "No", 8.0, vocab.NO_REASONING, "ok"),
    ('{"decision": "No", "confidence": 8.0, "reasoning": null}', "No", 8.0, None, "ok"),
    ('{"decision": "Perhaps", "confidence": 11, "reasoning": ""}', "Perhaps", 11.0, "", "ok"),
    ('{"decision": null, "confidence": "high"}', None, None, vocab.NO_REASONING, "ok"),
    ('{"DECISION": "Yes"}', None, None, vocab.NO_REASONING, "ok"),
    ('{"decision": "No", "decision": "Yes"}', "Yes", None, vocab.NO_REASONING, "ok"),
    ("not json", None, None, vocab.UNPARSEABLE, "unparseable"),
    ("", None, None, None, "no_response"),
    (None, None, None, None, "no_response"),
]


def test_json(spark):
    rows = parse(spark, [c[0] for c in JSON_CASES], P.parse_json_answer)
    for case, row in zip(JSON_CASES, rows):
        assert (row["decision"], row["confidence"], row["reasoning"], row["parse_status"]) == case[1:], case[0]
    assert rows[0]["decision_valid"] and rows[0]["confidence_valid"]
    assert not rows[13]["decision_valid"] and not rows[13]["confidence_valid"]


def test_json_agrees_with_python_on_plain_objects(spark):
    objects = [{"decision": d, "confidence": c, "reasoning": r} for d in ("Yes", "No") for c in (1, 9.5, "7") for r in ("é \"q\"", "a\nb")]
    rows = parse(spark, [json.dumps(o) for o in objects], P.parse_json_answer)
    for o, row in zip(objects, rows):
        assert (row["decision"], row["confidence"], row["reasoning"]) == (o["decision"], float(o["confidence"]), o["reasoning"])


LINE_CASES = [
    ("DECISION: Yes\nCONFIDENCE: 8\nREASONING: fine", "Yes", 8.0, "fine"),
    ("  DECISION:No \nCONFIDENCE: 8, high\nREASONING:  a: b ", "No", 8.0, "a: b"),
    ("DECISION: Yes\nDECISION: Maybe\nCONFIDENCE: 8/10", "Yes", None, vocab.UNPARSEABLE),
    ("CONFIDENCE: 4\nCONFIDENCE: 11\nREASONING: one\nREASONING: two", None, 4.0, "two"),
    ("CONFIDENCE: 0\nCONFIDENCE: 8.5\nDECISION: yes", None, None, vocab.UNPARSEABLE),
    (GOOD, None, None, vocab.UNPARSEABLE),
    (None, None, None, vocab.NO_RESPONSE),
    ("", None, None, vocab.NO_RESPONSE),
]


def test_lines(spark):
    rows = parse(spark, [c[0] for c in LINE_CASES], P.parse_labelled_answer)
    for case, row in zip(LINE_CASES, rows):
        assert (row["decision"], row["confidence"], row["reasoning"]) == case[1:], case[0]


def test_either_form(spark):
    texts = ['{"DECISION": "Yes", "Confidence": 9, "REASONING": "r"}', "DECISION: No\nCONFIDENCE: 2", "neither"]
    rows = parse(spark, texts, P.parse_answer)
    assert [(r["decision"], r["confidence"], r["parse_status"]) for r in rows] == [
        ("Yes", 9.0, "ok"), ("No", 2.0, "ok"), (None, None, "unparseable"),
    ]


@pytest.mark.parametrize("name,safe", [("a/b:c@d", "a_b_c_d"), ("plain-1.5", "plain-1.5")])
def test_path_safe(spark, name, safe):
    assert path_safe_name(name) == safe
    assert spark.range(1).select(P.path_safe(F.lit(name))).first()[0] == safe


def test_score(spark):
    df = spark.createDataFrame([(None,), (8.0,)], "c double")
    assert [r[0] for r in df.select(P.confidence_score(F.col("c"))).collect()] == [0.5, 0.8]
