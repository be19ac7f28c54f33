"""Physical plans: pushed filters, pruned columns, limits before shuffles, no nested loops, no row UDFs."""

import re

import pytest

from casewright.catalog import QUERIES
from casewright.catalog import adapters as A
from casewright.operators import cohort as C
from casewright.operators import progress as P
from casewright.operators.cases import trim_conversation

SF_DIR = "/root/testdata/sf0.001"
PYTHON_CALLS = {"score_stub", "pearson_test", "pearson_p"}
EAGER = {"scoring_resume", "few_shot_run", "scoring_stream", "stream_ids_in_state", "scoring_seen"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_CALLS:
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", text)


def test_note_choice_reads_no_text_before_the_winners(spark):
    notes = A.event_items(spark, SF_DIR, "view")
    text = plan(C.note_candidates(notes, None, title="view", back=5))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text
    assert "props" not in text
    exchange = text.index("Exchange hashpartitioning(patient_id")
    assert "WindowGroupLimit" in text[:exchange] and "Partial" in text[exchange : text.index("partial_max")]


@pytest.mark.parametrize("what", ["dedup", "latest", "trim"])
def test_ranked_rows_are_limited_before_the_shuffle(spark, what):
    frame = {
        "dedup": lambda: P.dedup_results(A.label_results(spark, SF_DIR).selectExpr("*", "'r' run_id"), ["run_id"]),
        "latest": lambda: C.latest_per_key(A.table(spark, SF_DIR, "orders"), "o_orderkey", "o_custkey"),
        "trim": lambda: trim_conversation(A.table(spark, SF_DIR, "conversations")),
    }[what]()
    text = plan(frame)
    for below in text.split("Exchange hashpartitioning")[1:]:
        assert "Partial" in below.split("FileScan")[0]


@pytest.mark.parametrize("name,times", [("censor_fallback", 1), ("censor_plan", 1), ("first_phrase", 1)])
def test_costly_search_runs_once(spark, name, times):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert len(re.findall(r"RLIKE\([^,]*, \(\?Ud\)ouaux\)", text)) == times


def test_flags_prune_and_push(spark):
    text = plan(QUERIES["index_flags"](spark, SF_DIR))
    assert "EqualTo(event_type,purchase)" in text and "value" not in re.search(r"ReadSchema: (\S+)", text)[1]


def test_metrics_scan_the_cases_once(spark):
    df = QUERIES["metrics_by"](spark, SF_DIR)
    assert plan(df).count("labels.parquet") == 1
