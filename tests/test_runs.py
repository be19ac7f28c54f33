"""Sources, the result store, scoring runs and their resumption."""

import pytest
from pyspark.sql import functions as F

from casewright import schemas
from casewright.catalog import adapters as A
from casewright.catalog import answer_queries as Q
from casewright.operators import progress as P
from casewright.operators.cases import with_prompt
from casewright.operators.scoring import score
from casewright.plans.scoring_run import run_few_shot, run_scoring
from casewright.session import materialize, shared_dir
from casewright.sources import exports as E
from casewright.sources import results as S
from casewright.sources import tables as T
from casewright.streaming.pending import read_case_stream, score_stream

RUN = {"provider": "stub", "model_name": "a/b:1"}


def cases(spark, n=40):
    ids = spark.range(1, n + 1)
    return ids.select(
        F.col("id").alias("llm_caseID"),
        F.lit("No radiology reports available.").alias("formatted_radiology_text"),
        F.repeat(F.lit("x"), F.col("id").cast("int")).alias("formatted_progress_text"),
    )


def total(prompt):
    return '{"decision": "Yes", "confidence": 7, "reasoning": "r"}'


def failing(prompt):
    if prompt.count("x") % 2:
        raise RuntimeError("busy")
    return total(prompt)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shards_and_optional_tables(spark, tmp_path):
    for year, n in [("a", 3), ("b", 2)]:
        spark.range(n).selectExpr(
            "cast(id as string) patient_id", "cast(id as string) code", "'CPT' code_type", "timestamp_ntz '2024-01-01' date"
        ).write.parquet(f"{tmp_path}/{year}/procedures.parquet")
    shards = [f"{tmp_path}/a", f"{tmp_path}/b"]
    tables = T.load_tables(spark, shards, ["procedures", "demographics"], optional=["demographics"])
    assert tables["procedures"].count() == 5
    assert tables["demographics"].count() == 0 and tables["demographics"].schema == schemas.DEMOGRAPHICS
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        T.load_tables(spark, shards, ["clinical_note"])
    inferred = T.read_shards(spark, shards, "procedures")
    assert inferred.count() == 5
    profile = {r["table_name"]: (r["n_rows"], r["n_columns"]) for r in T.profile_tables(tables).collect()}
    assert profile == {"procedures": (5, 4), "demographics": (0, 6)}
    assert T.preview(tables["procedures"]).count() == 5
    picked, ids = T.pilot_sample({"procedures": tables["procedures"]}, 2, "procedures")
    assert rows(ids) == [("0",), ("1",)] and picked["procedures"].count() == 4


def test_sequence_is_unique_and_stable(spark):
    numbered = T.with_sequence(spark.range(1000).repartition(5))
    once = rows(numbered)
    assert len({seq for _, seq in once}) == 1000 and rows(numbered) == once


def test_score_captures_errors(spark):
    prompts = with_prompt(cases(spark, 6))
    got = {r["llm_caseID"]: r for r in score(prompts, failing, **RUN, concurrency=3).collect()}
    assert {n for n, r in got.items() if r["error"] == "Error: busy"} | {n for n, r in got.items() if r["api_response"]} == set(range(1, 7))
    assert all((r["error"] is None) != (r["api_response"] is None) for r in got.values())
    assert got[1]["model_name"] == "a/b:1"


def test_run_twice_is_run_once(spark, tmp_path):
    store = f"{tmp_path}/store"
    some = run_scoring(cases(spark, 25), store, total, run_id="run-1", **RUN)
    assert some.count() == 25
    first = run_scoring(cases(spark), store, total, run_id="run-2", rounds=3, **RUN)
    again = run_scoring(cases(spark), store, failing, run_id="run-3", **RUN)
    assert rows(first) == rows(again) and first.count() == 40
    stored = S.read_results(spark, store)
    assert stored.count() == 40
    assert {r["run_id"]: r["count"] for r in stored.groupBy("run_id").count().collect()} == {"run-1": 25, "run-2": 15}
    assert P.missing_cases(cases(spark), stored).count() == 0
    other = run_scoring(cases(spark, 4), store, total, run_id="run-1", provider="stub", model_name="other")
    assert other.count() == 4


def test_earlier_results_win_over_duplicates(spark, tmp_path):
    store = f"{tmp_path}/store"
    result = lambda text: cases(spark, 5).select(
        "llm_caseID", F.lit("Yes").alias("decision"), F.lit(1.0).alias("confidence"), F.lit(text).alias("reasoning"),
        F.lit(None).cast("string").alias("api_response"), F.lit("ok").alias("parse_status"),
        F.lit("stub").alias("provider"), F.lit("a/b:1").alias("model_name"),
    )
    S.append_results(result("late"), store, "run-9")
    S.append_results(result("early"), store, "run-1")
    S.append_results(result("late"), store, "run-9")
    assert S.read_results(spark, store).count() == 15
    kept = P.dedup_results(S.read_results(spark, store), S.PRIORITY)
    assert {(r["reasoning"], r["count"]) for r in kept.groupBy("reasoning").count().collect()} == {("early", 5)}


def test_snapshots_of_a_run(spark, tmp_path):
    store, latest = f"{tmp_path}/store", f"{tmp_path}/latest"
    run_scoring(cases(spark), store, total, run_id="run-1", rounds=3, latest=latest, latest_every=2, final=str(tmp_path), **RUN)
    assert spark.read.parquet(latest).count() == 40 == S.read_results(spark, store).count()
    early = spark.read.parquet(f"{latest}_after_batch_002").count()
    assert 0 < early < 40 == spark.read.parquet(f"{latest}_after_batch_003").count()
    assert spark.read.parquet(S.final_path(str(tmp_path), RUN["provider"], RUN["model_name"], "run-1")).count() == 40


def test_failed_calls_can_be_retried(spark, tmp_path):
    store = f"{tmp_path}/store"
    run_scoring(cases(spark, 6), store, failing, run_id="run-1", **RUN)
    assert run_scoring(cases(spark, 6), store, total, run_id="run-2", **RUN).filter("decision IS NULL").count() == 3
    again = run_scoring(cases(spark, 6), store, total, run_id="run-3", retry_failed=True, **RUN)
    assert again.count() == 6 and again.filter("decision = 'Yes'").count() == 6


def test_unreadable_files_are_skipped(spark, tmp_path):
    store = f"{tmp_path}/store"
    assert S.read_results(spark, store).count() == 0
    run_scoring(cases(spark, 3), store, total, run_id="run-1", **RUN)
    broken = tmp_path / "store" / "provider=stub" / "run_id=run-1" / "part-broken.parquet"
    broken.write_bytes(b"not parquet at all")
    assert S.read_results(spark, store, skip_unreadable=True).count() == 3
    with pytest.raises(Exception, match="part-broken|FAILED_READ_FILE|not a Parquet"):
        S.read_results(spark, store).count()


def test_snapshots_and_final(spark, tmp_path):
    S.write_latest(cases(spark, 3), f"{tmp_path}/latest")
    S.write_latest(cases(spark, 4), f"{tmp_path}/latest")
    assert spark.read.parquet(f"{tmp_path}/latest").count() == 4
    path = S.write_final(cases(spark, 2), str(tmp_path), "stub", "a/b:1@x", "20240101_000000")
    assert path.endswith("/final_llm_results_stub_a_b_1_x_20240101_000000.parquet")
    assert spark.read.parquet(path).count() == 2


def test_csv_exports(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, 5.0, 1, 0, f'say "{i}", insufficient data' if i % 2 else "a, b") for i in range(1, 251)],
        "llm_caseID bigint, confidence double, llm_surgery int, other int, reasoning string",
    )
    with pytest.warns(UserWarning, match="actual_surgery"):
        path = E.export_eval_csv(df, f"{tmp_path}/eval")
    read = lambda p: spark.read.option("header", True).option("escape", '"').csv(p)
    assert path.endswith(".csv") and read(path).columns == ["llm_caseID", "confidence", "llm_surgery", "reasoning"]
    assert {r["reasoning"] for r in read(path).collect()} >= {"a, b", 'say "1", insufficient data'}
    with pytest.raises(ValueError, match="no column to export"):
        E.export_eval_csv(df.select("other"), f"{tmp_path}/none")
    kept = E.export_insufficient(df, f"{tmp_path}/dropped")
    assert kept.count() == 125 and read(f"{tmp_path}/dropped").count() == 125
    E.export_review_sample(df, f"{tmp_path}/full", f"{tmp_path}/sample")
    assert read(f"{tmp_path}/full").count() == 250
    assert max(int(r["llm_caseID"]) for r in read(f"{tmp_path}/sample").collect()) == 200


def test_few_shot_run(spark, tmp_path):
    seen = run_few_shot(
        cases(spark, 6).withColumn("had_surgery", F.col("llm_caseID") % 2 == 0), 2, f"{tmp_path}/store",
        lambda prompt: '{"reasoning": "%d"}' % prompt.count("Example Case ID"), run_id="run-1", **RUN,
    )
    assert {(r["llm_caseID"], r["reasoning"]) for r in seen.collect()} == {(n, "2") for n in range(3, 7)}
    with pytest.raises(ValueError, match="had_surgery"):
        run_few_shot(cases(spark, 3), 1, f"{tmp_path}/x", total, run_id="r", **RUN)


def test_stream_scores_new_files_once(spark, tmp_path):
    source, store, checkpoint = (f"{tmp_path}/{n}" for n in ("cases", "store", "checkpoint"))
    cases(spark, 5).write.parquet(source)

    def run():
        query = score_stream(read_case_stream(spark, source), store, checkpoint, total, run_id="s", **RUN)
        query.awaitTermination()
        return S.read_results(spark, store).count()

    assert run() == 5
    cases(spark, 9).write.mode("append").parquet(source)
    assert run() == 9
    assert run() == 9


@pytest.mark.parametrize("name", ["scoring_stream", "stream_ids_in_state"])
def test_streams_read_tables_of_several_files(spark, tmp_path, name):
    """The documents as one file and as a folder of parts, whatever the parts are called, give the same results."""
    given = "/root/testdata/sf0.001"
    A.table(spark, given, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    A.table(spark, given, "documents").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    first = next((tmp_path / "documents.parquet").glob("part-*.parquet"))
    first.rename(first.with_name("first"))
    whole, parts = (rows(getattr(Q, name)(spark, str(d))) for d in (given, tmp_path))
    assert parts == whole and len(parts) == A.table(spark, given, "documents").count()


def test_status_and_batches(spark):
    done = spark.createDataFrame([(i, "Yes" if i < 14 else None, i % 2) for i in [*range(1, 16), 1]], "llm_caseID bigint, decision string, batch_no int")
    status = P.progress_status(cases(spark), done).first()
    assert (status["total"], status["done"], status["remaining"], status["done_share"]) == (40, 15, 25, 15 / 40)
    assert status["first_done"] == list(range(1, 11))
    batched = cases(spark).withColumn("batch_no", F.floor((F.col("llm_caseID") - 1) / 10))
    assert rows(P.completed_batches(batched, done)) == [(0, 10, 10, True), (1, 10, 5, False), (2, 10, 0, False), (3, 10, 0, False)]
    summary = P.run_summary(done).first()
    assert (summary["total"], summary["parsed"], summary["n_yes"], summary["failed"]) == (16, 14, 14, 2)
    empty = P.run_summary(done.filter("false")).first()
    assert empty["total"] == 0 and empty["success_rate"] is None


def test_shared_folder(spark):
    folder = shared_dir(spark)
    assert folder and spark.sparkContext.getCheckpointDir()
    assert materialize(cases(spark, 3)).count() == 3


def test_responder_is_deterministic():
    assert A.respond("x" * 5) == A.respond("y" * 5)
