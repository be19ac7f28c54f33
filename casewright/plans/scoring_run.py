"""Resumable scoring runs, zero-shot and few-shot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import schemas
from casewright.functions.answers import parse_json_answer
from casewright.functions.render import prompt_zero_shot
from casewright.operators.bitmaps import add_to_bitmap, pending_by_bitmap, read_bitmap
from casewright.operators.cases import with_examples, with_prompt
from casewright.operators.filters import require_columns
from casewright.operators.numbering import train_test_split_ordered
from casewright.operators.progress import dedup_results, pending
from casewright.operators.scoring import Responder, score
from casewright.session import materialize
from casewright.sources.results import PRIORITY, append_results, read_results, write_final, write_latest

CASE_COLUMNS = [f.name for f in schemas.CASE]


def parsed_results(scored: DataFrame, parser: Callable[[Column], Column] = parse_json_answer) -> DataFrame:
    """Scored rows with parsed answers; a failed call keeps its error text as reasoning."""
    parsed = scored.withColumn("_answer", parser(F.col("api_response")))
    return parsed.select(
        "llm_caseID",
        F.col("_answer.decision").alias("decision"),
        F.col("_answer.confidence").alias("confidence"),
        F.coalesce(F.col("error"), F.col("_answer.reasoning")).alias("reasoning"),
        "api_response",
        F.col("_answer.parse_status").alias("parse_status"),
        "provider",
        "model_name",
    )


def run_scoring(
    cases: DataFrame,
    store: str,
    responder: Responder,
    *,
    provider: str,
    model_name: str,
    run_id: str,
    build_prompts: Callable[[DataFrame], DataFrame] = lambda c: with_prompt(c, prompt_zero_shot),
    parser: Callable[[Column], Column] = parse_json_answer,
    rounds: int = 1,
    concurrency: int | None = None,
    latest: str | None = None,
    latest_every: int = 5,
    retry_failed: bool = False,
    final: str | None = None,
    seen: str | None = None,
    this_run_only: bool = False,
) -> DataFrame:
    """Score the cases that have no stored result of this model and return all results.

    Each of the ``rounds`` appends its share of the pending cases as one committed
    write, so a stopped run loses at most one round. Later duplicates of a case lose
    to the earliest stored result. Run ids should sort in time order. ``latest`` names a
    snapshot of all results so far, overwritten every ``latest_every`` rounds and after
    the last one; each is also kept as ``<latest>_after_batch_NNN``. ``retry_failed`` asks
    again about cases without any stored answer, and an answer then wins over earlier failures.
    ``final`` names the folder for the combined result at the end of the run. Pending cases
    of several rounds are written once, by round, and each round reads its share.
    ``seen`` names a folder that keeps the finished ids of this provider and model as bitmaps: it is filled
    from the store when it is new, and later runs find their pending cases without reading a result. A
    round's ids are added after its results, so a run stopped in between asks again and the
    earlier results win. ``this_run_only`` is for callers that bring new cases only: finished ones are looked for among
    the results of this very run id, should it be a repetition, and no other result is read.
    """
    require_columns(cases, CASE_COLUMNS)
    spark = cases.sparkSession

    def stored() -> DataFrame:
        found = read_results(spark, store)
        return found.filter((F.col("provider") == provider) & (F.col("model_name") == model_name))

    def combined() -> DataFrame:
        found = stored().withColumn("_failed", F.col("api_response").isNull() if retry_failed else F.lit(False))
        return dedup_results(found, ["_failed", *PRIORITY]).drop("stored_in", "_failed")

    if seen is not None:
        if retry_failed:
            raise ValueError("kept ids do not tell failed calls from answered ones")
        if read_bitmap(spark, seen) is None:
            add_to_bitmap(stored(), seen)
        todo = pending_by_bitmap(cases, read_bitmap(spark, seen))
    else:
        done = stored().filter("api_response IS NOT NULL") if retry_failed else stored()
        todo = pending(cases, done.filter(F.col("run_id") == run_id) if this_run_only else done)
    if rounds > 1 or seen is not None:
        todo = materialize(todo.withColumn("_round", F.pmod(F.xxhash64("llm_caseID"), F.lit(rounds))), by="_round")
    for n in range(rounds):
        share = todo if "_round" not in todo.columns else todo.filter(F.col("_round") == n).drop("_round")
        if concurrency is not None:  # cases are dealt before prompts are rendered, which are longer
            share = share.repartition(concurrency, "llm_caseID")
        scored = score(
            build_prompts(share), responder, provider=provider, model_name=model_name
        )
        append_results(parsed_results(scored, parser), store, run_id)
        if seen is not None:
            add_to_bitmap(todo.filter(F.col("_round") == n), seen)
        if latest is not None and ((n + 1) % latest_every == 0 or n + 1 == rounds):
            kept = f"{latest}_after_batch_{n + 1:03d}"
            write_latest(combined(), kept)
            write_latest(spark.read.schema(schemas.RESULT).parquet(kept), latest)
    if final is not None:
        write_final(combined(), final, provider, model_name, run_id)
    return combined()


def run_few_shot(
    cases: DataFrame,
    n_examples: int,
    store: str,
    responder: Responder,
    **options,
) -> DataFrame:
    """Use the first n cases with their outcomes as examples and score the rest."""
    require_columns(cases, [*CASE_COLUMNS, "had_surgery"])
    if n_examples is None:
        raise ValueError("a few-shot run needs a number of examples: all of them go into every prompt")
    examples, rest = train_test_split_ordered(cases, n_examples)
    return run_scoring(
        rest, store, responder, build_prompts=lambda share: with_examples(share, examples), **options
    )
