"""Model-input frames: cases, prompts, few-shot examples, chat messages, turn trimming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import render, templates
from casewright.functions.text import strip_ws

CASE_ID = "llm_caseID"
NOTE = "formatted_progress_text"
REPORT = "formatted_radiology_text"


def case_frame(
    df: DataFrame,
    note: str = "last_progress_note_censored",
    reports: str = "radiology_reports",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Prepared cases as (case id, imaging text, note text)."""
    return df.select(
        CASE_ID,
        render.format_reports(F.col(reports)).alias(REPORT),
        render.format_note(F.col(note)).alias(NOTE),
        *keep,
    )


def with_prompt(cases: DataFrame, build: Callable[[Column, Column, Column], Column] = render.prompt_zero_shot) -> DataFrame:
    return cases.withColumn("prompt", build(F.col(CASE_ID), F.col(NOTE), F.col(REPORT)))


def _ordered_text(df: DataFrame, block: Column, name: str) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct(F.col(CASE_ID).alias("at"), block.alias("text"))))
    return df.agg(F.array_join(F.transform(blocks, lambda b: b["text"]), "").alias(name))


def examples_text(examples: DataFrame) -> DataFrame:
    """One row: the example blocks in case order. The examples are the n cases of a few-shot run."""
    block = render.example_block(F.col(CASE_ID), F.col(NOTE), F.col(REPORT), F.col("had_surgery"))
    return _ordered_text(examples, block, "examples").select(strip_ws(F.col("examples")).alias("examples"))


def with_examples(cases: DataFrame, examples: DataFrame) -> DataFrame:
    """Cases with their few-shot prompt.

    The example text is a scalar subquery: computed once and used as a constant in
    every task, so there is no join.
    """
    text = examples_text(examples).scalar()
    return cases.withColumn(
        "prompt", render.prompt_few_shot(F.col(CASE_ID), F.col(NOTE), F.col(REPORT), text)
    )


def chat_examples_text(examples: DataFrame) -> DataFrame:
    """One row: introduction, all examples, then the instructions once."""
    block = render.chat_example(F.col(CASE_ID), F.col(NOTE), F.col(REPORT), F.col("had_surgery"))
    body = _ordered_text(examples, block, "body")
    return body.select(
        F.concat(F.lit(templates.CHAT_INTRO), "body", F.lit(templates.CHAT_INSTRUCTIONS)).alias("examples")
    )


def messages(cases: DataFrame, examples: DataFrame, confirmation: str | None = None) -> DataFrame:
    """Cases with a chat context: system, examples, optional confirmation, the case."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    context = [
        message("system", F.lit(templates.CHAT_SYSTEM)),
        message("user", chat_examples_text(examples).scalar()),
    ]
    if confirmation is not None:
        context.append(message("assistant", F.lit(confirmation)))
    case = message("user", render.chat_case(F.col(CASE_ID), F.col(NOTE), F.col(REPORT)))
    return cases.withColumn("messages", F.array(*context, case))


def message_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", **trim) -> DataFrame:
    """A conversation's trimmed turns in order as an array of (role, content)."""
    ordered = F.array_sort(
        F.collect_list(F.struct(F.col(turn).alias("at"), F.col("role"), F.col("text").alias("content")))
    )
    return trim_conversation(turns, conv=conv, turn=turn, **trim).groupBy(conv).agg(
        F.transform(
            ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
        ).alias("messages")
    )


def trim_conversation(
    turns: DataFrame,
    max_len: int = 50,
    head: int = 3,
    tail: int = 20,
    conv: str = "conv_id",
    turn: str = "turn",
) -> DataFrame:
    """Conversations over ``max_len`` turns keep their first ``head`` and last ``tail``.

    Both ends are ranked only up to max_len+1 rows, which Spark applies before the
    shuffle; that many rows show that a conversation is long. A conversation with any
    number of turns thus sends at most that many per task.
    """

    def end(order: Column) -> DataFrame:
        ranked = turns.withColumn("_rn", F.row_number().over(Window.partitionBy(conv).orderBy(order)))
        seen = ranked.filter(F.col("_rn") <= max_len + 1)
        return seen.withColumn("_seen", F.count("*").over(Window.partitionBy(conv)))

    long = F.col("_seen") > max_len
    first = end(F.col(turn).asc()).filter(~long | (F.col("_rn") <= head))
    last = end(F.col(turn).desc()).filter(long & (F.col("_rn") <= tail))
    return first.unionByName(last).drop("_rn", "_seen")
