"""Asking a responder about every prompt, or attaching stored answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Responder = Callable[[str], "str | None"]


def score(
    prompts: DataFrame,
    responder: Responder,
    *,
    provider: str,
    model_name: str,
    key: str = "llm_caseID",
    prompt: str = "prompt",
    concurrency: int | None = None,
) -> DataFrame:
    """(key, api_response, error, provider, model_name) for every prompt.

    The responder is any serialisable callable from prompt text to answer text. A
    failing call fills ``error`` and does not fail the task. ``concurrency`` sets the
    number of partitions, i.e. of simultaneous callers at most. Keys pass through untouched.
    """
    work = prompts.select(key, prompt)
    if concurrency is not None:
        work = work.repartition(concurrency, key)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for text in batch.column(prompt):
                try:
                    answers.append(responder(text.as_py()))
                    errors.append(None)
                except Exception as failure:
                    answers.append(None)
                    errors.append(f"Error: {failure}")
            texts = [pa.array(answers, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(key), *texts], [key, "api_response", "error"])

    schema = T.StructType([work.schema[key]])
    schema = schema.add("api_response", T.StringType()).add("error", T.StringType())
    return work.mapInArrow(ask, schema).withColumns(
        {"provider": F.lit(provider), "model_name": F.lit(model_name)}
    )


def attach_responses(
    prompts: DataFrame, responses: DataFrame, key: str = "llm_caseID", column: str = "api_response"
) -> DataFrame:
    """Prompts with already stored answers; null where there is none."""
    return prompts.join(responses.select(key, column), key, "left")
