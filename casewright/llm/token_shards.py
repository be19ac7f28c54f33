"""Token ids in training order: packed sequences, a keyed permutation, fixed-stride shards."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm import text as T
from casewright.llm.chunks import chunk_of, chunk_ranges, order_hash

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of the rank file's vocabulary: the pattern that splits text before merging, and the end mark's id.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256

LENGTH = 1024  # ids in a sequence
SHARD = 1024  # sequences in a shard
ROUNDS = 4
CHUNK_BYTES = 8 << 20


@functools.lru_cache(2)
def coder(path: str):
    """A public byte-pair vocabulary, from its rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def feistel(index: np.ndarray, n: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: a balanced Feistel network over the next even number of
    bits; values that leave the range walk on until they are back in it."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    keys = T.mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed & (1 << 64) - 1))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            left, right = right, left ^ (T.mix(right ^ key) & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index).astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def pack_sequences(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    path: str = RANKS,
    end: int = END,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``chunk``, ``seq``, ``n_tokens``, ``doc_ids``, ``tokens`` (little-endian unsigned 16-bit ids).

    The documents of a chunk (a range of keys, in key order, nulls last, ties by a hash of the text) follow
    each other, each closed by the end mark, and are cut every ``length`` ids. The last
    sequence of a chunk is filled up with end marks; ``n_tokens`` counts without them. Null and
    empty texts give the end mark alone.
    """
    ranges = chunk_ranges(docs, key, text, chunk_bytes)
    rows = docs.select(
        F.col(key).cast("bigint").alias("_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        order_hash(text).alias("_hash"),
        chunk_of(key, text, ranges).alias("chunk"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mark = coder(path), np.array([end], "<u2").tobytes()
        for batch in batches:
            raw = [known.encode_to_numpy(t.as_py(), disallowed_special=()).astype("<u2").tobytes() + mark for t in batch.column("_text")]
            others = [batch.column(c) for c in ("_key", "_hash", "chunk")]
            yield pa.RecordBatch.from_arrays([*others, pa.array(raw, pa.binary())], ["_key", "_hash", "chunk", "tokens"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_key", "ascending"), ("_hash", "ascending")])
        stream = np.frombuffer(b"".join(table["tokens"].to_pylist()), "<u2")
        ends = np.cumsum([len(t.as_buffer()) // 2 for t in table["tokens"]])
        n = -(-len(stream) // length)
        filled = np.full(n * length, end, "<u2")
        filled[: len(stream)] = stream
        keys = table["_key"].to_pylist()
        first = np.searchsorted(ends, np.arange(n) * length, side="right")
        last = np.searchsorted(ends, np.minimum(np.arange(1, n + 1) * length, len(stream)) - 1, side="right")
        return pa.table(
            {
                "chunk": pa.array(np.full(n, table["chunk"][0].as_py(), np.int32)),
                "seq": pa.array(np.arange(n, dtype=np.int64)),
                "n_tokens": pa.array(np.minimum(length, len(stream) - np.arange(n) * length).astype(np.int32)),
                "doc_ids": pa.array([keys[a : b + 1] for a, b in zip(first, last)], pa.list_(pa.int64())),
                "tokens": pa.array([row.tobytes() for row in filled.reshape(n, length)], pa.binary()),
            }
        )

    coded = rows.mapInArrow(encode, "_key bigint, _hash bigint, chunk int, tokens binary")
    return coded.groupBy("chunk").applyInArrow(
        pack, "chunk int, seq bigint, n_tokens int, doc_ids array<bigint>, tokens binary"
    )


def training_shards(sequences: DataFrame, seed: int = 1, per_shard: int = SHARD) -> DataFrame:
    """``shard``, ``first_slot``, ``n_sequences``, ``stride`` (bytes), ``sequences`` (slot, n_tokens,
    doc_ids in slot order) and ``payload``: the sequences of the shard's slots end to end.

    A sequence's number is its place in (chunk, seq) order: the count of the chunks before,
    plus its own. The permutation of all numbers gives its slot; shard s holds the slots from
    s * per_shard on. No sequences give no shards. Nothing runs before the result is asked for:
    chunks are counted from the shuffle that packs them, and each task gets a run of shards,
    sorted by slot, of which it holds one shard at a time.
    """
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sequences.groupBy("chunk").agg(F.count("*").alias("n"))  # one row per chunk
    starts = sizes.select(
        "chunk",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    # three numbers per chunk of ``CHUNK_BYTES``
    numbered = sequences.join(F.broadcast(starts), "chunk").withColumn("index", F.col("start") + F.col("seq"))

    @F.pandas_udf("bigint")
    def slot(index: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), int(total.iloc[0]), seed) if len(index) else [], dtype="int64")

    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = F.ceil(F.col("total") / per_shard)
    run = F.expr(f"int(slot div {per_shard} * {tasks} div shards)")  # consecutive shards, about equally many in each task
    placed = (
        numbered.select(slot("index", "total").alias("slot"), shards.alias("shards"), "n_tokens", "doc_ids", "tokens")
        .repartitionById(tasks, run)
        .select("slot", "n_tokens", "doc_ids", "tokens")
        .sortWithinPartitions("slot")
    )
    schema = pa.list_(pa.struct([("slot", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64()))]))

    def shard_row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        first = table["slot"][0].as_py()
        rows = table.select(["slot", "n_tokens", "doc_ids"]).to_pylist()
        tokens = table["tokens"].to_pylist()
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([first // per_shard], pa.int64()),
                "first_slot": pa.array([first], pa.int64()),
                "n_sequences": pa.array([len(rows)], pa.int32()),
                "stride": pa.array([len(tokens[0])], pa.int32()),
                "sequences": pa.array([rows], schema),
                "payload": pa.array([b"".join(tokens)], pa.binary()),
            }
        )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("slot").to_numpy() // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and numbers[lo] != current:
                    yield shard_row(held)
                    held = []
                current = numbers[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield shard_row(held)

    return placed.mapInArrow(
        assemble,
        "shard bigint, first_slot bigint, n_sequences int, stride int, "
        "sequences array<struct<slot:bigint,n_tokens:int,doc_ids:array<bigint>>>, payload binary",
    )


def write_shards(shards: DataFrame, path: str) -> None:
    """Append the shards that ``path`` does not have yet, so a stopped write goes on where it stopped.

    A task's file, a run of shards, is in place once that task is committed (the second commit
    algorithm), not at the end of the job. What a stopped job leaves are whole files, and a
    task that runs twice writes the same file again.
    """
    spark = shards.sparkSession
    try:
        done = spark.read.parquet(path).select("shard")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    left = shards if done is None else shards.join(done, "shard", "left_anti").sortWithinPartitions("shard")
    writer = left.write.mode("append").option("compression", "zstd")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def read_slots(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """``slot``, ``n_tokens``, ``doc_ids``, ``tokens`` of slots start .. start + n - 1, in slot order:
    only the shards that hold them are read, and each sequence by its offset."""
    rows = spark.read.parquet(path).filter((F.col("first_slot") < start + n) & (F.col("first_slot") + F.col("n_sequences") > start))
    each = rows.select("payload", "stride", "first_slot", F.explode("sequences").alias("s"))
    at = ((F.col("s.slot") - F.col("first_slot")) * F.col("stride") + 1).cast("int")
    return (
        each.filter((F.col("s.slot") >= start) & (F.col("s.slot") < start + n))
        .select("s.*", F.substring("payload", at, F.col("stride")).alias("tokens"))
        .orderBy("slot")
    )
