"""Removal of passages that occur earlier in the corpus.

Documents are dealt into chunks by ranges of the key, a key of many rows by its texts' hashes. Each chunk hashes every window of n words
(Rabin-Karp) and sends its distinct hashes, sorted and dealt by their leading bits, to one
group per hash range; a hash that many documents share is sent once by each chunk. A group
keeps, for each hash, the earliest chunk and answers every other chunk with one bit. The
chunk then marks the words of windows that occur earlier, and merges them into maximal
intervals.

Two windows count as equal if their 64-bit hashes are equal.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import text as T
from casewright.llm.chunks import chunk_of, chunk_ranges, order_hash, order_key

CHUNK_BYTES = 8 << 20
GROUP_BYTES = 24 << 20


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, one plane per byte, so that high zeros compress."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(blob) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _in_order(table: pa.Table) -> pa.Table:
    """Rows by key (nulls last), then hash of the text, then text: the order that decides what is earlier."""
    return table.take(pc.sort_indices(table, [("_key", "ascending"), ("_hash", "ascending"), ("_text", "ascending")]))


def _windows(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes in order, the place of each window's first word, and word counts of texts."""
    hashes, places, counts, seen = [], [], [], 0
    for lo, hi, data, offsets in T.pieces(table["_text"]):
        starts, ends = T.words(data, offsets)
        doc = T.owner(starts, offsets)
        rolled = T.window_hash(T.word_hash(data, starts, ends), n)
        whole = np.flatnonzero(doc[: len(rolled)] == doc[n - 1 :][: len(rolled)])
        hashes.append(rolled[whole])
        places.append(whole + seen)
        counts.append(np.bincount(doc, minlength=hi - lo))
        seen += len(starts)
    none = np.zeros(0, np.int64)
    return (
        np.concatenate([np.zeros(0, np.uint64), *hashes]),
        np.concatenate([none, *places]),
        np.concatenate([none, *counts]),
    )


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes; for each window its place among them and whether it is the first."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    rank, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
    rank[order], first[order] = np.cumsum(fresh) - 1, fresh
    return ranked[fresh], rank, first


def _edges(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of leading bits starts among sorted hashes, and the end."""
    if bits == 0:
        return np.array([0, len(distinct)])
    tops = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(distinct, tops), len(distinct))


def substring_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = 20,
    carry: Sequence[str] = (),
    chunk_bytes: int = CHUNK_BYTES,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Per row: ``row`` (struct of the key and the carried columns), ``n_words``, ``n_removed``,
    ``removed`` (maximal intervals of word places, from first to before last) and ``kept_text``.

    A word goes if a window of ``n`` words covering it also starts earlier: in a row of
    smaller key, or earlier in the same row. Null or empty texts have no words and an empty
    kept text; a null key counts as the largest. Rows of equal keys rank by a hash of their text (Spark's xxhash64), and of
    identical rows one keeps its words. Bytes that are not UTF-8 are kept as they are. A very long text
    is hashed and cut whole, in the task of its chunk. Columns not carried are ignored, whatever they are named.
    """
    names = list(dict.fromkeys([key, *carry]))
    ranges = chunk_ranges(docs, key, text, chunk_bytes)
    bits = max(0, (ranges.n * chunk_bytes // group_bytes).bit_length())
    keyed = docs.select(
        F.struct(*[F.col(c) for c in names]).alias("row"),
        order_key(key).alias("_key"),
        order_hash(text).alias("_hash"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        chunk_of(key, text, ranges).alias("_chunk"),
    )

    def send(table: pa.Table) -> pa.Table:
        distinct, _, _ = _distinct(_windows(_in_order(table), n)[0])
        edges = _edges(distinct, bits)
        full = np.flatnonzero(edges[1:] > edges[:-1])
        chunk = table["_chunk"][0].as_py()
        return pa.table(
            {
                "_range": pa.array(full.astype(np.int32)),
                "_chunk": pa.array(np.full(len(full), chunk, np.int32)),
                "_hashes": pa.array([_pack(distinct[edges[i] : edges[i + 1]]) for i in full], pa.binary()),
            }
        )

    def decide(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("_chunk", "ascending")]))
        sent = [_unpack(b.as_buffer()) for b in table["_hashes"]]
        sizes = np.array([len(s) for s in sent])
        joined = np.concatenate(sent)
        order = np.argsort(joined, kind="stable")
        ranked = joined[order]
        later = np.zeros(len(joined), bool)
        later[order[1:]] = ranked[1:] == ranked[:-1]
        bits_ = [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(sizes)[:-1])]
        return pa.table({"_range": table["_range"], "_chunk": table["_chunk"], "_later": pa.array(bits_, pa.binary())})

    row_type = keyed.schema["row"].dataType.simpleString()
    out = (
        f"row {row_type}, n_words bigint, n_removed bigint, "
        "removed array<struct<first:int,last:int>>, kept_text binary"
    )

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _in_order(table)
        hashes, places, counts = _windows(table, n)
        distinct, rank, first = _distinct(hashes)
        edges = _edges(distinct, bits)
        later = np.zeros(len(distinct), bool)
        for at, blob in zip(answers["_range"].to_pylist(), answers["_later"]):
            lo, hi = edges[at], edges[at + 1]
            later[lo:hi] = np.unpackbits(np.frombuffer(blob.as_buffer(), np.uint8), count=hi - lo)
        repeated = places[later[rank] | ~first] if len(rank) else places
        steps = np.zeros(int(counts.sum()) + n + 1, np.int32)
        np.add.at(steps, repeated, 1)
        np.add.at(steps, repeated + n, -1)
        gone = np.cumsum(steps)[: int(counts.sum())] > 0
        ends = np.cumsum(counts)
        kept, removed, lost = [], [], np.zeros(len(counts), np.int64)
        texts = table["_text"].cast(pa.large_binary())
        for i, (text_, hi, size) in enumerate(zip(texts, ends, counts)):
            words = text_.as_py().split()
            mask = gone[hi - size : hi]
            if mask.any():
                step = np.diff(mask.astype(np.int8), prepend=0, append=0)
                lost[i] = mask.sum()
                words = compress(words, ~mask)
                removed.append(
                    [{"first": int(a), "last": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
                )
            else:
                removed.append([])
            kept.append(b" ".join(words))
        spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.table(
            {
                "row": table["row"],
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(lost),
                "removed": pa.array(removed, spans),
                "kept_text": pa.array(kept, pa.binary()),
            }
        )

    hashes = keyed.groupBy("_chunk").applyInArrow(send, "_range int, _chunk int, _hashes binary")
    answers = hashes.groupBy("_range").applyInArrow(decide, "_range int, _chunk int, _later binary")
    found = keyed.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(remove, out)
    return found.withColumn("kept_text", F.col("kept_text").cast("string"))
