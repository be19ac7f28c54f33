"""Rows dealt into chunks of about equal bytes: consecutive ranges of an integer key, then of a hash of the text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 200_000
LAST = (1 << 63) - 1
ROW_BYTES = 64  # what a row weighs beside its text, so that many empty ones are spread too


def order_key(key: str) -> Column:
    """The key that chunks are ranges of; a null counts as the largest."""
    return F.coalesce(F.col(key).cast("bigint"), F.lit(LAST))


def order_hash(text: str) -> Column:
    """What ranks rows of equal keys, over all chunks."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Ranges:
    """Ranges of keys in order, each cut into ``parts`` equal shares of its span.

    A range's span is that of its keys, and a row's place in it is its key plus the hash as a
    fraction. A range of one key is therefore cut by hashes alone.
    """

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, rows: np.ndarray, every: int, target: int):
        """Distinct sampled keys in order, bytes and rows of each in a sample of one row in ``every``."""
        target = max(1, target)
        first, span, parts, held = [], [], [], target  # bytes in the open range; full at first
        for i, (k, n, m) in enumerate(zip(keys.tolist(), (sizes * every).tolist(), rows.tolist())):
            if n > target and (m > 1 or every == 1):  # a key of many rows: a range of its own
                first.append(k), span.append(1), parts.append(-(-n // target))
                if k < LAST:
                    first.append(k + 1), span.append(1), parts.append(1)
                held = 0
            else:
                if held >= target:
                    if not first or first[-1] < k:
                        first.append(k), span.append(1), parts.append(1)
                    held = 0
                held += n
                parts[-1] = max(1, held // target)  # more than one only where sampled rows stand for more than a chunk
            span[-1] = max(span[-1], (int(keys[i + 1]) if i + 1 < len(keys) else k + 1) - first[-1])
        self.first = np.array(first or [0], np.int64)
        self.span = np.array(span or [1], float)
        self.parts = np.array(parts or [1], np.int64)
        self.start = np.cumsum(self.parts) - self.parts

    @property
    def n(self) -> int:
        return int(self.parts.sum())

    def place(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.maximum(np.searchsorted(self.first, keys, side="right") - 1, 0)
        beyond = (keys.view(np.uint64) - self.first[at].view(np.uint64)).astype(float)
        ranked = (hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(11)  # 53 leading bits, in the order of signed hashes
        share = np.where(keys < self.first[at], 0.0, beyond + ranked * 2.0**-53) / self.span[at]
        part = np.minimum((np.minimum(share, 1.0) * self.parts[at]).astype(np.int64), self.parts[at] - 1)
        return self.start[at] + part


def chunk_ranges(docs: DataFrame, key: str, text: str, target: int, sample: int = SAMPLE) -> Ranges:
    """The chunks of a table, of ``target`` bytes each or a little more.

    Keys and bytes of at most about ``sample`` rows, added up by key, reach the driver; between
    sampled keys chunks are equal shares, so their number grows with the table. The sample
    affects how even chunks are, never a result. Only rows of one key and one text can't be told apart.
    """
    keys = order_key(key)
    total, low, high = docs.agg(F.count("*"), F.min(keys), F.max(F.col(key).cast("bigint"))).first()
    every = max(1, -(-total // sample))
    size = F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES
    rows = docs.select(keys.alias("k"), order_hash(text).alias("h"), size.cast("bigint").alias("n"))
    if every > 1:
        rows = rows.filter(F.pmod(F.xxhash64("k", "h"), F.lit(every)) == 0)
    found = rows.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("m")).toPandas().sort_values("k")
    sampled, sizes, counts = (found[c].to_numpy(np.int64) for c in ("k", "n", "m"))
    for end in {low, high} - {None, *sampled.tolist()}:  # rows before the first and after the last sampled key are cut as others
        at = int(np.searchsorted(sampled, end))
        sampled, sizes, counts = np.insert(sampled, at, end), np.insert(sizes, at, int(sizes.mean()) if len(sizes) else target), np.insert(counts, at, 1)
    return Ranges(sampled, sizes, counts, every, target)


def chunk_of(key: str, text: str, ranges: Ranges) -> Column:
    """The number of a row's chunk, in the order of key and hash; null keys are in the last."""

    @F.pandas_udf("int")
    def place(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges.place(keys.to_numpy(np.int64), hashes.to_numpy(np.int64)).astype(np.int32))

    if ranges.n == 1:
        return F.lit(0)
    return place(order_key(key), order_hash(text))
