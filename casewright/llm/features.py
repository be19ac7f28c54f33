"""Hashed n-gram indicators of whole texts, and the vocabulary of a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import text as T
from casewright.session import materialize

ID_BITS = 31
SAMPLE = 20_000  # bound on the rows that a model is fitted on
MOST_IDS = 12_000_000  # and on the feature ids of these rows, whatever their length

#: (row of the text, feature id), repeats included
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = ord("A"), ord("a"), ord("a"), ord("0")
_COLLAPSED = np.zeros(256, bool)
_COLLAPSED[[ord("A"), ord("a"), ord("0")]] = True


def _id(hashes: np.ndarray, kind: int) -> np.ndarray:
    return T.mix(hashes ^ np.uint64(kind * 0x9E3779B9)) >> np.uint64(64 - ID_BITS)


def _grams(hashes: np.ndarray, doc: np.ndarray, n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    rolled = T.window_hash(hashes, n)
    whole = doc[: len(rolled)] == doc[n - 1 :][: len(rolled)]
    return doc[: len(rolled)][whole], _id(rolled[whole], kind)


def style_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word 1- and 2-grams, shape 1- to 3-grams, and repeats of the word before.

    A shape writes letters as a or A and digits as 0, runs of these once, other characters as
    they are.
    """
    starts, ends = T.words(data, offsets)
    doc = T.owner(starts, offsets)
    hashes = T.word_hash(_LOWER[data], starts, ends)
    found = [(doc, _id(hashes, 1)), _grams(hashes, doc, 2, 2)]
    shape = _CLASS[data]
    kept = np.ones(len(data), bool)
    kept[1:] = (shape[1:] != shape[:-1]) | ~_COLLAPSED[shape[1:]]
    kept[starts] = True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=at[1:])
    shapes = T.word_hash(shape[kept], at[starts], at[ends])
    found += [(doc, _id(shapes, 3)), _grams(shapes, doc, 2, 4), _grams(shapes, doc, 3, 5)]
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])) if len(doc) else doc
    found.append((doc[again], _id(np.zeros(len(again), np.uint64), 6)))
    return np.concatenate([d for d, _ in found]), np.concatenate([i for _, i in found])


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return T.runs(_LETTER[data], offsets)


def stem_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, lower-cased in A-Z, and their first 4, 5 and 6 bytes."""
    starts, ends = letter_runs(data, offsets)
    doc = T.owner(starts, offsets)
    sums, at = T.prefix_hash(_LOWER[data], starts, ends)
    lengths = ends - starts
    found = [(doc, _id(T.mix((sums[at[1:]] - sums[at[:-1]]) ^ lengths.astype(np.uint64)), 1))]
    for k in (4, 5, 6):
        long = lengths > k
        first = at[:-1][long]
        found.append((doc[long], _id(T.mix(sums[first + k] - sums[first]), k)))
    return np.concatenate([d for d, _ in found]), np.concatenate([i for _, i in found])


def word_ids(words: Sequence[str]) -> np.ndarray:
    """The ids that ``stem_features`` gives to whole words."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends = T.words(data, np.array([0, len(data)]))
    return _id(T.word_hash(_LOWER[data], starts, ends), 1)


def distinct_ids(doc: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids of each of n texts, end to end, and the offset of each text's."""
    keys = np.unique((doc.astype(np.uint64) << np.uint64(ID_BITS)) | ids)
    owners = (keys >> np.uint64(ID_BITS)).astype(np.int64)
    return (keys & np.uint64((1 << ID_BITS) - 1)).astype(np.int64), np.searchsorted(owners, np.arange(n + 1))


class Vocabulary:
    """Looks up the places of feature ids among the sorted ids a model knows."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.asarray(ids, np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.ids >> (ID_BITS - 20)] = True

    def find(self, doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place) pairs of the known ids, sorted."""
        hit = np.flatnonzero(self.maybe[ids >> np.uint64(ID_BITS - 20)])
        doc, ids = doc[hit], ids[hit].astype(np.int64)
        place = np.searchsorted(self.ids, ids)
        known = place < len(self.ids)
        known[known] = self.ids[place[known]] == ids[known]
        width = max(1, len(self.ids))
        keys = np.unique(doc[known] * width + place[known])
        return keys // width, keys % width


def with_features(rows: DataFrame, text: str, features: Features) -> DataFrame:
    """The columns of ``rows`` but the text, and ``ids``: the sorted distinct features of each row."""
    kept = [f for f in rows.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column(text)):
                ids, ends = distinct_ids(*features(data, offsets), hi - lo)
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                others = [batch.column(c).slice(lo, hi - lo) for c in names]
                yield pa.RecordBatch.from_arrays([*others, listed], [*names, "ids"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(T.released(run), f"{shape}, ids array<int>")


def fold(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key is in fold 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(of)).cast("int")


def true_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``key``, ``y``: one label per key, 1 if at least half of its non-null labels are 1."""
    return (
        labels.select(key, label)
        .dropna()
        .groupBy(key)
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    )


def hash_share(key: str, share: float) -> Column:
    """Whether the key is in the given share of all keys, by 63 bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 1) < F.lit(min(int(share * 2.0**63), (1 << 63) - 1))


def bounded_ids(found: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """The rows of a sample, or about such a share of them that their ``ids`` are ``most`` at most.

    The rows are written once: they are counted first, and read by the one task that fits on them.
    """
    found = materialize(found)
    n = found.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    return found if n <= most else found.filter(hash_share("_key", most / n))


def labelled_sample(labelled: DataFrame, n: int, bound: int = SAMPLE) -> DataFrame:
    """All of ``n`` rows, or about ``bound`` of them by a hash of ``_key``."""
    return labelled if n <= bound else labelled.filter(hash_share("_key", bound / n))


def lists(table: pa.Table, column: str = "ids") -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and offsets."""
    found = [c for c in table[column].chunks if len(c)]
    if not found:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in found])
    return np.concatenate([c.flatten().to_numpy() for c in found]), np.concatenate([[0], np.cumsum(sizes)])
