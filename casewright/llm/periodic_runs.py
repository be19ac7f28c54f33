"""Periodic runs in the words of a text, by longest common extensions over a difference cover.

Every position of a batch of texts has a residue modulo the size of a perfect difference set.
Only suffixes at residues of the set are sorted. For any two positions some step below the set's
size takes both to such residues, so a common extension is found by comparing that few words and
then asking a sparse table for the least common prefix between two places of the sorted order.

A run of period q is longer by ``shortest(q) - q`` words or more than its period, so some multiple of that
stride lies in it with the position q further on (a harmonic grid over all periods). Each such pair of equal words
is extended both ways. Only texts in which a pair reaches far enough are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import text as T

LEAST = 24  # words of the shortest run
REPEATS = 3  # and its least number of periods
COVER = np.array([1, 5, 11, 24, 25, 27])  # fixed values: a perfect difference set modulo 31
SIZE = 31
PAIRS = 1 << 20  # grid pairs looked at together


def _steps() -> np.ndarray:
    """For residues a, b: the least step that takes both into the cover."""
    inside = np.zeros(SIZE, bool)
    inside[COVER] = True
    at = np.arange(SIZE)
    both = inside[(at[:, None, None] + at) % SIZE] & inside[(at[None, :, None] + at) % SIZE]
    assert both.any(axis=2).all()
    return both.argmax(axis=2)


STEPS = _steps()


def equal_words(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from i and from j are equal, up to ``most`` for each pair."""
    found = np.zeros(len(i), np.int64)
    left = np.flatnonzero(most > 0)
    while len(left):
        at = found[left]
        left = left[words[i[left] + at] == words[j[left] + at]]
        found[left] += 1
        left = left[found[left] < most[left]]
    return found


class Extensions:
    """Longest common extensions to the right in an array whose texts end in words of their own.

    The array has to go on for ``SIZE`` words after the last position that is asked for.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words) - SIZE  # a block from each sampled position fits
        at = np.arange(max(n, 0))
        inside = np.zeros(SIZE, bool)
        inside[COVER] = True
        self.at = at[inside[at % SIZE]]
        self.rank = np.full(len(words) + 1, -1, np.int32)
        self._sort()

    def _blocks(self) -> list[np.ndarray]:
        """Keys of the block of SIZE words at each sampled position, most important first."""
        bits = max(1, int(self.words.max(initial=0)).bit_length())
        per = max(1, 63 // bits)
        keys = []
        for lo in range(0, SIZE, per):
            key = np.zeros(len(self.at), np.int64)
            for k in range(lo, min(lo + per, SIZE)):
                key = (key << bits) | self.words[self.at + k]
            keys.append(key)
        return keys

    def _sort(self) -> None:
        """Order of the sampled suffixes by doubling, then the common prefix of each with the one before."""
        m = len(self.at)
        keys = self._blocks()
        order = np.lexsort(keys[::-1]) if m else np.zeros(0, np.int64)
        fresh = np.ones(m, bool)
        for key in keys:
            ranked = key[order]
            if key is keys[0]:
                fresh[1:] = ranked[1:] != ranked[:-1]
            else:
                fresh[1:] |= ranked[1:] != ranked[:-1]
        levels, step = [], SIZE
        slots = np.arange(m)
        while True:
            first = np.maximum.accumulate(np.where(fresh, slots, 0)) if m else slots
            rank = self.rank.copy()
            rank[self.at[order]] = first
            levels.append((step, rank))
            alone = fresh & np.append(fresh[1:], True)[:m]
            open_ = np.flatnonzero(~alone)
            if not len(open_):
                break
            beyond = np.minimum(self.at[order[open_]] + step, len(self.rank) - 1)
            then = rank[beyond]
            inner = np.lexsort((then, first[open_]))
            order[open_] = order[open_][inner]
            then = then[inner]
            fresh[open_[1:]] |= then[1:] != then[:-1]
            step *= 2
        self.rank = levels[-1][1]
        a, b = self.at[order[:-1]].copy(), self.at[order[1:]].copy()
        shared = np.zeros(max(m - 1, 0), np.int64)
        for step, rank in reversed(levels):
            same = (rank[a] == rank[b]) & (rank[a] >= 0)
            shared[same] += step
            a[same] = np.minimum(a[same] + step, len(self.rank) - 1)
            b[same] = np.minimum(b[same] + step, len(self.rank) - 1)
        room = np.minimum(len(self.words) - np.maximum(a, b), SIZE)
        shared += equal_words(self.words, a, b, np.maximum(room, 0))
        self.table = [shared]
        width = 1
        while 2 * width <= len(shared):
            below = self.table[-1]
            self.table.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def reach(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j are equal, for i != j."""
        most = STEPS[i % SIZE, j % SIZE]
        found = equal_words(self.words, i, j, most)
        on = np.flatnonzero(found == most)
        a, b = self.rank[i[on] + most[on]], self.rank[j[on] + most[on]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        least = np.empty(len(on), np.int64)
        for k in np.unique(level):
            some = level == k
            row = self.table[k]
            least[some] = np.minimum(row[lo[some]], row[hi[some] - (1 << int(k))])
        found[on] += least
        return found


def _shortest(q: np.ndarray, least: int, repeats: int) -> np.ndarray:
    return np.maximum(least, repeats * q)


def _grid(n: int, longest: int, least: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period): multiples of each period's stride, some pairs at a time."""
    periods = np.arange(1, longest // repeats + 1)
    strides = _shortest(periods, least, repeats) - periods
    counts = np.maximum(0, -(-(n - periods) // strides))
    total = np.cumsum(counts)
    lo = 0
    while lo < len(periods):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        of = np.repeat(np.arange(lo, hi), counts[lo:hi])
        k = np.arange(len(of)) - np.repeat(total[lo:hi] - counts[lo:hi] - before, counts[lo:hi])
        yield k * strides[of], periods[of]
        lo = hi


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs in texts laid end to end, by start, then period.

    ``words`` are numbers from 0; ``ends`` is where each text ends. Equal words have equal numbers.
    """
    none = np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=0)
    longest = int(sizes.max(initial=0))
    if longest < least:
        return none, none, none
    # one stop after each text, different for each; room for blocks on both sides
    stops = int(words.max(initial=0)) + 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) + doc
    n = len(words) + len(sizes)
    padded = np.empty(n + SIZE + 1, np.int64)
    padded[n:] = stops + len(sizes) + np.arange(SIZE + 1)
    padded[place] = words
    padded[ends + np.arange(len(sizes))] = stops + np.arange(len(sizes))
    pairs = []
    for i, q in _grid(n, longest, least, repeats):
        same = padded[i] == padded[i + q]
        i, q = i[same], q[same]
        # a first look: without a stretch of the stride's length the pair is in no run
        stride = _shortest(q, least, repeats) - q
        cap = np.minimum(stride, SIZE)
        ahead = equal_words(padded, i, i + q, np.minimum(cap, n - i - q))
        behind = _behind(padded, i, q, np.minimum(cap - 1, i))
        far = ahead + behind >= cap
        pairs.append((i[far], q[far]))
    i = np.concatenate([none, *[p[0] for p in pairs]])
    q = np.concatenate([none, *[p[1] for p in pairs]])
    if not len(i):
        return none, none, none
    # sort only the texts with such pairs
    starts = np.concatenate([[0], ends[:-1] + np.arange(1, len(sizes))])
    lengths = sizes + 1
    owner = np.searchsorted(starts, i, side="right") - 1
    inside = i + q < starts[owner] + sizes[owner]  # texts may share passages
    i, q, owner = i[inside], q[inside], owner[inside]
    if not len(i):
        return none, none, none
    used = np.unique(owner)
    at = np.concatenate([[0], np.cumsum(lengths[used])])
    here = np.arange(at[-1]) - np.repeat(at[:-1], lengths[used]) + np.repeat(starts[used], lengths[used])
    text = np.append(padded[here], padded[n:])
    _, text = np.unique(text, return_inverse=True)  # small numbers again
    total = at[-1]
    ours = at[np.searchsorted(used, owner)] + i - starts[owner]
    forward = Extensions(text).reach(ours, ours + q)
    # to the left: the reversed array; the stop of the text before follows each reversed text
    turned = np.concatenate([text[: total - 1][::-1], text[total - 1 :]])
    backward = Extensions(turned).reach(total - 1 - ours, total - 1 - ours - q)
    first, last = ours - backward, ours + q + forward
    long = last - first >= _shortest(q, least, repeats)
    first, last, q, owner = first[long], last[long], q[long], owner[long]
    order = np.lexsort((q, last, first))
    first, last, q, owner = first[order], last[order], q[order], owner[order]
    fresh = np.ones(len(first), bool)  # of one stretch the smallest period
    fresh[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    first, last, q, owner = first[fresh], last[fresh], q[fresh], owner[fresh]
    shift = ends[owner] - sizes[owner] - at[np.searchsorted(used, owner)]
    order = np.lexsort((q, first))
    return (first + shift)[order], (last + shift)[order], q[order]


def _behind(words: np.ndarray, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words before i and before i + q are equal, up to ``most``."""
    found = np.zeros(len(i), np.int64)
    left = np.flatnonzero(most > 0)
    while len(left):
        at = i[left] - 1 - found[left]
        left = left[words[at] == words[at + q[left]]]
        found[left] += 1
        left = left[found[left] < most[left]]
    return found


def numbered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal where the bytes are, and where each text's end among them."""
    starts, ends = T.words(data, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    packed = np.ascontiguousarray(data[~T.SPACE[data]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    counts = np.bincount(T.owner(starts, offsets), minlength=len(offsets) - 1)
    return numbers, np.cumsum(counts)


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    repeats: int = REPEATS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row: ``row`` (struct of the key and carried columns), ``n_words``, ``runs`` and ``collapsed_text``.

    A run (start, length, period) is a stretch of words with that smallest period, of at least ``least`` words and
    ``repeats`` periods, that can't be extended either way; all runs are listed by start, then
    period. The collapsed text has the words, joined by one space, that no run contains after its first
    period. Each row is looked at by itself, so nothing is shuffled and repeated rows get equal
    results. Null and empty texts have no words, no runs and an empty collapsed text. A very
    long text is one task's; its memory grows with its words, its time with words times log of words. The key may
    be null or repeated. Columns not carried are ignored, whatever they are named.
    """
    names = list(dict.fromkeys([key, *carry]))
    picked = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(text).alias("_text"))
    spans = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_text").cast(pa.large_binary())
            for lo, hi, data, offsets in T.pieces(column):
                words, ends = numbered_words(data, offsets)
                first, last, period = find_runs(words, ends, least, repeats)
                begins = ends - np.diff(ends, prepend=0)
                doc = np.searchsorted(ends, first, side="right")
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, first + period, 1)
                np.add.at(steps, last, -1)
                gone = np.cumsum(steps)[:-1] > 0
                kept = []
                touched = set(doc.tolist())
                for i in range(lo, hi):
                    some = (column[i].as_py() or b"").split()
                    if i - lo in touched:
                        some = compress(some, ~gone[begins[i - lo] : ends[i - lo]])
                    kept.append(b" ".join(some))
                values = pa.StructArray.from_arrays(
                    [pa.array(first - begins[doc]), pa.array(last - first), pa.array(period)], fields=list(spans)
                )
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)), values)
                counts = pa.array((ends - begins).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), counts, found, pa.array(kept, pa.binary())],
                    ["row", "n_words", "runs", "collapsed_text"],
                )

    row_type = picked.schema["row"].dataType.simpleString()
    shape = f"row {row_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text binary"
    return picked.mapInArrow(run, shape).withColumn("collapsed_text", F.col("collapsed_text").cast("string"))
