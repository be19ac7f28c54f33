"""SentencePiece encoding and decoding over a shared-prefix walk of the distinct marked words."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import text as T
from casewright.llm.features import lists

MARK = "▁"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
PAIRS = 60_000  # pairs of pieces that a worker remembers
CACHED = 100_000  # distinct words whose ids a worker remembers
GROUP = 8 << 20  # bytes of text whose distinct words are walked together


class Pieces:
    """A SentencePiece vocabulary: ids, scores and byte pieces, read from a public model file.

    In a merge model (scores fall by one for each piece) the segmentation of a prefix is the
    segmentation of a shorter prefix plus one piece, and that piece is the only one which
    stays apart from the piece before it when the two are merged alone. In a unigram model it
    is the piece that gives the best sum of scores. Either way one forward state per prefix
    is enough.
    """

    def __init__(self, path: str = PIECES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.texts, self.byte_ids = {}, {}, [], {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            self.texts.append(piece)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
        if any(len(p.lstrip(MARK).replace(MARK, "")) != len(p.lstrip(MARK)) for p in self.ids):
            raise ValueError("a piece goes on after the mark of a new word; words can't be encoded apart")
        self.unknown = model.unk_id()
        whole = [s for s in self.score.values() if s > -1e8]
        self.merges = all(s == int(s) for s in whole)
        self.id_tuples = {p: (i,) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        # a floor under every score for characters without a piece
        self.floor = min(whole, default=0.0) - 10.0
        self.decoded = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(self.texts)
        ]
        sizes = np.array([len(p) for p in self.decoded], np.int64)
        self.piece_bytes = np.frombuffer(b"".join(self.decoded), np.uint8)
        self.piece_ends = np.concatenate([[0], np.cumsum(sizes)])
        self.pairs: dict[tuple[str, str], bool] = {}
        if self.merges:
            self.whole = {p for p in self.ids if len(p) > 1 and self.merged(p) == [p]}
            self.reach: dict[str, int] = {}  # by the last two characters, the longest piece
            for p in self.whole:
                self.reach[p[-2:]] = max(self.reach.get(p[-2:], 0), len(p))

    def merged(self, word: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(word)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _bytes(self, char: str) -> tuple[int, ...]:
        coded = char.encode()
        if all(b in self.byte_ids for b in coded):
            return tuple(self.byte_ids[b] for b in coded)
        return (self.unknown,)

    def _merged_ends(self, word: str, done: int, last: list[str], path: list[tuple]) -> None:
        """Append the forward state of every prefix longer than ``done``: its last piece, its ids."""
        reach, whole, pairs, ids = self.reach, self.whole, self.pairs, self.id_tuples
        piece = last[done]
        for end in range(done + 1, len(word) + 1):
            # only one piece fits, so the likeliest is tried first: the one before, longer by a character
            start = end - 1 - len(piece)
            piece = word[start:end]
            if not (piece in whole and self._fits(last[start], piece)):
                most = reach.get(word[end - 2 : end], 1) if end > 1 else 1
                for start in range(max(0, end - most), end - 1):
                    piece = word[start:end]
                    if piece in whole and (pairs.get((last[start], piece)) or self._fits(last[start], piece)):
                        break
                else:
                    start = end - 1
                    piece = word[start]
                    if piece not in ids:
                        ids[piece] = self._bytes(piece)
            last.append(piece)
            path.append(path[start] + ids[piece])

    def _fits(self, left: str, right: str) -> bool:
        if not left:
            return True
        apart = self.pairs.get((left, right))
        if apart is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            apart = left + right not in self.ids and self.merged(left + right) == [left, right]
            self.pairs[left, right] = apart
        return apart

    def _best_ends(self, word: str, done: int, last: list[float], path: list[tuple]) -> None:
        """The same by the best sum of scores, which is the state."""
        for end in range(done + 1, len(word) + 1):
            best = None
            for start in range(max(0, end - self.longest), end):
                piece = word[start:end]
                s = self.score.get(piece, self.floor if end - start == 1 else None)
                if s is not None and (best is None or last[start] + s > best[0]):
                    best = last[start] + s, start, piece
            s, start, piece = best
            if piece not in self.id_tuples:
                self.id_tuples[piece] = self._bytes(piece)
            last.append(s)
            path.append(path[start] + self.id_tuples[piece])

    def encode_sorted(self, words: Sequence[str]) -> Iterator[tuple[int, ...]]:
        """Ids of sorted words: a depth-first walk of their trie.

        Neighbours share their common prefix; its forward states stay, only the rest of the
        next word is worked out.
        """
        last: list = [""] if self.merges else [0.0]
        path: list[tuple] = [()]
        before = ""
        extend = self._merged_ends if self.merges else self._best_ends
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], path[shared + 1 :]
            extend(word, shared, last, path)
            yield path[-1]
            before = word

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of lists of ids: marks become spaces, the first one goes, byte pieces join to characters.

        Byte pieces that form no character become the replacement character.
        """
        sizes = self.piece_ends[ids + 1] - self.piece_ends[ids]
        data = gather(self.piece_bytes, self.piece_ends[ids], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        full = np.flatnonzero(np.diff(ends) > 0)
        marked = full[data[ends[full]] == 32]
        kept = np.ones(len(data), bool)
        kept[ends[marked]] = False
        gone = np.zeros(len(ends), np.int64)
        gone[marked + 1] = 1
        ends = (ends - np.cumsum(gone)).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[kept].tobytes())]
        )
        try:
            return found.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode("utf-8", "replace") for x in found], pa.string())


@functools.lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


_MARK_BYTES = MARK.encode()


class Words:
    """Ids of the words that a worker has met; the walk runs over the new ones of a batch."""

    def __init__(self, pieces: Pieces, bound: int = CACHED):
        self.pieces, self.bound = pieces, bound
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Walk over the words not met before, all at once."""
        if len(self.place) > self.bound:
            self.clear()
        new = sorted({w for w in words if w not in self.place})
        if not new:
            return
        flat, sizes = [], []
        for ids in self.pieces.encode_sorted([w.decode("utf-8", "replace").replace(" ", MARK) for w in new]):
            flat.extend(ids)
            sizes.append(len(ids))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of the given spans, end to end."""
    at = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))]


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans of bytes, and the place of each span among them."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    _, first, place = np.unique(T.word_hash(data, starts, ends), return_index=True, return_inverse=True)
    view = data.tobytes()
    return [view[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], place


def marked_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with a space set before every text, offsets, and the spans of its marked words.

    A word is a run of spaces and what follows up to the next space; a line feed, which no
    piece contains, stands alone.
    """
    n = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets) > 0)
    data = np.insert(data, offsets[full], 32)
    shift = np.zeros(n + 1, np.int64)
    shift[full + 1] = 1
    offsets = offsets + np.cumsum(shift)
    space, feed = data == 32, data == 10
    first = np.ones(len(data), bool)
    first[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    return data, offsets, starts, np.append(starts[1:], len(data))[: len(starts)]


def encode_batch(words: Words, column: pa.Array, limit: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first and last row, all ids end to end, and the offset of each row's ids.

    The distinct words of about ``limit`` bytes of text go through one walk.
    """
    if words.pieces.merges and "\n" in words.pieces.ids:
        raise ValueError("line feeds are pieces of this model")
    group, held = [], 0
    for lo, hi, data, offsets in T.pieces(column):
        data, offsets, starts, ends = marked_words(data, offsets)
        group.append((lo, hi, *distinct_spans(data, starts, ends), np.searchsorted(starts, offsets)))
        held += len(data)
        if held > limit:
            yield from _encoded(words, group)
            group, held = [], 0
    yield from _encoded(words, group)


def _encoded(words: Words, group: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    words.learn([w for _, _, spans, _, _ in group for w in spans])
    for lo, hi, spans, place, first in group:
        where = words.places(spans)[place]
        sizes = words.ends[where + 1] - words.ends[where]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        yield lo, hi, gather(words.flat, words.ends[where], sizes), upto[first]


@functools.lru_cache(2)
def worker_words(path: str) -> Words:
    return Words(load(path))


def sentencepiece_encode(
    docs: DataFrame, text: str = "text", path: str = PIECES, carry: Sequence[str] = ("doc_id",), decoded: bool = True
) -> DataFrame:
    """Per row: ``row`` (struct of the carried columns), ``ids`` and, if asked for, ``decoded``.

    The ids are those of the SentencePiece model in ``path`` (a space in front of the text,
    spaces as marks, bytes for characters without a piece); decoding gives the text back.
    Null and empty texts have no ids and decode to the empty text.
    """
    picked = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(path)
        for batch in batches:
            for lo, hi, ids, offsets in encode_batch(words, batch.column("_text")):
                listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [batch.column("row").slice(lo, hi - lo), listed]
                if decoded:
                    columns.append(words.pieces.decode_all(ids, offsets))
                yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "decoded"][: len(columns)])

    out = f"row {picked.schema['row'].dataType.simpleString()}, ids array<int>"
    return picked.mapInArrow(T.released(run), out + (", decoded string" if decoded else ""))


def sentencepiece_decode(encoded: DataFrame, ids: str = "ids", path: str = PIECES, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row: ``row`` (struct of the carried columns) and ``decoded``; null ids decode to the empty text."""
    picked = encoded.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            values, offsets = lists(pa.Table.from_batches([batch]), "_ids")
            texts = pieces.decode_all(values.astype(np.int64), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "decoded"])

    return picked.mapInArrow(run, f"row {picked.schema['row'].dataType.simpleString()}, decoded string")
