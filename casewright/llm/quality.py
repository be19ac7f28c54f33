"""A quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import features as X
from casewright.llm import text as T

COST = 1.0
EPOCHS = 12
MIN_DOCS = 3
SMALL_LABELS = 5_000_000  # labels (key and bit) that may be broadcast


def log_count_ratio(cols: np.ndarray, owner: np.ndarray, y: np.ndarray, n: int, smooth: float = 1.0) -> np.ndarray:
    """log of the class-1 share of each feature's count over its class-0 share."""
    one = np.bincount(cols[y[owner] == 1], minlength=n) + smooth
    zero = np.bincount(cols[y[owner] == 0], minlength=n) + smooth
    return np.log(one / one.sum()) - np.log(zero / zero.sum())


def dual_descent(
    cols: np.ndarray, values: np.ndarray, ends: np.ndarray, y: np.ndarray, cost: np.ndarray, n: int, epochs: int = EPOCHS
) -> np.ndarray:
    """Weights of the linear hinge-loss model (bias last), one dual variable at a time.

    Each step solves one row's dual variable exactly within [0, cost]; a full pass without
    a notable step ends it.
    """
    w, alpha = np.zeros(n + 1), np.zeros(len(y))
    square = np.add.reduceat(np.append(values**2, 0.0), ends[:-1]) * (np.diff(ends) > 0) + 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(y)):
            at, v = cols[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]]
            slope = sign[i] * (w[at] @ v + w[n]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[at] += step * sign[i] * v
                w[n] += step * sign[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of the logistic curve a * margin + b for smoothed labels (Newton steps)."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - goal) * margin).sum(), (p - goal).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin**2).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(ids: np.ndarray, ends: np.ndarray, y: np.ndarray) -> dict:
    """The model of rows with the given distinct feature ids and 0/1 labels.

    With one class only, or no row at all, the score is the smoothed share of class 1.
    """
    if len(y) == 0 or y.min() == y.max():
        return {"ids": np.zeros(0, np.int64), "w": np.zeros(1), "r": np.zeros(0), "a": 0.0, "b": float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))}
    ranked = np.sort(ids)
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool))
    known = ranked[first][np.diff(np.append(first, len(ranked))) >= MIN_DOCS]
    del ranked
    owner = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ends))
    cols = [np.zeros(0, np.int32)]  # places among the known, in parts: only the kept ones are held
    rows = [np.zeros(0, np.int32)]
    for at in range(0, len(ids), 1 << 21):
        some = ids[at : at + (1 << 21)]
        place = np.searchsorted(known, some)
        hit = np.flatnonzero(known[np.minimum(place, max(len(known) - 1, 0))] == some) if len(known) else place[:0]
        cols.append(place[hit].astype(np.int32))
        rows.append(owner[at : at + (1 << 21)][hit])
    cols, owner, known = np.concatenate(cols), np.concatenate(rows), known.astype(np.int64)
    del ids, rows
    n = len(known)
    ratio = log_count_ratio(cols, owner, y, n)
    ends = np.searchsorted(owner, np.arange(len(y) + 1))
    norm = np.sqrt(np.bincount(owner, ratio[cols] ** 2, minlength=len(y)))
    values = ratio[cols] / np.maximum(norm[owner], 1e-9)
    share = y.mean()
    cost = COST * np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w = dual_descent(cols, values, ends, y, cost, n)
    margin = np.bincount(owner, w[cols] * values, minlength=len(y)) + w[n]
    a, b = sigmoid_fit(margin, y)
    return {"ids": known, "w": w, "r": ratio, "a": a, "b": b}


def score(model: dict, vocabulary: X.Vocabulary, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The probability of class 1 of n texts with the given features."""
    doc, place = vocabulary.find(doc, ids)
    r = model["r"][place]
    norm = np.sqrt(np.bincount(doc, r * r, minlength=n))
    margin = np.bincount(doc, model["w"][place] * r, minlength=n) / np.maximum(norm, 1e-9) + model["w"][-1]
    return 1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -30, 30)))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    of: int = 3,
    held_out: int = 1,
    sample: int = X.SAMPLE,
) -> dict:
    """The model fitted on labelled rows outside fold ``held_out`` of ``of``: at most about ``sample`` of them
    and about ``features.MOST_IDS`` feature ids, so that long texts don't make the fit larger.

    One task fits on the sample's feature ids; only the fitted weights reach the driver.
    """
    truth = X.true_labels(labels, key, label).filter(X.fold(key, of) != held_out)
    n = truth.count()
    known = X.labelled_sample(truth.withColumnRenamed(key, "_key"), n, sample)
    if n <= SMALL_LABELS:
        known = F.broadcast(known)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(known, "_key")
    found = X.bounded_ids(X.with_features(rows.select("_key", "y", "_text"), "_text", X.style_features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema).sort_by("_key")
        (ids, ends), y = X.lists(table), table["y"].to_numpy()
        del table
        model = fit(ids, ends, y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    schema = pa.schema([("_key", pa.int64()), ("y", pa.int32()), ("ids", pa.list_(pa.int32()))])
    one = found.select(F.col("_key").cast("bigint"), "y", "ids").repartition(1)
    return pickle.loads(one.mapInArrow(T.released(run), "model binary").first()[0])


def score_quality(docs: DataFrame, model: dict, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of the carried columns) and ``score`` of every row; null texts score as empty."""
    picked = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        vocabulary = X.Vocabulary(known["ids"])
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column("_text")):
                scores = score(known, vocabulary, *X.style_features(data, offsets), hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(scores)], ["row", "score"])

    return picked.mapInArrow(T.released(run), f"row {picked.schema['row'].dataType.simpleString()}, score double")


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
    of: int = 3,
    held_out: int = 1,
) -> DataFrame:
    """Per row: ``row`` (struct of the key and carried columns), ``held_out``, ``score``, ``predicted``.

    The model learns from labels outside the held-out fold alone; rows without a usable
    label, key or text are scored all the same, repeated rows alike. Conflicting labels of a
    key count as 1 from one half on. Without labels of both classes the score is constant.
    """
    model = fit_quality(docs, labels, key, text, of=of, held_out=held_out)
    scored = score_quality(docs, model, text, list(dict.fromkeys([key, *carry])))
    return scored.select(
        "row",
        (X.fold(f"row.{key}", of) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
