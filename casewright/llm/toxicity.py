"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Sixteen voters look at each text: lists of stems, fixed word lists and patterns. The label
model reads only how often each combination of votes occurs, over all documents (at most 2 ** 16
rows), together with the labels that may be learned from, and estimates by expectation-
maximisation how each voter fires on either class given the voter it is most correlated with.
Its posterior labels train the classifier, which alone gives the scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import features as X
from casewright.llm import text as T
from casewright.llm.quality import SMALL_LABELS

VOTERS = 16
STEM_LISTS = 8
STEMS = 4_096  # most stems that the lists hold together
MIN_TOXIC = 4  # texts, near copies not counted, that a stem must occur in
MIN_RATIO = 15.0
RIDGE = 0.02

#: Common insults in four languages.
INSULTS = {
    "en": "idiot moron stupid loser trash scum clown pathetic worthless disgusting dumb fool jerk garbage filth",
    "fr": "idiot imbécile crétin stupide débile abruti minable ordure salaud connard bouffon nul dégoûtant",
    "de": "idiot dummkopf trottel blödmann versager abschaum erbärmlich wertlos widerlich depp vollpfosten",
    "es": "idiota imbécil estúpido tonto basura escoria payaso patético inútil asqueroso gilipollas",
}


def _near_copies(ids: np.ndarray, ends: np.ndarray, bands: int = 2, rows: int = 6) -> np.ndarray:
    """Texts whose smallest hashes of some band another text before them has: near copies."""
    copy, full = np.zeros(len(ends) - 1, bool), np.flatnonzero(np.diff(ends) > 0)
    if not len(full):
        return copy
    for band in range(bands):
        key = np.zeros(len(full), np.uint64)
        for row in range(rows):
            hashed = T.mix(ids.astype(np.uint64) + np.uint64((band * rows + row + 1) * 0x9E3779B97F4A7C1))
            key = T.mix(key ^ np.minimum.reduceat(hashed, ends[full]))
        _, first = np.unique(key, return_index=True)
        copy[np.delete(full, first)] = True
    return copy


def find_stems(ids: np.ndarray, ends: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Feature ids that occur in clearly more of the toxic texts; near copies count once."""
    one = ~_near_copies(ids, ends)
    owner = np.repeat(np.arange(len(y)), np.diff(ends))
    inside = one[owner]
    known, cols = np.unique(ids[inside], return_inverse=True)
    labels = y[owner[inside]]
    toxic = np.bincount(cols[labels == 1], minlength=len(known))
    clean = np.bincount(cols[labels == 0], minlength=len(known))
    n1, n0 = max(1, (y[one] == 1).sum()), max(1, (y[one] == 0).sum())
    ratio = ((toxic + 0.5) / (n1 + 1)) / ((clean + 0.5) / (n0 + 1))
    chosen = np.flatnonzero((toxic >= MIN_TOXIC) & (ratio >= MIN_RATIO))
    chosen = chosen[np.lexsort((chosen, -toxic[chosen]))][:STEMS]
    return np.sort(known[chosen]).astype(np.int64)


def votes(stems: X.Vocabulary, insults: X.Vocabulary, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each text, a number whose bit j tells whether voter j fires."""
    n = len(offsets) - 1
    fired = np.zeros((VOTERS, n), bool)
    hit_doc, hit = stems.find(doc, ids)
    lists = (T.mix(stems.ids.astype(np.uint64)) % np.uint64(STEM_LISTS)).astype(np.int64)
    fired[lists[hit], hit_doc] = True
    n_hits = np.bincount(hit_doc, minlength=n)
    size = np.maximum(np.diff(offsets), 1)
    fixed_doc, _ = insults.find(doc, ids)
    n_fixed = np.bincount(fixed_doc, minlength=n)

    def total(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    fired[8], fired[9] = n_fixed >= 1, n_fixed >= 2
    fired[10] = n_hits >= 3
    fired[11] = n_hits * 400 >= size
    fired[12] = total((data >= 65) & (data <= 90)) * 3 >= size  # shouting
    fired[13] = total((data == 33) | (data == 63)) * 100 >= size  # many marks
    fired[14] = total((data == 42) | (data == 36) | (data == 35)) * 100 >= size  # masked words
    fired[15] = (n_hits == 0) & (n_fixed == 0)  # speaks for a clean text
    return (fired.astype(np.int64) << np.arange(VOTERS)[:, None]).sum(axis=0)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 100) -> dict[int, float]:
    """The probability of label 1 for each vote pattern.

    Generative model: the label, then each voter given the label and its parent in a tree
    of the strongest conditional dependence (pairs of correlated voters). ``known`` holds 1,
    0, or -1 for rows of unknown label, whose posterior is estimated.
    """
    if not len(patterns):
        return {}
    bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
    weight = counts.astype(float)
    labelled = weight[known >= 0].sum()
    prior = (weight[known == 1].sum() + 1) / (labelled + 2) if labelled else 0.1
    toxic_votes = bits[:, :15].any(axis=1) & (bits[:, 15] == 0)
    q = np.where(known >= 0, known, np.where(toxic_votes, 0.7, 0.02)).astype(float)

    def tree(q: np.ndarray) -> list[int]:
        """Parent of each voter (-1: none) in the tree of largest conditional mutual information."""
        info = np.zeros((VOTERS, VOTERS))
        for w in (weight * q, weight * (1 - q)):
            share = w.sum() / weight.sum()
            p = {}
            for a in (0, 1):
                for b in (0, 1):
                    p[a, b] = ((bits == a) * w[:, None]).T.astype(float) @ (bits == b) + 0.1
            all_ = sum(p.values())
            for (a, b), joint in p.items():
                left, right = p[a, 0] + p[a, 1], p[0, b] + p[1, b]
                info += share * joint / all_ * np.log(joint * all_ / (left * right))
        parent, inside = [-1] * VOTERS, [0]
        while len(inside) < VOTERS:
            rest = [j for j in range(VOTERS) if j not in inside]
            j, k = max(((j, k) for j in rest for k in inside), key=lambda e: info[e])
            parent[j] = k
            inside.append(j)
        return parent

    for round_ in range(rounds):
        if round_ % 10 == 0 and round_ <= 30:
            parent = tree(q)
        logs = np.zeros((2, len(patterns)))
        for y, w in ((1, weight * q), (0, weight * (1 - q))):
            logs[y] += np.log(prior if y else 1 - prior)
            for j, k in enumerate(parent):
                above = bits[:, k] if k >= 0 else np.zeros(len(bits), int)
                both = np.zeros((2, 2))
                np.add.at(both, (above, bits[:, j]), w)
                chance = (both + 0.5) / (both.sum(axis=1, keepdims=True) + 1.0)
                logs[y] += np.log(chance[above, bits[:, j]])
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        new = np.where(known >= 0, known, posterior)
        done = np.abs(new - q).max() < 1e-6
        q = new
        prior = float(np.clip((weight * q).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        if done:
            break
    return dict(zip(patterns.tolist(), posterior.tolist()))


def fit_linear(ids: np.ndarray, ends: np.ndarray, p: np.ndarray, rounds: int = 300) -> dict:
    """Logistic weights of feature indicators for posterior labels ``p``; near copies count once.

    Features occur in at least three texts and are unevenly spread over the classes. Without any text
    the score is one half below.
    """
    rows = np.flatnonzero(~_near_copies(ids, ends))
    n = len(rows)
    if not n:
        return {"ids": np.zeros(0, np.int64), "w": np.zeros(1) - 1.0}
    owner = np.repeat(np.arange(len(p)), np.diff(ends))
    place = np.full(len(p), -1)
    place[rows] = np.arange(n)
    inside = place[owner] >= 0
    known, cols, counts = np.unique(ids[inside], return_inverse=True, return_counts=True)
    owner, goal = place[owner[inside]], p[rows]
    toxic = np.bincount(cols, goal[owner], minlength=len(known))
    share = max(goal.mean(), 1e-3)
    excess = (toxic - counts * share) / np.sqrt(counts * share * (1 - share) + 1e-9)
    kept = (counts >= 3) & (np.abs(excess) >= 3)
    at = np.cumsum(kept) - 1
    use = kept[cols]
    cols, owner = at[cols[use]], owner[use]
    m = int(kept.sum())
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    step_w, step_b = np.zeros(m) + 1e-8, 1e-8  # sums of squared slopes
    for _ in range(rounds):
        score = np.bincount(owner, w[cols], minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - goal) / n
        g = np.bincount(cols, error[owner], minlength=m) + RIDGE / n * w
        gb = error.sum()
        step_w += g * g
        step_b += gb * gb
        w -= 0.5 * g / np.sqrt(step_w)
        b -= 0.5 * gb / np.sqrt(step_b)
    return {"ids": known[kept].astype(np.int64), "w": np.append(w, b)}


def _in_one_task(rows: DataFrame, label: str, kind: pa.DataType, fit: Callable) -> object:
    """What ``fit(ids, ends, labels)`` makes of a bounded sample's rows, in one task."""
    schema = pa.schema([("_key", pa.int64()), (label, kind), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema).sort_by("_key")
        made = fit(*X.lists(table), table[label].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    picked = X.bounded_ids(rows.select(F.col("_key").cast("bigint"), label, "ids")).repartition(1)
    return pickle.loads(picked.mapInArrow(T.released(run), "made binary").first()[0])


def _with_votes(rows: DataFrame, stems: np.ndarray) -> DataFrame:
    """The columns but ``_text``, and ``votes``."""
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    names = [f.name for f in kept]
    fixed = np.unique(X.word_ids(" ".join(INSULTS.values()).split()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, insults = X.Vocabulary(stems), X.Vocabulary(fixed.astype(np.int64))
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column("_text")):
                found = votes(known, insults, data, offsets, *X.stem_features(data, offsets))
                others = [batch.column(c).slice(lo, hi - lo) for c in names]
                yield pa.RecordBatch.from_arrays([*others, pa.array(found)], [*names, "votes"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{shape}, votes bigint")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    of: int = 5,
    held_out: int = 0,
    sample: int = X.SAMPLE,
) -> dict:
    """The classifier. Labels of fold ``held_out`` are never read.

    Stems come from at most about ``sample`` labelled rows, the label model from the votes
    of all rows, the classifier from at most about ``sample`` rows outside the held-out fold
    and their posteriors. What reaches the driver: stems, vote patterns, weights.
    """
    spark = docs.sparkSession
    truth = X.true_labels(labels, key, label).filter(X.fold(key, of) != held_out).withColumnRenamed(key, "_key")
    n = truth.count()
    small = (lambda t: F.broadcast(t)) if n <= SMALL_LABELS else (lambda t: t)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    labelled = rows.join(small(X.labelled_sample(truth, n, sample)), "_key").select("_key", "y", "_text")
    stems = _in_one_task(X.with_features(labelled, "_text", X.stem_features), "y", pa.int32(), find_stems)

    voted = _with_votes(rows, stems).join(small(truth), "_key", "left")
    table = voted.groupBy("votes", F.coalesce("y", F.lit(-1)).alias("known")).count().toPandas()
    table = table.sort_values(["votes", "known"])
    posterior = fit_label_model(table["votes"].to_numpy(), table["count"].to_numpy(), table["known"].to_numpy())

    free = rows.filter(X.fold("_key", of) != held_out)
    chosen = X.labelled_sample(free, docs.count(), sample)
    judged = _with_votes(chosen.withColumn("_again", F.col("_text")), stems)
    names = spark.createDataFrame(
        [(int(v), float(p)) for v, p in posterior.items()], "votes bigint, p double"
    )  # at most 2 ** VOTERS rows
    soft = judged.join(F.broadcast(names), "votes").select("_key", "p", F.col("_again").alias("_text"))
    return _in_one_task(X.with_features(soft, "_text", X.stem_features), "p", pa.float64(), fit_linear)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
    of: int = 5,
    held_out: int = 0,
) -> DataFrame:
    """Per row: ``row`` (struct of the key and carried columns), ``held_out``, ``score``, ``predicted``.

    Null and empty texts have no features and get the score of the bias. Repeated rows score
    alike. Without labels the label model rests on the voters alone.
    """
    model = fit_toxicity(docs, labels, key, text, of=of, held_out=held_out)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys([key, *carry]))
    picked = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        vocabulary = X.Vocabulary(known["ids"])
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column("_text")):
                doc, place = vocabulary.find(*X.stem_features(data, offsets))
                margin = np.bincount(doc, known["w"][place], minlength=hi - lo) + known["w"][-1]
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(score)], ["row", "score"])

    scored = picked.mapInArrow(run, f"row {picked.schema['row'].dataType.simpleString()}, score double")
    return scored.select(
        "row",
        (X.fold(f"row.{key}", of) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
