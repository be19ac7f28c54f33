"""Ranked lexical search for a set of items, scoring each distinct bag of words once.

A document counts only by its bag: the frequencies of the words that some item has, and its length
norm m. Documents of one bag and norm are a class; a class is hashed, verified by its whole vectors,
scored once, and only classes among an item's best are expanded into their documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm import text as T
from casewright.session import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 256  # items scored together
WORDS = 1 << 20  # words of items that may be sent to every task
CELLS = 4 << 20  # numbers of a dense block of classes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(text: str) -> Column:
    """The words of a column's texts, lower-cased in A-Z, with repeats; none for null."""
    upper = "".join(map(chr, range(65, 91)))
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower()), F.lit(TERM), F.lit(0))


def bags(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """``doc`` (the key), ``n`` (all its words), ``terms`` and ``tfs``: the frequencies of known words, by number."""
    picked = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("_text"))
    known = pa.array([w.encode() for w in words], pa.large_binary())
    width = max(1, len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column("_text")):
                inside = _TERM[data]
                starts, ends = T.runs(inside, offsets)
                doc = T.owner(starts, offsets)
                at = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(ends - starts, out=at[1:])
                packed = np.ascontiguousarray(_LOWER[data[inside]])
                found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
                place = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False)
                hit = place >= 0
                keys, counts = np.unique(doc[hit] * width + place[hit], return_counts=True)
                cuts = pa.array(np.searchsorted(keys, np.arange(hi - lo + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(lo, hi - lo),
                        pa.array(np.bincount(doc, minlength=hi - lo).astype(np.int64)),
                        pa.ListArray.from_arrays(cuts, pa.array((keys % width).astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(counts.astype(np.int32))),
                    ],
                    ["doc", "n", "terms", "tfs"],
                )

    return picked.mapInArrow(run, "doc bigint, n bigint, terms array<int>, tfs array<int>")


def best_of(scores: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best positive scores: highest first, equal ones by document."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least]
    return some[np.lexsort((doc[some], -scores[some]))][:k]


def _score_classes(classes: DataFrame, weights: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_items: int, k: int) -> DataFrame:
    """``item``, ``cid``, ``least``, ``score``: the k best classes of each item and task.

    ``weights`` are the items' (item, word, weight) in blocks of items. A block of classes is a dense
    matrix of a word's part of the score, over the block's words alone; sums of whole numbers
    below 2 ** 53 are exact in doubles, larger ones are added as integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for items, words, w in weights:
            columns = np.unique(words)
            exact = np.int64 if float(w.sum()) * 1e6 >= 2.0**53 else np.float64
            table = np.zeros((len(columns), int(items.max()) - int(items.min()) + 1), exact)
            np.add.at(table, (np.searchsorted(columns, words), items - items.min()), w)
            blocks.append((int(items.min()), columns, table))
        top = [np.zeros((3, 0), np.int64) for _ in range(n_items)]  # cid, least (null: the largest), score
        for batch in batches:
            sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            words = batch.column("terms").flatten().to_numpy()
            tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
            m = batch.column("m").to_numpy()
            cid = batch.column("cid").to_numpy()
            least = pc.fill_null(batch.column("least"), (1 << 63) - 1).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
            for first, columns, table in blocks:
                step = max(1, CELLS // max(1, len(columns)))
                for lo in range(0, len(m), step):
                    hi = min(lo + step, len(m))
                    a, b = ends[lo], ends[hi]
                    row = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                    place = np.minimum(np.searchsorted(columns, words[a:b]), len(columns) - 1)
                    hit = columns[place] == words[a:b]
                    dense = np.zeros((hi - lo, len(columns)), table.dtype)
                    dense[row[hit], place[hit]] = impact[a:b][hit]
                    scores = (dense @ table).astype(np.int64)
                    for j in range(scores.shape[1]):
                        found = best_of(scores[:, j], least[lo:hi], k)
                        new = np.stack([cid[lo:hi][found], least[lo:hi][found], scores[found, j]])
                        every = np.concatenate([top[first + j], new], axis=1)
                        top[first + j] = every[:, best_of(every[2], every[1], k)]
        items = np.repeat(np.arange(n_items), [t.shape[1] for t in top])
        if len(items):
            cid, least, score = np.concatenate(top, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(items.astype(np.int32)), pa.array(cid), pa.array(least), pa.array(score)], ["item", "cid", "least", "score"])

    return classes.select("cid", "least", "m", "terms", "tfs").mapInArrow(run, "item int, cid bigint, least bigint, score bigint")


def lexical_top_k(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    most: int = WORDS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of each item by whole-number scores.

    A score adds w * ((10^9 * tf) div (1000 * tf + 8 * m)) over an item's words, repeats included; w is
    floor(1000 * ln((2N + 2) / (2df + 1))), N counts documents with words, m compares a document's
    length with the mean. Only scores above 0 count; equal ones rank by ascending key, a null key last.
    Each row is a document, so identical rows rank one after another. Null and empty texts have no
    words; an item without words, or without a match, has no rows. Item rows of one key are one item
    with the words of all its different texts; a null item key is a key. Empty tables give no rows. A very long text
    is counted whole, in one piece. Other columns are ignored, whatever their names.

    The items are the stated query set: their words are counted first and, up to ``most``, sent to every
    task; more are asked in several rounds over the documents. Memory of a task: one run of texts,
    one block of classes, and k rows for each item.
    """
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    asked = items.select(F.col(item_key).alias("item_id"), terms(item_text).alias("words")).distinct()
    wanted = asked.select("item_id", F.explode("words").alias("word")).groupBy("item_id", "word").agg(F.count("*").alias("qtf"))
    wanted = materialize(wanted)
    rounds = -(-wanted.count() // most)
    if rounds > 1:  # by item; each has its words in one round
        part = F.pmod(F.xxhash64(item_key), F.lit(2 * rounds))
        again = [lexical_top_k(docs, items.filter(part == i), k, key, text, item_key, item_text, 1 << 62) for i in range(2 * rounds)]
        return reduce(DataFrame.unionAll, again)
    words = [r["word"] for r in wanted.select("word").distinct().orderBy("word").collect()]  # at most ``most``, as counted above
    rows = materialize(bags(docs, key, text, words), "zstd")
    stats = rows.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    total, length = stats["n"], stats["l"]
    df = {r["term"]: r["df"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    out = "item_id {}, rank int, doc_id bigint, score bigint".format(kind)
    if not df:
        return spark.createDataFrame([], out)
    m = (F.lit(100 - 75) + F.call_function("div", F.lit(75) * F.col("n") * F.lit(total), F.lit(length))).alias("m")
    bagged = rows.filter(F.size("terms") > 0).select("doc", m, "terms", "tfs", F.xxhash64("terms", "tfs", m).alias("h"))
    classes = bagged.groupBy("h", "m", "terms", "tfs").agg(F.min("doc").alias("least"))  # verified: the vectors are part of the key
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "zstd")
    number = {w: i for i, w in enumerate(words)}
    listed = wanted.collect()
    ids = sorted({r["item_id"] for r in listed}, key=lambda i: (i is None, i))
    place = {i: n for n, i in enumerate(ids)}
    ln = {t: r for t, r in _weights(spark, df, total)}
    found = [(place[r["item_id"]], number[r["word"]], r["qtf"] * ln[number[r["word"]]]) for r in listed if number[r["word"]] in ln]
    found = np.array(sorted(found), np.int64).reshape(-1, 3)
    edges = np.searchsorted(found[:, 0], np.arange(0, len(ids) + BLOCK, BLOCK))
    weights = [tuple(found[a:b].T) for a, b in zip(edges[:-1], edges[1:]) if b > a]
    best = _score_classes(classes, weights, len(ids), k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("least"), F.col("cid"))
    best = best.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).select("item", "cid", "score")
    best = materialize(best)
    few = F.broadcast(best.select("cid").distinct())  # at most k rows an item
    won = classes.join(few, "cid", "left_semi").select("cid", "h", "m", "terms", "tfs")
    class_ = ["h", "m", "terms", "tfs"]
    first = Window.partitionBy(*class_).orderBy(F.col("doc").asc_nulls_last())
    members = bagged.join(F.broadcast(won.select("h").distinct()), "h", "left_semi")
    members = members.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= k)  # limited before the shuffle too
    members = members.join(won, class_).select("cid", "doc")
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    top = best.join(members, "cid").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], f"item int, item_id {kind}")
    return top.join(names, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def _weights(spark, df: dict[int, int], total: int) -> Sequence[tuple[int, int]]:
    """(word, weight) of every word that some document has; at most one for each word of the items."""
    share = (F.lit(2 * total + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))
    rows = spark.createDataFrame(list(df.items()), "term int, df bigint")
    return [(r["term"], r["w"]) for r in rows.select("term", F.floor(1000 * F.ln(share)).cast("bigint").alias("w")).collect()]
