"""Near-duplicates by SimHash: fingerprints compared exactly, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.components import components
from casewright.session import materialize

TILE = 4096
PAIRS = 64  # pairs of tiles that a task compares
SEED = 42


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, n: int = 4) -> int:
    """The SimHash of a text's n-word shingles, repeats included, lower-cased in A-Z; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[min(n, len(words)) - 1 :])
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in spans], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += _bit_sums(hashes[at : at + (1 << 16)])
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str, carry: Sequence[str], n: int = 4) -> DataFrame:
    """``row`` (struct of the carried columns) and ``fp`` (the fingerprint as a signed bigint)."""
    picked = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.large_binary())
            prints = [fingerprint(t.as_py() or b"", n) for t in texts]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), signed], ["row", "fp"])

    return picked.mapInArrow(run, f"row {picked.schema['row'].dataType.simpleString()}, fp bigint")


def _parts(distinct: int) -> int:
    """Into how many equal parts a fingerprint is cut for its tile's population counts."""
    return 1 if distinct < 50_000 else 2 if distinct < 4_000_000 else 4 if distinct < 1_000_000_000 else 8


def _merge(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of u and v, element by element; ``parent`` holds the root of each node."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def tile_links(left: np.ndarray, right: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever two tiles' fingerprints link: fewer than there are fingerprints."""
    nodes = np.concatenate([left, right])
    parent = np.arange(len(nodes))
    for at in range(0, len(left), block):
        rows = left[at : at + block]
        near = np.bitwise_count(rows[:, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        _merge(parent, i + at, j + len(left))
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def near_links(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all within ``radius`` bits.

    A fingerprint's cell is the population counts of its equal parts. Two fingerprints
    differ in at least as many bits as their counts do, so only cells within the radius are
    paired; each cell is cut into tiles by hash. A pair of tiles is compared whole, with
    exclusive-or and bit counts. What a tile pair returns spans its links without listing them.
    """
    spark = prints.sparkSession
    parts = _parts(prints.count())
    width = 64 // parts
    mask = (1 << width) - 1
    counts = [
        F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))).cast("int")
        for i in range(parts)
    ]
    celled = prints.select("fp", F.array(*counts).alias("cell"))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
    if parts <= 4:
        sizes = F.broadcast(sizes)  # at most 17 ** 4 cells; without it a large cell would be one task's
    tiles = materialize(
        celled.join(sizes, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int").alias("cut"))
        .agg(F.collect_list("fp").alias("fps"))
        .withColumn("id", F.xxhash64("cell", "cut"))
    )
    steps = [s for s in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius]
    offsets = spark.createDataFrame([(list(s),) for s in steps], "step array<int>")
    keys = tiles.select("cell", "id")
    shifted = keys.crossJoin(F.broadcast(offsets)).select(  # a fixed set of offsets
        F.col("id").alias("ida"), F.zip_with("cell", "step", lambda c, s: c + s).alias("cell")
    )
    pairs = shifted.join(keys.withColumnRenamed("id", "idb"), "cell").filter("ida <= idb").select("ida", "idb")
    joined = (
        pairs.join(tiles.select(F.col("id").alias("ida"), F.col("fps").alias("left")), "ida")
        .join(tiles.select(F.col("id").alias("idb"), F.col("fps").alias("right")), "idb")
        .select("left", "right")
        .repartition(max(1, -(-pairs.count() // PAIRS)))  # by work, which the bytes of a pair don't show
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = tile_links(
                    left.values.to_numpy().view(np.uint64), right.values.to_numpy().view(np.uint64), radius
                )
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return joined.mapInArrow(compare, "a bigint, b bigint").distinct()


def simhash_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = 4,
    radius: int = 4,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row: ``row`` (struct of the key and carried columns), ``fp``, ``component_id``, and
    ``root``, a fingerprint that names the component too.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; the component is
    named by its smallest key. Texts without words (null, empty) have fingerprint 0 and are
    linked like any other. Rows without a key belong to a component but do not name it; one
    of such rows only has a null name. Identical and repeated rows each get their row back.
    """
    rows = materialize(fingerprints(docs, text, list(dict.fromkeys([key, *carry])), n))
    prints = materialize(rows.groupBy("fp").agg(F.min(f"row.`{key}`").alias("least")))
    roots = components(near_links(prints.select("fp"), radius))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "root").select("fp", "component_id", "root")
    return rows.join(by_print, "fp").select("row", "fp", "component_id", "root")
