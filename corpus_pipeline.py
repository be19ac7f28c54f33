"""A training corpus from raw documents: filter, deduplicate, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes every stage's rows
as Parquet in the shared folder and gives the next stage what it reads back. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.mixing import mix_sources
from casewright.llm.quality import quality_scores
from casewright.llm.simhash import simhash_groups
from casewright.llm.substring_dedup import substring_dedup
from casewright.llm.tokenizer import MARK, sentencepiece_encode
from casewright.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; their columns are unchanged.

    Without labels of both classes the score is constant, and a corpus is kept whole unless
    most of its labels are bad.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs, labels, carry=COLUMNS)
    return scored.filter("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash component: four-word shingles, at most four differing bits.

    Documents without words (null, empty) are one component. Of several rows with that id the one with the least text (then language, source) stays.
    Of a group in which no row has an id, one row stays by the same order.
    """
    marked = docs.select(*COLUMNS).withColumns(
        {"_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_hash": F.xxhash64("text")}
    )
    lean = ["doc_id", "lang", "source", "n_chars", "_id", "_hash"]
    groups = simhash_groups(marked, n=4, radius=4, carry=lean).filter("component_id IS NULL OR row.doc_id = component_id")
    order = ["_hash", "lang", "source", "n_chars"]
    first = Window.partitionBy("root").orderBy(*order)  # rows of the smallest id: one, unless ids repeat
    chosen = groups.select("row.*", "root").withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    kept = marked.join(chosen.select("_id", "_hash"), ["_id", "_hash"], "left_semi")
    each = Window.partitionBy("_id", "_hash").orderBy(*order[1:])
    return kept.withColumn("_k", F.row_number().over(each)).filter("_k = 1").select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages of 20 words or more that occur earlier.

    A document that loses nothing keeps its text as it is; another's kept words are joined
    by one space. No document is dropped.
    """
    found = substring_dedup(docs, carry=[*COLUMNS])
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    return found.select(
        "row.doc_id",
        text.alias("text"),
        "row.lang",
        "row.source",
        F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars")).alias("n_chars"),
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; empty ones go with their copies."""
    mixed = mix_sources(docs, carry=COLUMNS)
    return mixed.filter("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids, their number, and whether the ids decode to the row's text, of every row.

    The model writes a space as a mark, so that a mark in a text comes back as a space. Null and empty texts
    have no ids and decode to the empty text; a row that does not decode is marked, not dropped.
    """
    marked = docs.withColumn("_hash", F.xxhash64(F.translate(F.coalesce("text", F.lit("")), MARK, " ")))
    coded = sentencepiece_encode(marked, carry=["doc_id", "source", "_hash"])
    same = (F.xxhash64("decoded") == F.col("row._hash")).alias("decodes")
    return coded.select("row.doc_id", "row.source", "ids", F.size("ids").alias("n_tokens"), same)



STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", passage_dedup),
    ("mixing", mix),
    ("sentencepiece", tokenise),
]

#: The classifier and the fingerprints can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
