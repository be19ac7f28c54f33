"""Scoring newly arriving case files: the batch run's operators under a stream trigger."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from casewright import schemas
from casewright.operators.scoring import Responder
from casewright.plans.scoring_run import run_scoring
from casewright.sources.results import read_results
from casewright.sources.tables import is_absent


def read_case_stream(
    spark: SparkSession, path: str, schema: T.StructType = schemas.CASE, name_filter: str = "*.parquet"
) -> DataFrame:
    """Case files of a folder as they arrive.

    A plain path is a folder. A pattern like ``cases.parque[t]`` takes a single file as well as a folder of that name,
    but no values from the names of subfolders.
    """
    return spark.readStream.schema(schema).option("pathGlobFilter", name_filter).parquet(path)


def score_stream(
    cases: DataFrame,
    store: str,
    checkpoint: str,
    responder: Responder,
    *,
    run_id: str,
    ids_in_state: bool = False,
    **options,
) -> StreamingQuery:
    """Score every case not yet in the store, then stop when the available files are done.

    A replayed micro-batch finds its cases in the store and adds nothing.

    With ``ids_in_state`` the ids seen so far are the stream's own state: cases pass ``dropDuplicates``
    on their id, which the stream's checkpoint keeps over restarts. The ids that the store holds at the first
    start are written beside the checkpoint and join the stream once; the first micro-batch, which may bring an id from both
    sides, still asks the store. From then on no micro-batch reads results but those of its own, for
    the case that it is a repetition. The store must then get no results of this model from elsewhere.
    State grows with the ids; set the RocksDB state store for many of them.
    """
    spark = cases.sparkSession
    if ids_in_state:
        ids = f"{checkpoint.rstrip('/')}_ids"
        names = ["llm_caseID"]
        try:
            kept = spark.read.parquet(ids).schema
        except AnalysisException as error:
            if not is_absent(error):
                raise
            found = read_results(spark, store)
            mine = (F.col("provider") == options["provider"]) & (F.col("model_name") == options["model_name"])
            found.filter(mine).select(*names).distinct().write.parquet(ids)
            kept = found.select(*names).schema
        old = spark.readStream.schema(kept).parquet(ids)
        cases = cases.withColumn("_new", F.lit(True)).unionByName(old, allowMissingColumns=True).dropDuplicates(names)

    def one(batch: DataFrame, epoch: int) -> None:
        if ids_in_state:
            batch = batch.filter("_new").drop("_new")
        run_scoring(
            batch, store, responder, run_id=f"{run_id}-{epoch:06d}", this_run_only=ids_in_state and epoch > 0, **options
        )

    return (
        cases.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
