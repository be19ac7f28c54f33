"""Session helpers shared by the tests, the benchmark and the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "casewright") -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors could not see it.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="casewright-")
        context.setCheckpointDir(named)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def materialize(df: DataFrame, compression: str = "snappy", by: str | None = None, whole: bool = False) -> DataFrame:
    """Write the frame once as parquet in the shared folder and read it back.

    Later passes then read only the columns they need, and a lost executor re-reads
    files instead of recomputing the job. ``compression="zstd"`` suits large binary columns.
    ``by`` names a column whose values get folders of their own, so that one can be read alone.
    ``whole`` keeps what a task writes to a folder in one file and, up to 512 MB, in one row group,
    which a single task reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/casewright/{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    if whole:
        writer = writer.options(**{"maxRecordsPerFile": 0, "parquet.block.size": 512 << 20})
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
