"""The result store: one append-only parquet dataset per run configuration."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright import schemas
from casewright.functions.answers import path_safe_name
from casewright.sources.tables import empty, is_absent

PRIORITY = ["run_id", "stored_in"]
FILE_BYTES = 128 << 20  # of texts in one compacted file
ROW_BYTES = 64  # what a row weighs beside its texts
_ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.RESULT) + ", stored_in string, version int"


def read_results(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """All stored results with the file they came from; none yet gives an empty frame.

    Deduplicate by ``PRIORITY``: earlier runs win. An unreadable file fails the read;
    ``skip_unreadable`` leaves such files, and the answers in them, out.
    """
    try:
        stored = (
            spark.read.schema(schemas.RESULT)
            .option("ignoreCorruptFiles", skip_unreadable)
            .option("pathGlobFilter", "*.parquet")
            .parquet(path)
        )
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return empty(spark, schemas.RESULT).withColumn("stored_in", F.lit(None).cast("string"))
    names = [f.name for f in schemas.RESULT]
    return stored.select(*names, F.col("_metadata.file_name").alias("stored_in"))


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_name``, ``length`` of the store's files of which no row can be read: the ones ``skip_unreadable`` leaves out.

    The folder is listed without reading contents, and the files that rows came from are taken off. A
    readable file without rows is in the list too; of a file that is damaged further in, the
    rows before the damage are read and it is not.
    """
    one_slash = lambda c: F.regexp_replace(c, ":/+", ":/")
    try:
        listed = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.parquet")
            .option("recursiveFileLookup", True)
            .load(path)
            .select(one_slash(F.col("path")).alias("_path"), "length")
        )
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return spark.createDataFrame([], "file_name string, length bigint")
    rows = spark.read.schema(schemas.RESULT).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").parquet(path)
    read = rows.select(one_slash(F.col("_metadata.file_path")).alias("_path")).distinct()
    return listed.join(read, "_path", "left_anti").select(F.element_at(F.split("_path", "/"), -1).alias("file_name"), "length")


def _versions(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    schema = "stored_in string, version int" if kind == "files" else _ROWS
    try:
        return spark.read.schema(schema).parquet(f"{path.rstrip('/')}_compacted/{kind}")
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return None


def latest_version(spark: SparkSession, path: str) -> int:
    """The newest complete version of the compacted store; 0 without one."""
    files = _versions(spark, path, "files")
    return 0 if files is None else files.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def compact_results(spark: SparkSession, path: str, rows_per_file: int = 1_000_000, bytes_per_file: int = FILE_BYTES) -> int:
    """Rewrite all stored results into files of about ``rows_per_file`` rows or ``bytes_per_file`` bytes of texts, whichever
    is less, as a new version; returns its number.

    The rows go to ``<path>_compacted/rows/version=N`` by hash of the whole row, so that a case with many results has no
    file to itself, each with the name of the file it came from, so that the order of precedence stays. The list of the files that the version covers is written last: without it
    the version does not exist, and a stopped compaction is taken up under the next number. Nothing is removed
    or overwritten, so readers of an older version, and of the store itself, go on undisturbed. The store
    must not lose files; when to remove covered files is the owner's choice.
    """
    current = read_version(spark, path)
    rows, kept = _versions(spark, path, "rows"), f"{path.rstrip('/')}_compacted"
    used = 0 if rows is None else rows.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    version = max(used, latest_version(spark, path)) + 1
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("bigint") for f in current.schema if f.dataType == T.StringType()]
    n_rows, n_bytes = current.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(ROW_BYTES))), F.lit(0))).first()
    n = max(1, -(-n_rows // rows_per_file), -(-n_bytes // bytes_per_file))
    stamped = current.repartition(n, *current.columns).withColumn("version", F.lit(version))
    stamped.write.mode("append").partitionBy("version").parquet(f"{kept}/rows")
    files = _versions(spark, path, "rows").filter(F.col("version") == version).select("stored_in", "version").distinct()
    files.coalesce(1).write.mode("append").partitionBy("version").parquet(f"{kept}/files")  # one row a file
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored results by way of a version of the compacted store, with what was appended since.

    None is the newest complete version. The store's files that the version covers are not read: the folder is
    listed, covered names are taken off, and the few files left, of the rounds since then, are read by name.
    """
    version = latest_version(spark, path) if version is None else version
    if version == 0:
        return read_results(spark, path)
    names = [f.name for f in schemas.RESULT] + ["stored_in"]
    rows = _versions(spark, path, "rows").filter(F.col("version") == version).select(*names)
    covered = _versions(spark, path, "files").filter(F.col("version") == version).select("stored_in")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    found = listed.select("path", F.element_at(F.split("path", "/"), -1).alias("stored_in")).join(covered, "stored_in", "left_anti")
    fresh = [r["path"] for r in found.collect()]  # names of the files since the compaction
    if not fresh:
        return rows
    since = spark.read.schema(schemas.RESULT).option("basePath", path).parquet(*fresh)
    return rows.unionByName(since.select(*names[:-1], F.col("_metadata.file_name").alias("stored_in")))


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    """Add a batch of results; partitioned so one provider or run can be read alone."""
    names = [f.name for f in schemas.RESULT]
    stamped = df.withColumn("run_id", F.lit(run_id)).select(*names)
    stamped.write.mode("append").partitionBy("provider", "run_id").parquet(path)


def write_latest(df: DataFrame, path: str) -> None:
    """Overwrite the snapshot of everything so far; never the store the frame is read from."""
    df.write.mode("overwrite").parquet(path)


def final_path(root: str, provider: str, model_name: str, stamp: str) -> str:
    return f"{root.rstrip('/')}/final_llm_results_{provider}_{path_safe_name(model_name)}_{stamp}.parquet"


def write_final(df: DataFrame, root: str, provider: str, model_name: str, stamp: str) -> str:
    """Write the combined result under a name made of provider, model and time; returns the path."""
    path = final_path(root, provider, model_name, stamp)
    df.write.parquet(path)
    return path
