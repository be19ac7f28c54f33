"""Reading logical tables that are stored as several shards."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright import schemas
from casewright.operators.cohort import restrict_to
from casewright.operators.numbering import BROADCAST_KEYS, first_ids
from casewright.session import materialize


def read_shards(
    spark: SparkSession,
    shards: Sequence[str],
    table: str,
    schema: T.StructType | None = None,
    suffix: str = ".parquet",
) -> DataFrame:
    """All shards of one table, duplicates kept.

    With a schema this is one scan over all paths. Without one, shards may differ in
    columns and are united by name.
    """
    paths = [f"{s.rstrip('/')}/{table}{suffix}" for s in shards]
    if schema is not None:
        return spark.read.schema(schema).parquet(*paths)
    return union_all([spark.read.parquet(p) for p in paths])


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def is_absent(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def load_tables(
    spark: SparkSession,
    shards: Sequence[str],
    names: Sequence[str],
    optional: Sequence[str] = (),
    table_schemas: Mapping[str, T.StructType] = schemas.TABLES,
    suffix: str = ".parquet",
) -> dict[str, DataFrame]:
    """Named tables as lazy frames. An absent optional table is a typed empty frame."""
    tables = {}
    for name in names:
        try:
            tables[name] = read_shards(spark, shards, name, table_schemas.get(name), suffix)
        except AnalysisException as error:
            if name not in optional or not is_absent(error) or name not in table_schemas:
                raise
            tables[name] = empty(spark, table_schemas[name])
    return tables


def with_sequence(df: DataFrame, name: str = "note_seq") -> DataFrame:
    """Rows with a unique number that follows the input order within a file.

    Ties between notes of one day break by this number, so it must not change when a
    task runs again: the numbered rows are written once to the shared folder.
    """
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name, rows, number of columns, column names."""
    return union_all(
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            F.lit(",".join(df.columns)).alias("columns"),
        )
        for name, df in tables.items()
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def pilot_sample(
    tables: Mapping[str, DataFrame], n: int, id_table: str = "clinical_note", key: str = "patient_id"
) -> tuple[dict[str, DataFrame], DataFrame]:
    """All rows of the first n patients, per table, and their ids.

    The id list has n rows, so a small n is broadcast.
    """
    ids = first_ids(tables[id_table], n, key)
    listed = F.broadcast(ids) if n <= BROADCAST_KEYS else ids
    return {name: restrict_to(df, listed, key) for name, df in tables.items()}, ids
