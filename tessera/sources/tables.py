"""Lookup and panel tables, and staging of stage output."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.stages import Stage, own

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def source_order() -> Column:
    """Place of a row in its Parquet files: file, then row. It survives shuffles once selected, and can be compared."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read an exported sheet (Parquet or CSV with a header), keeping ``columns``.

    Without a schema every CSV column stays text, so no inference pass runs.
    """
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without that setting the session's warehouse folder serves. A warehouse on
    a machine's own disk is refused on a cluster, where executors would not see
    each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if folder.startswith("file:") and not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def checkpoint_table(
    df: DataFrame,
    path: str,
    refresh: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write a stage's output once and read it back from storage (an eager job).

    The returned frame has no lineage to the inputs, so a lost executor costs
    a re-read, not a recomputation. An earlier result is reused while columns,
    plan and input files are the same (see ``stages.Stage``); otherwise, or
    with ``refresh``, a new version is written and the old one is left to its
    readers until the stage is pruned.
    """
    return Stage(df.sparkSession, path).table(df, refresh, partition_by)


def stage_derived(df: DataFrame) -> DataFrame:
    """Write a derived lookup to the shared folder and read it back (an eager job).

    As a file its size is known when the next join is planned, so Spark's own
    broadcast threshold decides with a real figure. Without this a lookup
    made by aggregation carries its input's size estimate, and the big side
    of the join would be shuffled for nothing. The files stay in the shared
    folder, under names that begin with ``tessera-derived-``, unless the work
    runs inside ``stages.owned_stages``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-derived-{uuid.uuid4().hex}"
    own(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
