"""Reading the quote archive and writing the products."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXCHANGE_DIR = r"/(?:exchange=)?([A-Z]{2,4})/"  # the first folder below the root


def read_archive(spark: SparkSession, root: str, schema: T.StructType, exchange_pattern: str = EXCHANGE_DIR) -> DataFrame:
    """Every Parquet file below ``root`` as one table, with ``exchange`` taken from the first folder below it.

    Small files are packed into tasks by ``spark.sql.files.maxPartitionBytes``; the
    path comes from file metadata, so it costs no extra column read. The files' own
    schemas are compared with ``schema`` and their paths with the pattern before any row
    is read: a missing column, another type or a path without an exchange is an error.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    stored = reader.option("mergeSchema", "true").parquet(root)
    check_schema(stored, schema)
    below = re.escape(re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", root).rstrip("/")) + exchange_pattern
    unmatched = [f for f in stored.inputFiles() if not re.search(below, f)]
    if unmatched:
        raise ValueError(f"no exchange in the path of {len(unmatched)} files, e.g. {unmatched[0]}")
    files = reader.schema(schema).parquet(root)
    path = F.col("_metadata.file_path")
    return files.select(*schema.fieldNames(), F.regexp_extract(path, below, 1).alias("exchange"))


def write_archive(df: DataFrame, root: str, values: list[str], by: str = "exchange") -> None:
    """Write each of ``values`` of ``by`` into its folder below ``root``; a row of another value, or of none, is an error.

    There is one pass per value, whose rows go straight to their files. A single partitioned write
    would sort each task's rows by value first, and quotes are far more than a task holds.
    """
    known = F.col(by).isin(values)
    for value in values:
        mine = F.when(known, F.col(by) == value).otherwise(F.raise_error(F.lit(f"{by} is not one of {', '.join(values)}")))
        df.where(mine).drop(by).write.parquet(f"{root}/{by}={value}")


def check_schema(df: DataFrame, schema: T.StructType) -> None:
    """Fail early, on the driver and without a job, when a table lacks a column or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")


def write_features(df: DataFrame, path: str, by: str = "variety", mode: str = "errorifexists") -> None:
    """Write a product partitioned by ``by``.

    ``rebalance`` gathers each value into few files, and lets adaptive execution
    split a value that holds much of the table, which ``repartition(by)`` would not.
    """
    df.hint("rebalance", F.col(by)).write.mode(mode).partitionBy(by).parquet(path)


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write metric rows as JSON lines."""
    df.write.mode(mode).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the graph as ``nodes`` and ``edges`` tables."""
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
