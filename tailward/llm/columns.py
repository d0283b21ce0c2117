"""Appending result columns without regard to what a table's other columns are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *without: str) -> Column:
    """All columns of ``df`` but those named, as one struct ``_row``."""
    kept = [c for c in df.columns if c not in without]
    return F.struct(*[quoted(c) for c in kept] or [F.lit(None).alias("_none")]).alias("_row")


def unpacked(df: DataFrame) -> list[Column]:
    """The columns held in ``_row``."""
    return [F.col("_row")[c].alias(c) for c in df.schema["_row"].dataType.names if c != "_none"]


def broadcast_if_small(written: DataFrame, width: Column, most: int = 32 << 20) -> DataFrame:
    """Mark a written table for broadcast if its rows, each ``width`` bytes, are measured at ``most`` bytes or less; else it joins by shuffle."""
    size = written.agg(F.sum(width + 64)).first()[0] or 0
    return F.broadcast(written) if size <= most else written


def add_columns(df: DataFrame, found: Column, names: list[str]) -> DataFrame:
    """Append the fields ``names`` of the struct ``found``, in place of columns of the same name."""
    held = df.select(packed(df, *names), found.alias("_found"))
    return held.select(*unpacked(held), *[F.col("_found")[n].alias(n) for n in names])
