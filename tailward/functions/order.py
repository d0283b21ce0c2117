"""Orders of two parts as one number, so that ``min_by`` and ``max_by`` aggregate by hash.

An aggregate over a struct has no buffer of fixed length, so Spark sorts all rows by group
before it combines any. A decimal of 38 digits has one, and holds both parts exactly.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _id(row_id: str) -> Column:
    """Null below every bigint."""
    return F.coalesce(F.col(row_id).cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(20,0)"))


def time_order(ts: str, start: Column, row_id: str) -> Column:
    """Orders by ``ts``, and rows of equal time by ``row_id`` (a bigint, null first); ``start`` is a time that the group shares."""
    seconds = (F.col(ts) - start).cast("interval second").cast("decimal(20,6)")
    return (seconds * F.lit(Decimal(10**6))).cast("decimal(18,0)") * F.lit(Decimal(2**65)) + _id(row_id)


def id_order(row_id: str, *fields: str) -> Column:
    """Orders by ``row_id`` (a bigint, null first), and rows that share it by a hash of ``fields``, so that all fields come from one row."""
    return _id(row_id) * F.lit(Decimal(2**59)) + F.pmod(F.xxhash64(*fields), F.lit(2**59)).cast("decimal(20,0)")
