"""The last earlier row of another table, for series of any length and number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailward.session import stage


def asof_join(left: DataFrame, right: DataFrame, on: str, right_on: str, by: list[str], strict: bool = False) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of equal ``by`` whose ``right_on`` is the latest up to ``on`` (before it, if ``strict``).

    Both sides' distinct times are cut into ranges of (``by``, time), so a series spreads over as
    many tasks as it needs. Each range finds its own last observations, and the last one of
    all ranges before is carried in, one row per range and series. Rows of ``left`` then
    find their time's observation by equality, so equal times are looked up once. Of
    observations at one time the greatest by the other columns counts. Rows without an
    earlier observation keep nulls; a null time or ``by`` has none.
    """
    values = [c for c in right.columns if c not in by]
    rest = [c for c in values if c != right_on]
    seen = right.where(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("_at")).agg(F.max(F.struct(right_on, *rest)).alias("_obs"))
    asked = left.select(*by, F.col(on).alias("_at")).where("_at is not null").distinct()
    kind = seen.schema["_obs"].dataType
    # at equal times an observation stands behind what asks for strictly earlier ones, and before what takes its own time too
    both = asked.select(*by, "_at", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(kind).alias("_obs"), F.lit(True).alias("_asked")).unionByName(
        seen.select(*by, "_at", F.lit(1 if strict else 0).alias("_side"), "_obs", F.lit(False).alias("_asked"))
    )
    ranged = stage(both.repartitionByRange(*by, "_at").withColumn("_part", F.spark_partition_id()), "asof")
    inside = Window.partitionBy(*by, "_part").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_own", F.last("_obs", ignorenulls=True).over(inside)).where("_asked").select(*by, "_at", "_part", "_own")
    # one row per series and range
    ends = ranged.groupBy(*by, "_part").agg(F.max("_obs").alias("_end"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(*by, "_part", "_carried")
    found = local.join(carried, [*by, "_part"]).select(*by, F.col("_at").alias(on), F.coalesce("_own", "_carried").alias("_obs"))
    return left.join(found, [*by, on], "left").select(*left.columns, *[F.col("_obs")[c].alias(c) for c in values])
