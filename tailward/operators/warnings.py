"""Rule warnings L0 to L3, episodes, systemic warnings and the two-track backtest.

Every table here has one row per variety and bar or fewer, so the calendar bounds its
size per variety; none of these operators reads quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailward.functions.time import interval, minutes_between
from tailward.session import stage

KEY = ["variety", "bar"]
CUT_QUANTILES = [0.90, 0.97, 0.99]
SKETCH_K = 4096  # rank error of a merged sketch about 0.1 %
CLASSES = 24  # of window lengths; the last one holds all above 2 ** 22 hours
SYSTEM = -1  # stands for "all varieties together" in the system track


def strength(c: str) -> Column:
    """Size of a z-score, rounded so that a value equal to a cut compares as equal."""
    return F.round(F.abs(F.col(f"z_{c}")), 6)


def calibrate(df: DataFrame, cols: list[str], qs: list[float] = CUT_QUANTILES, key: str = "variety") -> DataFrame:
    """Cut points of ``|z_<col>|`` per key and feature, in ``cut_1``, ``cut_2``, …

    Exact percentiles over the long form, so that every (key, feature) is its own group.
    A cut between two sizes of 6 digits has at most 8, so rounding to 9 changes no cut.
    """
    long = df.select(key, *[strength(c).alias(c) for c in cols]).unpivot([key], cols, "feature", "size")
    cuts = long.groupBy(key, "feature").agg(F.percentile("size", F.array(*[F.lit(q) for q in qs])).alias("cuts"))
    return cuts.select(key, "feature", *[F.round(F.get("cuts", F.lit(i)), 9).alias(f"cut_{i + 1}") for i in range(len(qs))])


def sketch_days(df: DataFrame, cols: list[str], key: str = "variety", order: str = "bar", k: int = SKETCH_K) -> DataFrame:
    """One mergeable quantile sketch of ``|z_<col>|`` per key, feature and day.

    A stored table of these is calibrated again each day by adding the day's rows; the bars
    before are not read. A sketch holds at most a few times ``k`` values, whatever it has seen, and all of them
    while there are no more than ``k``.
    """
    long = df.select(key, F.to_date(order).alias("day"), *[strength(c).alias(c) for c in cols]).unpivot([key, "day"], cols, "feature", "size")
    return long.groupBy(key, "feature", "day").agg(F.count("size").alias("n"), F.kll_sketch_agg_double("size", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, key: str = "variety") -> DataFrame:
    """One sketch per key and feature: of all days, or of days merged before."""
    return sketches.groupBy(key, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def calibrate_sketched(sketches: DataFrame, qs: list[float] = CUT_QUANTILES, key: str = "variety") -> DataFrame:
    """The cuts of ``calibrate`` from sketches: values that occurred, without interpolation; null for a feature without values.

    The share of values up to a cut is within the sketch's rank error of the quantile (about
    2.5 / ``k`` ** 0.94 at 99 % confidence), and exact while there are no more than ``k`` values.
    """
    merged = merge_sketches(sketches, key)
    cut = lambda q: F.round(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))), 9)
    return merged.select(key, "feature", *[cut(q).alias(f"cut_{i + 1}") for i, q in enumerate(qs)])


def _wide(cuts: DataFrame, cols: list[str], key: str, levels: int) -> DataFrame:
    marks = F.array(*[F.col(f"cut_{i + 1}") for i in range(levels)])
    return cuts.groupBy(key).agg(F.lit(True).alias("_known"), *[F.max(F.when(F.col("feature") == c, marks)).alias(f"cuts_{c}") for c in cols])


def score_levels(
    df: DataFrame, cuts: DataFrame, cols: list[str], min_hits: int = 2, levels: int = 3, key: str = "variety"
) -> DataFrame:
    """Add ``hits_1..3`` (features past each cut), ``level``: the largest L with enough hits, else 0, and ``no_cuts``.

    A null z-score is not past any cut. A key without any cuts cannot be judged: its
    level is null and ``no_cuts`` is true. The cuts have one row per key; the optimiser
    broadcasts them while they are below its size threshold.
    """
    past = lambda c, i: F.coalesce((strength(c) > F.get(f"cuts_{c}", F.lit(i))).cast("int"), F.lit(0))
    hits = {f"hits_{i + 1}": sum((past(c, i) for c in cols), F.lit(0)) for i in range(levels)}
    level = F.lit(0)
    for i in range(1, levels + 1):
        level = F.when(F.col(f"hits_{i}") >= min_hits, F.lit(i)).otherwise(level)
    joined = df.join(_wide(cuts, cols, key, levels), key, "left").withColumns(hits)
    unknown = F.col("_known").isNull()
    return joined.withColumn("level", F.when(~unknown, level)).withColumn("no_cuts", unknown).drop("_known", *[f"cuts_{c}" for c in cols])


def debounce(df: DataFrame, k: int = 2, level: str = "level", key: str = "variety", order: str = "bar") -> DataFrame:
    """Replace ``level`` by the lowest of the last ``k`` bars; 0 until ``k`` bars exist, null where it was null."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(k - 1), 0)
    held = F.when(F.count(F.lit(1)).over(w) >= k, F.min(level).over(w)).otherwise(F.lit(0))
    return df.withColumn(level, F.when(F.col(level).isNotNull(), held))


def episodes(
    df: DataFrame, min_level: int = 1, gap: str = "30 minutes", keys: tuple[str, ...] = ("variety",), level: str = "level"
) -> DataFrame:
    """Runs of bars at ``min_level`` or above, split where bars are more than ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy("bar")
    previous = F.lag("bar").over(w)
    first = previous.isNull() | (F.col("bar") > previous + interval(gap))
    return (
        df.where(F.col(level) >= min_level)
        .withColumn("_first", F.when(first, F.col("bar")))
        .withColumn("start_bar", F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "start_bar")
        .agg(F.max("bar").alias("end_bar"), F.count(F.lit(1)).alias("n_bars"), F.max(level).alias("peak_level"))
    )


def systemic(df: DataFrame, level: int = 1, n: int = 3) -> DataFrame:
    """Per bar the varieties at ``level`` or above; ``is_systemic`` from ``n`` of them on."""
    bars = df.groupBy("bar").agg(F.count_if(F.col("level") >= level).alias("n_varieties"))
    return bars.withColumn("is_systemic", F.col("n_varieties") >= n)


def _length_class(opens: Column, closes: Column) -> Column:
    """The least class whose bins, of 2 ** class hours, are no shorter than the window."""
    hours = minutes_between(closes, opens) / 60
    return sum(((hours > F.lit(float(1 << j))).cast("int") for j in range(CLASSES - 1)), F.lit(0))


def _bin(ts: Column, cls: Column) -> Column:
    hours = minutes_between(ts, F.lit("1970-01-01").cast("timestamp_ntz")) / 60
    return F.floor(hours / F.call_function("shiftleft", F.lit(1).cast("bigint"), cls))


def listed_windows(events: DataFrame, lead: str, keys: tuple[str, ...] = ("variety",)) -> DataFrame:
    """Events under the bins that their windows ``[start - lead, end]`` touch: two at most, as a class's bins are no shorter than its windows."""
    opens = F.col("start_ts") - interval(lead)
    classed = events.select(*keys, "start_ts", "end_ts", opens.alias("_opens"), _length_class(opens, F.col("end_ts")).alias("_class")).where("end_ts is not null")
    bins = F.array_distinct(F.array(_bin(F.col("_opens"), F.col("_class")), _bin(F.col("end_ts"), F.col("_class"))))
    return classed.withColumn("_bin", F.explode(bins))


def match_events(
    warnings: DataFrame, events: DataFrame, lead: str = "4 hours", keys: tuple[str, ...] = ("variety",), at: str = "start_bar"
) -> DataFrame:
    """Pairs of a warning and an event with the warning in ``[start - lead, end]``.

    An interval join has no equality for Spark to partition on, so events are dealt to
    classes by length, and within a class to bins of doubling width: an event of any length is
    listed twice at most. A warning is looked up once in each class that occurs.
    ``first_lead_minutes`` is the lead of the event's earliest matching warning.
    """
    listed = stage(listed_windows(events, lead, keys), "listed-windows")
    classes = sorted(r["_class"] for r in listed.select("_class").distinct().collect())  # at most CLASSES
    asked = warnings.select(*keys, F.col(at).alias("warned_at")).withColumn("_class", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>")))
    asked = asked.withColumn("_bin", _bin(F.col("warned_at"), F.col("_class")))
    per_event = Window.partitionBy(*keys, "start_ts", "end_ts")
    lead_minutes = minutes_between(F.col("start_ts"), F.col("warned_at"))
    return (
        asked.join(listed, [*keys, "_class", "_bin"])
        .where(F.col("warned_at").between(F.col("_opens"), F.col("end_ts")))
        .drop("_class", "_bin", "_opens")
        .withColumn("lead_minutes", lead_minutes)
        .withColumn("first_lead_minutes", F.max("lead_minutes").over(per_event))
    )


def for_both_tracks(events: DataFrame) -> DataFrame:
    """Events of each variety and, once more, of the system: fuse the result in one go."""
    tracks = F.explode(F.array(F.col("variety"), F.lit(SYSTEM)))
    return events.withColumn("variety", tracks)


def both_tracks(levels: DataFrame, n: int = 3, max_level: int = 3) -> DataFrame:
    """Bars at each minimum level, by variety and for the system as a whole, in one table."""
    by_variety = levels.where(F.col("level") >= 1).select(
        "variety", "bar", "level", F.explode(F.sequence(F.lit(1), F.col("level"))).alias("min_level")
    )
    system = (
        by_variety.groupBy("min_level", "bar")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("level").alias("level"))
        .where(F.col("_n") >= n)
        .select(F.lit(SYSTEM).alias("variety"), "bar", "level", "min_level")
    )
    return by_variety.unionByName(system).withColumn("track", _track())


def _track() -> Column:
    return F.when(F.col("variety") == SYSTEM, "system").otherwise("variety")


def backtest(
    levels: DataFrame,
    fused: DataFrame,
    lead: str = "4 hours",
    n: int = 3,
    gap: str = "30 minutes",
    max_level: int = 3,
) -> DataFrame:
    """Precision, recall, F1 and mean lead per track and minimum level.

    Variety track: a variety's episodes against its fused events. System track: episodes
    of bars where at least ``n`` varieties warn, against events fused over all varieties,
    which ``fused`` holds as rows of the variety ``SYSTEM`` (see ``for_both_tracks``).
    A warning is an episode start; a ratio is null on a zero denominator. Leads are added up in
    whole microseconds, so the mean does not depend on the order of rows.
    """
    keys = ("min_level", "variety")
    warned = stage(episodes(both_tracks(levels, n, max_level), 1, gap, keys), "track-episodes")
    listed = fused.select("variety", "start_ts", "end_ts")
    events = stage(listed.select("*", F.explode(F.sequence(F.lit(1), F.lit(max_level))).alias("min_level")), "track-events")
    pairs = stage(match_events(warned, events, lead, keys), "track-pairs")
    hit_warnings = pairs.select(*keys, "warned_at").distinct()
    lead_micros = F.timestamp_diff("MICROSECOND", F.min("warned_at"), F.col("start_ts"))
    hit_events = pairs.groupBy(*keys, "start_ts", "end_ts").agg(lead_micros.alias("lead"))

    def tally(df: DataFrame, **figures: Column) -> DataFrame:
        names = ("n_warnings", "n_matched_warnings", "n_events", "n_matched_events", "lead_sum")
        return df.select(*keys, *[figures.get(c, F.lit(0)).cast("bigint").alias(c) for c in names])

    one = F.lit(1)
    rows = (
        tally(warned, n_warnings=one)
        .unionByName(tally(hit_warnings, n_matched_warnings=one))
        .unionByName(tally(events, n_events=one))
        .unionByName(tally(hit_events, n_matched_events=one, lead_sum=F.col("lead")))
    )
    counts = ("n_warnings", "n_matched_warnings", "n_events", "n_matched_events")
    total = rows.groupBy(_track().alias("track"), "min_level").agg(
        *[F.sum(c).alias(c) for c in counts], F.sum("lead_sum").alias("lead_sum")
    )
    p, r = F.col("precision"), F.col("recall")
    return (
        total.withColumn("precision", F.try_divide("n_matched_warnings", "n_warnings"))
        .withColumn("recall", F.try_divide("n_matched_events", "n_events"))
        .withColumn("f1", F.try_divide(p * r * 2, p + r))
        .withColumn("mean_lead_minutes", F.try_divide("lead_sum", F.col("n_matched_events") * F.lit(60e6)))
        .drop("lead_sum")
    )
