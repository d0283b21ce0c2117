"""Fixed table layouts; readers check against them instead of inferring."""

from pyspark.sql import types as T

QUOTES = T.StructType(
    [
        T.StructField("quote_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("variety", T.IntegerType()),
        T.StructField("fwd", T.DoubleType()),
        T.StructField("tenor_days", T.IntegerType()),
        T.StructField("cp", T.StringType()),
        T.StructField("mny_idx", T.IntegerType()),
        T.StructField("strike", T.DoubleType()),
        T.StructField("iv", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("open_interest", T.LongType()),
        T.StructField("bid_size", T.LongType()),
        T.StructField("ask_size", T.LongType()),
        T.StructField("side", T.IntegerType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("src_id", T.LongType()),
        T.StructField("variety", T.IntegerType()),
        T.StructField("start_ts", T.TimestampNTZType()),
        T.StructField("end_ts", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
    ]
)

MACRO = T.StructType([T.StructField("obs_date", T.DateType()), T.StructField("macro_index", T.DoubleType())])
