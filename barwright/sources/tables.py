"""Raw market files: trades, bars, exchange pages, activity queries, sentiment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators.align import floor_hour
from ..operators.clean import keep_first, time_range

# Fixed format: trade files have no header and these seven columns.
TICK_SCHEMA = T.StructType([
    T.StructField("trade_id", T.LongType()), T.StructField("price", T.DoubleType()),
    T.StructField("qty", T.DoubleType()), T.StructField("quote_qty", T.DoubleType()),
    T.StructField("timestamp", T.LongType()), T.StructField("is_buyer_maker", T.BooleanType()),
    T.StructField("is_best_match", T.BooleanType()),
])


def read_ticks(spark: SparkSession, path: str, extra: Sequence[T.StructField] = ()) -> DataFrame:
    """Headerless trade CSV; epoch milliseconds become a timestamp.  ``extra`` fields follow
    the seven fixed ones (for example a symbol)."""
    schema = T.StructType([*TICK_SCHEMA.fields, *extra])
    return spark.read.schema(schema).csv(path).withColumn("timestamp", F.timestamp_millis("timestamp"))


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of bar Parquet files with the time column called ``date``."""
    return spark.read.parquet(folder).withColumn("date", F.col("timestamp").cast("timestamp")).drop("timestamp")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm_path))


def cached_bars(
    spark: SparkSession, folder: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Read the bar table if it was completed before, else build, write and read it.

    The success marker decides, so a half-written table is rebuilt.  Partitioning by series
    lets later reads prune.
    """
    if not path_exists(spark, f"{folder}/_SUCCESS"):
        bars = build().withColumnRenamed("date", "timestamp")
        if partition_by:
            bars = bars.repartition(*partition_by)
        bars.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    return read_bars(spark, folder)


def read_activity_query(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One activity-query CSV with header; its ``date`` is floored to the hour."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    raw = reader.csv(path)
    return raw.withColumn("date", floor_hour(F.col("date").cast("timestamp")))


def clean_ohlcv_pages(pages: DataFrame, lo, hi, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Overlapping hourly pages (``time`` in epoch seconds) to one sorted OHLCV table."""
    rest = [c for c in pages.columns if c not in (*keys, "time")]
    unique = keep_first(pages, [*keys, "time"], list(order) or rest)
    shaped = unique.select(
        *keys, F.timestamp_seconds("time").alias("date"), "open", "high", "low", "close",
        F.col("volumefrom").alias("volume_ETH"), F.col("volumeto").alias("volume_USD"))
    return time_range(shaped, "date", lo, hi).orderBy(*keys, "date")


SENTIMENT_PAYLOAD = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("value_classification", T.StringType()),
])))])


def read_sentiment(spark: SparkSession, path: str) -> DataFrame:
    """Sentiment payload (``data`` array of strings) to typed rows."""
    payload = spark.read.schema(SENTIMENT_PAYLOAD).json(path)
    row = payload.select(F.explode("data").alias("r")).select("r.*")
    return row.select(
        F.timestamp_seconds(F.col("timestamp").cast("long")).alias("date"),
        F.col("value").cast("int").alias("fg_index"),
        F.col("value_classification").alias("fg_label"),
    )
