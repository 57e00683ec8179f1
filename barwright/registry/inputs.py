"""Market-shaped inputs derived from the shared tables, as DataFrames and as SQL.

Prices and volumes are multiples of a power of two, so sums are exact in any order and
comparisons between two engines do not hinge on rounding noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.over import Layout
from ..operators.bars import ticks_to_bars
from ..session import pin_session

BARS = Layout.of("symbol", "date")
SERIES = Layout.of("series_id", "date")
DAILY = Layout.of("series", "date")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin_session(spark).read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 8).cast("int").alias("symbol"),
        F.col("event_id").alias("trade_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        ((F.round(F.col("value") * 100).cast("long") + 100) / F.lit(64.0)).alias("price"),
        (F.col("event_id") % 97 + 1).cast("double").alias("qty"),
        (F.col("event_id") % 3 == 0).alias("is_buyer_maker"),
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf), ["symbol"])


def series_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The same bars with the key named as the bundles expect it."""
    return bars(spark, sf).withColumnRenamed("symbol", "series_id")


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars under OHLCV names."""
    return series_bars(spark, sf).select(
        "series_id", "date", F.col("price_first").alias("open"), F.col("price_max").alias("high"),
        F.col("price_min").alias("low"), F.col("price_last").alias("close"),
        F.col("qty_sum").alias("volume_ETH"), F.col("amount_sum").alias("volume_USD"))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Close and volume per symbol and hour."""
    return bars(spark, sf).select(
        "symbol", "date", F.col("price_last").alias("close"), F.col("price_max").alias("high"),
        F.col("price_min").alias("low"), F.col("qty_sum").alias("volume"))


def ohlcv_daily(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("timestamp").alias("date"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity")) / F.lit(64.0)).alias("px"),
        F.col("l_quantity").alias("qty"), (F.floor("l_extendedprice") / F.lit(1024.0)).alias("usd"))
    return li.groupBy("series", "date").agg(
        F.max("px").alias("high"), F.min("px").alias("low"),
        (F.floor(F.sum("px") * 64 / F.count("px")) / F.lit(64.0)).alias("close"),
        F.sum("qty").alias("volume_ETH"), F.sum("usd").alias("volume_USD"))


def activity(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("usd", F.floor("o_totalprice") / F.lit(1024.0))
    n = lambda cond: (F.sum(F.when(cond, 1).otherwise(0)) + 1).cast("double")
    s = F.col("o_orderstatus")
    return o.groupBy((F.col("o_custkey") % 4).cast("int").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("date")).agg(
        F.sum("usd").alias("total_flow_sum"),
        F.count(F.lit(1)).cast("double").alias("address_count_sum"),
        F.countDistinct("o_custkey").cast("double").alias("active_receivers"),
        n(s == "F").alias("active_senders"),
        (F.sum(F.when(s == "O", F.col("usd")).otherwise(0.0)) + 1.0).alias("dex_volume"),
        n(s == "P").alias("contract_calls"),
        n(F.col("o_totalprice") > 300000).alias("whale_tx_count"),
    )


def drivers(spark: SparkSession, sf: str) -> DataFrame:
    """Slow driver columns per series and hour."""
    b = series_bars(spark, sf)
    h = lambda k: (F.col(k) / F.lit(64.0))
    return b.select(
        "series_id", "date",
        F.col("price_last").alias("VIX_close"), h("qty_sum").alias("fundingRate"),
        F.col("price_max").alias("GLI_norm"), F.col("price_min").alias("btc_dominance"),
        F.col("amount_sum").alias("stablecoin_volume_usd"),
        # every seventh hour is missing, so values are carried forward
        F.when(F.hour("date") % 7 != 3, F.col("price_first")).alias("velocity_stablecoin_24h"),
        h("amount_sum").alias("dex_volume_usd"), F.col("price_first").alias("median_gas_price"),
        F.col("qty_count").cast("double").alias("tx_count"), (F.col("price_max") - F.col("price_min")).alias("realized_vol_24h"),
        (F.col("buy_trade_sum") / F.lit(16.0)).alias("eth_volume_dominance"),
        F.col("buy_qty_sum").alias("long_short_imbalance"), F.col("qty_sum").alias("velocity_usd_24h"),
    )


def events_t1(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals starting at every fifth bar of a symbol, seven hours long, the last open."""
    w = BARS.ordered()
    n = F.count(F.lit(1)).over(BARS.whole())
    rn = F.row_number().over(w) - 1
    b = hourly(spark, sf).select("symbol", "date", rn.alias("rn"), n.alias("n"))
    return b.filter(F.col("rn") % 5 == 0).select(
        "symbol", F.col("rn").cast("int").alias("event_id"), F.col("date").alias("t_start"),
        F.when(F.col("rn") < F.col("n") - 10, F.col("date") + F.expr("interval 7 hours")).alias("t_end"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return l.join(d, "doc_id").select(
        "doc_id", (F.col("doc_id") % 5).cast("int").alias("fold"), F.col("lang").alias("model"),
        F.col("quality").alias("y"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"),
        ((F.col("n_chars") % 1000) / F.lit(250.0) - 2.0).alias("logit"))


def predictions_multi(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id", (F.col("vec_id") % 4).cast("int").alias("batch"), (F.col("label") % 3).cast("int").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(f"s{i}") for i in range(3)])


# ---- the same as SQL -------------------------------------------------------

TICKS = """
ticks AS (
  SELECT CAST(user_id % 8 AS INT) AS symbol, event_id AS trade_id, ts AS "timestamp",
         (CAST(round(value * 100) AS BIGINT) + 100) / 64.0::DOUBLE AS price,
         CAST(event_id % 97 + 1 AS DOUBLE) AS qty, event_id % 3 = 0 AS is_buyer_maker
  FROM events)"""


def _bars_sql(name: str, key: str, alias: str) -> str:
    return f"""
{name} AS (
  SELECT {key} AS {alias}, date_trunc('hour', "timestamp")::TIMESTAMP AS date,
         arg_min(price, row("timestamp", trade_id)) AS price_first,
         arg_max(price, row("timestamp", trade_id)) AS price_last,
         max(price) AS price_max, min(price) AS price_min, avg(price) AS price_mean,
         sum(qty) AS qty_sum, count(qty) AS qty_count, avg(qty) AS qty_mean, sum(price * qty) AS amount_sum,
         sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0 END) AS buy_qty_sum,
         avg(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0 END) AS buy_qty_mean,
         sum(CASE WHEN is_buyer_maker THEN qty ELSE 0 END) AS sell_qty_sum,
         avg(CASE WHEN is_buyer_maker THEN qty ELSE 0 END) AS sell_qty_mean,
         CAST(sum(CASE WHEN NOT is_buyer_maker THEN 1 ELSE 0 END) AS BIGINT) AS buy_trade_sum,
         CAST(sum(CASE WHEN is_buyer_maker THEN 1 ELSE 0 END) AS BIGINT) AS sell_trade_sum
  FROM ticks GROUP BY ALL)"""


BARS_SQL = TICKS + "," + _bars_sql("bars", "symbol", "symbol")
SERIES_SQL = TICKS + "," + _bars_sql("bars1", "symbol", "series_id")
PRICED_SQL = SERIES_SQL + """,
priced AS (
  SELECT series_id, date, price_first AS open, price_max AS high, price_min AS low, price_last AS close,
         qty_sum AS "volume_ETH", amount_sum AS "volume_USD" FROM bars1)"""
HOURLY_SQL = BARS_SQL + """,
hourly AS (
  SELECT symbol, date, price_last AS close, price_max AS high, price_min AS low, qty_sum AS volume,
         row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn,
         count(*) OVER (PARTITION BY symbol) AS n
  FROM bars)"""
DAILY_SQL = """
daily AS (
  SELECT series, date, max(px) AS high, min(px) AS low, floor(sum(px) * 64 / count(px)) / 64.0::DOUBLE AS close,
         sum(qty) AS "volume_ETH", sum(usd) AS "volume_USD"
  FROM (SELECT l_returnflag AS series, CAST(l_shipdate AS TIMESTAMP) AS date,
               floor(l_extendedprice / l_quantity) / 64.0::DOUBLE AS px, l_quantity AS qty,
               floor(l_extendedprice) / 1024.0::DOUBLE AS usd FROM lineitem)
  GROUP BY ALL)"""
ACTIVITY_SQL = """
activity AS (
  SELECT CAST(o_custkey % 4 AS INT) AS series_id, CAST(o_orderdate AS TIMESTAMP) AS date, sum(usd) AS total_flow_sum,
         CAST(count(*) AS DOUBLE) AS address_count_sum, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS active_receivers,
         CAST(count(*) FILTER (o_orderstatus = 'F') + 1 AS DOUBLE) AS active_senders,
         sum(CASE WHEN o_orderstatus = 'O' THEN usd ELSE 0.0 END) + 1.0 AS dex_volume,
         CAST(count(*) FILTER (o_orderstatus = 'P') + 1 AS DOUBLE) AS contract_calls,
         CAST(count(*) FILTER (o_totalprice > 300000) + 1 AS DOUBLE) AS whale_tx_count
  FROM (SELECT *, floor(o_totalprice) / 1024.0::DOUBLE AS usd FROM orders)
  GROUP BY ALL)"""
DRIVERS_SQL = SERIES_SQL + """,
drivers AS (
  SELECT series_id, date, price_last AS "VIX_close", qty_sum / 64.0::DOUBLE AS "fundingRate", price_max AS "GLI_norm",
         price_min AS btc_dominance, amount_sum AS stablecoin_volume_usd,
         CASE WHEN hour(date) % 7 <> 3 THEN price_first END AS velocity_stablecoin_24h,
         amount_sum / 64.0::DOUBLE AS dex_volume_usd, price_first AS median_gas_price,
         CAST(qty_count AS DOUBLE) AS tx_count, price_max - price_min AS realized_vol_24h,
         buy_trade_sum / 16.0::DOUBLE AS eth_volume_dominance, buy_qty_sum AS long_short_imbalance,
         qty_sum AS velocity_usd_24h FROM bars1)"""
EVENTS_SQL = HOURLY_SQL + """,
t1 AS (
  SELECT symbol, CAST(rn AS INT) AS event_id, date AS t_start,
         CASE WHEN rn < n - 10 THEN date + INTERVAL 7 HOUR END AS t_end
  FROM hourly WHERE rn % 5 = 0)"""
PREDICTIONS_SQL = """
predictions AS (
  SELECT l.doc_id, CAST(l.doc_id % 5 AS INT) AS fold, d.lang AS model, l.quality AS y,
         (d.n_chars % 1000) / 1000.0::DOUBLE AS score, (d.n_chars % 1000) / 250.0::DOUBLE - 2.0 AS logit
  FROM labels l JOIN documents d USING (doc_id))"""
MULTI_SQL = """
multi AS (
  SELECT vec_id, CAST(vec_id % 4 AS INT) AS batch, CAST(label % 3 AS INT) AS y,
         CAST(embedding[1] AS DOUBLE) AS s0, CAST(embedding[2] AS DOUBLE) AS s1, CAST(embedding[3] AS DOUBLE) AS s2
  FROM embeddings)"""
