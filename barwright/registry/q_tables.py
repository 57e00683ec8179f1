"""Sources, cleaning, alignment and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import flag as sflag, ratio as sratio
from ..operators import align, clean, fit, profile
from ..operators.bars import BAR_COLUMNS, ticks_to_bars
from ..plans.price import date_features
from ..session import scratch_dir
from ..sources import tables as src
from ..sources.bar_store import read_store, refresh_bars
from ..streaming.ingest import ingest_changed_files, ingest_new_files, read_current, read_ingested
from . import inputs as I
from .core import finish, query, rounded
from .sql import Win, clip, finite, flag, ratio

B, D, S = Win("symbol"), Win("series"), Win("series_id")
DOUBLES = [c for c in BAR_COLUMNS if c not in ("qty_count", "buy_trade_sum", "sell_trade_sum")]
COUNTS = ["qty_count", "buy_trade_sum", "sell_trade_sum"]
BARS_OUT = finish(I.BARS_SQL, "bars", ["symbol", "date", *COUNTS], DOUBLES)

# ---- sources ---------------------------------------------------------------


@query("a1_tick_to_bar", BARS_OUT)
def a1(spark, sf):
    return rounded(I.bars(spark, sf))


@query("s1_read_bar_folder", BARS_OUT)
def s1(spark, sf):
    folder = scratch_dir(spark, "bars")
    I.bars(spark, sf).withColumnRenamed("date", "timestamp").write.parquet(folder)
    return rounded(src.read_bars(spark, folder))


@query("s2_read_tick_csv", BARS_OUT)
def s2(spark, sf):
    folder = scratch_dir(spark, "ticks")
    t = I.ticks(spark, sf)
    t.select(
        "trade_id", "price", "qty", (F.col("price") * F.col("qty")).alias("quote_qty"),
        F.unix_millis("timestamp").alias("timestamp"), "is_buyer_maker", F.lit(True).alias("is_best_match"), "symbol",
    ).write.csv(folder)
    back = src.read_ticks(spark, folder, [T.StructField("symbol", T.IntegerType())])
    return rounded(ticks_to_bars(back, ["symbol"]))


@query("s3_bar_cache", BARS_OUT)
def s3(spark, sf):
    folder = scratch_dir(spark, "cache")
    src.cached_bars(spark, folder, lambda: I.bars(spark, sf), ["symbol"])

    def rebuilt():
        raise AssertionError("the finished table must be reused")

    return rounded(src.cached_bars(spark, folder, rebuilt, ["symbol"]))


def replace_file(spark, old: str, rows) -> None:
    """Put rows in the place of one file, under its old name."""
    corrected = scratch_dir(spark, "corrected")
    rows.coalesce(1).write.parquet(corrected)
    new = spark.read.parquet(corrected).inputFiles()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path(old), False)
    files.rename(path(new), path(old))


@query("s3_bar_store", BARS_OUT)
def s3_store(spark, sf):
    """Bars by day from daily files: first without the last days and with a wrong file, then with a late and a mended one."""
    t = I.ticks(spark, sf).withColumn("part", F.date_format("timestamp", "yyyy-MM-dd"))
    source, folder = scratch_dir(spark, "trades"), scratch_dir(spark, "bar-store")
    schema = t.drop("part").schema
    read = lambda paths: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)
    days = sorted(r[0] for r in t.select("part").distinct().collect())
    late, wrong = days[len(days) // 3], days[len(days) // 2]
    on = lambda day: F.col("part") == day
    early = t.filter(~on(late)).withColumn("qty", F.when(on(wrong), F.col("qty") + 1).otherwise(F.col("qty")))
    early.repartition("part").write.partitionBy("part").parquet(source)
    assert refresh_bars(spark, source, folder, read, ["symbol"]) == [d for d in days if d != late]
    t.filter(on(late)).coalesce(1).write.mode("append").partitionBy("part").parquet(source)
    listed = spark.read.parquet(f"{source}/part={wrong}").inputFiles()[0]
    replace_file(spark, listed, t.filter(on(wrong)).drop("part"))
    assert refresh_bars(spark, source, folder, read, ["symbol"]) == sorted([late, wrong]), "other days must stay as they are"
    assert refresh_bars(spark, source, folder, read, ["symbol"]) == []
    return rounded(read_store(spark, folder).select("symbol", "date", *BAR_COLUMNS))


@query("s4_read_activity_csv", """
SELECT CAST(o_orderdate AS TIMESTAMP) AS date, o_orderpriority AS cex_name, round(o_totalprice, 2) AS total_flow,
       CAST(1 AS INT) AS address_count FROM orders""")
def s4(spark, sf):
    folder = scratch_dir(spark, "flow")
    o = I.table(spark, sf, "orders")
    o.select(
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 25 minutes")).alias("date"),
        F.col("o_orderpriority").alias("cex_name"), F.round("o_totalprice", 2).alias("total_flow"),
        F.lit(1).alias("address_count"),
    ).write.option("header", True).csv(folder)
    return src.read_activity_query(
        spark, folder, "date timestamp, cex_name string, total_flow double, address_count int")


@query("s5_incremental_ingest", f"""WITH {I.TICKS}
SELECT symbol, count(*) AS n, sum(qty) AS qty, max("timestamp") AS last_ts FROM ticks GROUP BY symbol""")
def s5(spark, sf):
    t = I.ticks(spark, sf)
    source, target, mark = (scratch_dir(spark, n) for n in ("landing", "table", "progress"))
    middle = F.timestamp_micros(F.lit(1_705_276_800_000_000))
    t.filter(F.col("timestamp") < middle).write.parquet(source)
    first = ingest_new_files(spark, source, target, mark, t.schema)
    t.filter(F.col("timestamp") >= middle).write.mode("append").parquet(source)
    second = ingest_new_files(spark, source, target, mark, t.schema)
    again = ingest_new_files(spark, source, target, mark, t.schema)
    assert first and second and not again, "each file must be taken once"
    return read_ingested(spark, target).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.max("timestamp").alias("last_ts"))


@query("s5_rewritten_file", f"""WITH {I.TICKS}
SELECT symbol, count(*) AS n, sum(CASE WHEN symbol = 3 THEN qty + 1 ELSE qty END) AS qty FROM ticks GROUP BY symbol""")
def s5_rewritten(spark, sf):
    """One file per symbol; after the first run one file is rewritten under its old name."""
    t = I.ticks(spark, sf)
    source, target = scratch_dir(spark, "landing"), scratch_dir(spark, "table")
    t.withColumn("part", F.col("symbol")).repartition("part").write.partitionBy("part").parquet(source)
    first = ingest_changed_files(spark, source, target, t.schema)
    old = spark.read.parquet(f"{source}/part=3").inputFiles()[0]
    replace_file(spark, old, t.filter("symbol = 3").withColumn("qty", F.col("qty") + 1))
    second = ingest_changed_files(spark, source, target, t.schema)
    again = ingest_changed_files(spark, source, target, t.schema)
    assert (first, second, again) == (8, 1, 0), "each version of a file must be taken once"
    return read_current(spark, target).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


LO, HI = "2024-01-05 06:00:00", "2024-01-25 18:00:00"


@query("s6_clean_ohlcv_pages", f"""WITH {I.PRICED_SQL}
SELECT series_id, date, open, high, low, close, "volume_ETH", "volume_USD" FROM priced
WHERE date BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'""")
def s6(spark, sf):
    p = I.priced(spark, sf).select(
        "series_id", F.unix_seconds("date").alias("time"), "open", "high", "low", "close",
        F.col("volume_ETH").alias("volumefrom"), F.col("volume_USD").alias("volumeto"))
    overlap = p.withColumn("volumefrom", F.col("volumefrom") + 1.0)
    pages = p.withColumn("page", F.lit(0)).unionByName(overlap.withColumn("page", F.lit(1)))
    return src.clean_ohlcv_pages(pages, F.lit(LO).cast("timestamp"), F.lit(HI).cast("timestamp"), ["series_id"], ["page"])


SENTIMENT = """
sentiment AS (
  SELECT time_bucket(INTERVAL 8 HOUR, ts) AS date, CAST(10 + count(*) % 80 AS INT) AS fg_index,
         max(event_type) AS fg_label
  FROM events GROUP BY ALL)"""


def sentiment(spark, sf):
    e = I.table(spark, sf, "events")
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 28_800) * 28_800)
    return e.groupBy(slot.alias("date")).agg(
        (F.count(F.lit(1)) % 80 + 10).cast("int").alias("fg_index"), F.max("event_type").alias("fg_label"))


@query("s7_read_sentiment_json", f"WITH {SENTIMENT} SELECT date, fg_index, fg_label FROM sentiment")
def s7(spark, sf):
    folder = scratch_dir(spark, "sentiment")
    s = sentiment(spark, sf)
    s.groupBy(F.to_date("date").alias("day")).agg(F.collect_list(F.struct(
        F.unix_seconds("date").cast("string").alias("timestamp"), F.col("fg_index").cast("string").alias("value"),
        F.col("fg_label").alias("value_classification"))).alias("data")).select("data").write.json(folder)
    return src.read_sentiment(spark, folder)


# ---- projections, filters, cleaning ----------------------------------------


@query("p1_select_rename_drop", "SELECT event_id AS trade_id, user_id, value AS price FROM events")
def p1(spark, sf):
    return I.table(spark, sf, "events").withColumnRenamed("event_id", "trade_id").withColumnRenamed("value", "price").drop(
        "ts", "event_type", "props")


@query("p2_time_range", f"SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'")
def p2(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", "ts")
    return clean.time_range(e, "ts", F.lit(LO).cast("timestamp_ntz"), F.lit(HI).cast("timestamp_ntz")).withColumn(
        "ts", F.col("ts").cast("timestamp"))


@query("p3_dedupe_keep_first", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def p3(spark, sf):
    e = I.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return clean.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("p4_drop_null_rows", finish(
    I.HOURLY_SQL + f", x AS (SELECT symbol, date, close, {B.mean('close', 24)} AS ma FROM hourly)",
    "x", ["symbol", "date", "close"], ["ma"], where="WHERE ma IS NOT NULL"))
def p4(spark, sf):
    x = I.hourly(spark, sf).select("symbol", "date", "close", I.BARS.mean("close", 24).alias("ma"))
    return rounded(clean.drop_null_rows(x))


@query("p5_drop_sparse_columns", f"""WITH {I.PRICED_SQL}
SELECT series_id, date, close, CASE WHEN hour(date) % 4 <> 0 THEN high END AS mostly_there FROM priced""")
def p5(spark, sf):
    h = F.hour("date") % 4
    x = I.priced(spark, sf).select(
        "series_id", "date", "close", F.when(h != 0, F.col("high")).alias("mostly_there"),
        F.when(h == 0, F.col("low")).alias("mostly_missing"))
    return clean.drop_sparse_columns(x, 0.5, ["series_id", "date"])


@query("p6_infinite_to_null", finish(
    I.HOURLY_SQL + f", x AS (SELECT symbol, date, {finite(ratio('close - 1.0', 'high - low'))} AS r FROM hourly)",
    "x", ["symbol", "date"], ["r"]))
def p6(spark, sf):
    x = I.hourly(spark, sf).select("symbol", "date", sratio(F.col("close") - 1.0, F.col("high") - F.col("low")).alias("r"))
    return rounded(clean.finite_columns(x, ["r"]))


@query("p7_numeric_columns", """
SELECT doc_id, n_chars, TRY_CAST(substr(source, 4) AS DOUBLE) AS source_no, TRY_CAST(lang AS DOUBLE) AS lang_no
FROM documents""")
def p7(spark, sf):
    d = I.table(spark, sf, "documents").select(
        "doc_id", "n_chars", "lang", F.substring("source", 4, 100).alias("source_no"), F.col("lang").alias("lang_no"))
    d = clean.coerce_numeric(d, ["source_no", "lang_no"])
    return d.select(*clean.numeric_columns(d))


@query("p8_exclude_noise_clusters", """
SELECT vec_id, label - 2 AS cluster_id FROM embeddings WHERE label - 2 NOT IN (-1, -2)""")
def p8(spark, sf):
    e = I.table(spark, sf, "embeddings").select("vec_id", (F.col("label") - 2).alias("cluster_id"))
    return clean.exclude_clusters(e, "cluster_id")


@query("p9_confidence_filter", f"WITH {I.PREDICTIONS_SQL} SELECT doc_id, y, score FROM predictions WHERE score >= 0.6")
def p9(spark, sf):
    return clean.confident(I.predictions(spark, sf).select("doc_id", "y", "score"), "score", 0.6)


@query("p10_chronological_split", f"""WITH {I.PRICED_SQL},
p AS (SELECT date, close, DATE '2024-01-20' AS d FROM priced)
SELECT 'disjoint_train' AS part, date, close FROM p WHERE date < d
UNION ALL SELECT 'disjoint_test', date, close FROM p WHERE date >= d
UNION ALL SELECT 'overlap_train', date, close FROM p WHERE date < d + INTERVAL 1 DAY
UNION ALL SELECT 'overlap_test', date, close FROM p WHERE date >= d""")
def p10(spark, sf):
    p = I.priced(spark, sf).select("date", "close")
    parts = zip(("disjoint_train", "disjoint_test"), clean.chronological_split(p, "date", "2024-01-20"))
    both = zip(("overlap_train", "overlap_test"), clean.chronological_split(p, "date", "2024-01-20", "reference"))
    frames = [f.select(F.lit(n).alias("part"), "date", "close") for n, f in (*parts, *both)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


MASK = f"({B.rn()} <= floor(count(*) {B.whole} * 0.7::DOUBLE))"


@query("p11_train_mask", f"WITH {I.HOURLY_SQL} SELECT symbol, date, {MASK} AS is_train FROM hourly")
def p11(spark, sf):
    return I.hourly(spark, sf).select("symbol", "date", fit.train_mask(I.BARS).alias("is_train"))


@query("p12_clip_to_bounds", f"""WITH {I.HOURLY_SQL}
SELECT symbol, date, {clip('close', 2, 10)} AS close, {clip('volume', 20, 90)} AS volume FROM hourly""")
def p12(spark, sf):
    return clean.clip_columns(I.hourly(spark, sf).select("symbol", "date", "close", "volume"),
                              {"close": (2.0, 10.0), "volume": (20.0, 90.0), "absent": (0.0, 1.0)})


MASKED = I.HOURLY_SQL + f", m AS (SELECT symbol, date, close, volume, {MASK} AS t FROM hourly)"
TR = "CASE WHEN t THEN close END"
SD_SAMPLE = f"(CASE WHEN coalesce(stddev_samp({TR}) {B.whole}, 0) = 0 THEN 1.0 ELSE stddev_samp({TR}) {B.whole} END)"
SD_POP = f"(CASE WHEN coalesce(stddev_pop({TR}) {B.whole}, 0) = 0 THEN 1.0 ELSE stddev_pop({TR}) {B.whole} END)"
WINSOR = f"least(greatest(close, {B.qwhole(TR, 0.005)}), {B.qwhole(TR, 0.995)})"


def masked(spark, sf):
    return I.hourly(spark, sf).select("symbol", "date", "close", "volume", fit.train_mask(I.BARS).alias("t"))


@query("p13_winsorise_on_train", finish(
    MASKED + f", x AS (SELECT symbol, date, {WINSOR} AS close FROM m)", "x", ["symbol", "date"], ["close"]))
def p13(spark, sf):
    return rounded(fit.winsorised(masked(spark, sf), ["symbol"], ["close"], F.col("t")).select("symbol", "date", "close"))


@query("p14_standardise_on_train", finish(
    MASKED + f", x AS (SELECT symbol, date, (close - avg({TR}) {B.whole}) / {SD_SAMPLE} AS z FROM m)",
    "x", ["symbol", "date"], ["z"]))
def p14(spark, sf):
    return rounded(masked(spark, sf).select("symbol", "date", fit.standard_over(I.BARS, "close", F.col("t")).alias("z")))


@query("p15_scaler_fit_apply", finish(
    MASKED + f", x AS (SELECT symbol, date, (close - avg({TR}) {B.whole}) / {SD_POP} AS close_scaled FROM m)",
    "x", ["symbol", "date"], ["close_scaled"]))
def p15(spark, sf):
    m = masked(spark, sf)
    params = fit.fit_params(m, ["symbol"], ["close"], F.col("t"))
    out = fit.apply_standard(m.select("symbol", "date", "close"), params, ["symbol"], ["close"], "std_pop", "_scaled")
    return rounded(out.drop("close"))


@query("b1_date_features", finish(I.TICKS, """(SELECT trade_id, "timestamp" t, hour("timestamp") h, dayofyear("timestamp") d FROM ticks)""", [
    "trade_id", "CAST(h AS INT) AS hour", "CAST(d AS INT) AS day", "CAST(isodow(t) - 1 AS INT) AS day_of_week",
    "CAST(month(t) AS INT) AS month", "CAST(h AS INT) AS hour_of_day"],
    ["sin(2 * pi() * h / 24.0) AS hour_sin", "cos(2 * pi() * h / 24.0) AS hour_cos",
     "sin(2 * pi() * d / 365.25) AS day_sin", "cos(2 * pi() * d / 365.25) AS day_cos"]))
def b1(spark, sf):
    return rounded(date_features(I.ticks(spark, sf).select("trade_id", "timestamp"), "timestamp").drop("timestamp"))


# ---- joins and alignment ---------------------------------------------------

GRID = SENTIMENT + """,
grid AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM sentiment),
sent AS (
  SELECT g.date, last_value(s.fg_index IGNORE NULLS) OVER (ORDER BY g.date) AS fg_index,
         last_value(s.fg_label IGNORE NULLS) OVER (ORDER BY g.date) AS fg_label
  FROM grid g LEFT JOIN sentiment s USING (date))"""
TYPES = ("click", "error", "purchase", "signup", "view")
PER_TYPE = "".join(f""",
t_{t} AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS date, count(*) AS n_{t} FROM events WHERE event_type = '{t}' GROUP BY ALL)"""
                   for t in TYPES)


def per_type(spark, sf, kind):
    e = I.table(spark, sf, "events").filter(F.col("event_type") == kind)
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("date")).agg(
        F.count(F.lit(1)).alias(f"n_{kind}"))


@query("j1_inner_join_on_hour", f"""WITH {I.PRICED_SQL}, {GRID}{PER_TYPE}
SELECT series_id, date, close, n_click, n_error, n_purchase, n_signup, n_view, b.qty_sum, fg_index FROM priced
JOIN (SELECT series_id, date, qty_sum FROM bars1) b USING (series_id, date) JOIN t_click USING (date) JOIN t_error USING (date)
JOIN t_purchase USING (date) JOIN t_signup USING (date) JOIN t_view USING (date) JOIN sent USING (date)""")
def j1(spark, sf):
    s = sentiment(spark, sf).withColumn("series_id", F.lit(0))
    grid = align.hourly_grid(s, ["series_id"], "date", ["fg_index"]).select("date", "fg_index")
    base = align.join_all([I.priced(spark, sf).select("series_id", "date", "close"),
                           I.series_bars(spark, sf).select("series_id", "date", "qty_sum")], ["series_id", "date"])
    return align.join_all([base, *(per_type(spark, sf, t) for t in TYPES), grid], ["date"])


@query("j2_full_outer_join_on_hour", f"""WITH base AS (SELECT 1){PER_TYPE}
SELECT date, {", ".join(f"n_{t}::DOUBLE AS n_{t}" for t in TYPES)}
FROM t_click {" ".join(f"FULL JOIN t_{t} USING (date)" for t in TYPES[1:])}""")
def j2(spark, sf):
    x = align.join_all([per_type(spark, sf, t) for t in TYPES], ["date"], "full")
    return x.select("date", *[F.col(f"n_{t}").cast("double") for t in TYPES])


SLOW = """,
slow AS (
  SELECT symbol, time_bucket(INTERVAL 8 HOUR, "timestamp") + INTERVAL 30 MINUTE AS date,
         CASE WHEN count(*) % 5 = 0 THEN NULL ELSE sum(qty) END AS level FROM ticks GROUP BY ALL)"""


def slow_level(spark, sf):
    t = I.ticks(spark, sf)
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / 28_800) * 28_800 + 1_800)
    return t.groupBy("symbol", slot.alias("date")).agg(
        F.when(F.count(F.lit(1)) % 5 == 0, None).otherwise(F.sum("qty")).alias("level"))


@query("j3_asof_join", f"""WITH {I.HOURLY_SQL}{SLOW}
SELECT h.symbol, h.date, h.close, s.level FROM hourly h ASOF LEFT JOIN slow s ON h.symbol = s.symbol AND h.date >= s.date""")
def j3(spark, sf):
    return align.asof_join(I.hourly(spark, sf).select("symbol", "date", "close"), slow_level(spark, sf), ["symbol"], "date", ["level"])


@query("j3_asof_join_of_trades", f"""WITH {I.HOURLY_SQL}{SLOW}
SELECT t.symbol, t.trade_id, t.price, s.level FROM ticks t ASOF LEFT JOIN slow s ON t.symbol = s.symbol AND t."timestamp" >= s.date""")
def j3_trades(spark, sf):
    t = I.ticks(spark, sf).select("symbol", "trade_id", F.col("timestamp").alias("date"), "price")
    return align.asof_join_in_buckets(t, slow_level(spark, sf), ["symbol"], "date", ["level"]).drop("date")


@query("j3b_merge_slow_sources", f"""WITH {I.HOURLY_SQL}{SLOW},
v AS (SELECT symbol, date - INTERVAL 3 HOUR AS date, level * 2 AS vix FROM slow)
SELECT h.symbol, h.date, h.close, s.level, v.vix FROM hourly h
ASOF LEFT JOIN slow s ON h.symbol = s.symbol AND h.date >= s.date
ASOF LEFT JOIN v ON h.symbol = v.symbol AND h.date >= v.date""")
def j3b(spark, sf):
    s = slow_level(spark, sf)
    v = s.select("symbol", (F.col("date") - F.expr("interval 3 hours")).alias("date"), (F.col("level") * 2).alias("vix"))
    return align.merge_slow_series(
        I.hourly(spark, sf).select("symbol", "date", "close"), [(s, "level"), (v, "vix")], ["symbol"], "date")


@query("j5_interval_containment", f"""WITH {I.EVENTS_SQL},
c AS (SELECT symbol, event_id, t_start, coalesce(t_end, (SELECT max(date) FROM hourly h WHERE h.symbol = t1.symbol)) AS t_end FROM t1)
SELECT c.symbol, event_id, date, close FROM c JOIN hourly h ON h.symbol = c.symbol AND h.date BETWEEN t_start AND t_end""")
def j5(spark, sf):
    from ..operators.labels import close_open_ends

    b = I.hourly(spark, sf).select("symbol", "date", "close")
    e = close_open_ends(I.events_t1(spark, sf), b, ["symbol"], "t_end", "date")
    return align.interval_join(e, b, ["symbol"], "t_start", "t_end", "date").select("symbol", "event_id", "date", "close")


@query("j6_lookup_with_defaults", """
SELECT e.vec_id, e.label - 1 AS cluster_id,
       coalesce(r.r_name, CASE WHEN e.label - 1 = -1 THEN 'noise' ELSE 'unknown' END) AS strategy_name
FROM embeddings e LEFT JOIN region r ON r.r_regionkey = e.label - 1""")
def j6(spark, sf):
    e = I.table(spark, sf, "embeddings").select("vec_id", (F.col("label") - 1).alias("cluster_id"))
    r = I.table(spark, sf, "region").select(F.col("r_regionkey").alias("cluster_id"), F.col("r_name").alias("strategy_name"))
    return align.lookup(e, r, "cluster_id", "strategy_name").select("vec_id", "cluster_id", "strategy_name")


@query("j7_hourly_grid", f"""WITH {I.HOURLY_SQL},
g AS (SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM hourly GROUP BY symbol)
SELECT symbol, date, last_value(close IGNORE NULLS) {B.sofar} AS close FROM g LEFT JOIN (SELECT symbol, date, close FROM hourly) USING (symbol, date)""")
def j7(spark, sf):
    return align.hourly_grid(I.hourly(spark, sf), ["symbol"], "date", ["close"])


@query("j8_floor_to_hour", "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS hour_ts FROM events")
def j8(spark, sf):
    return I.table(spark, sf, "events").select("event_id", align.floor_hour(F.col("ts").cast("timestamp")).alias("hour_ts"))


@query("u1_union_keep_first", f"""WITH base AS (SELECT 1){PER_TYPE},
u AS ({" UNION ALL ".join(f"SELECT {i} AS src, date, {', '.join(f'n_{t}' if t == x else f'NULL::BIGINT AS n_{t}' for t in TYPES)} FROM t_{x}" for i, x in enumerate(TYPES))})
SELECT date, {", ".join(f"n_{t}::DOUBLE AS n_{t}" for t in TYPES)} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY src) k FROM u) WHERE k = 1""")
def u1(spark, sf):
    x = align.union_keep_first([per_type(spark, sf, t) for t in TYPES], ["date"])
    return x.select("date", *[F.col(f"n_{t}").cast("double") for t in TYPES])


@query("e1_row_index", f"""WITH {I.TICKS}
SELECT symbol, trade_id, row_number() OVER (PARTITION BY symbol ORDER BY "timestamp", trade_id) - 1 AS row_index,
       count(*) OVER (PARTITION BY symbol) AS n FROM ticks""")
def e1(spark, sf):
    t = I.ticks(spark, sf).select("symbol", "trade_id", "timestamp")
    return align.row_index(t, ["symbol"], ["timestamp", "trade_id"], F.date_trunc("hour", "timestamp"), total="n").drop("timestamp")


# ---- aggregations ----------------------------------------------------------


@query("a2_flow_totals", """
SELECT CAST(o_orderdate AS TIMESTAMP) AS date, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS total_flow_sum,
       CAST(count(*) AS DOUBLE) AS address_count_sum FROM orders GROUP BY o_orderdate""")
def a2(spark, sf):
    o = I.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("date"), F.floor("o_totalprice").alias("flow"), F.lit(1).alias("one"))
    return align.flow_totals(o, "date", {"flow": "total_flow_sum", "one": "address_count_sum"})


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("a2b_flow_pivot", "SELECT CAST(o_orderdate AS TIMESTAMP) AS date, " + ", ".join(
    f"""CAST(sum(floor(o_totalprice)) FILTER (o_orderpriority = '{p}') AS DOUBLE) AS "{p}" """ for p in PRIORITIES)
    + "FROM orders GROUP BY o_orderdate")
def a2b(spark, sf):
    o = I.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("date"), "o_orderpriority", F.floor("o_totalprice").cast("double").alias("flow"))
    return align.flow_pivot(o, "date", "o_orderpriority", "flow", PRIORITIES)


PROFILE = I.DAILY_SQL + """,
span AS (SELECT series, min(low) AS lo, max(high) AS hi FROM daily GROUP BY series),
edges AS (SELECT series, CAST(i AS INT) AS bin, lo + i * ((hi - lo) / 20) AS lower,
                 CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 20) END AS upper
          FROM span, generate_series(0, 19) t(i)),
bins AS (SELECT e.series, bin, lower, upper, coalesce(sum("volume_USD"), 0) AS volume
         FROM edges e LEFT JOIN daily d ON d.series = e.series AND low < upper AND high > lower GROUP BY ALL)"""


@query("a3_volume_by_price_bins", finish(PROFILE, "bins", ["series", "bin"], ["lower", "upper", "volume"]))
def a3(spark, sf):
    return rounded(profile.volume_bins(I.ohlcv_daily(spark, sf), ["series"]))


STATS = PROFILE + """,
ranked AS (SELECT *, (lower + upper) / 2 AS mid,
             sum(volume) OVER (PARTITION BY series ORDER BY volume DESC, bin DESC ROWS UNBOUNDED PRECEDING) AS cum,
             sum(volume) OVER (PARTITION BY series) AS total FROM bins),
stats AS (SELECT series, avg(volume) AS vbp_mean, max(volume) AS vbp_max, stddev_pop(volume) AS vbp_std,
            arg_min(mid, row(-volume, bin)) AS poc_price,
            max(mid) FILTER (cum <= total * 0.7::DOUBLE) AS vah_price, min(mid) FILTER (cum <= total * 0.7::DOUBLE) AS val_price
          FROM ranked GROUP BY series),
mean AS (SELECT series, sum(close * "volume_USD") / sum("volume_USD") AS vwap FROM daily GROUP BY series),
wav AS (SELECT d.series, max(vwap) AS vwap, sqrt(sum((close - vwap) * (close - vwap) * "volume_USD") / sum("volume_USD")) AS vwap_std
        FROM daily d JOIN mean USING (series) GROUP BY d.series)"""


@query("a4_point_of_control", finish(STATS, "stats", ["series"], ["poc_price"]))
def a4(spark, sf):
    return rounded(profile.bin_statistics(profile.volume_bins(I.ohlcv_daily(spark, sf), ["series"]), ["series"]).select("series", "poc_price"))


@query("a5_value_area", finish(STATS, "stats", ["series"], ["vbp_mean", "vbp_max", "vbp_std", "vah_price", "val_price"]))
def a5(spark, sf):
    bins = profile.volume_bins(I.ohlcv_daily(spark, sf), ["series"])
    return rounded(profile.bin_statistics(bins, ["series"]).drop("poc_price"))


@query("a6_vwap", finish(STATS, "wav", ["series"], ["vwap", "vwap_std"]))
def a6(spark, sf):
    return rounded(profile.vwap(I.ohlcv_daily(spark, sf), ["series"]))


FIT = ", ".join(
    f"SELECT symbol, '{c}' AS \"column\", count({c}) FILTER (t) AS n, avg({c}) FILTER (t) AS mean, stddev_samp({c}) FILTER (t) AS std, "
    f"stddev_pop({c}) FILTER (t) AS std_pop, quantile_cont({c}, 0.005) FILTER (t) AS q_005, "
    f"quantile_cont({c}, 0.995) FILTER (t) AS q_995 FROM m GROUP BY symbol" for c in ("close", "volume")
).replace(", SELECT symbol", " UNION ALL SELECT symbol")


@query("a7_fit_parameters", finish(MASKED + f", f AS ({FIT})", "f", ["symbol", '"column"', "n"],
                                   ["mean", "std", "std_pop", "q_005", "q_995"]))
def a7(spark, sf):
    return rounded(fit.fit_params(masked(spark, sf), ["symbol"], ["close", "volume"], F.col("t"), (0.005, 0.995)))


@query("a8_null_counts", f"""WITH {I.DRIVERS_SQL}, x AS (SELECT *, {S.lag('tx_count', 24)} AS tx_lag FROM drivers)
SELECT count(*) FILTER (velocity_stablecoin_24h IS NULL) AS velocity_stablecoin_24h, count(*) FILTER (tx_lag IS NULL) AS tx_lag FROM x""")
def a8(spark, sf):
    x = I.drivers(spark, sf).select("velocity_stablecoin_24h", I.SERIES.lag("tx_count", 24).alias("tx_lag"))
    return clean.null_counts(x)


@query("a9_series_zscore", finish(
    I.HOURLY_SQL + f", x AS (SELECT symbol, date, (close - avg(close) {B.whole}) / (stddev_samp(close) {B.whole} + 1e-8) AS z FROM hourly)",
    "x", ["symbol", "date"], ["z"]))
def a9(spark, sf):
    return rounded(I.hourly(spark, sf).select("symbol", "date", I.BARS.series_zscore("close").alias("z")))


@query("a10_quantile_flags", f"""WITH {I.HOURLY_SQL}
SELECT symbol, date, {flag(f"close > {B.qwhole('close', 0.75)}")} AS over_q75, {flag(f"close >= {B.qwhole('close', 0.7)}")} AS ge_q70,
       {flag(f"close <= {B.qwhole('close', 0.3)}")} AS le_q30,
       CASE WHEN close > {B.qwhole('close', 0.9)} THEN 1 WHEN close < {B.qwhole('close', 0.1)} THEN -1 ELSE 0 END AS tail
FROM hourly""")
def a10(spark, sf):
    h, c = I.hourly(spark, sf), F.col("close")
    x = fit.with_quantiles(h, ["symbol"], {"close": c}, {f"p{q}": q / 100 for q in (10, 30, 70, 75, 90)})
    at = lambda q: F.col(f"_q_close.p{q}")
    return x.select("symbol", "date", sflag(c > at(75)).alias("over_q75"), sflag(c >= at(70)).alias("ge_q70"), sflag(c <= at(30)).alias("le_q30"),
                    F.when(c > at(90), 1).when(c < at(10), -1).otherwise(0).alias("tail"))


@query("a11_category_codes", """
WITH c AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS code FROM (SELECT DISTINCT event_type FROM events))
SELECT event_id, event_type, code FROM events JOIN c USING (event_type)""")
def a11(spark, sf):
    return fit.category_codes(I.table(spark, sf, "events").select("event_id", "event_type"), "event_type", "code")


@query("a12_class_balance", finish(I.PREDICTIONS_SQL + """,
c AS (SELECT fold, count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos,
             count(*) FILTER (y = 0) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE AS pos_weight FROM predictions GROUP BY fold)""",
                                   "c", ["fold", "n_neg", "n_pos"], ["pos_weight"]))
def a12(spark, sf):
    return rounded(fit.class_balance(I.predictions(spark, sf), "y", ["fold"]))
