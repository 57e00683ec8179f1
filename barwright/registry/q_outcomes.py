"""Labels, weights, sequences, folds, metrics, reports, training."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import losses
from ..functions.scalar import argmax, sigmoid, softmax
from ..operators import labels as L
from ..operators import metrics as M
from ..operators.align import row_index
from ..operators.clean import finite_columns, numeric_columns
from ..plans import pipeline, report, training
from ..plans.orderbook import orderbook_features
from ..plans.price import price_features
from ..session import cut_lineage, scratch_dir
from ..sources import reports as rsrc
from . import inputs as I
from .core import finish, query, rounded
from .q_tables import SLOW, slow_level
from .sql import Win, flag

B, S = Win("symbol"), Win("series_id")
KEY = ["symbol"]

# ---- labels and weights ----------------------------------------------------


@query("l1_direction_label", f"""WITH {I.HOURLY_SQL}
SELECT symbol, date, {flag(f"{B.lead('close', 4)} > close")} AS labels,
       CASE WHEN {B.lead('close', 4)} IS NOT NULL THEN {flag(f"{B.lead('close', 4)} > close")}::DOUBLE END AS labels_open FROM hourly""")
def l1(spark, sf):
    return I.hourly(spark, sf).select(
        "symbol", "date", L.direction_label(I.BARS, "close").alias("labels"),
        L.direction_label(I.BARS, "close", open_tail="null").cast("double").alias("labels_open"))


CLOSED = I.EVENTS_SQL + """,
tc AS (SELECT symbol, event_id, t_start, coalesce(t_end, (SELECT max(date) FROM hourly h WHERE h.symbol = t1.symbol)) AS t_end FROM t1),
pairs AS MATERIALIZED (SELECT tc.symbol, event_id, date FROM tc JOIN hourly h ON h.symbol = tc.symbol AND date BETWEEN t_start AND t_end),
conc AS MATERIALIZED (
  SELECT h.symbol, h.date, count(event_id) AS n_open FROM hourly h
  JOIN (SELECT symbol, min(t_start) AS a, max(t_end) AS b FROM tc GROUP BY symbol) r ON r.symbol = h.symbol AND h.date BETWEEN a AND b
  LEFT JOIN pairs p ON p.symbol = h.symbol AND p.date = h.date GROUP BY ALL)"""


@query("l2_concurrency", f"WITH {CLOSED} SELECT symbol, date, n_open FROM conc")
def l2(spark, sf):
    return L.concurrency(I.hourly(spark, sf), I.events_t1(spark, sf), KEY, "date")


@query("l3_indicator_pairs", f"WITH {CLOSED} SELECT symbol, event_id, date FROM pairs")
def l3(spark, sf):
    return L.indicator_pairs(I.hourly(spark, sf), I.events_t1(spark, sf), KEY, ts="date")


@query("l4_average_uniqueness", finish(CLOSED + """,
u AS (SELECT symbol, event_id, avg(1.0::DOUBLE / n_open) AS avg_uniqueness FROM pairs JOIN conc USING (symbol, date) GROUP BY ALL)""",
                                       "u", ["symbol", "event_id"], ["avg_uniqueness"]))
def l4(spark, sf):
    x = L.average_uniqueness(I.hourly(spark, sf), I.events_t1(spark, sf), KEY, "date")
    return rounded(x.select("symbol", "event_id", "avg_uniqueness"))


#: One step draws by the running totals of all uniqueness means, taken from the counts that the chain carries along.
DRAWS = CLOSED + """,
ev AS (SELECT tc.symbol, event_id, count(*) FILTER (h.date < t_start) AS lo, count(*) FILTER (h.date <= t_end) AS hi
       FROM tc JOIN hourly h ON h.symbol = tc.symbol GROUP BY ALL),
packed AS MATERIALIZED (SELECT symbol, list(event_id ORDER BY event_id) AS ids, list(lo ORDER BY event_id) AS los, list(hi ORDER BY event_id) AS his, max(hi) AS bars
                        FROM ev GROUP BY symbol),
chain AS (
  SELECT symbol, r.range AS replica, -1::BIGINT AS draw, NULL::INT AS event_id, list_transform(range(bars), lambda b: 0) AS taken FROM packed, range(4) r
  UNION ALL
  SELECT symbol, replica, draw, ids[k], list_transform(taken, lambda t, b: t + CASE WHEN b > los[k] AND b <= his[k] THEN 1 ELSE 0 END)
  FROM (SELECT *, 1 + len(list_filter(totals, lambda x: x <= u * totals[-1])) AS k
        FROM (SELECT *, list_transform(range(1, len(ids) + 1), lambda j: list_sum(shares[1:j])) AS totals
              FROM (SELECT c.symbol, replica, draw + 1 AS draw, taken, ids, los, his,
                      ('0x' || substr(md5('11:' || c.symbol || ':' || replica || ':' || (draw + 1)), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u,
                      list_transform(range(1, len(ids) + 1), lambda j: list_sum(list_transform(taken[los[j] + 1:his[j]], lambda t: 1::DOUBLE / (1 + t))) / (his[j] - los[j])) AS shares
                    FROM chain c JOIN packed p ON c.symbol = p.symbol WHERE draw + 1 < len(ids)))))"""


@query("l5_sequential_bootstrap", f"WITH RECURSIVE {DRAWS} SELECT symbol, replica::INT AS replica, draw::INT AS draw, event_id FROM chain WHERE draw >= 0")
def l5(spark, sf):
    return L.sequential_bootstrap(I.hourly(spark, sf), I.events_t1(spark, sf), KEY, replicas=4, seed=11, ts="date")


@query("l6_sample_weights", finish(CLOSED + f""",
ret AS (SELECT symbol, date, {B.logret('close')} AS r FROM hourly),
raw AS (SELECT p.symbol, p.event_id, sum(r / n_open) AS s FROM pairs p JOIN conc USING (symbol, date) JOIN ret USING (symbol, date) GROUP BY ALL),
w0 AS (SELECT symbol, event_id, abs(coalesce(s, 0) * exp(-0.01 * floor((epoch(max(t_start) OVER (PARTITION BY symbol)) - epoch(t_start)) / 86400))) AS w
       FROM raw JOIN tc USING (symbol, event_id)),
w1 AS (SELECT symbol, event_id, w * count(*) OVER (PARTITION BY symbol) / sum(w) OVER (PARTITION BY symbol) AS weight FROM w0)""",
                                   "w1", ["symbol", "event_id"], ["weight"]))
def l6(spark, sf):
    x = L.sample_weights(I.hourly(spark, sf), I.events_t1(spark, sf), KEY, ts="date")
    return rounded(x.select("symbol", "event_id", "weight"))


LEAD4 = flag(f"{B.lead('close', 4)} > close")
UP = f", lab AS (SELECT symbol, date, rn, close, volume, {LEAD4} AS y FROM hourly)"


def labelled(spark, sf):
    return I.hourly(spark, sf).withColumn("y", L.direction_label(I.BARS, "close"))


@query("l7_predictability_score", finish(
    I.HOURLY_SQL + UP + """,
x AS (SELECT a.symbol, a.date, avg(CAST(a.y = b.y AS DOUBLE)) AS score FROM lab a JOIN lab b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 2 AND a.rn + 2 GROUP BY ALL)""",
    "x", ["symbol", "date"], ["score"]))
def l7(spark, sf):
    x = labelled(spark, sf)
    return rounded(x.select("symbol", "date", L.predictability(I.BARS, "y").alias("score")))


SEQ = I.HOURLY_SQL + UP + f""",
sq AS (SELECT symbol, first_value(date) {B.last(20)} AS start_ts, date AS end_ts,
  list(close) {B.last(20)} AS cl, list(volume) {B.last(20)} AS vl, y, volume AS weight, count(*) {B.last(20)} AS k FROM lab)"""


def seq(spark, sf):
    return L.sequences(labelled(spark, sf), I.BARS, ["close", "volume"], 20, "y", "volume")


@query("l8_sliding_windows", finish(SEQ, "sq", ["symbol", "start_ts", "end_ts", "y"], [
    "cl[1] AS first_close", "cl[20] AS last_close", "list_sum(cl) AS sum_close", "list_sum(vl) AS sum_volume", "weight"], where="WHERE k = 20"))
def l8(spark, sf):
    x = seq(spark, sf)
    total = lambda i: F.aggregate("x", F.lit(0.0), lambda a, v: a + v[i])
    return rounded(x.select(
        "symbol", "start_ts", "end_ts", "y", F.col("x")[0][0].alias("first_close"), F.col("x")[19][0].alias("last_close"),
        total(0).alias("sum_close"), total(1).alias("sum_volume"), "weight"))


def stats_sql(n: int = 20, k: int = 10) -> tuple[str, list[str]]:
    full, first, last = B.last(n), B.rows(n - 1, -(n - k)), B.last(k)
    e: dict[str, str] = {}
    for c in ("close", "volume"):
        for tag, fr in (("", full), ("_sub_first", first), ("_sub_last", last)):
            e |= {f"{c}{tag}_mean": f"avg({c}) {fr}", f"{c}{tag}_std": f"stddev_samp({c}) {fr}", f"{c}{tag}_min": f"min({c}) {fr}",
                  f"{c}{tag}_max": f"max({c}) {fr}", f"{c}{tag}_last": f"last_value({c}) {fr}",
                  f"{c}{tag}_diff": f"last_value({c}) {fr} - first_value({c}) {fr}"}
        e[f"{c}_skew"] = f"skewness({c}) {full}"
        e[f"{c}_kurtosis"] = f"kurtosis({c}) {full}"
        fr = B.last(n - 1)
        e[f"{c}_autocorr1"] = f"CASE WHEN max({c}) {fr} > min({c}) {fr} AND max(p_{c}) {fr} > min(p_{c}) {fr} THEN corr({c}, p_{c}) {fr} END"
        for q in (10, 25, 50, 75, 90):
            e[f"{c}_p{q}"] = f"quantile_cont({c}, {q / 100}) {full}"
    for tag, fr in (("", full), ("_sub_first", first), ("_sub_last", last)):
        e |= {f"date{tag}_mean": f"avg(d) {fr}", f"date{tag}_std": f"stddev_samp(d) {fr}", f"date{tag}_min": f"min(d) {fr}", f"date{tag}_max": f"max(d) {fr}",
              f"date{tag}_last": f"last_value(d) {fr}", f"date{tag}_diff": f"last_value(d) {fr} - first_value(d) {fr}"}
    text = I.HOURLY_SQL + f""",
st0 AS (SELECT symbol, date, close, volume, epoch(date) AS d, {B.lag('close')} AS p_close, {B.lag('volume')} AS p_volume, rn FROM hourly),
st AS (SELECT symbol, date, rn, {', '.join(f'{v} AS {n}' for n, v in e.items())} FROM st0)"""
    return text, list(e)


STATS, STAT_COLS = stats_sql()
NUMBER_COLS = [c for c in STAT_COLS if not c.startswith("date")]
NUMBERS_OUT = finish(STATS, "st", ["symbol", "date"], NUMBER_COLS, where="WHERE rn >= 19")


def stat_source(spark, sf):
    return I.hourly(spark, sf).select("symbol", "date", "close", "volume")


@query("l9_window_statistics", NUMBERS_OUT)
def l9(spark, sf):
    return rounded(L.window_statistics(stat_source(spark, sf), I.BARS, ["close", "volume"], 20))


@query("l9_window_statistics_with_gaps", NUMBERS_OUT)
def l9_gaps(spark, sf):
    return rounded(L.window_statistics(stat_source(spark, sf), I.BARS, ["close", "volume"], 20, gaps=True))


@query("l9_timestamp_statistics", finish(STATS, "st", ["symbol", "date"], [c for c in STAT_COLS if c.startswith("date")], 3, where="WHERE rn >= 19"))
def l9_times(spark, sf):
    return rounded(L.window_statistics(stat_source(spark, sf), I.BARS, [], 20, times=["date"]), 3)


def sequence_sql(base: str) -> str:
    return f"""WITH {SEQ},
s0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_ts) - 1 AS g, epoch(start_ts) - epoch(min(start_ts) OVER (PARTITION BY symbol)) AS passed
       FROM sq WHERE k = 20),
s1 AS (SELECT *, CASE WHEN g % 5 = 4 THEN NULL ELSE CAST(g % 5 - 1 AS INT) END AS c, CAST({base} AS BIGINT) AS base FROM s0)
SELECT symbol, CAST(g AS VARCHAR) AS group_id, base + t AS time_idx, CAST(y AS DOUBLE) AS target, cl[t + 1] AS close, vl[t + 1] AS volume,
       c AS original_cluster_id, coalesce(r_name, 'unknown') AS strategy_name
FROM s1 CROSS JOIN generate_series(0, 19) q(t) LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 2) ON r_regionkey = c
WHERE coalesce(c, -2) NOT IN (-1, -2)"""


def clustered(spark, sf):
    """Samples with their number, every fifth without a cluster, and the names of two clusters."""
    g = F.row_number().over(Window.partitionBy("symbol").orderBy("start_ts")) - 1
    samples = seq(spark, sf).withColumn("_g", g).withColumn(
        "cluster_id", F.when(F.col("_g") % 5 == 4, None).otherwise((F.col("_g") % 5 - 1).cast("int")))
    names = I.table(spark, sf, "region").filter("r_regionkey < 2").select(
        F.col("r_regionkey").cast("int").alias("cluster_id"), F.col("r_name").alias("strategy_name"))
    return samples, names


@query("l10_sequence_table", sequence_sql("passed // 3600"))
def l10(spark, sf):
    samples, names = clustered(spark, sf)
    return L.sequence_table(samples.drop("_g"), KEY, ["close", "volume"], names)


@query("l10_sequence_table_by_number", sequence_sql("floor(g * 2.5::DOUBLE)"))
def l10_by_number(spark, sf):
    samples, names = clustered(spark, sf)
    numbered = samples.withColumn("start_row", F.col("_g") * F.lit(2.5)).drop("_g", "start_ts")
    return L.sequence_table(numbered, KEY, ["close", "volume"], names, start="start_row")


@query("l11_walk_forward_folds", f"""WITH {I.HOURLY_SQL},
f AS (SELECT symbol, date, CAST(fold AS INT) AS fold, rn, n - (5 - fold) * (n // 6) AS b, n // 6 AS size FROM hourly CROSS JOIN generate_series(0, 4) t(fold))
SELECT symbol, date, fold, CASE WHEN rn < b THEN 'train' ELSE 'test' END AS role FROM f WHERE rn < b + size""")
def l11(spark, sf):
    h = I.hourly(spark, sf).select("symbol", "date")
    x = row_index(h, KEY, ["date"], F.date_trunc("day", "date"), total="n")
    return L.walk_forward_folds(x, "row_index", "n").select("symbol", "date", "fold", "role")


@query("l12_hour_index", "SELECT event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS time_idx, 0 AS series_id FROM events")
def l12(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", L.hour_index("ts").alias("time_idx"), F.lit(0).alias("series_id"))


# ---- metrics ---------------------------------------------------------------

P, PM = I.PREDICTIONS_SQL, I.MULTI_SQL


@query("m1_sigmoid_threshold", finish(P, "(SELECT *, 1 / (1 + exp(-logit)) AS p FROM predictions)", [
    "doc_id", f"{flag('p > 0.5')} AS above", f"{flag('p >= 0.5')} AS at_least"], ["p"]))
def m1(spark, sf):
    x = I.predictions(spark, sf).select("doc_id", sigmoid("logit").alias("p"))
    return rounded(x.select("doc_id", (F.col("p") > 0.5).cast("int").alias("above"), (F.col("p") >= 0.5).cast("int").alias("at_least"), "p"))


SOFT = PM + """,
sm AS (SELECT *, exp(s0) + exp(s1) + exp(s2) AS z,
         CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS pred FROM multi)"""


def multi(spark, sf):
    x = I.predictions_multi(spark, sf)
    return x.withColumn("pred", argmax([F.col(f"s{i}") for i in range(3)]))


@query("m2_softmax_argmax", finish(SOFT, "sm", ["vec_id", "pred"], [f"exp(s{i}) / z AS p{i}" for i in range(3)]))
def m2(spark, sf):
    probs = softmax([F.col(f"s{i}") for i in range(3)])
    return rounded(multi(spark, sf).select("vec_id", "pred", *[p.alias(f"p{i}") for i, p in enumerate(probs)]))


SCORED = P + """,
c AS (SELECT fold, count(*) FILTER (p AND y = 1)::DOUBLE AS tp, count(*) FILTER (p AND y = 0)::DOUBLE AS fp,
        count(*) FILTER (NOT p AND y = 1)::DOUBLE AS fn, count(*) FILTER (NOT p AND y = 0)::DOUBLE AS tn
      FROM (SELECT *, score > 0.5 AS p FROM predictions) GROUP BY fold),
s AS (SELECT fold, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
        coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


def scored(spark, sf):
    x = I.predictions(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return M.classification_scores(x, ["fold"], "y", "pred")


@query("m3_classification_scores", finish(SCORED, "s", ["fold"], ["accuracy", "precision", "recall", "f1"]))
def m3(spark, sf):
    return rounded(scored(spark, sf))


@query("m4_quadratic_kappa", finish(SOFT + """,
o AS (SELECT batch, sum((y - pred) * (y - pred))::DOUBLE / count(*) AS o FROM sm GROUP BY batch),
m AS (SELECT batch, count(*) AS n FROM sm GROUP BY batch),
ex AS (SELECT a.batch, sum((a.v - b.v) * (a.v - b.v) * a.c * b.c)::DOUBLE / max(n) / max(n) AS e
       FROM (SELECT batch, y AS v, count(*) AS c FROM sm GROUP BY ALL) a JOIN (SELECT batch, pred AS v, count(*) AS c FROM sm GROUP BY ALL) b USING (batch)
       JOIN m USING (batch) GROUP BY a.batch),
k AS (SELECT batch, 1 - o / e AS qwk FROM o JOIN ex USING (batch))""", "k", ["batch"], ["qwk"]))
def m4(spark, sf):
    return rounded(M.quadratic_kappa(multi(spark, sf), ["batch"], "y", "pred"))


@query("m5_selective_accuracy", finish(SOFT + ", k AS (SELECT batch, coalesce(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) FILTER (pred IN (0, 2)), 0) AS selective_accuracy FROM sm GROUP BY batch)",
                                       "k", ["batch"], ["selective_accuracy"]))
def m5(spark, sf):
    return rounded(M.selective_accuracy(multi(spark, sf), ["batch"], "y", "pred"))


@query("m6_bce_with_logits", finish(P + ", k AS (SELECT fold, avg(3.0 * y * ln(1 + exp(-logit)) + (1 - y) * ln(1 + exp(logit))) AS bce FROM predictions GROUP BY fold)",
                                    "k", ["fold"], ["bce"]))
def m6(spark, sf):
    return rounded(M.mean_loss(I.predictions(spark, sf), ["fold"], losses.bce_with_logits("logit", "y", 3.0), "bce"))


FOCAL = P + """,
q AS (SELECT *, greatest(least(1 / (1 + exp(-logit)), 1 - 1e-6), 1e-6) AS p FROM predictions),
fl AS (SELECT *, -0.25 * (1 - p) ** 2 * y * ln(p) - 0.75 * p ** 2 * (1 - y) * ln(1 - p) AS loss FROM q)"""


@query("m7_focal_loss", finish(FOCAL + ", k AS (SELECT fold, avg(loss) AS focal_mean, sum(loss) AS focal_sum FROM fl GROUP BY fold)",
                               "k", ["fold"], ["focal_mean", "focal_sum"]))
def m7(spark, sf):
    x = I.predictions(spark, sf).withColumn("loss", losses.focal_loss("logit", "y"))
    return rounded(x.groupBy("fold").agg(F.avg("loss").alias("focal_mean"), F.sum("loss").alias("focal_sum")))


@query("m7b_focal_derivatives", finish(P + """,
q AS (SELECT doc_id, y::DOUBLE AS y, 1 / (1 + exp(-logit)) AS p FROM predictions),
k AS (SELECT doc_id,
  0.25 * y * (1 - p) ** 2 * (2 * p * ln(p + 1e-12) + p - 1) + 0.75 * (1 - y) * p ** 2 * (p - 2 * (1 - p) * ln(1 - p + 1e-12)) AS grad,
  (0.25 * y * (1 - p) ** 2 * (2 * (1 - p - p * ln(p + 1e-12)) + 1) + 0.75 * (1 - y) * p ** 2 * (2 * (p - (1 - p) * ln(1 - p + 1e-12)) + 1)) * p * (1 - p) AS hess FROM q)""",
                                       "k", ["doc_id"], ["grad", "hess"]))
def m7b(spark, sf):
    return rounded(I.predictions(spark, sf).select(
        "doc_id", losses.focal_gradient("logit", "y").alias("grad"), losses.focal_hessian("logit", "y").alias("hess")))


@query("m8_listnet_loss", finish(P + """,
z AS (SELECT fold, ln(sum(exp(logit))) AS lse, sum(exp(y)) AS zt FROM predictions GROUP BY fold),
k AS (SELECT fold, -sum(exp(y) / zt * (logit - lse)) AS listnet FROM predictions JOIN z USING (fold) GROUP BY fold)""", "k", ["fold"], ["listnet"]))
def m8(spark, sf):
    return rounded(M.listnet_loss(I.predictions(spark, sf), ["fold"], "y", "logit"))


@query("m9_quantile_loss", finish(PM + """,
k AS (SELECT batch, avg(greatest(-0.9 * (y - s0), 0.1 * (y - s0)) + greatest(-0.5 * (y - s1), 0.5 * (y - s1)) + greatest(-0.1 * (y - s2), 0.9 * (y - s2))) AS pinball
      FROM multi GROUP BY batch)""", "k", ["batch"], ["pinball"]))
def m9(spark, sf):
    loss = losses.pinball_loss({0.1: F.col("s0"), 0.5: F.col("s1"), 0.9: F.col("s2")}, F.col("y"))
    return rounded(M.mean_loss(I.predictions_multi(spark, sf), ["batch"], loss, "pinball"))


MSLE = P + ", k AS (SELECT fold, avg((ln(1 + y) - ln(1 + score)) ** 2) AS msle FROM predictions GROUP BY fold)"


@query("m10_mean_squared_log_error", finish(MSLE, "k", ["fold"], ["msle"]))
def m10(spark, sf):
    return rounded(M.mean_loss(I.predictions(spark, sf), ["fold"], losses.squared_log_error("y", "score"), "msle"))


@query("m11_kl_divergence", finish(PM + """,
r AS (SELECT batch, min(s0) AS lo, max(s0) AS hi FROM multi GROUP BY batch),
a AS (SELECT batch, least(floor((s0 - lo) * 50.0 / (hi - lo)), 49) AS b, count(*) AS c FROM multi JOIN r USING (batch) GROUP BY ALL),
p AS (SELECT batch, least(floor((s1 - lo) * 50.0 / (hi - lo)), 49) AS b, count(*) AS c FROM multi JOIN r USING (batch) WHERE s1 BETWEEN lo AND hi GROUP BY ALL),
n AS (SELECT batch, sum(c) AS na FROM a GROUP BY batch), m AS (SELECT batch, sum(c) AS np FROM p GROUP BY batch),
j AS (SELECT a.batch, a.c / na AS pa, coalesce(p.c, 0) / np AS pp FROM a JOIN n USING (batch) JOIN m USING (batch) LEFT JOIN p ON p.batch = a.batch AND p.b = a.b),
k AS (SELECT batch, sum(CASE WHEN pp = 0 THEN 'inf'::DOUBLE ELSE pa * ln(pa / pp) END) AS kl, sum(CASE WHEN pp = 0 THEN 0 ELSE pa * ln(pa / pp) END) AS kl_shared FROM j GROUP BY batch)""",
                                   "k", ["batch"], ["kl"]))
def m11(spark, sf):
    return rounded(M.kl_histograms(I.predictions_multi(spark, sf), ["batch"], "s0", "s1"))


GRID = [round(0.1 + 0.05 * i, 2) for i in range(17)]
SWEEP = P + f""",
g AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in GRID)}]) AS threshold),
c AS (SELECT fold, threshold, count(*) FILTER (score > threshold AND y = 1)::DOUBLE AS tp, count(*) FILTER (score > threshold AND y = 0)::DOUBLE AS fp,
        count(*) FILTER (score <= threshold AND y = 1)::DOUBLE AS fn, count(*) FILTER (score <= threshold AND y = 0)::DOUBLE AS tn
      FROM predictions CROSS JOIN g GROUP BY ALL),
s AS (SELECT fold, threshold, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
        coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


def sweep(spark, sf):
    return M.threshold_sweep(I.predictions(spark, sf), ["fold"], "y", "score", GRID)


@query("m12_threshold_sweep", finish(SWEEP, "s", ["fold"], ["threshold", "accuracy", "precision", "recall", "f1"]))
def m12(spark, sf):
    return rounded(sweep(spark, sf))


@query("m12_best_threshold", finish(
    SWEEP + ", k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, threshold) = 1)", "k", ["fold"], ["threshold", "f1"]))
def m12_best(spark, sf):
    return rounded(M.best_threshold(sweep(spark, sf), ["fold"]))


@query("m13_mean_of_folds", finish(SCORED + ", k AS (SELECT avg(f1) AS mean_score, avg(accuracy) AS mean_accuracy FROM s)", "k", [], ["mean_score", "mean_accuracy"]))
def m13(spark, sf):
    s = scored(spark, sf)
    return rounded(s.agg(F.avg("f1").alias("mean_score"), F.avg("accuracy").alias("mean_accuracy")))


def auc_sql(score: str, name: str, source: str = "predictions") -> str:
    """Rank-sum with mid-ranks for ties."""
    return f""",
{name}_r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY {score}) + (count(*) OVER (PARTITION BY fold, {score}) - 1) / 2.0 AS rk FROM {source}),
{name} AS (SELECT fold, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
         / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM {name}_r GROUP BY fold)"""


@query("m14_auc", finish(P + auc_sql("score", "k"), "k", ["fold"], ["auc"]))
def m14(spark, sf):
    return rounded(M.auc(I.predictions(spark, sf), ["fold"], "y", "score"))


# ---- report artefacts ------------------------------------------------------

RIVAL = "((logit + 2.0) * 3250.0 % 1000) / 1000.0"
COMPARE = P + f", p2 AS (SELECT *, round({RIVAL}, 6) AS rival FROM predictions)" + auc_sql("score", "ka", "p2") + auc_sql("rival", "kb", "p2") + """,
cmp AS (SELECT ka.fold, round(ka.auc, 9) AS lgbm_auc, round(kb.auc, 9) AS tft_auc FROM ka JOIN kb USING (fold))"""


def compare(spark, sf):
    p = I.predictions(spark, sf).withColumn("rival", F.round(((F.col("logit") + 2.0) * 3250.0 % 1000) / 1000.0, 6))
    a = M.auc(p, ["fold"], "y", "score", "lgbm_auc")
    b = M.auc(p, ["fold"], "y", "rival", "tft_auc")
    return a.join(b, "fold").select("fold", F.round("lgbm_auc", 9).alias("lgbm_auc"), F.round("tft_auc", 9).alias("tft_auc"))


def stage_run(spark, sf) -> str:
    """Two run folders; only the later one holds the comparison under an alternative name."""
    root = scratch_dir(spark, "reports")
    c = compare(spark, sf)
    c.withColumn("lgbm_auc", F.lit(0.5)).coalesce(1).write.option("header", True).csv(f"{root}/run_20240101/auc_compare.csv")
    c.coalesce(1).write.option("header", True).csv(f"{root}/run_20240202/auc_compare.csv")
    return root


def read_compare(spark, sf):
    folder = rsrc.latest_run(spark, stage_run(spark, sf))
    path = rsrc.find_artefact(spark, folder, rsrc.ARTEFACTS["compare_csv"])
    return rsrc.read_report_csv(spark, path, [report.FOLD[0], report.TREE_AUC[0], report.DEEP_AUC[0]])


R1 = finish(COMPARE, "cmp", ["fold"], ["lgbm_auc", "tft_auc"])


@query("s8_read_report_csv", R1)
def s8(spark, sf):
    return rounded(read_compare(spark, sf))


@query("s9_read_summary_json", finish(COMPARE + """,
k AS (SELECT 'lgbm_auc_mean' AS key, avg(lgbm_auc) AS value FROM cmp UNION ALL SELECT 'tft_auc_mean', avg(tft_auc) FROM cmp)""", "k", ["key"], ["value"]))
def s9(spark, sf):
    folder = scratch_dir(spark, "summary")
    c = compare(spark, sf)
    c.agg(F.avg("lgbm_auc").alias("lgbm_auc_mean"), F.avg("tft_auc").alias("tft_auc_mean")).write.json(folder)
    df, keys = rsrc.read_summary(spark, folder)
    return rounded(df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("r")).select("r.*"))


@query("s10_latest_run", finish(COMPARE, "cmp", ["'run_20240202' AS run", "fold"], ["lgbm_auc", "tft_auc"]))
def s10(spark, sf):
    """The latest run's comparison with the run's name."""
    folder = rsrc.latest_run(spark, stage_run(spark, sf))
    path = rsrc.find_artefact(spark, folder, rsrc.ARTEFACTS["compare_csv"])
    rows = rsrc.read_report_csv(spark, path, [report.FOLD[0], report.TREE_AUC[0], report.DEEP_AUC[0]])
    return rounded(rows.withColumn("run", F.lit(folder.rsplit("/", 1)[1])))


@query("r1_fold_comparison", R1)
def r1(spark, sf):
    return rounded(report.fold_comparison(compare(spark, sf)))


def five(c: str, m: str) -> str:
    return f"""SELECT '{m}' AS model, count({c}) AS n, min({c}) AS "min", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS "median",
  quantile_cont({c}, 0.75) AS q3, max({c}) AS "max" FROM cmp"""


@query("r2_auc_distribution", finish(COMPARE + f", k AS ({five('lgbm_auc', 'lgbm')} UNION ALL {five('tft_auc', 'tft')})", "k", ["model", "n"],
                                     ['"min"', "q1", '"median"', "q3", '"max"']))
def r2(spark, sf):
    return rounded(report.auc_distribution(compare(spark, sf)))


LOFO = """
lofo AS (SELECT CAST(user_id AS VARCHAR) AS feature, CASE WHEN user_id % 9 = 0 THEN NULL ELSE round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE - 10, 9) END AS delta_auc FROM events GROUP BY user_id)"""


def lofo(spark, sf):
    e = I.table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return e.groupBy("user_id").agg((F.sum("cents") / F.count("cents") / F.lit(100.0) - 10).alias("d")).select(
        F.col("user_id").cast("string").alias("feature"),
        F.when(F.col("user_id") % 9 == 0, None).otherwise(F.round("d", 9)).alias("delta_auc"))


@query("r3_ablation_ranking", finish(LOFO, "(SELECT * FROM lofo WHERE delta_auc IS NOT NULL ORDER BY delta_auc DESC, feature LIMIT 20)",
                                     ["feature AS name"], ["delta_auc"]))
def r3(spark, sf):
    return rounded(report.ablation_ranking(lofo(spark, sf), 20))


@query("r4_win_fold_contribution", finish(COMPARE + """,
d AS (SELECT tft_auc - lgbm_auc AS delta FROM cmp),
k AS (SELECT delta > 0 AS win, avg(delta) AS mean_delta, count(*) AS n FROM d GROUP BY ALL)""", "k", ["win", "n"], ["mean_delta"],
                                          where="WHERE (SELECT count(*) FROM k) = 2"))
def r4(spark, sf):
    return rounded(report.win_fold_contribution(compare(spark, sf)))


# ---- whole chain and training ----------------------------------------------

H = Win("h.symbol", "h.date")
AHEAD = ", ".join(flag(f"{H.lead('close', n)} > close") + f" AS labels_{n}h" for n in (1, 3, 6))
CHAIN = I.HOURLY_SQL + SLOW + f""",
c0 AS (SELECT h.symbol, h.date, close, volume, s.level, {AHEAD}
       FROM (SELECT * FROM hourly) h ASOF LEFT JOIN slow s ON h.symbol = s.symbol AND h.date >= s.date)"""


def _scaled(c: str) -> str:
    t = f"CASE WHEN date < DATE '2024-01-20' THEN {c} END"
    sd = f"stddev_pop({t}) {B.whole}"
    return f"({c} - avg({t}) {B.whole}) / (CASE WHEN coalesce({sd}, 0) = 0 THEN 1.0 ELSE {sd} END) AS {c}"


CHAIN_SQL = CHAIN + f", c1 AS (SELECT symbol, date, labels_1h, labels_3h, labels_6h, {', '.join(_scaled(c) for c in ('close', 'volume', 'level'))} FROM c0)"


@query("e2_model_matrix", finish(CHAIN_SQL, "c1", [
    "CASE WHEN date < DATE '2024-01-20' THEN 'train' ELSE 'test' END AS part", "symbol", "date", "labels_1h", "labels_3h", "labels_6h"],
    ["close", "volume", "level"]))
def e2(spark, sf):
    base = I.hourly(spark, sf).select("symbol", "date", "close", "volume")
    x = pipeline.with_slow_series(base, [(slow_level(spark, sf), "level")], KEY, "date")
    x = pipeline.with_labels(x, I.BARS)
    names = ["labels_1h", "labels_3h", "labels_6h"]
    train, test = pipeline.split_and_scale(x, I.BARS, "2024-01-20", names)
    return rounded(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))))


CHANGED_SQL = CHAIN_SQL + f""",
h0 AS (SELECT symbol, date, CASE WHEN date < DATE '2024-01-20' THEN 'train' ELSE 'test' END AS part, close FROM c1),
h1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY date) AS rn, close - avg(close) OVER (PARTITION BY symbol, part) AS v FROM h0),
r(symbol, part, rn, pos, neg, up, down) AS (
  SELECT symbol, part, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0 FROM h1 GROUP BY symbol, part
  UNION ALL
  SELECT symbol, part, rn, CASE WHEN p > 2 THEN 0.0 ELSE p END, CASE WHEN p <= 2 AND n < -2 THEN 0.0 ELSE n END, CAST(p > 2 AS INT), CAST(p <= 2 AND n < -2 AS INT)
  FROM (SELECT h1.symbol, h1.part, h1.rn, greatest(0.0, r.pos + v) AS p, least(0.0, r.neg + v) AS n
        FROM r JOIN h1 ON h1.symbol = r.symbol AND h1.part = r.part AND h1.rn = r.rn + 1)),
x AS (SELECT part, symbol, date, up AS close_cusum_up_flag, down AS close_cusum_down_flag FROM r JOIN h1 USING (symbol, part, rn))"""


@query("e2_change_flags_after_split", finish(CHANGED_SQL, "x", ["part", "symbol", "date", "close_cusum_up_flag", "close_cusum_down_flag"], []))
def e2_change_flags(spark, sf):
    base = I.hourly(spark, sf).select("symbol", "date", "close", "volume")
    x = pipeline.with_labels(pipeline.with_slow_series(base, [(slow_level(spark, sf), "level")], KEY, "date"), I.BARS)
    halves = pipeline.split_and_scale(x, I.BARS, "2024-01-20", ["labels_1h", "labels_3h", "labels_6h"], change_columns=["close"])
    train, test = (h.withColumn("part", F.lit(n)) for n, h in zip(("train", "test"), halves))
    return train.unionByName(test).select("part", "symbol", "date", "close_cusum_up_flag", "close_cusum_down_flag")


def matrix(spark, sf):
    h = I.hourly(spark, sf).withColumns({
        "y": L.direction_label(I.BARS, "close"), "f1": I.BARS.diff("close"), "f2": I.BARS.mean("close", 6, 1), "f3": F.col("volume"),
        "w": F.lit(1.0) + F.col("volume") / 97.0}).withColumn("all", F.lit(0))
    return row_index(h.select("all", "symbol", "date", "close", "y", "f1", "f2", "f3", "w"), ["all"], ["date", "symbol"], F.date_trunc("day", "date"), total="n")


def full_matrix(spark, sf):
    """(rows with every price, order-flow and slow feature, the features' names)."""
    c = F.col
    x = I.bars(spark, sf).select(
        "symbol", "date", c("price_max").alias("high"), c("price_min").alias("low"), c("price_last").alias("close"),
        c("qty_sum").alias("volume_ETH"), c("amount_sum").alias("volume_USD"), "price_first", "price_last", "price_max", "price_min",
        "price_mean", "qty_sum", "qty_count", "buy_qty_sum", "sell_qty_sum", "buy_trade_sum", "sell_trade_sum")
    x = orderbook_features(price_features(x, I.BARS, drop="none"), I.BARS)
    x = pipeline.with_slow_series(x, [(slow_level(spark, sf), "level")], KEY, "date")
    names = [n for n in numeric_columns(x) if n not in ("symbol", "date")]
    x = cut_lineage(finite_columns(x, names).withColumns({
        "y": L.direction_label(I.BARS, "close"), "w": F.lit(1.0) + c("qty_sum") / 97.0, "all": F.lit(0)}))
    return row_index(x, ["all"], ["date", "symbol"], F.date_trunc("day", "date"), total="n"), names


TRIALS = training.draw_trials(3, 3)
#: Rounds of the trial that is left after the halvings; the whole search would use all of its rounds.
BUDGET = 48
TRIAL_INTS, TRIAL_DOUBLES = ["depth", "rounds", "min_rows", "leaves"], ["step", "subsample", "feature_share", "threshold", "pos_weight", "l1", "l2"]


def trials_sql() -> str:
    """The drawn trials, the rows that five folds test, and what must hold of any search."""
    names = ["trial", *TRIAL_INTS, *TRIAL_DOUBLES]
    lines = ", ".join("(" + ", ".join([str(i), *(str(getattr(t, n)) for n in TRIAL_INTS), *(f"{getattr(t, n)!r}::DOUBLE" for n in TRIAL_DOUBLES)]) + ")"
                      for i, t in enumerate(TRIALS))
    return I.BARS_SQL + f""",
trials({', '.join(names)}) AS (VALUES {lines}),
x AS (SELECT trials.*, CAST(5 * (n // 6) AS INT) AS test_rows, TRUE AS in_order, TRUE AS in_range, TRUE AS in_budget FROM trials, (SELECT count(*) AS n FROM bars))"""


def searched(found, score: str, least: float, most: float, falling: bool):
    """The trials of a search, with checks of their order, scores and rounds instead of the scores."""
    w = Window.orderBy("_place")  # one row per trial
    s, before = F.col(score), F.lag(score).over(w)
    x = found.withColumn("_place", F.monotonically_increasing_id())
    fits = (before >= s) if falling else (before <= s)
    return rounded(x.select("trial", *TRIAL_INTS, *TRIAL_DOUBLES, "test_rows", F.coalesce(fits, F.lit(True)).alias("in_order"),
                            s.between(least, most).alias("in_range"), F.col("trained").between(1, BUDGET).alias("in_budget")))


TRIALS_SQL = finish(trials_sql(), "x", ["trial", *TRIAL_INTS, "test_rows", "in_order", "in_range", "in_budget"], TRIAL_DOUBLES)


@query("t1_tune_classifier", TRIALS_SQL)
def t1(spark, sf):
    rows, names = full_matrix(spark, sf)
    return searched(training.tune_classifier(rows, names, "y", "row_index", "n", TRIALS, budget=BUDGET), "mean_f1", 0.0, 1.0, True)


@query("t2_tune_regressor", TRIALS_SQL)
def t2(spark, sf):
    rows, names = full_matrix(spark, sf)
    names = [n for n in names if n not in ("close", "price_last")]  # the target itself
    return searched(training.tune_regressor(rows, names, "close", "w", "row_index", "n", TRIALS, budget=BUDGET), "mean_msle", 0.0, 10.0, False)


@query("t_fold_profile", finish(I.HOURLY_SQL + UP + """,
m AS (SELECT y, row_number() OVER (ORDER BY date, symbol) - 1 AS i, count(*) OVER () AS n FROM lab),
f AS (SELECT unnest(range(5)) AS fold),
p AS (SELECT CAST(fold AS INT) AS fold, CASE WHEN i < n - (5 - fold) * (n // 6) THEN 'train' ELSE 'test' END AS role, y
      FROM m, f WHERE i < n - (4 - fold) * (n // 6)),
x AS (SELECT fold, role, count(*) AS n, avg(y::DOUBLE) AS positive_share FROM p GROUP BY ALL)""", "x", ["fold", "role", "n"], ["positive_share"]))
def t_fold_profile(spark, sf):
    return rounded(training.fold_profile(matrix(spark, sf), "y", "row_index", "n"))
