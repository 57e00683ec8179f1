"""Parameters fitted on the training rows and applied to every row.

Two equivalent routes.  ``*_over`` expressions compute the parameters as whole-partition
windows, which ride on the exchange the feature windows already use: no second read of the
input and no join.  ``fit_params``/``apply_standard`` produce a small parameter table (one row
per series) for saving and for applying to other data; it is joined on the series columns and
left to the optimizer, which broadcasts it only when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.over import Layout
from ..functions.scalar import clip_to, dbl, flag
from ..session import cut_lineage
from .quantiles import beside, exact_quantiles, fitted


def train_mask(ly: Layout, share: float = 0.7) -> Column:
    """True on the first ``int(share * n)`` rows of each series."""
    n = ly.fold("count", F.count, None, None, F.lit(1))
    return ly.row_number() <= F.floor(n * F.lit(share))


def mask_by_index(row: str, total: str, share: float = 0.7) -> Column:
    """Same mask from a dense row index (see ``align.row_index``)."""
    return F.col(row) < F.floor(F.col(total) * F.lit(share))


def on_train(c, mask: Column) -> Column:
    return F.when(mask, dbl(c))


def quantile_over(ly: Layout, c, mask: Column | None, q: float) -> Column:
    x = on_train(c, mask) if mask is not None else dbl(c)
    return ly.fold(f"quantile{q}", lambda v: F.percentile(v, F.lit(q)), None, None, x)


def _mean(ly: Layout, x: Column) -> Column:
    return ly.fold("avg", F.avg, None, None, x)


def unit_if_flat(sd: Column) -> Column:
    return F.when(sd.isNull() | (sd == 0.0), F.lit(1.0)).otherwise(sd)


def winsor_over(ly: Layout, c, mask: Column, lo: float = 0.005, hi: float = 0.995) -> Column:
    both = ly.fold(f"quantiles{lo},{hi}", lambda v: F.percentile(v, F.array(F.lit(lo), F.lit(hi))), None, None, on_train(c, mask))
    return clip_to(dbl(c), both[0], both[1])


def standard_over(ly: Layout, c, mask: Column) -> Column:
    """Train mean and sample deviation; a series with no training value is left alone."""
    x = on_train(c, mask)
    mean, sd = _mean(ly, x), unit_if_flat(ly.fold("std", F.stddev_samp, None, None, x))
    return F.when(mean.isNull(), dbl(c)).otherwise((dbl(c) - mean) / sd)


def scaler_over(ly: Layout, c, mask: Column) -> Column:
    """Population scaler: missing values ignored, flat columns only centred."""
    x = on_train(c, mask)
    mean, sd = _mean(ly, x), unit_if_flat(ly.fold("std_pop", F.stddev_pop, None, None, x))
    return (dbl(c) - mean) / sd


def fit_params(
    df: DataFrame, series: Sequence[str], columns: Sequence[str], mask: Column | None = None,
    quantiles: Sequence[float] = (),
) -> DataFrame:
    """Long table ``(series, column, n, mean, std, std_pop, q_<p>...)``: one aggregate, and a second one where
    quantiles are asked for (see ``operators.quantiles``)."""
    mask = F.lit(True) if mask is None else mask
    more = {"n": F.count("_x"), "mean": F.avg("_x"), "std": F.stddev_samp("_x"), "std_pop": F.stddev_pop("_x")}
    return exact_quantiles(df, series, {c: on_train(c, mask) for c in columns}, {quantile_name(q): q for q in quantiles}, more)


def with_quantiles(
    df: DataFrame, series: Sequence[str], columns: Mapping[str, Column], shares: Mapping[str, float], prefix: str = "_q_",
) -> DataFrame:
    """Rows with the exact quantiles of their series as structs ``<prefix><name>`` (fields named as in ``shares``), without a
    series in one task.  ``df`` is read three times: cut its lineage first if it is dear."""
    x = beside(df, fitted(df, series, columns, shares), series, "_fits")
    return x.withColumns({f"{prefix}{c}": F.get("_fits", F.lit(i)) for i, c in enumerate(columns)}).drop("_fits")


def winsorised(df: DataFrame, series: Sequence[str], columns: Sequence[str], mask: Column, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Columns clipped to quantiles of their training rows."""
    x = with_quantiles(df, series, {c: on_train(c, mask) for c in columns}, {"lo": lo, "hi": hi})
    return x.withColumns({c: clip_to(dbl(c), F.col(f"_q_{c}.lo"), F.col(f"_q_{c}.hi")) for c in columns}).drop(*[f"_q_{c}" for c in columns])


def quantile_name(q: float) -> str:
    return "q_" + f"{q:g}".replace("0.", "")


def apply_standard(
    df: DataFrame, params: DataFrame, series: Sequence[str], columns: Sequence[str],
    std: str = "std", suffix: str = "",
) -> DataFrame:
    """Join saved parameters back and standardise ``columns``."""
    wide = params.groupBy(*series).agg(
        *[F.max(F.when(F.col("column") == c, F.struct("mean", std))).alias(f"_p_{c}") for c in columns]
    )
    joined = df.join(wide, list(series), "left")
    scaled = joined.withColumns({
        f"{c}{suffix}": (dbl(c) - F.col(f"_p_{c}.mean")) / unit_if_flat(F.col(f"_p_{c}.{std}")) for c in columns
    })
    return scaled.drop(*[f"_p_{c}" for c in columns])


def quantile_flag(ly: Layout, c, q: float, op: str, mask: Column | None = None) -> Column:
    """Compare with a whole-series (or train-only) quantile."""
    bar, x = quantile_over(ly, c, mask, q), dbl(c)
    return flag({">": x > bar, ">=": x >= bar, "<": x < bar, "<=": x <= bar}[op])


def ternary_quantile_flag(ly: Layout, c, low: float = 0.1, high: float = 0.9, mask: Column | None = None) -> Column:
    x = dbl(c)
    return (
        F.when(x > quantile_over(ly, c, mask, high), 1)
        .when(x < quantile_over(ly, c, mask, low), -1)
        .otherwise(0)
    )


def category_codes(df: DataFrame, label: str, out: str) -> DataFrame:
    """0-based code of each label in sorted order; NULL is -1.

    The distinct labels are reduced map-side first and dealt by ranges, so that neither a common beginning nor
    their number puts them in one task.  A code is the rank in its range plus the number of labels in the ranges before,
    one number per partition.  The code table is joined without a forced broadcast, since labels may be many.
    """
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    sorted_ = labels.repartitionByRange(label).sortWithinPartitions(label).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(sorted_.select(label, F.shiftright("_id", 33).cast("int").alias("_p"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_i")))
    sizes = dict(placed.groupBy("_p").count().collect())
    offsets = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0)))
    before = F.create_map(*[F.lit(v) for pair in offsets.items() for v in pair])[F.col("_p")] if offsets else F.lit(0)
    codes = placed.select(label, (before + F.col("_i")).cast("int").alias(out))
    return df.join(codes, label, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def class_balance(df: DataFrame, label: str, series: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive."""
    neg = F.sum((F.col(label) == 0).cast("int")).cast("long")
    pos = F.sum((F.col(label) == 1).cast("int")).cast("long")
    return df.groupBy(*series).agg(neg.alias("n_neg"), pos.alias("n_pos"), F.try_divide(neg, pos).alias("pos_weight"))
