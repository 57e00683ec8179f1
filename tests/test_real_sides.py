"""b8 and b22 on the unchanged bars: empty sides reach the ratios, in digits that need a relative tolerance.

The registered b8 and b22 add 1 to every side, in Spark and in SQL."""

import numpy as np
import pytest

from barwright.plans import pipeline
from barwright.plans.orderbook import orderbook_features
from barwright.registry import inputs as I
from barwright.registry import q_bundles as q
from barwright.registry.core import SQL
from harness import canonical, duck

SF = "/root/testdata/sf0.01"  # complete rows of b22 need long series
SHIFT = q.BOTH_SIDES[len(I.SERIES_SQL):]
REAL = ", both_sides AS (SELECT * FROM bars1)"


def book(spark):
    x = orderbook_features(I.series_bars(spark, SF), I.SERIES)
    return x.select("series_id", "date", *[n.strip('"') for n in (*q.BOOK_INTS, *q.BOOK_DOUBLES)])


def everything(spark):
    x = pipeline.all_features(q.combined(spark, SF, I.series_bars), I.DAILY, drop="rows")
    return x.select("series", "date", *[n.strip('"') for n in (*q.ALL_I, *q.ALL_D)])


@pytest.mark.parametrize("name, make, key", [("b8_orderbook_features", book, "series_id"), ("b22_all_features", everything, "series")])
def test_real_sides_match_sql(spark, name, make, key):
    assert SQL[name].count(SHIFT) == 1
    want = duck(SF).execute(SQL[name].replace(SHIFT, REAL)).df()
    got = q.rounded(make(spark)).toPandas()
    assert len(got) == len(want) > 0 and set(got.columns) == set(want.columns)
    got, want = (canonical(x).sort_values([key, "date"], ignore_index=True) for x in (got, want))
    assert (got[[key, "date"]] == want[[key, "date"]]).all(axis=None)
    for c in set(got.columns) - {key, "date"}:
        # two digits are lost where ratios of 1e9 cancel; NULLs are equal only to NULLs
        scale = np.nanmax(np.abs(want[c])) if want[c].notna().any() else 0.0
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=2e-6 + 1e-13 * scale, err_msg=c)
    if name.startswith("b8"):
        assert got["buy_sell_ratio"].max() > 1e8  # bars without sells are there
