"""Order statistics by refinement of ranges equal sorted values, for ties, huge and infinite values, groups of any kind."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwave.operators.order_statistics import order_statistics, quantiles


@pytest.fixture(scope="module")
def values():
    draw = np.random.default_rng(3)
    groups = {
        "normal": draw.normal(size=900).tolist(),
        "ties": [7.0] * 800 + [1.0, 9.0] * 50,
        "wide": [*(10.0 ** draw.uniform(-300, 300, 300)).tolist(), -1.7e308, 1.7e308, 5e-324, 0.0],
        "endless": [float("-inf")] * 30 + [float("inf")] * 40 + draw.normal(size=90).tolist(),
        "one": [4.0],
        None: draw.integers(0, 5, 200).astype(float).tolist(),
        "none": [None, float("nan")],
    }
    return groups


def test_every_rank(spark, values):
    rows = [(g, v) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = order_statistics(df, "v", lambda n: F.sequence(F.lit(0).cast("long"), n, F.lit(37).cast("long")), ["g"], bins=8, few=5)
    want = {(g, k): x for g, vs in values.items() if g != "none" for k, x in enumerate(sorted(vs)) if k % 37 == 0}
    assert {(r.g, r["rank"]): r.x for r in got.collect()} == want


def test_quantiles_with_and_without_groups(spark, values):
    rows = [(g, v) for g, vs in values.items() if g not in ("wide", "endless") for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = {"low": 0.1, "half": 0.5, "top": 1.0}
    got = {r.g: (r.low, r.half, r.top) for r in quantiles(df, "v", shares, ["g"], bins=16, few=3).collect()}
    for g, vs in values.items():
        if g == "none":
            assert got[g] == (None, None, None)
        elif g in got:
            assert got[g] == pytest.approx(tuple(np.quantile(vs, list(shares.values()))))
    (whole,) = quantiles(df, "v", shares, bins=16, few=3).collect()
    assert tuple(whole) == pytest.approx(tuple(np.quantile([v for _, v in rows if v is not None and v == v], list(shares.values()))))
    assert quantiles(df.where("false"), "v", shares, ["g"]).count() == 0
