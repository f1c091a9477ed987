"""Two-level ordered primitives against brute force, with tiny chunks and blocks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(k, i, rng.choice([None, float(rng.randint(-9, 9))]) if i % 3 else float(i % 7)) for k in "ab" for i in range(157)]
    df = spark.createDataFrame(data, "k string, i long, v double").withColumn("chunk", F.floor(F.col("i") / 10))
    return df, pd.DataFrame(data, columns=["k", "i", "v"])


def _sorted(df, *cols):
    return df.orderBy("k", "i").select(*cols).toPandas()


def test_running_and_index(rows):
    df, pdf = rows
    got = _sorted(O.running(df, ["k"], "chunk", ["i"], {"s": ("sum", "v"), "m": ("max", "v"), "n": ("count", "v")}), "s", "m", "n")
    g = pdf.groupby("k")["v"]
    np.testing.assert_allclose(got["s"], g.transform(lambda x: x.fillna(0).cumsum()))
    np.testing.assert_allclose(got["m"], g.cummax().groupby(pdf["k"]).ffill())
    np.testing.assert_array_equal(got["n"], g.transform(lambda x: x.notna().cumsum()))
    idx = _sorted(O.row_index(df, ["k"], "chunk", ["i"]), "bar_no")
    np.testing.assert_array_equal(idx["bar_no"], pdf.groupby("k").cumcount())


def test_carry_last(rows):
    df, pdf = rows
    filled = pdf.groupby("k")["v"].ffill()
    got = _sorted(O.carry_last(df, ["k"], "chunk", ["i"], {"c": "v"}), "c")
    np.testing.assert_allclose(got["c"], filled)
    before = _sorted(O.carry_last(df, ["k"], "chunk", ["i"], {"c": "v"}, include_current=False), "c")
    np.testing.assert_allclose(before["c"], filled.groupby(pdf["k"]).shift())


@pytest.mark.parametrize("block", [5, 16, 1000])
def test_rolling_halo(rows, block):
    df, pdf = rows
    out = O.rolling(df, ["k"], 4, 2, lambda d, w: d.withColumn("a", F.sum("v").over(w.rowsBetween(-4, 2))), index="i", block=block)
    got = _sorted(out, "a")
    want = pdf.groupby("k")["v"].transform(lambda x: pd.Series([np.nansum(x.iloc[max(0, j - 4): j + 3]) for j in range(len(x))], index=x.index))
    np.testing.assert_allclose(got["a"].fillna(0), want)


def test_islands(spark):
    pos = [1, 2, 4, 20, 21, 60, 61, 95]
    df = spark.createDataFrame([("a", p) for p in pos], "k string, i long").withColumn("chunk", F.floor(F.col("i") / 10))
    got = [r.run_no for r in O.islands(df, ["k"], "chunk", "i", 5).orderBy("i").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 3, 4]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {"hot": rng.normal(size=5000).round(2), "one": np.array([3.5]), "few": np.array([1.0, 2.0, 4.0, 8.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: r for r in O.exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, accuracy=200).collect()}
    for k, vs in data.items():
        assert got[k].m == pytest.approx(np.quantile(vs, 0.5)) and got[k].q == pytest.approx(np.quantile(vs, 0.9)) and got[k].n == len(vs)


def test_asof(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 15, "y"), ("b", 1, "z")], "k string, t long, tag string")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 7, 2.0), ("a", 12, 3.0)], "k string, u long, v double")
    got = {r.tag: r.v for r in O.asof_backward(left, right, ["k"], "t", "u", ["v"], lambda c: F.floor(c / 10)).collect()}
    assert got == {"x": 1.0, "y": 3.0, "z": None}
