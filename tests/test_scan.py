"""Ordered operators against pandas on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import scan


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abcdef"), n)),
        "t": rng.integers(0, 500, n), "id": np.arange(n), "v": rng.normal(size=n).round(3)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_rank_all_and_within(skewed):
    pdf, df = skewed
    want = pdf.sort_values(["t", "id"]).assign(rank=range(1, len(pdf) + 1)).set_index("id")["rank"]
    got = scan.rank_all(df, ["t", "id"]).toPandas().set_index("id")
    assert (got["rank"] == want.loc[got.index]).all() and (got["row_count"] == len(pdf)).all()
    got = scan.rank_within(df, ["k"], ["t", "id"]).toPandas().sort_values(["k", "t", "id"])
    assert (got["rank"].to_numpy() == got.groupby("k").cumcount().to_numpy() + 1).all()
    assert (got["row_count"].to_numpy() == got.groupby("k")["id"].transform("size").to_numpy()).all()


def test_running_sum_and_previous_row(skewed):
    pdf, df = skewed
    ordered = pdf.sort_values(["k", "t", "id"])
    got = scan.running_within(df, ["k"], ["t", "id"], "v", "total").toPandas().sort_values(["k", "t", "id"])
    np.testing.assert_allclose(got["total"], ordered.groupby("k")["v"].cumsum())
    got = scan.previous_row(df, ["k"], ["t", "id"], F.floor(F.col("t") / 50), ["v"]).toPandas().sort_values(["k", "t", "id"])
    np.testing.assert_allclose(got["previous_v"].astype(float), ordered.groupby("k")["v"].shift(1))


def test_keep_one(spark):
    df = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 5, None)], "k string, seq int, v string")
    assert {(r.k, r.v) for r in scan.keep_one(df, ["k"], ["seq"]).collect()} == {("x", "a"), ("y", None)}
    assert {(r.k, r.v) for r in scan.keep_one(df, ["k"], ["seq"], "last").collect()} == {("x", "b"), ("y", None)}
