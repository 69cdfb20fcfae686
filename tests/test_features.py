import math

import numpy as np
import pytest
from fixtures import bars, returns, walk

from tidemark.operators import features, standardize
from tidemark.operators.features import compute_features
from tidemark.schema import FeatureParams


def from_returns(r):
    return [100.0, *(100 * np.exp(np.cumsum(r)))]


def test_kernels_match_numpy_constants(spark):
    row = compute_features(bars(spark, from_returns(returns()))).collect()
    assert len(row) == 1 and row[0]["day"] == 20 and row[0]["row"] == 0
    assert row[0]["realized_vol"] == pytest.approx(0.013052667346011494, rel=1e-12)
    assert row[0]["skewness"] == pytest.approx(-0.60418734748994118, rel=1e-11)
    assert row[0]["momentum"] == pytest.approx(-0.029879627244415407, rel=1e-12)


def test_flat_returns_have_no_skewness(spark):
    row = compute_features(bars(spark, from_returns([0.004] * 20))).first()
    assert row["skewness"] == 0.0 and row["realized_vol"] == pytest.approx(0, abs=1e-15)


def test_drawdown(spark):
    rise = compute_features(bars(spark, [100 + i for i in range(21)])).first()
    assert rise["max_drawdown"] == 0.0
    dip = compute_features(bars(spark, [100.0] * 15 + [100, 110, 99, 105, 120, 90])).first()
    assert dip["max_drawdown"] == pytest.approx(math.log(90 / 120), rel=1e-14)


def test_relative_volume(spark):
    params = FeatureParams(include_volume=True, baseline=60)
    closes = walk(60)
    flat = compute_features(bars(spark, closes, [5e6] * 60), params).first()
    assert flat["rel_volume"] == pytest.approx(0, abs=1e-15)
    double = compute_features(bars(spark, closes, [4.0] * 40 + [16.0] * 20), params).first()
    assert double["rel_volume"] == pytest.approx(math.log(2))
    one_zero = compute_features(bars(spark, closes, [1.0] * 40 + [0.0] + [1.0] * 19), params).first()
    assert one_zero["rel_volume"] == pytest.approx(math.log((19 / 20) / (59 / 60)))
    with pytest.raises(Exception, match="mean volume"):
        compute_features(bars(spark, closes, [0.0] * 60), params).collect()


@pytest.mark.parametrize("params", [FeatureParams(), FeatureParams(include_volume=True, baseline=40)])
def test_no_look_ahead(spark, params):
    closes = walk(70)
    whole = {r["day"]: r for r in compute_features(bars(spark, closes), params).collect()}
    assert min(whole) == params.first_day
    for cut in range(params.first_day + 1, 71, 7):
        for r in compute_features(bars(spark, closes[:cut]), params).collect():
            assert r == whole[r["day"]]


def test_columns_agree_across_dimensions_and_warmup(spark):
    b = bars(spark, walk(300))
    five = {r["day"]: r for r in compute_features(b, FeatureParams.of_dimension(5)).collect()}
    four = {r["day"]: r for r in compute_features(b, FeatureParams.of_dimension(4, 251)).collect()}
    assert five.keys() == four.keys() and min(four) == 251
    assert all(five[d][c] == four[d][c] for d in four for c in FeatureParams().columns)


def test_errors(spark):
    with pytest.raises(ValueError):
        FeatureParams(window=2)
    with pytest.raises(ValueError):
        FeatureParams(include_volume=True, baseline=20)
    with pytest.raises(ValueError):
        FeatureParams.of_dimension(3)
    with pytest.raises(ValueError, match="21 bars"):
        compute_features(bars(spark, walk(15)), check_length=True)


def test_series_are_apart(spark):
    a, b = walk(30), walk(30, 9)
    both = compute_features(bars(spark, a, series="a").unionByName(bars(spark, b, series="b")))
    alone = compute_features(bars(spark, b, series="b"))
    assert both.where("series_id = 'b'").orderBy("day").collect() == alone.orderBy("day").collect()


def test_lookup_names_the_next_day(spark):
    rows = compute_features(bars(spark, walk(40)))
    assert features.find_row(rows, "2001-01-25").count() == 1
    with pytest.raises(ValueError, match="2001-01-21"):
        features.find_row(rows, "2001-01-03")
    with pytest.raises(ValueError, match="no row on or after"):
        features.find_row(rows, "2031-01-03")


def two_columns(spark):
    x = returns()
    return spark.createDataFrame([("all", i, float(v), float(2 * v + 5)) for i, v in enumerate(x)], "series_id string, row int, x double, y double"), x


def test_standardizers_match_numpy(spark):
    df, x = two_columns(spark)
    z = standardize.ZScore().fit(df, ("x", "y")).params.first()
    assert z["c_x"] == pytest.approx(-0.0014939813622207704, rel=1e-12) and z["s_x"] == pytest.approx(0.013052667346011494, rel=1e-12)
    q = standardize.Robust().fit(df, ("x", "y")).params.first()
    assert q["c_x"] == pytest.approx(0.00045403325546376056, rel=1e-12)
    assert q["s_x"] * standardize.NORMAL_IQR == pytest.approx(0.024178386631696119, rel=1e-12)
    for kind in standardize.KINDS:
        out = standardize.make_standardizer(kind).fit_transform(df, ("x", "y")).orderBy("row").collect()
        assert [r["x"] for r in out] == pytest.approx([r["y"] for r in out], abs=1e-9)
    out = np.array([r["x"] for r in standardize.ZScore().fit_transform(df, ("x", "y")).collect()])
    assert out.mean() == pytest.approx(0, abs=1e-12) and out.std(ddof=1) == pytest.approx(1, rel=1e-12)
    assert [r["x"] for r in df.orderBy("row").collect()] == list(x)


def test_standardizer_errors(spark):
    df, _ = two_columns(spark)
    with pytest.raises(RuntimeError):
        standardize.ZScore().transform(df)
    with pytest.raises(ValueError):
        standardize.ZScore().fit(df, ("x",)).transform(df, ("x", "y"))
    with pytest.raises(ValueError):
        standardize.make_standardizer("other")
    flat = spark.createDataFrame([("all", i, float(i), 42.0) for i in range(10)], "series_id string, row int, x double, y double")
    for kind in standardize.KINDS:
        with pytest.raises(ValueError, match="y"):
            standardize.make_standardizer(kind).fit(flat, ("x", "y"))
        with pytest.raises(ValueError, match="two rows"):
            standardize.make_standardizer(kind).fit(flat.limit(1), ("x",))
