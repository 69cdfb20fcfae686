"""The shapes of plans that scale depends on."""

import re

from fixtures import bars, points, walk
from pyspark.sql import functions as F

from tidemark.operators import features, knn, validate
from tidemark.schema import FeatureParams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(df, tmp_path, name="t"):
    df.write.parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


def test_features_take_one_exchange_and_read_what_they_need(spark, tmp_path):
    b = stored(bars(spark, walk(60)), tmp_path)
    four = plan(features.compute_features(b))
    assert four.count("Exchange") == 1 and "hashpartitioning(series_id" in four
    read = re.search(r"ReadSchema: struct<([^>]*)>", four)[1]
    assert "volume" not in read and "open" not in read and "close" in read
    assert plan(features.compute_features(b, FeatureParams(include_volume=True, baseline=30))).count("Exchange") == 1


def test_features_of_a_day_push_nothing_below_their_windows(spark, tmp_path):
    b = stored(bars(spark, walk(60)), tmp_path)
    one = features.compute_features(b).where("date = date'2001-02-10'")
    assert one.count() == 1 and one.first()["momentum"] == features.compute_features(b).where("day = 40").first()["momentum"]


def test_neighbours_never_make_pairs(spark, tmp_path):
    df, c = points(spark, [(i, i % 3) for i in range(30)])
    df = stored(df, tmp_path)
    one, cut = plan(knn.knn(df, c, 3)), plan(knn.knn(df, c, 3, block_rows=7))
    assert "CartesianProduct" not in one + cut and "NestedLoop" not in one + cut and "WindowGroupLimit" in cut
    assert one.count("Exchange") == 1 and "Join" not in one


def test_validation_shares_its_exchanges(spark, tmp_path):
    labels = stored(spark.createDataFrame([("all", i, i % 2) for i in range(20)], "series_id string, row int, label int"), tmp_path)
    assert "NestedLoop" not in plan(validate.recurrence(labels)) and plan(validate.persistence(labels)).count("Exchange") <= 2


def test_agreement_reads_its_pairs_once(spark):
    """They may come from a search of neighbours, which would be made three times."""
    df, c = points(spark, [(i, i % 3) for i in range(30)])
    near = knn.knn(df, c, 1).select((F.col("row") % 3).alias("a"), (F.col("neighbor_row") % 3).alias("b"))
    assert plan(validate.adjusted_rand(near, "a", "b")).count("FlatMapGroupsInArrow") == 1
