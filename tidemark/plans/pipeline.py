"""Bars to standardised rows, neighbours and labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, hdbscan, knn, standardize, validate
from ..schema import ClusterParams, FeatureParams

#: Days of market stress.
STRESS_DAYS = ("2008-10-10", "2008-11-20", "2020-03-16", "2020-03-23")


def standard_rows(bars: DataFrame, params: FeatureParams = FeatureParams(), kind: str = "zscore") -> tuple[DataFrame, DataFrame]:
    """Raw and standardised feature rows."""
    raw = features.compute_features(bars, params, check_length=True)
    return raw, standardize.make_standardizer(kind).fit_transform(raw, params.columns)


def neighbors_on(bars: DataFrame, dates: list[str], k: int = 10, index: str = "exact", params: FeatureParams = FeatureParams()) -> DataFrame:
    """The k nearest rows of the rows on dates, with dates and the neighbours' raw features."""
    raw, points = standard_rows(bars, params)
    asked = points.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    found = knn.knn(points, params.columns, k, queries=asked) if index == "exact" else knn.make_index(index)(points, params.columns, k).join(asked.select("series_id", "row"), ["series_id", "row"], "left_semi")
    return described(found, raw, params.columns)


def described(found: DataFrame, raw: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Neighbours with both dates and the neighbours' raw features."""
    own = raw.select("series_id", "row", "date")
    other = raw.select("series_id", F.col("row").alias("neighbor_row"), F.col("date").alias("neighbor_date"), *columns)
    return found.join(own, ["series_id", "row"]).join(other, ["series_id", "neighbor_row"]).select("series_id", "date", "row", "rank", "neighbor_row", "neighbor_date", "dist", *columns)


def regimes(bars: DataFrame, feature_params: FeatureParams = FeatureParams(), params: ClusterParams = ClusterParams(), tree: str = "exact") -> DataFrame:
    """series_id, row, day, date, label and stability of every feature row."""
    _, points = standard_rows(bars, feature_params)
    return hdbscan.hdbscan(points, feature_params.columns, params, tree).select("series_id", "row", "day", "date", "label", "stability")


def regime_report(bars: DataFrame, labels: DataFrame, gap: int = 60, horizon: int = 20) -> DataFrame:
    return validate.report(labels, bars, gap, horizon)


def index_bench(points: DataFrame, columns: tuple[str, ...], k: int = 10, **options) -> tuple[DataFrame, DataFrame]:
    """Exact and approximate neighbours of all rows, whose jobs can be timed and compared."""
    return knn.knn(points, columns, k), knn.approximate_knn(points, columns, k, **options)
