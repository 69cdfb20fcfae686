"""A registered query for each operator, on bars built from the order table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, graph, hdbscan, knn, standardize, validate
from ..schema import OHLCV, ClusterParams, FeatureParams
from ..sources import bars as B
from ..sources import sinks
from ..sources.storage import shared_dir
from . import pipeline

D4, D5 = FeatureParams(), FeatureParams(include_volume=True)
K, BLOCK, MIN_SAMPLES = 10, 20, 10
VECTOR = tuple(f"e{i}" for i in range(64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars_from_orders(table(spark, sf_dir, "orders"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, whole numbers as longs; the series isn't shown."""
    kinds = dict(df.dtypes)
    one = lambda c: F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c)
    return df.select(*[one(c) for c in df.columns if c != "series_id"])


def rows4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.compute_features(bars(spark, sf_dir), D4)


def rows5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.compute_features(bars(spark, sf_dir), D5)


def points4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.ZScore().fit_transform(rows4(spark, sf_dir), D4.columns).cache()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as points: row in id order, one column for each number."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("all").alias("series_id"), F.col("vec_id").cast("int").alias("row"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VECTOR)])


def bars_daily(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


def log_returns(spark, sf_dir):
    return rounded(features.with_returns(bars(spark, sf_dir)).select("date", "ret"))


def ohlcv_violations(spark, sf_dir):
    """Order bars with every seventh price negated and every eleventh missing."""
    broken = bars(spark, sf_dir).select("series_id", "date", F.when(F.col("day") % 7 == 0, -F.col("open")).otherwise(F.col("open")).alias("open"), "high", "low", F.when(F.col("day") % 11 != 0, F.col("close")).alias("close"), "volume")
    return B.violations(broken).select("date", "rule")


def merge_dedupe(spark, sf_dir):
    """Two downloads that overlap become one."""
    every = bars(spark, sf_dir).drop("day")
    both = every.where("date < date'1999-01-01'").unionByName(every.where("date >= date'1998-12-01'"))
    return rounded(B.merge_chunks(both))


def history_depth(spark, sf_dir):
    return rounded(B.history(bars(spark, sf_dir)))


def one_feature(name):
    params = D5 if name == "rel_volume" else D4
    return lambda spark, sf_dir: rounded(features.compute_features(bars(spark, sf_dir), params).select("row", "date", name))


def features_d4(spark, sf_dir):
    return rounded(rows4(spark, sf_dir))


def features_d5(spark, sf_dir):
    return rounded(rows5(spark, sf_dir))


def features_warmup251(spark, sf_dir):
    return rounded(features.compute_features(bars(spark, sf_dir), FeatureParams(min_first_day=251)))


def zscore_params(spark, sf_dir):
    return rounded(standardize.ZScore().parameters(rows4(spark, sf_dir), D4.columns))


def zscore_apply(spark, sf_dir):
    return rounded(standardize.ZScore().fit_transform(rows4(spark, sf_dir), D4.columns))


def robust_params(spark, sf_dir):
    return rounded(standardize.Robust().parameters(rows4(spark, sf_dir), D4.columns))


def robust_apply(spark, sf_dir):
    return rounded(standardize.Robust().fit_transform(rows4(spark, sf_dir), D4.columns))


def feature_corr(spark, sf_dir):
    return rounded(standardize.correlations(rows5(spark, sf_dir), D5.columns))


def feature_spread(spark, sf_dir):
    return rounded(standardize.spread(rows4(spark, sf_dir), D4.columns))


def volume_by_year(spark, sf_dir):
    return rounded(standardize.volume_by_year(bars(spark, sf_dir)))


def close_range(spark, sf_dir):
    """The axis of a chart: lowest and highest close of each series."""
    return rounded(bars(spark, sf_dir).groupBy("series_id").agg(F.min("close").alias("low"), F.max("close").alias("high")))


def momentum_by_series(spark, sf_dir):
    """A series for each order priority: their windows run side by side."""
    split = B.bars_from_orders(table(spark, sf_dir, "orders"), F.col("o_orderpriority"))
    return rounded(features.compute_features(split, D4).withColumn("series", F.col("series_id")).select("series", "row", "date", "momentum", "realized_vol"))


def lookup_on_date(spark, sf_dir):
    """The feature row of one day."""
    return rounded(features.find_row(rows4(spark, sf_dir), "1998-06-02"))


def neighbor_table(spark, sf_dir):
    """The neighbour file: index, date, rank, neighbour's index and date, distance."""
    found = knn.knn(points4(spark, sf_dir), D4.columns, 3)
    return rounded(sinks.neighbors_csv(found, rows4(spark, sf_dir)))


def label_table(spark, sf_dir):
    """The label file of the proxy labels: index, date, label."""
    return rounded(sinks.labels_csv(proxy(spark, sf_dir)))


def distinct_labels(spark, sf_dir):
    """Labels that occur, without noise."""
    return rounded(proxy(spark, sf_dir).where("label >= 0").select("label").distinct())


def label_counts(spark, sf_dir):
    """Rows, clusters and share of noise of the proxy labels."""
    return rounded(validate.counts(proxy(spark, sf_dir)))


def chart_json(spark, sf_dir):
    """The chart's JSON with the proxy labels in both resolutions."""
    labels = proxy(spark, sf_dir)
    return sinks.chart_json(bars(spark, sf_dir), rows4(spark, sf_dir), labels, labels, D4.columns).drop("series_id")


def knn_exact(spark, sf_dir):
    return rounded(knn.knn(points4(spark, sf_dir), D4.columns, 10))


def knn_external(spark, sf_dir):
    """The 10 nearest of a given point that is no row."""
    asked = spark.createDataFrame([("all", 0, 0.5, -0.25, 0.1, 1.0)], "series_id string, row int, " + ", ".join(f"{c} double" for c in D4.columns))
    return rounded(knn.knn(points4(spark, sf_dir), D4.columns, 10, block=0, queries=asked).drop("row"))


def knn_on_date(spark, sf_dir):
    """The 10 nearest of row 700, with their dates and raw features."""
    raw, points = rows4(spark, sf_dir), points4(spark, sf_dir)
    return rounded(pipeline.described(knn.knn(points, D4.columns, 10, queries=points.where("row = 700")), raw, D4.columns))


def knn_stress_days(spark, sf_dir):
    """The 5 nearest of four listed days."""
    points = points4(spark, sf_dir)
    asked = points.where(F.col("date").isin([F.lit(d).cast("date") for d in STRESS]))
    found = knn.knn(points, D4.columns, 5, queries=asked)
    return rounded(pipeline.described(found, rows4(spark, sf_dir), D4.columns).select("date", "rank", "neighbor_date", "dist"))


STRESS = ("1996-03-05", "1997-10-27", "1998-08-31", "2000-04-14")


def next_day_lookup(spark, sf_dir):
    """The first row on or after some dates; none after the last."""
    dates = spark.createDataFrame([("1994-01-01",), ("1997-03-02",), ("1998-06-06",), ("2000-01-01",), ("2031-01-01",)], "wanted string")
    return features.next_days(rows4(spark, sf_dir), dates).drop("series_id")


def knn_blocked_w20(spark, sf_dir):
    return rounded(knn.neighbor_graph(points4(spark, sf_dir), D4.columns, 10, 20))


def knn_embeddings(spark, sf_dir):
    """The 10 nearest of every embedding, in 64 dimensions."""
    return rounded(knn.knn(vectors(spark, sf_dir), VECTOR, 10))


def core_distance(spark, sf_dir):
    return rounded(graph.core_distances(knn.neighbor_graph(points4(spark, sf_dir), D4.columns, 10, 20), 10))


def knn_edges_sym(spark, sf_dir):
    return rounded(graph.symmetric_edges(knn.neighbor_graph(points4(spark, sf_dir), D4.columns, 10, 20)))


def mutual_reach(spark, sf_dir):
    g = knn.neighbor_graph(points4(spark, sf_dir), D4.columns, 10, 20).cache()
    return rounded(graph.mutual_reachability(graph.symmetric_edges(g), graph.core_distances(g, 10)))


def weighed(tree: DataFrame) -> DataFrame:
    return rounded(tree.agg(F.count("*").alias("edges"), F.sum("w").alias("weight")))


def whole(spark, sf_dir):
    points = points4(spark, sf_dir)
    g = knn.neighbor_graph(points, D4.columns, K, BLOCK).cache()
    return points, g, graph.core_distances(g, MIN_SAMPLES)


def mst_exact(spark, sf_dir):
    """Edges and weight of the exact tree over all rows."""
    points, _, core = whole(spark, sf_dir)
    return weighed(graph.spanning_tree(points, core, D4.columns, BLOCK))


def mst_rounds(spark, sf_dir):
    """The same by distributed rounds."""
    points, _, core = whole(spark, sf_dir)
    return weighed(graph.boruvka(points, core, D4.columns, BLOCK))


def mst_all(spark, sf_dir):
    """The exact tree's edges."""
    points, _, core = whole(spark, sf_dir)
    return rounded(graph.spanning_tree(points, core, D4.columns, BLOCK))


def mst_rounds_all(spark, sf_dir):
    """The same edges by distributed rounds."""
    points, _, core = whole(spark, sf_dir)
    return rounded(graph.boruvka(points, core, D4.columns, BLOCK))


def mst_substrate(spark, sf_dir):
    """Edges and weight of the tree over the neighbour graph of all rows."""
    points, g, core = whole(spark, sf_dir)
    return weighed(graph.substrate_tree(points, g, core, D4.columns, BLOCK))


def substrate_edges(spark, sf_dir):
    """That tree's edges."""
    points, g, core = whole(spark, sf_dir)
    return rounded(graph.substrate_tree(points, g, core, D4.columns, BLOCK))


CLUSTERS = ClusterParams(min_cluster_size=15, min_samples=5)


def labelled(spark, sf_dir):
    return hdbscan.hdbscan(points4(spark, sf_dir), D4.columns, CLUSTERS)


def hdbscan_labels(spark, sf_dir):
    return rounded(labelled(spark, sf_dir).select("row", "date", "label"))


def hdbscan_stability(spark, sf_dir):
    return rounded(hdbscan.clusters(labelled(spark, sf_dir)))


def cluster_counts(spark, sf_dir):
    return rounded(validate.counts(labelled(spark, sf_dir)))


def cluster_persistence(spark, sf_dir):
    return rounded(validate.persistence(labelled(spark, sf_dir)))


def cluster_recurrence(spark, sf_dir):
    return rounded(validate.recurrence(labelled(spark, sf_dir), 5))


def cluster_report(spark, sf_dir):
    """Days, runs, episodes and following volatility of the clusters and of noise."""
    return rounded(validate.report(labelled(spark, sf_dir).cache(), bars(spark, sf_dir), 5))


def scaling_recall(spark, sf_dir):
    """Recall at 10 of the neighbours under robust scaling against those under z-scores."""
    raw = rows4(spark, sf_dir)
    robust = standardize.Robust().fit_transform(raw, D4.columns)
    return rounded(knn.recall(knn.knn(robust, D4.columns, 10), knn.knn(points4(spark, sf_dir), D4.columns, 10)))


def csv_round_trip(spark, sf_dir):
    """The bars, written as a bar file and loaded back through its contract."""
    path = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/bars-{uuid.uuid4().hex}"
    sinks.write_csv(sinks.bars_csv(bars(spark, sf_dir)).coalesce(1), path)
    return rounded(B.read_ohlcv_csv(spark, path))


def chart_rows(spark, sf_dir):
    """The chart's JSON read back: each feature row with its date, close, features and both labels."""
    blob = "dates array<string>, close array<double>, offset int, features array<array<double>>, fine array<int>, coarse array<int>"
    found = chart_json(spark, sf_dir).select(F.from_json("json", blob).alias("j")).select("j.*", F.posexplode("j.features").alias("row", "f"))
    at = F.col("offset") + F.col("row") + 1
    return rounded(found.select("row", F.element_at("dates", at).alias("date"), F.element_at("close", at).alias("close"), *[F.col("f")[i].alias(c) for i, c in enumerate(D4.columns)], F.element_at("fine", F.col("row") + 1).alias("fine"), F.element_at("coarse", F.col("row") + 1).alias("coarse")))


def proxy(spark, sf_dir):
    """Rows labelled by volatility: noise in the middle, 0 calm, 1 restless. SQL can say that."""
    label = F.when(F.col("realized_vol") < 0.9, 0).when(F.col("realized_vol") > 1.1, 1).otherwise(-1)
    return rows4(spark, sf_dir).select("series_id", "row", "day", "date", label.alias("label"))


def persistence(spark, sf_dir):
    return rounded(validate.persistence(proxy(spark, sf_dir)))


def recurrence(spark, sf_dir):
    return rounded(validate.recurrence(proxy(spark, sf_dir), 5))


def episodes(spark, sf_dir):
    return rounded(validate.episodes(proxy(spark, sf_dir), 5))


def forward_vol(spark, sf_dir):
    return rounded(validate.forward_vol(proxy(spark, sf_dir), bars(spark, sf_dir)))


def regime_report(spark, sf_dir):
    return rounded(validate.report(proxy(spark, sf_dir), bars(spark, sf_dir), 5))


EVENTS = [(1, "first", "1996-01-10", "1996-03-01"), (2, "second", "1996-02-20", "1997-05-05"), (3, "third", "2000-12-30", "2001-01-02")]


def event_overlap(spark, sf_dir):
    events = spark.createDataFrame(EVENTS, "event_order int, event string, start string, end string").select("event_order", "event", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return rounded(validate.overlapping_events(validate.episodes(proxy(spark, sf_dir), 5), events).select("label", "episode", "first_date", "last_date", "event"))


def named_labels(spark, sf_dir):
    """Labels' names, days and noise of the proxy labels."""
    named = validate.name_labels(proxy(spark, sf_dir), {0: "calm", 1: "restless"})
    return named.groupBy("name").agg(F.count("*").alias("n_days"))


def ari(spark, sf_dir):
    """Agreement of an embedding's label with that of its nearest other embedding."""
    points = vectors(spark, sf_dir)
    near = knn.knn(points, VECTOR, 1).select("row", "neighbor_row")
    of = points.select(F.col("row").alias("neighbor_row"), F.col("label").alias("other"))
    pairs = near.join(points.select("row", "label"), "row").join(of, "neighbor_row")
    return rounded(validate.adjusted_rand(pairs, "label", "other"))


def ann_recall(spark, sf_dir):
    """Recall at 10 of hashing against exact search over all rows."""
    exact, found = pipeline.index_bench(points4(spark, sf_dir), D4.columns)
    return knn.recall(found, exact).select((F.col("recall") >= 0.95).alias("enough"), F.round("recall", 4).alias("recall"))


QUERIES = {
    f.__name__: f
    for f in (
        bars_daily, log_returns, ohlcv_violations, merge_dedupe, history_depth, features_d4, features_d5, features_warmup251, zscore_params, zscore_apply, robust_params, robust_apply, feature_corr,
        feature_spread, volume_by_year, knn_exact, knn_external, knn_on_date, knn_stress_days, next_day_lookup, knn_blocked_w20, knn_embeddings, core_distance, knn_edges_sym, mutual_reach, mst_exact, mst_rounds,
        mst_all, mst_rounds_all, mst_substrate, substrate_edges, cluster_persistence, cluster_recurrence, cluster_report, scaling_recall, csv_round_trip, chart_rows, hdbscan_labels, hdbscan_stability, cluster_counts, persistence, recurrence, episodes, forward_vol, regime_report, event_overlap, named_labels, ari, ann_recall,
        close_range, momentum_by_series, lookup_on_date, neighbor_table, label_table, distinct_labels, label_counts, chart_json,
    )
} | {f"{c}_{n}": one_feature(c) for c, n in (("realized_vol", 20), ("momentum", 20), ("max_drawdown", 20), ("skewness", 20), ("rel_volume", 252))}
