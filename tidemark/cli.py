"""Command line: features, neighbors, crisis, bench, dump-nn, regimes.

Exit codes: 0, 1 for an error in data or parameters, 2 for wrong usage.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features, knn, standardize, validate
from .plans import pipeline
from .schema import ClusterParams, FeatureParams
from .sources import sinks
from .sources.bars import read_ohlcv_csv


#: brute and hnsw are names that such tools use for exact and approximate search.
INDEX_NAMES = {"exact": "exact", "brute": "exact", "lsh": "lsh", "hnsw": "lsh"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *, prefix: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("csv")
        if prefix:
            p.add_argument("prefix", nargs="?", default="out")
        return p

    p = command("features", "raw and standardised feature files", prefix=True)
    p.add_argument("--std", choices=["zscore", "robust", "none"], default="zscore")
    p.add_argument("--d", type=int, default=4, choices=[4, 5])
    p.add_argument("--warmup", type=int, default=0)
    p = command("neighbors", "the nearest days of one day")
    p.add_argument("--date", required=True)
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--index", choices=sorted(INDEX_NAMES), default="exact")
    p = command("crisis", "the nearest days of days of stress")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--days", nargs="+", default=list(pipeline.STRESS_DAYS))
    p = command("bench", "time and recall of hashing against exact search")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--tables", type=int, default=12)
    p.add_argument("--bits", type=int, default=2)
    p.add_argument("--width", type=float, default=2.0)
    p.add_argument("--queries", type=int, default=11, help="single queries that are timed")
    p = command("dump-nn", "the neighbours of all days", prefix=True)
    p.add_argument("-k", type=int, default=10)
    p = command("regimes", "clusters, their validation and labels", prefix=True)
    for flag, default in (("-k", 10), ("--mcs", 30), ("--min-samples", 10), ("--block", 20), ("--gap", 60), ("--warmup", 0)):
        p.add_argument(flag, type=int, default=default)
    p.add_argument("--mst", choices=["exact", "substrate"], default="exact")
    p.add_argument("--d", type=int, default=4, choices=[4, 5])
    return top


def shown(df: DataFrame) -> None:
    df.show(200, truncate=False)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    bars = read_ohlcv_csv(spark, args.csv).cache()
    if args.command == "features":
        params = FeatureParams.of_dimension(args.d, args.warmup)
        raw = features.compute_features(bars, params, check_length=True).cache()
        sinks.write_csv(sinks.features_csv(raw, params.columns), f"{args.prefix}_raw.csv", "overwrite")
        if args.std != "none":
            std = standardize.make_standardizer(args.std).fit_transform(raw, params.columns)
            sinks.write_csv(sinks.features_csv(std, params.columns), f"{args.prefix}_std.csv", "overwrite")
        shown(raw.agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last")))
        shown(standardize.spread(raw, params.columns))
        return
    if args.command == "regimes":
        labels = pipeline.regimes(bars, FeatureParams.of_dimension(args.d, args.warmup), ClusterParams(args.k, args.block, args.mcs, args.min_samples), args.mst).cache()
        shown(validate.counts(labels))
        shown(pipeline.regime_report(bars, labels, args.gap))
        sinks.write_csv(sinks.labels_csv(labels), f"{args.prefix}_labels.csv", "overwrite")
        return
    params = FeatureParams()
    raw, points = pipeline.standard_rows(bars, params)
    if args.command == "neighbors":
        features.find_row(raw, args.date)
        shown(pipeline.neighbors_on(bars, [args.date], args.k, INDEX_NAMES[args.index]).orderBy("rank"))
    elif args.command == "crisis":
        for day in args.days:
            features.find_row(raw, day)
        shown(pipeline.neighbors_on(bars, args.days, args.k).orderBy("date", "rank"))
    elif args.command == "dump-nn":
        found = knn.knn(points, params.columns, args.k)
        sinks.write_csv(sinks.neighbors_csv(found, raw).orderBy("index", "rank"), f"{args.prefix}_nn.csv", "overwrite")
    elif args.command == "bench":
        exact, found = (df.cache() for df in pipeline.index_bench(points.cache(), params.columns, args.k, tables=args.tables, bits=args.bits, width=args.width))
        for name, df in (("exact", exact), ("lsh", found)):
            began = time.perf_counter()
            rows = df.count()
            print(f"{name}: {time.perf_counter() - began:.3f} s for {rows} neighbours")
        shown(knn.recall(found, exact))
        times = []
        for row in range(max(1, args.queries)):
            began = time.perf_counter()
            knn.knn(points, params.columns, args.k, queries=points.where(F.col("row") == row)).collect()
            times.append(time.perf_counter() - began)
        times.sort()
        print(f"one query: mean {sum(times) / len(times):.3f} s, p50 {times[len(times) // 2]:.3f} s, p99 {times[len(times) * 99 // 100]:.3f} s")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        run(args, spark or SparkSession.builder.appName("tidemark").getOrCreate())
    except (ValueError, RuntimeError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
