"""Writers of bars, features, neighbours and labels, readers of features and labels, and the chart's JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import OHLCV


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; doubles as the shortest text that reads back equal."""
    df.write.mode(mode).csv(path, header=True)


def bars_csv(bars: DataFrame) -> DataFrame:
    """The columns of a bar file, in order."""
    return bars.select(*OHLCV).orderBy("date")


def features_csv(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return features.select("date", *columns).orderBy("date")


def read_features_csv(spark: SparkSession, path: str, columns: tuple[str, ...], series_id: str = "all") -> DataFrame:
    """series_id, row, date and columns of a feature file, raw or standardised; another header fails."""
    kinds = ", ".join(["date date", *(f"{c} double" for c in columns)])
    found = spark.read.csv(path, schema=kinds, header=True, enforceSchema=False, mode="FAILFAST")
    row = F.row_number().over(Window.orderBy("date")) - 1  # one file is one series
    return found.select(F.lit(series_id).alias("series_id"), row.alias("row"), "date", *columns)


def read_labels_csv(spark: SparkSession, path: str, series_id: str = "all") -> DataFrame:
    """series_id, row, date and label of a label file."""
    found = spark.read.csv(path, schema="index int, date date, label int", header=True, enforceSchema=False, mode="FAILFAST")
    return found.select(F.lit(series_id).alias("series_id"), F.col("index").alias("row"), "date", "label")


def neighbors_csv(neighbors: DataFrame, rows: DataFrame) -> DataFrame:
    """index, date, rank, neighbor_index, neighbor_date, distance. rows: series_id, row and date."""
    a = rows.select("series_id", "row", "date")
    b = rows.select("series_id", F.col("row").alias("neighbor_row"), F.col("date").alias("neighbor_date"))
    found = neighbors.join(a, ["series_id", "row"]).join(b, ["series_id", "neighbor_row"])
    return found.select(F.col("row").alias("index"), "date", "rank", F.col("neighbor_row").alias("neighbor_index"), "neighbor_date", F.col("dist").alias("distance"))


def labels_csv(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("row").alias("index"), "date", "label").orderBy("index")


def chart_json(bars: DataFrame, features: DataFrame, fine: DataFrame, coarse: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """series_id and the chart's JSON: dates, closes, the first row's day, rounded feature rows and
    two resolutions of labels. One row for each series, as the chart shows a series whole; a row of
    features without a label in both is an error."""
    ordered = lambda key, *values: F.transform(F.array_sort(F.collect_list(F.struct(key, *values))), lambda x: x)
    whole = bars.groupBy("series_id").agg(ordered("day", "date", F.round("close", 2).alias("c")).alias("b"))
    labels = features.join(fine.select("series_id", "row", F.col("label").alias("fine")), ["series_id", "row"], "left").join(coarse.select("series_id", "row", F.col("label").alias("coarse")), ["series_id", "row"], "left")
    miss = F.raise_error(F.lit("a feature row has no label"))
    labels = labels.withColumn("fine", F.coalesce("fine", miss.cast("int"))).withColumn("coarse", F.coalesce("coarse", miss.cast("int")))
    rows = labels.groupBy("series_id").agg(F.min("day").alias("first_day"), ordered("row", F.array(*[F.round(c, 6) for c in columns]).alias("f"), "fine", "coarse").alias("f"))
    blob = F.struct(
        F.transform("b", lambda x: x["date"].cast("string")).alias("dates"), F.transform("b", lambda x: x["c"]).alias("close"), F.col("first_day").alias("offset"),
        F.transform("f", lambda x: x["f"]).alias("features"), F.transform("f", lambda x: x["fine"]).alias("fine"), F.transform("f", lambda x: x["coarse"]).alias("coarse"),
    )
    return whole.join(rows, "series_id").select("series_id", F.to_json(blob).alias("json"))


def chart_pages(charts: DataFrame, template: str, mark: str) -> DataFrame:
    """series_id and html: the template with each series' JSON at mark. ``</`` is escaped, so that no
    text can end the script that holds the JSON."""
    if template.count(mark) != 1:
        raise ValueError(f"the template has to have {mark!r} once")
    before, after = template.split(mark)
    return charts.select("series_id", F.concat(F.lit(before), F.replace("json", F.lit("</"), F.lit("<\\/")), F.lit(after)).alias("html"))
