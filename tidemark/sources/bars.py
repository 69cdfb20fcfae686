"""Daily bars: reading, contract checks, merging, and building from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import OHLCV, PRICES

#: A whole number or decimal as a strict parser takes it: no blanks, no plus sign.
NUMBER = r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"
CORRUPT = "_corrupt"
LOADED_YEARS = 20


class ContractError(ValueError):
    """The input breaks the bar contract."""


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file's fields as strings, with ``line`` (the file's own numbers: the header is 1, blank lines
    count) and the whole line where it hasn't exactly six fields. Quotes mean nothing. A header other
    than the bar header fails.

    The number is the line's place, so the file is read by one task; a large archive comes as a table
    and goes to ``violations`` without lines.
    """
    text = spark.read.text(path).coalesce(1).withColumn("line", F.monotonically_increasing_id() + 1)
    value = F.regexp_replace(F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), "\r$", "")
    text = text.select("line", value.alias("value"))
    header = text.where("line = 1").head()
    if header is None or header["value"] != ",".join(OHLCV):
        raise ContractError(f"{path}:1: the header has to be {','.join(OHLCV)}")
    parts = F.split("value", ",", -1)
    six = F.size(parts) == len(OHLCV)
    fields = [F.when(six, parts[i]).alias(c) for i, c in enumerate(OHLCV)]
    return text.where("line > 1 and value <> ''").select(*fields, F.when(~six, F.col("value")).alias(CORRUPT), "line")


def typed(raw: DataFrame, series_id: str = "all") -> DataFrame:
    """Bars with their types; what isn't a number or a date becomes null."""
    number = lambda c: F.when(F.col(c).rlike(NUMBER), F.col(c).try_cast("double"))
    rest = [c for c in ("line",) if c in raw.columns]
    return raw.select(F.lit(series_id).alias("series_id"), F.col("date").try_cast("date").alias("date"), *[number(c).alias(c) for c in OHLCV[1:]], *rest)


def violations(bars: DataFrame, line: str | None = None) -> DataFrame:
    """line (if given, else null), series_id, date, rule and value of every breach of the contract:
    a missing or broken field, a price that isn't positive and finite, a negative or infinite
    volume, a date that repeats or, where lines are known, goes back."""
    at = F.col(line).cast("long") if line else F.lit(None).cast("long")
    checks: list[tuple[str, Column, Column]] = [("date missing", F.col("date").isNull(), F.col("date"))]
    for c in PRICES:
        checks += [(f"{c} is no number", F.col(c).isNull() | F.isnan(c), F.col(c)), (f"{c} isn't positive", (F.col(c) <= 0) | (F.col(c) == float("inf")), F.col(c))]
    checks += [("volume is no number", F.col("volume").isNull() | F.isnan("volume"), F.col("volume")), ("volume is negative", (F.col("volume") < 0) | (F.col("volume") == float("inf")), F.col("volume"))]
    if line:
        before = F.lag("date").over(Window.partitionBy("series_id").orderBy(line))
        order = ("date doesn't increase", F.col("_before").isNotNull() & (F.col("date") <= F.col("_before")), F.col("date"))
        bars = bars.withColumn("_before", before)
    else:
        order = ("date repeats", F.col("_copies") > 1, F.col("date"))
        bars = bars.withColumn("_copies", F.count("*").over(Window.partitionBy("series_id", "date")))
    found = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value"))) for rule, broken, value in [*checks, order]]
    rows = bars.select(at.alias("line"), "series_id", "date", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v"))
    return rows.select("line", "series_id", "date", "v.rule", "v.value")


def read_ohlcv_csv(spark: SparkSession, path: str, series_id: str = "all") -> DataFrame:
    """Bars of one series from a CSV file, or ContractError with file, line and reason.

    Takes a byte order mark, CRLF and blank lines; the header must be the bar header, every row must
    have six fields and every field be a whole number or date as it stands.
    """
    raw = read_raw_csv(spark, path)
    wrong = raw.where(F.col(CORRUPT).isNotNull()).orderBy("line").head() if raw.where(F.col(CORRUPT).isNotNull()).head(1) else None
    if wrong:
        raise ContractError(f"{path}:{wrong['line']}: needs six fields: {wrong[CORRUPT]}")
    bars = typed(raw, series_id)
    first = violations(bars, "line").orderBy("line").head()
    if first:
        raise ContractError(f"{path}:{first['line']}: {first['rule']} ({first['value']})")
    if bars.isEmpty():
        raise ContractError(f"{path}: has no rows")
    return with_days(bars.drop("line"))


def with_days(bars: DataFrame) -> DataFrame:
    """bars with day: 0, 1, ... in date order within each series."""
    return bars.withColumn("day", F.row_number().over(Window.partitionBy("series_id").orderBy("date")) - 1)


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """One bar for each series and date of overlapping downloads: identical repeats become one, two
    different bars of a day are an error."""
    values = [c for c in OHLCV if c != "date"]
    merged = chunks.groupBy("series_id", "date").agg(F.count_distinct(F.struct(*values)).alias("_kinds"), *[F.min(c).alias(c) for c in values])
    clash = F.raise_error(F.concat(F.lit("two different bars for "), F.col("series_id"), F.lit(" on "), F.col("date").cast("string")))
    return merged.select("series_id", "date", *[F.when(F.col("_kinds") > 1, clash.cast("double")).otherwise(F.col(c)).alias(c) for c in values])


def history(bars: DataFrame) -> DataFrame:
    """series_id, bars, first and last date, years, and whether there are LOADED_YEARS years."""
    found = bars.groupBy("series_id").agg(F.count("*").alias("bars"), F.min("date").alias("first"), F.max("date").alias("last"))
    years = F.datediff("last", "first") / F.lit(365.25)
    return found.withColumn("years", years).withColumn("deep", years >= LOADED_YEARS)


def bars_from_orders(orders: DataFrame, series: Column | None = None) -> DataFrame:
    """A bar for each order day: the first and last order's price by key open and close it, volume is
    the number of orders. series: a column that splits the orders into series."""
    key = F.lit("all") if series is None else series.cast("string")
    price = F.col("o_totalprice")
    bars = orders.where("o_orderdate is not null and o_totalprice is not null").groupBy(key.alias("series_id"), F.to_date("o_orderdate").alias("date"))
    bars = bars.agg(
        F.min_by(price, "o_orderkey").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return with_days(bars)
