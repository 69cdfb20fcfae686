"""Feature rows from bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling
from ..schema import FeatureParams


def with_returns(bars: DataFrame) -> DataFrame:
    """bars with ret, the log return from the day before (null on day 0)."""
    return bars.withColumn("ret", rolling.log_return(F.col("close"), Window.partitionBy("series_id").orderBy("day")))


def compute_features(bars: DataFrame, params: FeatureParams = FeatureParams(), check_length: bool = False) -> DataFrame:
    """series_id, row, day, date and the features of params; a row's windows end at its day.

    One sort by series and day serves all windows; only the columns that are used are computed.
    check_length: ValueError for series too short for one row (an action; else they have no rows).
    """
    first, n = params.first_day, params.window
    if check_length:
        short = bars.groupBy("series_id").count().where(F.col("count") <= first).head(5)
        if short or bars.isEmpty():
            raise ValueError(f"needs {first + 1} bars at least; too short: {[tuple(r) for r in short]}")
    by = Window.partitionBy("series_id").orderBy("day")
    trail = lambda size: by.rowsBetween(1 - size, 0)
    r, close, volume = F.col("ret"), F.col("close"), F.col("volume")
    kinds = {
        "realized_vol": rolling.realized_vol(r, trail(n)),
        "momentum": rolling.momentum(r, trail(n)),
        "max_drawdown": rolling.max_drawdown(close, trail(n + 1)),
        "skewness": rolling.skewness(r, trail(n), n),
    }
    if params.include_volume:
        kinds["rel_volume"] = rolling.rel_volume(volume, trail(n), trail(params.baseline))
    rows = with_returns(bars).select("series_id", "day", "date", *[kinds[c].alias(c) for c in params.columns])
    return rows.where(F.col("day") >= first).select("series_id", (F.col("day") - first).cast("int").alias("row"), "day", "date", *params.columns)


def find_row(rows: DataFrame, date: str) -> DataFrame:
    """The rows of a date; where there is none, ValueError that names the next date."""
    found = rows.where(F.col("date") == F.lit(date).cast("date"))
    if found.isEmpty():
        after = rows.where(F.col("date") > F.lit(date).cast("date")).agg(F.min("date")).first()[0]
        raise ValueError(f"no row on {date}; the next is on {after}" if after else f"no row on or after {date}")
    return found


def next_days(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """For each row of dates (column wanted): the first date on or after it, per series.

    An as-of join: both sides are sorted together by series and date, so no pairs are made.
    """
    series = rows.select("series_id").distinct()
    asked = dates.select(F.col("wanted").cast("date").alias("date"), F.lit(True).alias("asked")).join(series)
    both = rows.select("series_id", "date", F.lit(False).alias("asked")).unionByName(asked.select("series_id", "date", "asked"))
    ahead = Window.partitionBy("series_id").orderBy("date", F.col("asked").desc()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("next_date", F.first(F.when(~F.col("asked"), F.col("date")), ignorenulls=True).over(ahead))
    return found.where("asked").select("series_id", F.col("date").alias("wanted"), "next_date")
