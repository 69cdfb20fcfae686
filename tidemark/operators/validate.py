"""What labels are worth: persistence, recurrence, the volatility that follows, agreement.

labels: series_id, row, label (-1 is noise), and day where bars are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import log_return


def with_runs(labels: DataFrame) -> DataFrame:
    """labels with starts (1 where a run of equal labels begins, else 0) and run (its number)."""
    w = Window.partitionBy("series_id").orderBy("row")
    starts = F.when(F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)
    return labels.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w))


def persistence(labels: DataFrame) -> DataFrame:
    """series_id, label, n_days, n_runs and mean_run, noise too."""
    found = with_runs(labels).groupBy("series_id", "label").agg(F.count("*").alias("n_days"), F.sum("starts").alias("n_runs"))
    return found.withColumn("mean_run", F.col("n_days") / F.col("n_runs"))


def with_episodes(labels: DataFrame, gap: int) -> DataFrame:
    """The rows that aren't noise, with opens (1 where the label was away for over gap rows, else 0)
    and episode, its number within the label."""
    w = Window.partitionBy("series_id", "label").orderBy("row")
    away = F.col("row") - F.lag("row").over(w)
    rows = labels.where("label >= 0").withColumn("opens", F.when(away <= gap, 0).otherwise(1))
    return rows.withColumn("episode", F.sum("opens").over(w))


def recurrence(labels: DataFrame, gap: int = 60) -> DataFrame:
    """series_id, label, n_days, n_episodes, first_row and last_row, without noise."""
    found = with_episodes(labels, gap).groupBy("series_id", "label")
    return found.agg(F.count("*").alias("n_days"), F.sum("opens").alias("n_episodes"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def episodes(labels: DataFrame, gap: int = 60) -> DataFrame:
    """series_id, label, episode, n_days, and first and last row and date of each episode."""
    found = with_episodes(labels, gap).groupBy("series_id", "label", "episode")
    return found.agg(F.count("*").alias("n_days"), *[f(c).alias(f"{n}_{c}") for c in ("row", "date") for n, f in (("first", F.min), ("last", F.max))])


def forward_volatility(bars: DataFrame, horizon: int = 20) -> DataFrame:
    """series_id, day and forward_vol: the sample deviation of the next horizon returns; days without
    so many are left out."""
    if horizon < 2:
        raise ValueError("horizon has to be 2 at least")
    by = Window.partitionBy("series_id").orderBy("day")
    ahead = by.rowsBetween(1, horizon)
    rows = bars.withColumn("r", log_return(F.col("close"), by))
    rows = rows.select("series_id", "day", F.stddev_samp("r").over(ahead).alias("forward_vol"), F.count("r").over(ahead).alias("_n"))
    return rows.where(F.col("_n") == horizon).drop("_n")


def upper_median(c: str) -> Column:
    """The middle value, of an even number the upper of the two. It keeps counts of values, no list."""
    below, above = F.expr(f"percentile_disc(0.5) within group (order by {c})"), F.expr(f"percentile_disc(0.5) within group (order by {c} desc)")
    return F.greatest(below, above)


def forward_vol(labels: DataFrame, bars: DataFrame, horizon: int = 20) -> DataFrame:
    """series_id, label, n, mean_vol and median_vol of the days with a whole window ahead, noise too."""
    rows = labels.select("series_id", "day", "label").join(forward_volatility(bars, horizon), ["series_id", "day"])
    return rows.groupBy("series_id", "label").agg(F.count("*").alias("n"), F.avg("forward_vol").alias("mean_vol"), upper_median("forward_vol").alias("median_vol"))


def only_labels(labels: DataFrame, shown: list[int], noise: bool = False) -> DataFrame:
    """labels of some regimes, and noise where it is wanted."""
    return labels.where(F.col("label").isin(list(shown)) | (F.lit(noise) & (F.col("label") < 0)))


def report(labels: DataFrame, bars: DataFrame, gap: int = 60, horizon: int = 20) -> DataFrame:
    """One row for each label: days, runs, mean run, episodes (null for noise) and what follows."""
    keys = ["series_id", "label"]
    found = persistence(labels).join(recurrence(labels, gap).drop("n_days"), keys, "left")
    return found.join(forward_vol(labels, bars, horizon), keys, "left").orderBy(*keys)


def counts(labels: DataFrame) -> DataFrame:
    """series_id, n_rows, n_clusters, n_noise and noise_share."""
    noise = F.count_if(F.col("label") < 0)
    distinct = F.count_distinct(F.when(F.col("label") >= 0, F.col("label")))
    return labels.groupBy("series_id").agg(F.count("*").alias("n_rows"), distinct.alias("n_clusters"), noise.alias("n_noise"), (noise / F.count("*")).alias("noise_share"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """ari of two labels of the same rows; noise is a label like others. 1 where both have one class.
    pairs is read once: it may be the end of a long search."""
    two = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    sums = cells.cube(a, b).agg(F.sum("n").alias("n"), F.grouping_id().alias("over"))  # 0: cells, 1: of a, 2: of b, 3: all
    of = lambda over, value, name: F.sum(F.when(F.col("over") == over, value)).alias(name)
    sums = sums.agg(of(0, two(F.col("n")), "s"), of(1, two(F.col("n")), f"s_{a}"), of(2, two(F.col("n")), f"s_{b}"), of(3, F.col("n"), "total"))
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / two(F.col("total"))
    most = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return sums.select(F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def name_labels(labels: DataFrame, names: dict[int, str]) -> DataFrame:
    """labels with name; labels without one are called by their number."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.expr("map()")
    return labels.withColumn("name", F.coalesce(F.try_element_at(known, F.col("label")), F.col("label").cast("string")) if names else F.col("label").cast("string"))


def overlapping_events(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Each episode with the first event (by event_order) that overlaps it, or null.

    events: event_order, event, start, end. A range join of days: both sides go to the months that
    they touch and meet there by equality, so no pair that shares no month is made.
    """
    months = lambda a, b: F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month")))
    keys = ["series_id", "label", "episode"]
    left = spans.select(*keys, "first_date", "last_date", months("first_date", "last_date").alias("month"))
    right = events.select("event_order", "event", "start", "end", months("start", "end").alias("month"))
    pairs = left.join(right, "month").where((F.col("start") <= F.col("last_date")) & (F.col("end") >= F.col("first_date")))
    first = pairs.groupBy(*keys).agg(F.min_by("event", "event_order").alias("event"))
    return spans.join(first, keys, "left")
