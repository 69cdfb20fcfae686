"""Schemas and parameters.

A series is a run of daily bars. ``day`` numbers a series' bars from 0 in date order, ``row``
numbers its feature rows; both are made once and carried, as a DataFrame has no order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
OHLCV = ("date", *PRICES, "volume")
BARS = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in OHLCV[1:]]])
FEATURES = ("realized_vol", "momentum", "max_drawdown", "skewness", "rel_volume")


@dataclass(frozen=True)
class FeatureParams:
    """window: returns in a window; baseline: days of mean volume; min_first_day: at least the first row's day."""

    window: int = 20
    include_volume: bool = False
    baseline: int = 252
    min_first_day: int = 0

    def __post_init__(self):
        if self.window < 3:
            raise ValueError("window has to be 3 at least")
        if self.include_volume and self.baseline <= self.window:
            raise ValueError("baseline has to be longer than window")

    @property
    def first_day(self) -> int:
        """The day of the first row: the first with a full window in every column."""
        return max(self.window, self.baseline - 1 if self.include_volume else 0, self.min_first_day)

    @property
    def columns(self) -> tuple[str, ...]:
        return FEATURES[: 4 + self.include_volume]

    @classmethod
    def of_dimension(cls, d: int, min_first_day: int = 0) -> FeatureParams:
        """4 features, or 5 with relative volume."""
        if d not in (4, 5):
            raise ValueError("there are 4 or 5 features")
        return cls(include_volume=d == 5, min_first_day=min_first_day)


@dataclass(frozen=True)
class ClusterParams:
    """k neighbours at least block days apart; min_samples counts the point itself."""

    k: int = 10
    block: int = 20
    min_cluster_size: int = 30
    min_samples: int = 10

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k has to be 1 at least")
        if not 2 <= self.min_samples <= self.k + 1:
            raise ValueError("min_samples has to be from 2 to k + 1")
        if self.min_cluster_size < 2:
            raise ValueError("min_cluster_size has to be 2 at least")
        if self.block < 0:
            raise ValueError("block can't be negative")
