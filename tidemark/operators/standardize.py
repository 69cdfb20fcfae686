"""Standardisers: fit gives a row of parameters for each series, transform is (x - centre) / scale."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored_table

#: A scale below this is no scale: the column doesn't vary.
DEAD = 1e-12
#: Fixed value: the interquartile range of a standard normal distribution.
NORMAL_IQR = 1.3489795003921634


class Standardizer(ABC):
    """fit, then transform; transforming before fitting or with other columns is an error."""

    def __init__(self):
        self.columns: tuple[str, ...] | None = None
        self.params: DataFrame | None = None

    @staticmethod
    @abstractmethod
    def centre_and_scale(c: str) -> tuple[Column, Column]:
        """Aggregates for one column."""

    def parameters(self, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """series_id, n, and c_<column> and s_<column> of every series."""
        pairs = {c: self.centre_and_scale(c) for c in columns}
        return rows.groupBy("series_id").agg(F.count("*").alias("n"), *[x.alias(f"{p}_{c}") for c, pair in pairs.items() for p, x in zip("cs", pair)])

    def fit(self, rows: DataFrame, columns: tuple[str, ...]) -> Standardizer:
        """Learns the parameters; ValueError if a series has under two rows or a column doesn't vary."""
        params = stored_table(self.parameters(rows, columns), "scales")
        dead = [F.when(~(F.col(f"s_{c}") >= DEAD), F.lit(c)) for c in columns]  # also null and NaN
        bad = params.select("series_id", "n", F.concat_ws(", ", *dead).alias("dead")).where("n < 2 or dead <> ''").head()
        if bad:
            raise ValueError(f"series {bad['series_id']}: {'under two rows' if bad['n'] < 2 else 'no spread in ' + bad['dead']}")
        self.columns, self.params = tuple(columns), params
        return self

    def transform(self, rows: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
        """rows with the columns standardised; rows itself isn't changed."""
        if self.params is None:
            raise RuntimeError("fit comes first")
        if columns is not None and tuple(columns) != self.columns:
            raise ValueError(f"fitted on {self.columns}, not {tuple(columns)}")
        return standardized(rows, self.params, self.columns)

    def fit_transform(self, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return self.fit(rows, columns).transform(rows)


def standardized(rows: DataFrame, params: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """rows ((x - centre) / scale) by each series' parameters."""
    new = {c: (F.col(c) - F.col(f"c_{c}")) / F.col(f"s_{c}") for c in columns}
    return rows.join(params, "series_id").select(*[new[c].alias(c) if c in new else rows[c] for c in rows.columns])


class ZScore(Standardizer):
    """Mean and sample standard deviation of the whole series: looks ahead, on purpose."""

    @staticmethod
    def centre_and_scale(c: str) -> tuple[Column, Column]:
        return F.avg(c), F.stddev_samp(c)


class Robust(Standardizer):
    """Median and interquartile range over that of a normal distribution; quantiles are interpolated."""

    @staticmethod
    def centre_and_scale(c: str) -> tuple[Column, Column]:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return q[1], (q[2] - q[0]) / NORMAL_IQR


KINDS = {"zscore": ZScore, "robust": Robust}


def make_standardizer(name: str) -> Standardizer:
    if name not in KINDS:
        raise ValueError(f"no standardiser {name!r}; there are {sorted(KINDS)}")
    return KINDS[name]()


def correlations(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """series_id, a, b and the Pearson correlation of each pair of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    found = rows.groupBy("series_id").agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("p"))
    return found.select("series_id", F.explode("p").alias("p")).select("series_id", "p.a", "p.b", "p.corr")


def spread(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """series_id, feature, sd, low, first percentile, and the robust over the classic scale."""
    one = lambda c: F.struct(
        F.lit(c).alias("feature"), F.stddev_samp(c).alias("sd"), F.min(c).alias("low"), F.percentile(c, 0.01).alias("p1"),
        ((F.percentile(c, 0.75) - F.percentile(c, 0.25)) / NORMAL_IQR / F.stddev_samp(c)).alias("robust_ratio"),
    )
    found = rows.groupBy("series_id").agg(F.array(*[one(c) for c in columns]).alias("p"))
    return found.select("series_id", F.explode("p").alias("p")).select("series_id", "p.*")


def volume_by_year(bars: DataFrame) -> DataFrame:
    """series_id, year and the median volume."""
    return bars.groupBy("series_id", F.year("date").alias("year")).agg(F.median("volume").alias("median_volume"))
