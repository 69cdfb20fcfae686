"""Trailing-window statistics as column expressions; w is the window they run over."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Below this population variance a window counts as flat and its skewness is 0.
FLAT = 1e-16


def log_return(close: Column, w: WindowSpec) -> Column:
    """ln of the close over the close before; w is ordered."""
    return F.log(close / F.lag(close).over(w))


def realized_vol(r: Column, w: WindowSpec) -> Column:
    """Sample standard deviation, not annualised."""
    return F.stddev_samp(r).over(w)


def momentum(r: Column, w: WindowSpec) -> Column:
    return F.sum(r).over(w)


def max_drawdown(close: Column, w: WindowSpec) -> Column:
    """The lowest ln(close / highest close so far in the window): 0 or less."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("low"))

    def step(acc, c):
        peak = F.greatest(acc["peak"], c)
        return F.struct(peak.alias("peak"), F.least(acc["low"], F.log(c / peak)).alias("low"))

    return F.aggregate(F.collect_list(close).over(w), start, step, lambda acc: acc["low"])


def skewness(r: Column, w: WindowSpec, n: int) -> Column:
    """Bias-corrected skewness of n values; 0 for a flat window."""
    corrected = F.skewness(r).over(w) * ((n * (n - 1)) ** 0.5 / (n - 2))
    return F.when(F.var_pop(r).over(w) < FLAT, 0.0).otherwise(F.coalesce(corrected, F.lit(0.0)))


def rel_volume(volume: Column, short: WindowSpec, long: WindowSpec) -> Column:
    """ln of the mean volume over the baseline's; a mean that isn't positive is an error."""
    near, base = F.avg(volume).over(short), F.avg(volume).over(long)
    return F.when((near <= 0) | (base <= 0), F.raise_error(F.lit("the mean volume isn't positive")).cast("double")).otherwise(F.log(near / base))
