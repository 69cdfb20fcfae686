"""Made-up inputs of the tests."""

import datetime

import numpy as np

START = datetime.date(2001, 1, 1)


def returns():
    return np.random.default_rng(42).normal(-0.001, 0.015, 20)


def bars(spark, closes, volumes=None, series="all"):
    """Bars with the given closes on consecutive days."""
    volumes = volumes or [1e6 + i for i in range(len(closes))]
    closes = [float(c) for c in closes]
    rows = [(series, START + datetime.timedelta(i), i, 0.999 * c, 1.005 * c, 0.995 * c, float(c), float(v)) for i, (c, v) in enumerate(zip(closes, volumes))]
    return spark.createDataFrame(rows, "series_id string, date date, day int, open double, high double, low double, close double, volume double")


def walk(n, seed=1):
    """Closes of a random walk with steps of up to 3 %."""
    steps = np.random.default_rng(seed).uniform(-0.03, 0.03, n - 1)
    return list(100 * np.exp(np.concatenate([[0], np.cumsum(steps)])))


def points(spark, xs, series="all"):
    """Points with columns x0, x1, ..."""
    d = len(xs[0])
    kinds = "series_id string, row int, " + ", ".join(f"x{i} double" for i in range(d))
    return spark.createDataFrame([(series, i, *map(float, x)) for i, x in enumerate(xs)], kinds), tuple(f"x{i}" for i in range(d))


def blobs(p, m, seed=5, apart=12.0):
    """Two round heaps of p points and m far points that stand on two rings around both."""
    rng = np.random.default_rng(seed)
    heaps = np.concatenate([rng.standard_normal((p, 2)), rng.standard_normal((p, 2)) + [apart, 0]])
    angle, radius = rng.uniform(0, 2 * np.pi, m), rng.uniform(16, 30, m)
    far = np.column_stack([apart / 2 + radius * np.cos(angle), radius * np.sin(angle)])
    return [tuple(x) for x in np.concatenate([heaps, far])]
