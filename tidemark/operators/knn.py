"""Nearest neighbours: exact by blocks, for given points, and approximate by hashing.

Exact search compares every query with every point of its series, so pairs are never rows: one float32
product bounds their distances from below, and only those that may be among the k best are measured. Series of
up to ``SINGLE_ROWS`` rows are one group each, whose rows are shuffled once. Where a series is longer,
series are cut into blocks of ``BLOCK_ROWS`` rows, each pair of blocks is one group, and a group
hands back the k best of its points for each query; an ordinary top-k merges the groups. A row then
goes to as many groups as its series has blocks, 1 in ``BLOCK_ROWS`` of its comparisons.
Neighbours are ordered by squared distance, then row; a point is left out by its row, never by a
distance of 0, and rows under ``block`` days apart aren't neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, SINGLE_ROWS = 32_768, 8192
#: Distances held at once.
CELLS = 1 << 21
#: Queries and points of a tile of lower bounds, points that set the first limits, and pairs measured at once.
TILE_QUERIES, TILE_POINTS, FIRST_POINTS, PAIRS = 512, 4096, 1024, 1 << 14
RANKED = "series_id string, row int, rank int, neighbor_row int, dist double"
NEIGHBORS = "series_id string, row int, neighbor_row int, d2 double"


def matrix(batch: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy().astype(np.float64) for c in columns]) if len(batch) else np.zeros((0, len(columns)))


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q and x, summed column by column."""
    total = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        total += (q[:, k, None] - x[None, :, k]) ** 2
    return total


def squared_pairs(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As squared, and to the bit, of the pairs (i, j) only."""
    total = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        d = q[i[part]] - x[j[part]]
        total[part] = np.cumsum(np.square(d, out=d), axis=1, out=d)[:, -1]  # a running sum adds in order
    return total


def with_few_copies(row: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Which points have fewer than most equal points before them. A repeated row number counts once."""
    seen: dict[bytes, tuple[int, int | None]] = {}
    keep = np.ones(len(x), bool)
    for at, (n, point) in enumerate(zip(row.tolist(), x)):
        key = point.tobytes()
        before, last = seen.get(key, (0, None))
        seen[key] = (before + (n != last), n)
        keep[at] = seen[key][0] <= most
    return keep


class Bounds:
    """Lower bounds of squared distances by one product of float32 matrices, whatever its rounding.

    Rows are scaled by their largest number and centred. With an extra column a product is
    |x|^2 - 2 q x; its error is under wide * (|q|^2 + |x|^2), which is taken off, and slack is for what centring
    rounds and for numbers too small for float32.
    """

    def __init__(self, q: np.ndarray, x: np.ndarray, scale: float):
        wide = (x.shape[1] + 16) * 2.0**-22
        centre = (x / scale).mean(axis=0)
        q, x = q / scale - centre, x / scale - centre
        self.scale, self.more = scale, 1 + wide
        self.own = (1 - wide) * np.square(q).sum(axis=1) - (2.0**-48) ** 2 * x.shape[1] / wide - 1e-30
        self.left = np.column_stack([q, np.ones(len(q))]).astype(np.float32)
        self.right = np.column_stack([-2 * x, (1 - wide) * np.square(x).sum(axis=1)]).astype(np.float32)

    def products(self, of: slice, to: slice) -> np.ndarray:
        return self.left[of] @ self.right[to].T

    def most(self, of: slice, limit: np.ndarray) -> np.ndarray:
        """The products of all points within limit, a squared distance, are at most this."""
        return (np.square(np.sqrt(limit) / self.scale) * self.more - self.own[of]).astype(np.float32)


def best(q_row: np.ndarray, q: np.ndarray, x_row: np.ndarray, x: np.ndarray, k: int, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, neighbour rows and squared distances of the k nearest at least apart rows away
    (0: no limit). x_row ascends.

    Lower bounds of all pairs by tiles; pairs that a bound lets into the k best so far are measured
    column by column. Rows with numbers that aren't finite have no neighbours and are none.
    """
    near = k + max(0, 2 * apart - 1)  # so many points have k that are far enough, whatever the query
    mine, there = np.isfinite(q).all(axis=1), np.isfinite(x).all(axis=1)
    q_row, q, x_row, x = q_row[mine], q[mine], x_row[there], x[there]
    there = with_few_copies(x_row, x, near)  # of equal points only the first can be neighbours
    x_row, x = x_row[there], x[there]
    if not len(q) or not len(x):
        return q_row[:0], x_row[:0], np.zeros(0)
    scale = max(np.abs(q).max(), np.abs(x).max()) or 1.0
    if not 1e-100 < scale < 1e100:  # squares might leave the range of numbers
        return best_of_all(q_row, q, x_row, x, k, apart)
    bounds, out = Bounds(q, x, scale), []
    for at in range(0, len(q), TILE_QUERIES):
        of = slice(at, at + TILE_QUERIES)
        rows, own = q_row[of], q[of]
        limit = np.full(len(rows), np.inf)
        i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for lo in range(0, len(x), TILE_POINTS):
            low = bounds.products(of, slice(lo, lo + TILE_POINTS))
            if not lo and (n := min(near, low.shape[1])) >= k:  # any k points far enough limit the k best
                some = np.argpartition(low[:, :FIRST_POINTS], min(n, FIRST_POINTS) - 1, axis=1)[:, :n]
                d2 = squared_pairs(own, x, np.repeat(np.arange(len(rows)), some.shape[1]), some.ravel()).reshape(some.shape)
                d2[np.abs(rows[:, None] - x_row[some]) < apart] = np.inf
                limit = np.partition(d2, k - 1, axis=1)[:, k - 1] if some.shape[1] >= k else limit
            hits = np.flatnonzero(low <= bounds.most(of, limit)[:, None])
            hi, hj = np.divmod(hits, low.shape[1])
            hj += lo
            if apart:
                far = np.abs(rows[hi] - x_row[hj]) >= apart
                hi, hj = hi[far], hj[far]
            if len(hi):
                i, j, d = np.concatenate([i, hi]), np.concatenate([j, hj]), np.concatenate([d, squared_pairs(own, x, hi, hj)])
                i, j, d, place = first(i, j, d, k)
                full = place == k - 1
                limit[i[full]] = d[full]
        out.append((rows[i], x_row[j], d))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def first(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs of each i that are first by d and j, in order, and their places."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return i[keep], j[keep], d[keep], place[keep]


def best_of_all(q_row: np.ndarray, q: np.ndarray, x_row: np.ndarray, x: np.ndarray, k: int, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best, measuring every pair."""
    out = []
    for at in range(0, len(q), step := max(1, CELLS // max(1, len(x)))):
        rows = q_row[at : at + step]
        d2 = squared(q[at : at + step], x)
        if apart:
            d2[np.abs(rows[:, None] - x_row[None, :]) < apart] = np.inf
        n = min(k, len(x))
        limit = np.partition(d2, n - 1, axis=1)[:, n - 1] if n else np.zeros(len(rows))
        i, j = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))  # with all that tie for the last place
        i, j, d, _ = first(i, j, d2[i, j], n)
        out.append((rows[i], x_row[j], d))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3)) if out else (q_row[:0], x_row[:0], np.zeros(0))


def knn(points: DataFrame, columns: tuple[str, ...], k: int, block: int = 1, queries: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """series_id, row, rank (from 1), neighbor_row and dist of the k nearest of each row.

    points: series_id, row (dense from 0) and columns. block: the least distance in rows; 1 leaves
    out only the row itself, 0 nothing. queries: the rows asked for (default all); with block 0 they
    needn't be points. Fewer than k where there are fewer admissible points.
    """
    if k < 1:
        raise ValueError("k has to be 1 at least")
    points = points.select("series_id", "row", *columns)
    asked = points if queries is None else queries.select("series_id", "row", *columns)
    most = points.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    if most <= min(SINGLE_ROWS, block_rows):
        return best_of_series(asked if queries is not None else None, points, columns, k, block)
    return ranked(best_of_groups(asked, points, ["series_id"], columns, k, block, block_rows), k)


def best_of_series(asked: DataFrame | None, points: DataFrame, columns: tuple[str, ...], k: int, block: int) -> DataFrame:
    """As knn: each series is one group (asked: None for all points)."""

    def search(series: str, q: pa.Table, x: pa.Table) -> pa.Table:
        x = x.sort_by("row")
        q = x if q is None else q
        i, j, d2 = best(q.column("row").to_numpy(), matrix(q, columns), x.column("row").to_numpy(), matrix(x, columns), k, block)
        starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i)))) + 1
        return pa.table({"series_id": pa.array([series] * len(i), pa.string()), "row": pa.array(i, pa.int32()), "rank": pa.array(rank, pa.int32()), "neighbor_row": pa.array(j, pa.int32()), "dist": pa.array(np.sqrt(d2))})

    if asked is None:
        return points.groupBy("series_id").applyInArrow(lambda key, x: search(key[0].as_py(), None, x), RANKED)
    asked = asked.toDF(*[f"q_{c}" for c in asked.columns])  # asked may come from points, whose columns would be ambiguous
    return asked.groupBy("q_series_id").cogroup(points.groupBy("series_id")).applyInArrow(lambda key, q, x: search(key[0].as_py(), q.rename_columns(x.column_names), x), RANKED)


def best_of_groups(asked: DataFrame, points: DataFrame, keys: list[str], columns: tuple[str, ...], k: int, block: int, block_rows: int) -> DataFrame:
    """series_id, row, neighbor_row and d2: of each row asked for, the k nearest points with the same
    keys in each of their blocks. keys begin with series_id."""
    part = F.floor(F.col("row") / block_rows).cast("int")
    points, asked = points.withColumn("b", part), asked.withColumn("b", part)
    blocks = lambda df: df.groupBy(*keys).agg(F.collect_set("b").alias("of"))  # noqa: E731  small numbers: rows / block_rows
    left = asked.join(blocks(points), keys).select(*keys, F.col("b").alias("qb"), F.explode("of").alias("xb"), F.lit(True).alias("query"), "row", *columns)
    right = points.join(blocks(asked), keys).select(*keys, F.explode("of").alias("qb"), F.col("b").alias("xb"), F.lit(False).alias("query"), "row", *columns)

    def search(group: pa.Table) -> pa.Table:
        is_query = group.column("query").to_numpy()
        q, x = group.filter(pa.array(is_query)), group.filter(pa.array(~is_query)).sort_by("row")
        i, j, d2 = best(q.column("row").to_numpy(), matrix(q, columns), x.column("row").to_numpy(), matrix(x, columns), k, block)
        series = pa.array([group.column("series_id")[0].as_py()] * len(i), pa.string())
        return pa.table({"series_id": series, "row": pa.array(i, pa.int32()), "neighbor_row": pa.array(j, pa.int32()), "d2": pa.array(d2)})

    return left.unionByName(right.select(left.columns)).groupBy(*keys, "qb", "xb").applyInArrow(search, NEIGHBORS)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k first neighbours of each row by squared distance and row, with rank and dist."""
    order = Window.partitionBy("series_id", "row").orderBy("d2", "neighbor_row")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("series_id", "row", "rank", "neighbor_row", F.sqrt("d2").alias("dist"))


def check_graph_size(points: DataFrame, k: int, block: int) -> None:
    """ValueError unless every series has more than k + 2 (block - 1) rows."""
    need = k + 2 * max(0, block - 1)
    short = points.groupBy("series_id").count().where(F.col("count") <= need).head()
    if short:
        raise ValueError(f"series {short['series_id']} has {short['count']} rows; k={k} and block={block} need more than {need}")


def neighbor_graph(points: DataFrame, columns: tuple[str, ...], k: int, block: int) -> DataFrame:
    """The k nearest of each row at least block rows away (block 0: the plain neighbours)."""
    check_graph_size(points, k, block)
    return knn(points, columns, k, max(1, block))


def projections(d: int, tables: int, bits: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(tables, bits, d)), rng.uniform(0, width, size=(tables, bits))


def approximate_knn(points: DataFrame, columns: tuple[str, ...], k: int, tables: int = 12, bits: int = 2, width: float = 2.0, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """knn by locality-sensitive hashing: rows that share a bucket of some table are compared exactly.

    A bucket is the floors of bits random projections over width. More tables and wider buckets
    find more; the same seed gives the same result. A bucket is compared by blocks as in knn, whatever
    its size, and only the k best of each row leave a pair of blocks.
    """
    if k < 1 or tables < 1 or bits < 1 or width <= 0:
        raise ValueError("k, tables, bits and width have to be positive")
    a, b = projections(len(columns), tables, bits, width, seed)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(pa.Table.from_batches([batch]), columns)
            cells = np.floor((np.einsum("tbd,nd->ntb", a, x) + b) / width).astype(np.int64)
            n = batch.num_rows
            at = np.repeat(np.arange(n), tables)
            keys = [",".join(map(str, c)) for c in cells.reshape(n * tables, bits).tolist()]
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys)], names=[*batch.schema.names, "table", "bucket"])

    points = points.select("series_id", F.col("row").cast("int").alias("row"), *[F.col(c).cast("double").alias(c) for c in columns])
    kinds = ", ".join(["series_id string", "row int", *[f"`{c}` double" for c in columns], "table int", "bucket string"])
    hashed = points.mapInArrow(buckets, kinds)
    found = best_of_groups(hashed, hashed, ["series_id", "table", "bucket"], columns, k, 1, block_rows)
    return ranked(found.dropDuplicates(["series_id", "row", "neighbor_row"]), k)


INDEXES = {"exact": knn, "lsh": approximate_knn}


def make_index(name: str):
    if name not in INDEXES:
        raise ValueError(f"no index {name!r}; there are {sorted(INDEXES)}")
    return INDEXES[name]


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """recall: the share of exact's neighbours that found has, over all rows."""
    keys = ["series_id", "row", "neighbor_row"]
    hits = exact.join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return hits.groupBy("series_id", "row").agg((F.count("hit") / F.count("*")).alias("r")).agg(F.avg("r").alias("recall"))
