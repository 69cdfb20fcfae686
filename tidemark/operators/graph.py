"""Edges, mutual reachability and minimum spanning trees.

Edges are ordered by (weight, smaller row, larger row). That order has no ties, so the spanning
tree is unique and both ways to it give the same edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored_table
from .knn import BLOCK_ROWS, CELLS, matrix, squared

EDGES = "series_id string, a int, b int, w double"
#: A series of up to so many rows is spanned in one task (memory grows with its rows, time with
#: their square); longer ones take rounds of distributed minima.
LOCAL_ROWS = 20_000


def core_distances(graph: DataFrame, min_samples: int) -> DataFrame:
    """series_id, row and core: the distance of neighbour min_samples - 1, as the row itself counts."""
    return graph.where(F.col("rank") == min_samples - 1).select("series_id", "row", F.col("dist").alias("core"))


def symmetric_edges(graph: DataFrame) -> DataFrame:
    """series_id, a < b and dist of each pair that is neighbours in one direction or both."""
    edges = graph.select("series_id", F.least("row", "neighbor_row").alias("a"), F.greatest("row", "neighbor_row").alias("b"), "dist")
    return edges.groupBy("series_id", "a", "b").agg(F.min("dist").alias("dist"))


def mutual_reachability(edges: DataFrame, core: DataFrame) -> DataFrame:
    """edges with w: the largest of the distance and both core distances."""
    for end in "ab":
        edges = edges.join(core.select("series_id", F.col("row").alias(end), F.col("core").alias(f"core_{end}")), ["series_id", end])
    return edges.select("series_id", "a", "b", F.greatest("dist", "core_a", "core_b").alias("w"))


def prim(x: np.ndarray, core: np.ndarray, block: int, known: list[tuple[int, int, float]] = ()) -> list[tuple[int, int, float]]:
    """The spanning tree's edges (a, b, w) over all pairs at least block rows apart.

    ValueError if the pairs don't connect all rows.
    """
    n = len(x)
    best_w, best_a, best_b = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    outside, rows, edges, at = np.ones(n, bool), np.arange(n), [], 0
    for _ in range(n - 1):
        outside[at] = False
        w = np.maximum(np.sqrt(squared(x[at : at + 1], x)[0]), np.maximum(core, core[at]))
        a, b = np.minimum(rows, at), np.maximum(rows, at)
        better = outside & (b - a >= block) & ((w < best_w) | (w == best_w) & ((a < best_a) | (a == best_a) & (b < best_b)))
        best_w[better], best_a[better], best_b[better] = w[better], a[better], b[better]
        least = best_w[outside].min()
        if not np.isfinite(least):
            raise ValueError(f"rows at least {block} apart don't connect the series")
        ties = np.flatnonzero(outside & (best_w == least))
        at = int(ties[np.lexsort((best_b[ties], best_a[ties]))[0]])
        edges.append((int(best_a[at]), int(best_b[at]), float(best_w[at])))
    return edges


def spanning_tree(points: DataFrame, core: DataFrame, columns: tuple[str, ...], block: int, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """series_id, a, b and w of the minimum spanning tree over all admissible pairs of each series.

    Series of up to local_rows rows are one task each; if one is longer, all take distributed rounds.
    """
    most = points.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    if most > local_rows:
        return boruvka(points, core, columns, block)
    joined = points.select("series_id", "row", *columns).join(core, ["series_id", "row"])

    def span(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        row = group.column("row").to_numpy()
        edges = prim(matrix(group, columns), group.column("core").to_numpy(), block)
        a, b, w = (np.array(c) for c in zip(*edges)) if edges else (np.zeros(0, int),) * 3
        return edge_table(group.column("series_id")[0].as_py(), row[a], row[b], w.astype(float))

    return joined.groupBy("series_id").applyInArrow(span, EDGES)


def edge_table(series: str, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pa.Table:
    return pa.table({"series_id": pa.array([series] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "w": pa.array(w, pa.float64())})


def boruvka(points: DataFrame, core: DataFrame, columns: tuple[str, ...], block: int, edges: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same tree by rounds: each component takes its least outgoing edge, components are merged.

    edges: only these (series_id, a, b, w); default all admissible pairs, which are compared in
    pairs of blocks and never become rows. A round leaves at most half of the components.
    ValueError if the edges don't connect a series.
    """
    state = stored_table(points.select("series_id", F.col("row").alias("node"), F.col("row").alias("comp")), "comp")
    tree = None
    while True:
        sizes = state.groupBy("series_id").agg(F.count_distinct("comp").alias("n")).where("n > 1")
        open_series = sizes.select("series_id")
        count = open_series.count()
        if not count:
            return tree if tree is not None else points.sparkSession.createDataFrame([], EDGES)
        now = state.join(open_series, "series_id", "left_semi")
        least = least_by_pairs(points, core, now, columns, block, block_rows) if edges is None else least_of(edges, now)
        chosen = stored_table(least.groupBy("series_id", "comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("series_id", "comp", "e.*"), "chosen")
        if chosen.select("series_id").distinct().count() < count:
            raise ValueError(f"rows at least {block} apart don't connect the series")
        new = chosen.select("series_id", "a", "b", "w").distinct()
        tree = stored_table(new if tree is None else tree.unionByName(new), "tree")
        state = stored_table(merged(state, chosen), "comp")


def least_of(edges: DataFrame, state: DataFrame) -> DataFrame:
    """series_id, comp, w, a, b and other: each component's edges to others, from both ends."""
    for end in "ab":
        edges = edges.join(state.select("series_id", F.col("node").alias(end), F.col("comp").alias(f"comp_{end}")), ["series_id", end])
    out = edges.where("comp_a <> comp_b")
    ends = [out.select("series_id", F.col(f"comp_{x}").alias("comp"), "w", "a", "b", F.col(f"comp_{y}").alias("other")) for x, y in ("ab", "ba")]
    return ends[0].unionByName(ends[1])


def least_by_pairs(points: DataFrame, core: DataFrame, state: DataFrame, columns: tuple[str, ...], block: int, block_rows: int) -> DataFrame:
    """As least_of over all admissible pairs: every row's least edge to another component, from each
    pair of blocks."""
    part = F.floor(F.col("row") / block_rows).cast("int")
    rows = points.select("series_id", "row", *columns).join(core, ["series_id", "row"]).join(state.select("series_id", F.col("node").alias("row"), "comp"), ["series_id", "row"]).withColumn("part", part)
    parts = rows.groupBy("series_id").agg(F.collect_set("part").alias("parts"))
    many = rows.join(parts, "series_id").select("*", F.explode("parts").alias("with")).drop("parts")
    names = ["row", "core", "comp", *columns]
    left = many.select("series_id", F.col("part").alias("p"), F.col("with").alias("q"), F.lit(True).alias("from"), *names)
    right = many.select("series_id", F.col("with").alias("p"), F.col("part").alias("q"), F.lit(False).alias("from"), *names)

    def search(group: pa.Table) -> pa.Table:
        is_from = group.column("from").to_numpy()
        sides = [group.filter(pa.array(k)).sort_by("row") for k in (is_from, ~is_from)]
        (i, ci, gi, x), (j, cj, gj, y) = ((t.column("row").to_numpy(), t.column("core").to_numpy(), t.column("comp").to_numpy(), matrix(t, columns)) for t in sides)
        out = []
        for at in range(0, len(i), step := max(1, CELLS // max(1, len(j)))):
            s = slice(at, at + step)
            w = np.maximum(np.sqrt(squared(x[s], y)), np.maximum(ci[s, None], cj[None, :]))
            w[(gi[s, None] == gj[None, :]) | (np.abs(i[s, None] - j[None, :]) < block)] = np.inf
            # Of equal weights the least (a, b): the partner's row decides, smaller ones first.
            k = np.argmin(w, axis=1)
            least = w[np.arange(len(k)), k]
            ok = np.isfinite(least)
            out.append((gi[s][ok], least[ok], np.minimum(i[s], j[k])[ok], np.maximum(i[s], j[k])[ok], gj[k][ok]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(5)]
        series = pa.array([group.column("series_id")[0].as_py()] * len(cols[0]), pa.string())
        return pa.table({"series_id": series, **{n: pa.array(c, t) for n, c, t in zip(("comp", "w", "a", "b", "other"), cols, (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))}})

    return left.unionByName(right).groupBy("series_id", "p", "q").applyInArrow(search, "series_id string, comp int, w double, a int, b int, other int")


def merged(state: DataFrame, chosen: DataFrame) -> DataFrame:
    """state with components joined along the chosen edges; a component's name is its root's.

    Chosen edges form trees whose only cycles are two components that chose each other; the smaller
    of those is the root. Pointers are doubled until all point at roots.
    """
    both = chosen.select("series_id", F.col("comp").alias("x"), F.col("other").alias("y"))
    back = both.select("series_id", F.col("y").alias("x"), F.col("x").alias("y"), F.lit(True).alias("mutual"))
    point = both.join(back, ["series_id", "x", "y"], "left").select("series_id", "x", F.when(F.col("mutual") & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("y"))
    while True:
        point = stored_table(point, "point")
        ahead = point.select("series_id", F.col("x").alias("y"), F.col("y").alias("z"))
        jumped = point.join(ahead, ["series_id", "y"])
        if jumped.where("y <> z").isEmpty():
            break
        point = jumped.select("series_id", "x", F.col("z").alias("y"))
    named = state.join(point.select("series_id", F.col("x").alias("comp"), F.col("y").alias("root")), ["series_id", "comp"], "left")
    return named.select("series_id", "node", F.coalesce("root", "comp").alias("comp"))


def substrate_tree(points: DataFrame, graph: DataFrame, core: DataFrame, columns: tuple[str, ...], block: int) -> DataFrame:
    """The tree over the graph's edges only, with the least admissible pairs as bridges where they
    leave parts unconnected. For comparison: it can be heavier than spanning_tree."""
    edges = stored_table(mutual_reachability(symmetric_edges(graph), core), "edges")
    state = stored_table(points.select("series_id", F.col("row").alias("node"), F.col("row").alias("comp")), "comp")
    tree, bridging = None, False
    while True:
        more = state.groupBy("series_id").agg(F.count_distinct("comp").alias("n")).where("n > 1").count()
        if not more:
            return tree if tree is not None else points.sparkSession.createDataFrame([], EDGES)
        least = least_by_pairs(points, core, state, columns, block, BLOCK_ROWS) if bridging else least_of(edges, state)
        chosen = stored_table(least.groupBy("series_id", "comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("series_id", "comp", "e.*"), "chosen")
        if chosen.isEmpty():
            if bridging:
                raise ValueError(f"rows at least {block} apart don't connect the series")
            bridging = True
            continue
        new = chosen.select("series_id", "a", "b", "w").distinct()
        tree = stored_table(new if tree is None else tree.unionByName(new), "tree")
        state = stored_table(merged(state, chosen), "comp")
