"""Density clusters from a spanning tree: hierarchy, condensation, stability, selection, labels.

The hierarchy joins n - 1 sorted edges one after the other, so each series is one task on its own
edges; all before it is distributed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ClusterParams
from ..sources.storage import stored_table
from .graph import core_distances, spanning_tree, substrate_tree
from .knn import neighbor_graph

#: Distances below this count as this, so that densities stay finite.
LEAST_DISTANCE = 1e-12
NOISE = -1
RESULT = "series_id string, row int, label int, stability double"


def dendrogram(n: int, edges: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children (two columns), height and size of the joins n, n + 1, ... of edges in (w, a, b) order."""
    top, sizes = list(range(2 * n - 1)), np.ones(2 * n - 1, np.int64)
    children, heights = np.zeros((n - 1, 2), np.int64), np.zeros(n - 1)
    newest = list(range(n))  # of each set's root row: the join that holds it

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for k, (w, a, b) in enumerate(sorted((w, a, b) for a, b, w in edges)):
        ra, rb = find(a), find(b)
        children[k], heights[k] = (newest[ra], newest[rb]), w
        sizes[n + k] = sizes[newest[ra]] + sizes[newest[rb]]
        top[rb] = ra
        newest[ra] = n + k
    return children, heights, sizes


def condense(n: int, edges: list[tuple[int, int, float]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The condensed tree: each cluster's parent (-1: root), birth density and stability, and for each
    row the cluster that it falls out of.

    A join splits its cluster where both sides have least rows; a smaller side's rows fall out at the
    join's density, and the other side goes on as the same cluster.
    """
    children, heights, sizes = dendrogram(n, edges)
    parent, birth, stability = [-1], [0.0], [0.0]
    home = np.zeros(n, np.int64)

    def rows_below(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            x = stack.pop()
            stack.extend(children[x - n]) if x >= n else out.append(x)
        return out

    stack = [(2 * n - 2, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue  # only a cluster's last row: it has left with its sibling
        density = 1 / max(heights[node - n], LEAST_DISTANCE)
        sides = children[node - n].tolist()
        large = [s for s in sides if sizes[s] >= least]
        if len(large) == 2:
            for side in sides:
                stability[cluster] += (density - birth[cluster]) * sizes[side]
                parent.append(cluster)
                birth.append(density)
                stability.append(0.0)
                stack.append((side, len(parent) - 1))
            continue
        for side in sides:
            if side in large:
                stack.append((side, cluster))
            else:
                stability[cluster] += (density - birth[cluster]) * sizes[side]
                home[rows_below(side)] = cluster
    return np.array(parent), np.array(birth), np.array(stability), home


def select(parent: np.ndarray, stability: np.ndarray) -> np.ndarray:
    """Excess of mass: which clusters are chosen. A cluster stays unless its children's best is
    greater; the root is never chosen."""
    chosen, best = np.zeros(len(parent), bool), stability.copy()
    below = np.zeros(len(parent))
    for c in range(len(parent) - 1, 0, -1):  # children have larger numbers
        chosen[c] = not below[c] > stability[c]
        best[c] = max(below[c], stability[c])
        below[parent[c]] += best[c]
    for c in range(1, len(parent)):  # what lies below a chosen one isn't
        p = parent[c]
        while p > 0 and not chosen[p]:
            p = parent[p]
        chosen[c] &= p <= 0
    return chosen


def labels_of(n: int, edges: list[tuple[int, int, float]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and its cluster's stability of each row; clusters are numbered by their first row, noise
    is -1 with stability 0."""
    if n < 2:
        return np.full(n, NOISE), np.zeros(n)
    if len(edges) != n - 1:
        raise ValueError(f"{n} rows need {n - 1} edges, not {len(edges)}")
    parent, _, stability, home = condense(n, edges, least)
    chosen = select(parent, stability)
    cluster = np.arange(len(parent))
    for c in range(len(parent)):
        if not chosen[c]:
            cluster[c] = cluster[parent[c]] if parent[c] >= 0 else NOISE
    of = cluster[home]
    numbers: dict[int, int] = {NOISE: NOISE}
    for c in of.tolist():
        numbers.setdefault(c, len(numbers) - 1)
    return np.array([numbers[c] for c in of.tolist()]), np.where(of >= 0, stability[of], 0.0)


def extract_clusters(points: DataFrame, tree: DataFrame, min_cluster_size: int) -> DataFrame:
    """series_id, row, label and the label's stability of every row of points."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size has to be 2 at least")

    def label(key: tuple, rows: pa.Table, edges: pa.Table) -> pa.Table:
        row = np.sort(rows.column("row").to_numpy())
        at = {r: i for i, r in enumerate(row.tolist())}
        found = [(at[a], at[b], w) for a, b, w in zip(*(edges.column(c).to_pylist() for c in "abw"))]
        labels, stability = labels_of(len(row), found, min_cluster_size)
        return pa.table({"series_id": pa.array([key[0].as_py()] * len(row), pa.string()), "row": pa.array(row, pa.int32()), "label": pa.array(labels, pa.int32()), "stability": pa.array(stability)})

    rows = points.select("series_id", F.col("row").cast("int").alias("row"))
    return rows.groupBy("series_id").cogroup(tree.groupBy("series_id")).applyInArrow(label, RESULT)


def hdbscan(points: DataFrame, columns: tuple[str, ...], params: ClusterParams = ClusterParams(), tree: str = "exact") -> DataFrame:
    """points with label and stability. tree: exact, or substrate (over the neighbour graph only)."""
    if tree not in ("exact", "substrate"):
        raise ValueError("tree is exact or substrate")
    points = stored_table(points, "points")
    graph = stored_table(neighbor_graph(points, columns, params.k, params.block), "neighbors")
    core = core_distances(graph, params.min_samples)
    edges = spanning_tree(points, core, columns, params.block) if tree == "exact" else substrate_tree(points, graph, core, columns, params.block)
    labels = extract_clusters(points, edges, params.min_cluster_size)
    return points.join(labels, ["series_id", "row"])


def clusters(labels: DataFrame) -> DataFrame:
    """series_id, label, stability and n_days of each cluster."""
    return labels.where(F.col("label") >= 0).groupBy("series_id", "label").agg(F.max("stability").alias("stability"), F.count("*").alias("n_days"))
