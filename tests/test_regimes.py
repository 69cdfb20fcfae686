import itertools
import random

import numpy as np
import pytest
from fixtures import START, bars, blobs, points, walk
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import graph, hdbscan, knn, validate
from tidemark.plans import pipeline
from tidemark.schema import ClusterParams


def near(df):
    return [(r["row"], r["neighbor_row"], round(r["dist"], 9)) for r in df.orderBy("row", "rank").collect()]


def test_knn_hand_fixture(spark):
    df, c = points(spark, [(0, 0), (1, 0), (0, 2), (3, 4)])
    assert near(knn.knn(df, c, 10))[:3] == [(0, 1, 1), (0, 2, 2), (0, 3, 5)]
    asked = points(spark, [(2.9, 4.1)])[0]
    assert near(knn.knn(df, c, 1, block=0, queries=asked)) == [(0, 3, round(0.02**0.5, 9))]
    with pytest.raises(ValueError):
        knn.knn(df, c, 0)


def test_knn_ties_go_by_row(spark):
    df, c = points(spark, [(0, 0), (1, 1), (1, 1), (5, 5)])
    assert [n for r, n, _ in near(knn.knn(df, c, 2)) if r == 0] == [1, 2]


def brute(xs, k, block):
    x = np.array(xs)
    out = []
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        order = sorted((d[j], j) for j in range(len(x)) if abs(i - j) >= block)[:k]
        out += [(i, j, round(v**0.5, 9)) for v, j in order]
    return out


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_knn_blocks_and_bands(spark, block_rows):
    xs = [(random.Random(i).randrange(6), random.Random(-i).randrange(6)) for i in range(60)]  # many ties
    df, c = points(spark, xs)
    for block in (1, 4):
        assert near(knn.knn(df, c, 5, block=block, block_rows=block_rows)) == brute(xs, 5, block)


def test_one_group_and_many_give_the_same(spark):
    """Two series, queries that aren't points, and series of one group against cut ones."""
    xs = np.random.default_rng(2).normal(size=(90, 3)).round(1)
    a, c = points(spark, xs[:60], "a")
    b = points(spark, xs[60:], "b")[0]
    both = a.unionByName(b)
    order = lambda df: [tuple(r) for r in df.select("series_id", "row", "rank", "neighbor_row", "dist").orderBy("series_id", "row", "rank").collect()]
    for block in (0, 1, 5):
        assert order(knn.knn(both, c, 4, block)) == order(knn.knn(both, c, 4, block, block_rows=11))
    asked = points(spark, [(0.1, 0.2, 0.3)], "b")[0]
    assert order(knn.knn(both, c, 4, 0, asked)) == order(knn.knn(both, c, 4, 0, asked, block_rows=11)) != []
    assert knn.knn(both.limit(0), c, 2).count() == 0


def test_bounds_lose_no_neighbour(monkeypatch):
    """Tiles of bounds against every pair: ties, copies, repeated rows, offsets, numbers that aren't finite."""
    monkeypatch.setattr(knn, "TILE_QUERIES", 7)
    monkeypatch.setattr(knn, "TILE_POINTS", 13)
    monkeypatch.setattr(knn, "FIRST_POINTS", 9)
    rng = np.random.default_rng(5)
    normal = rng.normal(size=(90, 5))
    holes = np.where(rng.random(normal.shape) < 0.03, rng.choice([np.nan, np.inf, -np.inf], normal.shape), normal)
    rows = np.arange(90, dtype=np.int32)
    for x in (normal, normal.round(), normal * 1e-3 + 1e6, np.repeat(normal[:9], 10, axis=0), np.zeros((90, 5)), normal * 1e-300, normal * 1e150, holes):
        for k, apart, row in ((1, 1, rows), (4, 0, rows), (4, 6, rows), (100, 1, rows), (3, 1, rows // 3)):
            with np.errstate(all="ignore"):
                d2 = knn.squared(x, x)
            far = np.isfinite(d2) & (np.abs(row[:, None] - row) >= apart)
            order = [[j for j in np.argsort(d2[i], kind="stable") if far[i, j]][:k] for i in range(90)]
            want = [(row[i], row[j], d2[i, j]) for i in range(90) for j in order[i]]
            with np.errstate(all="ignore"):
                assert list(zip(*knn.best(row, x, row, x, k, apart))) == want


def test_few_pairs_are_measured(monkeypatch):
    """One in a hundred at most, copies or not."""
    measured, whole = [], knn.squared_pairs
    monkeypatch.setattr(knn, "squared_pairs", lambda q, x, i, j: measured.append(len(i)) or whole(q, x, i, j))
    x = np.random.default_rng(6).normal(size=(9000, 64))
    x[copies := np.arange(0, 9000, 4)] = x[0]
    row = np.arange(9000, dtype=np.int32)
    i, j, d2 = knn.best(row, x, row, x, 10, 1)
    assert len(i) == 90_000 and sum(measured) < 9000**2 / 100
    assert j[i == 0].tolist() == copies[1:11].tolist() and not d2[i == 0].any()


def test_graph_precondition(spark):
    df, c = points(spark, blobs(10, 2))
    with pytest.raises(ValueError, match="more than"):
        knn.neighbor_graph(df, c, 4, 10)
    assert knn.neighbor_graph(df, c, 4, 9).count() == 22 * 4


def test_hashing_recall_and_determinism(spark):
    g = iter(np.random.default_rng(9).standard_normal(4 * 800))
    centres = [(0, 0, 0, 0), (6, 0, 0, 0), (0, 6, 0, 0), (3, 3, 6, 0)]
    xs = [tuple(m + next(g) for m in centres[i % 4]) for i in range(800)]
    df, c = points(spark, xs)
    found = knn.approximate_knn(df, c, 10)
    assert knn.recall(found, knn.knn(df, c, 10)).first()["recall"] >= 0.95
    assert near(found) == near(knn.approximate_knn(df, c, 10)) == near(knn.approximate_knn(df, c, 10, block_rows=300))
    with pytest.raises(ValueError):
        knn.make_index("tree")


def kruskal(x, core, block):
    top = list(range(len(x)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    edges = []
    for i, j in itertools.combinations(range(len(x)), 2):
        if j - i >= block:
            edges.append((max(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), core[i], core[j]), i, j))
    out = []
    for w, i, j in sorted(edges):
        a, b = find(i), find(j)
        if a != b:
            top[a] = b
            out.append((i, j, round(w, 9)))
    return sorted(out)


@pytest.mark.parametrize("p, m, block", [(60, 20, 1), (30, 10, 4)])
def test_both_spanning_trees_equal_kruskal(spark, p, m, block):
    xs = blobs(p, m)
    df, c = points(spark, xs)
    g = knn.neighbor_graph(df, c, 6, block).cache()
    core = graph.core_distances(g, 5)
    cores = [r["core"] for r in core.orderBy("row").collect()]
    want = kruskal(np.array(xs), cores, block)
    edges = lambda t: sorted((r["a"], r["b"], round(r["w"], 9)) for r in t.collect())
    assert edges(graph.spanning_tree(df, core, c, block)) == want
    assert edges(graph.boruvka(df, core, c, block, block_rows=40)) == want
    rough = edges(graph.substrate_tree(df, g, core, c, block))
    total, best = sum(w for *_, w in rough), sum(w for *_, w in want)
    assert len(rough) == len(want) and best - 1e-9 <= total <= 1.05 * best


def test_disconnected_series_is_an_error(spark):
    df, c = points(spark, [(0, 0), (1, 1), (2, 2)])
    core = df.selectExpr("series_id", "row", "0D as core")
    with pytest.raises(Exception, match="connect"):
        graph.spanning_tree(df, core, c, 5).collect()
    with pytest.raises(ValueError, match="connect"):
        graph.boruvka(df, core, c, 5)


def test_blobs_end_to_end(spark):
    p, m = 150, 25
    df, c = points(spark, blobs(p, m))
    found = hdbscan.hdbscan(df, c, ClusterParams(k=10, block=1, min_cluster_size=30, min_samples=10)).orderBy("row").collect()
    labels = [r["label"] for r in found]
    assert set(labels) == {-1, 0, 1}
    for part in (labels[:p], labels[p : 2 * p]):
        assert max(part.count(0), part.count(1)) >= 0.9 * p
    assert labels[2 * p :].count(-1) >= 0.9 * m
    again = hdbscan.hdbscan(df, c, ClusterParams(k=10, block=1, min_cluster_size=30, min_samples=10)).orderBy("row").collect()
    assert found == again


def test_no_split_means_noise():
    edges = [(i, i + 1, 1.0 + 0.01 * i) for i in range(9)]
    labels, stability = hdbscan.labels_of(10, edges, 6)
    assert (labels == -1).all() and (stability == 0).all()
    assert hdbscan.labels_of(1, [], 2)[0].tolist() == [-1]
    with pytest.raises(ValueError):
        hdbscan.labels_of(4, [(0, 1, 1.0)], 2)


def test_two_groups_and_ties():
    group = lambda at: [(at + i, at + i + 1, 1.0) for i in range(4)]
    labels, stability = hdbscan.labels_of(10, [*group(0), *group(5), (4, 5, 9.0)], 3)
    assert labels.tolist() == [0] * 5 + [1] * 5
    assert stability[0] == pytest.approx((1 - 1 / 9) * 5)


@pytest.mark.parametrize("bad", [{"min_samples": 1}, {"min_samples": 12}, {"min_cluster_size": 1}, {"k": 0}, {"block": -1}])
def test_cluster_parameters(bad):
    with pytest.raises(ValueError):
        ClusterParams(**bad)
    assert ClusterParams(min_samples=11)


def labels_frame(spark, labels):
    from datetime import timedelta

    rows = [("all", i, i + 20, START + timedelta(i), v) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "series_id string, row int, day int, date date, label int")


def test_persistence(spark):
    rows = validate.persistence(labels_frame(spark, [0, 0, 0, -1, 1, 1, 0, 0])).collect()
    assert {(r["label"], r["n_days"], r["n_runs"], r["mean_run"]) for r in rows} == {(-1, 1, 1, 1.0), (0, 5, 2, 2.5), (1, 2, 1, 2.0)}


def test_recurrence(spark):
    labels = [0 if i in (0, 1, 2, 10, 11, 100) else -1 for i in range(120)]
    for gap, episodes in ((5, 3), (50, 2)):
        r = validate.recurrence(labels_frame(spark, labels), gap).first()
        assert (r["n_days"], r["n_episodes"], r["first_row"], r["last_row"]) == (6, episodes, 0, 100)


def test_forward_vol(spark):
    closes = [100.0]
    for i in range(60):
        step = 0.01 if i < 40 else 0.02
        closes.append(closes[-1] * np.exp(step if i % 2 else -step))
    labels = [-1] * 41
    labels[0], labels[20] = 0, 1
    found = {r["label"]: r for r in validate.forward_vol(labels_frame(spark, labels), bars(spark, closes)).collect()}
    assert found[0]["mean_vol"] == pytest.approx(0.01, rel=0.04) and found[1]["mean_vol"] == pytest.approx(0.02, rel=0.04)
    assert found[0]["n"] == 1
    with pytest.raises(ValueError):
        validate.forward_volatility(bars(spark, closes), 1)


def test_upper_median(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    assert df.agg(validate.upper_median("v")).first()[0] == 3.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-1, 2), min_size=1, max_size=40), st.integers(1, 6))
def test_runs_and_episodes_equal_a_loop(spark, labels, gap):
    df = labels_frame(spark, labels)
    runs = {k: len([1 for v, g in itertools.groupby(labels) if v == k]) for k in set(labels)}
    assert {r["label"]: r["n_runs"] for r in validate.persistence(df).collect()} == runs
    want = {}
    for k in set(labels) - {-1}:
        at = [i for i, v in enumerate(labels) if v == k]
        want[k] = 1 + sum(b - a > gap for a, b in zip(at, at[1:]))
    assert {r["label"]: r["n_episodes"] for r in validate.recurrence(df, gap).collect()} == want


def test_adjusted_rand(spark):
    pairs = lambda p: spark.createDataFrame(p, "a int, b int")
    assert validate.adjusted_rand(pairs([(0, 5), (0, 5), (1, 7), (-1, 9)]), "a", "b").first()["ari"] == pytest.approx(1)
    assert validate.adjusted_rand(pairs([(0, 0), (0, 1), (1, 0), (1, 1)]), "a", "b").first()["ari"] == pytest.approx(-0.5)
    assert validate.adjusted_rand(pairs([(0, 3), (0, 3)]), "a", "b").first()["ari"] == 1


def test_events_take_the_first_that_overlaps(spark):
    spans = validate.episodes(labels_frame(spark, [0] * 3 + [-1] * 70 + [0] * 2), 10)
    events = spark.sql("select * from values (2, 'b', date'2001-01-02', date'2001-01-20'), (1, 'a', date'2001-01-03', date'2001-06-01') as t(event_order, event, start, end)")
    found = {r["episode"]: r["event"] for r in validate.overlapping_events(spans, events).collect()}
    assert found == {1: "a", 2: "a"}
    assert validate.overlapping_events(spans, events.limit(0)).where("event is not null").count() == 0


def test_pipeline_and_command_line(spark, tmp_path, capsys):
    from tidemark import cli
    from tidemark.sources import sinks

    b = bars(spark, walk(260))
    labels = pipeline.regimes(b, params=ClusterParams(k=6, block=5, min_cluster_size=8, min_samples=4))
    assert labels.count() == 240
    sinks.write_csv(sinks.bars_csv(b).coalesce(1), str(tmp_path / "bars"))
    path = str(next((tmp_path / "bars").glob("part-*.csv")))
    out = str(tmp_path / "out")
    assert cli.main(["features", path, out], spark) == 0
    assert spark.read.csv(f"{out}_std.csv", header=True).count() == 240
    assert cli.main(["regimes", path, out, "--mcs", "8", "--min-samples", "4"], spark) == 0
    assert cli.main(["dump-nn", path, out, "-k", "3"], spark) == 0
    assert spark.read.csv(f"{out}_nn.csv", header=True).count() == 720
    assert cli.main(["neighbors", path, "--date", "2001-03-01"], spark) == 0
    assert cli.main(["crisis", path, "--days", "2001-03-01", "2001-04-02"], spark) == 0
    assert cli.main(["crisis", path], spark) == 1
    assert cli.main(["neighbors", path, "--date", "2001-03-01", "--index", "hnsw"], spark) == 0
    assert cli.main(["bench", path], spark) == 0
    assert "recall" in capsys.readouterr().out
    assert cli.main(["neighbors", path, "--date", "2031-03-01"], spark) == 1
    assert cli.main(["nonsense"], spark) == 2


def top_down(rows, edges, birth, least):
    """(stability, label groups) of a cluster by cutting its tree's longest edge again and again."""
    left, stability = set(rows), 0.0
    while True:
        inside = [e for e in edges if e[0] in left and e[1] in left]
        if not inside:
            return stability, None
        w, a, b = max((w, a, b) for a, b, w in inside)
        near = {i: [] for i in left}
        for x, y, v in inside:
            if (v, x, y) != (w, a, b):
                near[x].append(y)
                near[y].append(x)
        side, stack = {a}, [a]
        while stack:
            for y in near[stack.pop()]:
                if y not in side:
                    side.add(y)
                    stack.append(y)
        other, density = left - side, 1 / w
        if len(side) >= least and len(other) >= least:
            stability += (density - birth) * len(left)
            below = []
            for part in (side, other):
                own, groups = top_down(part, edges, density, least)
                best = sum(s for s, _ in groups) if groups else 0.0
                below += groups if groups and best > own else [(own, part)]
            return stability, below
        for part in (side, other):
            if len(part) < least:
                stability += (density - birth) * len(part)
                left = left - part
        if not left:
            return stability, None


@pytest.mark.parametrize("p, m, least", [(40, 20, 8), (25, 25, 5), (50, 0, 10), (30, 40, 4)])
def test_labels_equal_a_top_down_definition(p, m, least):
    x = np.array(blobs(p, m, seed=p))
    edges = graph.prim(x, np.zeros(len(x)), 1)
    labels, stability = hdbscan.labels_of(len(x), edges, least)
    groups = top_down(set(range(len(x))), edges, 0.0, least)[1] or []
    got = {frozenset(np.flatnonzero(labels == k).tolist()): stability[labels == k][0] for k in set(labels.tolist()) - {-1}}
    assert got.keys() == {frozenset(g) for _, g in groups}
    for s, g in groups:
        assert got[frozenset(g)] == pytest.approx(s, rel=1e-9)
