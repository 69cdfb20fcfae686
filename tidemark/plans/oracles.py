"""The registered queries in SQL, for an independent engine. Later tables build on earlier ones."""

from __future__ import annotations

import re

from ..operators.standardize import NORMAL_IQR
from ..schema import FEATURES
from .queries import BLOCK, CLUSTERS, EVENTS, K, MIN_SAMPLES, STRESS

F4, F5 = FEATURES[:4], FEATURES


def over(n: int) -> str:
    return f"OVER (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def each(columns, form: str, sep: str = ", ") -> str:
    return sep.join(form.format(c=c) for c in columns)


def distance(a: str, b: str, columns=F4) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in columns)


def neighbours(points: str, k: int, block: int, where: str = "true") -> str:
    return f"""SELECT a.row AS row, b.row AS neighbor_row, sqrt({distance("a", "b")}) AS dist, row_number() OVER (PARTITION BY a.row ORDER BY {distance("a", "b")}, b.row) AS rank
    FROM {points} a JOIN {points} b ON abs(a.row - b.row) >= {block} WHERE {where} QUALIFY rank <= {k}"""


TABLES = {
    "bars": "SELECT CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS day FROM orders GROUP BY CAST(o_orderdate AS DATE)",
    "returns": "SELECT *, ln(close / lag(close) OVER (ORDER BY day)) AS ret FROM bars",
    "raw": f"""SELECT day, date, stddev_samp(ret) {over(20)} AS realized_vol, sum(ret) {over(20)} AS momentum, list(close) {over(21)} AS closes,
    CASE WHEN var_pop(ret) {over(20)} < 1e-16 THEN 0 ELSE skewness(ret) {over(20)} END AS skewness, ln(avg(volume) {over(20)} / avg(volume) {over(252)}) AS rel_volume FROM returns""",
    "every": "SELECT * EXCLUDE closes, list_min(list_transform(range(1, len(closes) + 1), lambda j: ln(closes[j] / list_max(closes[1:j])))) AS max_drawdown FROM raw WHERE day >= 20",
    "rows4": f"SELECT day - 20 AS row, day, date, {each(F4, '{c}')} FROM every",
    "rows5": f"SELECT day - 251 AS row, day, date, {each(F5, '{c}')} FROM every WHERE day >= 251",
    "zparams": f"SELECT count(*) AS n, {each(F4, 'avg({c}) AS c_{c}, stddev_samp({c}) AS s_{c}')} FROM rows4",
    "rparams": f"SELECT count(*) AS n, {each(F4, f'quantile_cont({{c}}, 0.5) AS c_{{c}}, (quantile_cont({{c}}, 0.75) - quantile_cont({{c}}, 0.25)) / {NORMAL_IQR} AS s_{{c}}')} FROM rows4",
    "points": f"SELECT row, day, date, {each(F4, '({c} - c_{c}) / s_{c} AS {c}')} FROM rows4, zparams",
    "near": neighbours("points", 10, 1),
    "blocked": neighbours("points", 10, 20),
    "core": "SELECT row, dist AS core FROM blocked WHERE rank = 9",
    "edges": "SELECT least(row, neighbor_row) AS a, greatest(row, neighbor_row) AS b, min(dist) AS dist FROM blocked GROUP BY ALL",
    "proxy": "SELECT row, day, date, CAST(CASE WHEN realized_vol < 0.9 THEN 0 WHEN realized_vol > 1.1 THEN 1 ELSE -1 END AS BIGINT) AS label FROM rows4",
    "runs": "SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (ORDER BY row) AND row > 0 THEN 0 ELSE 1 END AS starts FROM proxy",
    "lasting": "SELECT label, count(*) AS n_days, sum(starts) AS n_runs, count(*) / sum(starts) AS mean_run FROM runs GROUP BY label",
    "opened": "SELECT *, CASE WHEN row - lag(row) OVER (PARTITION BY label ORDER BY row) <= 5 THEN 0 ELSE 1 END AS opens FROM proxy WHERE label >= 0",
    "spans": "SELECT *, CAST(sum(opens) OVER (PARTITION BY label ORDER BY row) AS BIGINT) AS episode FROM opened",
    "recurring": "SELECT label, count(*) AS n_days, sum(opens) AS n_episodes, min(row) AS first_row, max(row) AS last_row FROM opened GROUP BY label",
    "episodes": "SELECT label, episode, count(*) AS n_days, min(row) AS first_row, max(row) AS last_row, min(date) AS first_date, max(date) AS last_date FROM spans GROUP BY label, episode",
    "ahead": "SELECT day, stddev_samp(ret) OVER w AS v, count(ret) OVER w AS n FROM returns WINDOW w AS (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)",
    "following": "SELECT label, count(*) AS n, avg(v) AS mean_vol, list_sort(list(v))[len(list(v)) // 2 + 1] AS median_vol FROM proxy JOIN ahead USING (day) WHERE n = 20 GROUP BY label",
    "robust_points": f"SELECT row, {each(F4, '({c} - c_{c}) / s_{c} AS {c}')} FROM rows4, rparams",
    "robust_near": neighbours("robust_points", 10, 1),
    "vectors": "SELECT CAST(vec_id AS BIGINT) AS row, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings",
    "vector_near": """SELECT a.row AS row, a.label AS label, b.row AS neighbor_row, b.label AS other, list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d2,
    row_number() OVER (PARTITION BY a.row ORDER BY d2, b.row) AS rank FROM vectors a JOIN vectors b ON a.row <> b.row QUALIFY rank <= 10""",
}


def query(*tables: str, select: str, recursive: str = "") -> str:
    """select over the named tables and those that they need."""
    need: list[str] = []

    def want(name: str) -> None:
        for other in TABLES:
            if other != name and other not in need and f" {other} " in f" {TABLES[name].replace(',', ' ').replace('(', ' ')} ".replace("\n", " "):
                want(other)
        if name not in need:
            need.append(name)

    for t in tables:
        want(t)
    parts = [f"{t} AS MATERIALIZED ({TABLES[t]})" for t in need] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.rpartition('.')[2]}" for c in columns)


def feature(name: str) -> str:
    rows = "rows5" if name == "rel_volume" else "rows4"
    return query(rows, select=f"SELECT row, date, {r(name)} FROM {rows}")


#: Rounds in which components take their least edges, and doublings of the pointers between them.
ROUNDS, DOUBLINGS = 9, 7


def spanning(name: str, core: str, order: str = "false") -> dict[str, str]:
    """Tables whose last, called name, has the edges a, b and w of the spanning tree of points; edges for
    which order is false come first, then lighter ones."""
    p = f"{name}_"
    out = {
        f"{p}pairs": f"SELECT a.row AS a, b.row AS b, {order} AS late, greatest(sqrt({distance('a', 'b')}), ca.core, cb.core) AS w FROM points a JOIN points b ON b.row - a.row >= {BLOCK} JOIN {core} ca ON ca.row = a.row JOIN {core} cb ON cb.row = b.row",
        f"{p}comp0": "SELECT row, row AS c FROM points",
    }
    for k in range(ROUNDS):
        comp = f"{p}comp{k}"
        out[f"{p}out{k}"] = f"SELECT late, w, a, b, x.c AS ca, y.c AS cb FROM {p}pairs JOIN {comp} x ON x.row = a JOIN {comp} y ON y.row = b WHERE x.c <> y.c"
        out[f"{p}best{k}"] = f"SELECT c, min(e) AS e FROM (SELECT ca AS c, struct_pack(late := late, w := w, a := a, b := b, o := cb) AS e FROM {p}out{k} UNION ALL SELECT cb AS c, struct_pack(late := late, w := w, a := a, b := b, o := ca) AS e FROM {p}out{k}) GROUP BY c"
        out[f"{p}to{k}x0"] = f"SELECT x.c AS c, CASE WHEN y.e.o = x.c AND x.c < y.c THEN x.c ELSE x.e.o END AS r FROM {p}best{k} x JOIN {p}best{k} y ON y.c = x.e.o"
        for d in range(DOUBLINGS):
            out[f"{p}to{k}x{d + 1}"] = f"SELECT x.c AS c, y.r AS r FROM {p}to{k}x{d} x JOIN {p}to{k}x{d} y ON y.c = x.r"
        out[f"{p}comp{k + 1}"] = f"SELECT row, coalesce(r, x.c) AS c FROM {comp} x LEFT JOIN {p}to{k}x{DOUBLINGS} t ON t.c = x.c"
    out[name] = " UNION ".join(f"SELECT e.a AS a, e.b AS b, e.w AS w FROM {p}best{k}" for k in range(ROUNDS))
    return out


TABLES |= spanning("exact_tree", "core")
TABLES |= spanning("rough_tree", "core", "(a.row, b.row) NOT IN (SELECT (a, b) FROM edges )")
TABLES["core5"] = f"SELECT row, dist AS core FROM blocked WHERE rank = {CLUSTERS.min_samples - 1}"
TABLES |= spanning("cluster_tree", "core5")

#: Density clusters by the tree's joins in order: a join's sides; rows leave a cluster where their side
#: is small or both are large; the cluster's stability is what its rows stay, in inverse distances.
LEAST = CLUSTERS.min_cluster_size
JOINS = """joins(k, comp, w, left_rows, right_rows) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(row ORDER BY row) FROM points), CAST(0 AS DOUBLE), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT j.k + 1, list_transform(j.comp, lambda x: CASE WHEN x = j.comp[e.b + 1] THEN j.comp[e.a + 1] ELSE x END), e.w,
    list_filter(range(0, len(j.comp)), lambda i: j.comp[i + 1] = j.comp[e.a + 1]), list_filter(range(0, len(j.comp)), lambda i: j.comp[i + 1] = j.comp[e.b + 1])
  FROM joins j JOIN ordered e ON e.k = j.k + 1)"""
CLUSTER_TABLES = {
    "ordered": "SELECT row_number() OVER (ORDER BY w, a, b) AS k, a, b, w FROM cluster_tree",
    "sides": "SELECT k, 0 AS side, 1 / greatest(w, 1e-12) AS density, left_rows AS members, len(right_rows) AS other FROM joins WHERE k > 0 UNION ALL SELECT k, 1 AS side, 1 / greatest(w, 1e-12) AS density, right_rows AS members, len(left_rows) AS other FROM joins WHERE k > 0",
    "steps": f"SELECT unnest(members) AS row, k, side, density, len(members) >= {LEAST} AS goes_on FROM sides WHERE len(members) < {LEAST} OR other >= {LEAST}",
    "falls": "SELECT row, max(k) AS k FROM steps WHERE NOT goes_on GROUP BY row",
    "path": "SELECT s.row AS row, s.k AS k, s.side AS side, s.density AS density, s.goes_on AS goes_on, lead(s.density) OVER (PARTITION BY s.row ORDER BY s.k DESC) AS leaves, lag(s.k * 2 + s.side) OVER (PARTITION BY s.row ORDER BY s.k DESC) AS parent FROM steps s JOIN falls f ON f.row = s.row WHERE s.k >= f.k",
    "found": "SELECT k * 2 + side AS cluster, any_value(parent) AS parent, sum(leaves - density) AS stability, row_number() OVER (ORDER BY k * 2 + side) AS i FROM path WHERE goes_on GROUP BY k, side",
    "kin": "SELECT x.i AS i, x.cluster AS cluster, x.stability AS stability, y.i AS above FROM found x LEFT JOIN found y ON y.cluster = x.parent",
    "weighing": "",
    "chosen": "SELECT k.cluster AS cluster, k.i AS i, k.stability AS stability FROM kin k, (SELECT takes FROM weighing ORDER BY i DESC LIMIT 1) WHERE takes[k.i]",
    "top": "SELECT p.row AS row, arg_max(c.cluster, c.i) AS cluster, arg_max(c.stability, c.i) AS stability FROM path p JOIN chosen c ON c.cluster = p.k * 2 + p.side WHERE p.goes_on GROUP BY p.row",
    "numbered": "SELECT cluster, row_number() OVER (ORDER BY min(row)) - 1 AS label FROM top GROUP BY cluster",
    "labelled": "SELECT p.row AS row, p.day AS day, p.date AS date, coalesce(n.label, -1) AS label, coalesce(t.stability, 0) AS stability FROM points p LEFT JOIN top t ON t.row = p.row LEFT JOIN numbered n ON n.cluster = t.cluster",
}
#: From the smallest clusters up: one is taken unless what is best below it is more.
WEIGHING = """weighing(i, below, takes) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(CAST(0 AS DOUBLE)) FROM kin), (SELECT list(false) FROM kin)
  UNION ALL
  SELECT w.i + 1, list_transform(w.below, lambda x, j: CASE WHEN j = c.above THEN x + greatest(w.below[c.i], c.stability) ELSE x END), list_transform(w.takes, lambda x, j: CASE WHEN j = c.i THEN NOT w.below[c.i] > c.stability ELSE x END)
  FROM weighing w JOIN kin c ON c.i = w.i + 1)"""
#: The validators' tables over these labels.
VALIDATORS = ("runs", "lasting", "opened", "spans", "recurring", "following")
for _name in VALIDATORS:
    CLUSTER_TABLES[f"c_{_name}"] = re.sub(rf"\b({'|'.join(VALIDATORS)})\b(?= )", r"c_\1", TABLES[_name].replace(" proxy", " labelled")).replace("sum(c_", "sum(")


def cluster_query(*tables: str, select: str) -> str:
    """select over tables of clusters; named ones of TABLES come first."""
    base = query("cluster_tree", "points", "ahead", select="").rstrip()
    own, parts = ["ordered", "sides", "steps", "falls", "path", "found", "kin", "weighing", "chosen", "top", "numbered", "labelled", *tables], []
    for t in own:
        if t == "sides":
            parts.append(JOINS)
        parts.append(WEIGHING if t == "weighing" else f"{t} AS MATERIALIZED ({CLUSTER_TABLES[t]})")
    return base.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + ",\n".join(parts) + "\n" + select


EVENT_ROWS = ", ".join(f"({n}, '{e}', DATE '{a}', DATE '{b}')" for n, e, a, b in EVENTS)
PAIRS5 = [(a, b) for i, a in enumerate(F5) for b in F5[i + 1 :]]

SQL = {
    "bars_daily": query("bars", select=f"SELECT date, {r('open', 'high', 'low', 'close', 'volume')}, day FROM bars"),
    "log_returns": query("returns", select=f"SELECT date, {r('ret')} FROM returns"),
    "ohlcv_violations": query("bars", select="SELECT date, 'open isn''t positive' AS rule FROM bars WHERE day % 7 = 0 UNION ALL SELECT date, 'close is no number' AS rule FROM bars WHERE day % 11 = 0"),
    "merge_dedupe": query("bars", select=f"SELECT date, {r('open', 'high', 'low', 'close', 'volume')} FROM bars"),
    "history_depth": query("bars", select="SELECT count(*) AS bars, min(date) AS first, max(date) AS last, round(date_diff('day', min(date), max(date)) / 365.25, 6) AS years, date_diff('day', min(date), max(date)) / 365.25 >= 20 AS deep FROM bars"),
    "features_d4": query("rows4", select=f"SELECT row, day, date, {r(*F4)} FROM rows4"),
    "features_d5": query("rows5", select=f"SELECT row, day, date, {r(*F5)} FROM rows5"),
    "features_warmup251": query("rows4", select=f"SELECT day - 251 AS row, day, date, {r(*F4)} FROM rows4 WHERE day >= 251"),
    "zscore_params": query("zparams", select=f"SELECT n, {r(*[f'{p}_{c}' for c in F4 for p in 'cs'])} FROM zparams"),
    "zscore_apply": query("points", select=f"SELECT row, day, date, {r(*F4)} FROM points"),
    "robust_params": query("rparams", select=f"SELECT n, {r(*[f'{p}_{c}' for c in F4 for p in 'cs'])} FROM rparams"),
    "robust_apply": query("rows4", "rparams", select=f"SELECT row, day, date, {each(F4, 'round(({c} - c_{c}) / s_{c}, 6) AS {c}')} FROM rows4, rparams"),
    "feature_corr": query("rows5", select=" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM rows5" for a, b in PAIRS5)),
    "feature_spread": query("rows4", select=" UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS low, round(quantile_cont({c}, 0.01), 6) AS p1, round((quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / {NORMAL_IQR} / stddev_samp({c}), 6) AS robust_ratio FROM rows4" for c in F4)),
    "volume_by_year": query("bars", select="SELECT year(date) AS year, round(median(volume), 6) AS median_volume FROM bars GROUP BY 1"),
    "knn_exact": query("near", select=f"SELECT row, rank, neighbor_row, {r('dist')} FROM near"),
    "knn_external": query("points", select=f"SELECT row_number() OVER (ORDER BY {distance('p', 'q')}, p.row) AS rank, p.row AS neighbor_row, round(sqrt({distance('p', 'q')}), 6) AS dist FROM points p, (SELECT 0.5::DOUBLE AS realized_vol, -0.25::DOUBLE AS momentum, 0.1::DOUBLE AS max_drawdown, 1.0::DOUBLE AS skewness) q QUALIFY rank <= 10"),
    "knn_on_date": query("near", "rows4", select=f"SELECT a.date AS date, n.row AS row, rank, neighbor_row, b.date AS neighbor_date, {r('n.dist', *['b.' + c for c in F4])} FROM near n JOIN rows4 a ON a.row = n.row JOIN rows4 b ON b.row = neighbor_row WHERE n.row = 700"),
    "knn_stress_days": query("near", "rows4", select=f"SELECT a.date AS date, rank, b.date AS neighbor_date, {r('n.dist')} FROM near n JOIN rows4 a ON a.row = n.row JOIN rows4 b ON b.row = neighbor_row WHERE rank <= 5 AND a.date IN ({', '.join(f"DATE '{d}'" for d in STRESS)})"),
    "next_day_lookup": query("rows4", select="SELECT wanted, (SELECT min(date) FROM rows4 WHERE date >= wanted) AS next_date FROM (VALUES (DATE '1994-01-01'), (DATE '1997-03-02'), (DATE '1998-06-06'), (DATE '2000-01-01'), (DATE '2031-01-01')) v(wanted)"),
    "knn_blocked_w20": query("blocked", select=f"SELECT row, rank, neighbor_row, {r('dist')} FROM blocked"),
    "knn_embeddings": query("vector_near", select="SELECT row, rank, neighbor_row, round(sqrt(d2), 6) AS dist FROM vector_near"),
    "core_distance": query("core", select=f"SELECT row, {r('core')} FROM core"),
    "knn_edges_sym": query("edges", select=f"SELECT a, b, {r('dist')} FROM edges"),
    "mutual_reach": query("edges", "core", select="SELECT a, b, round(greatest(dist, x.core, y.core), 6) AS w FROM edges JOIN core x ON x.row = a JOIN core y ON y.row = b"),
    "mst_exact": query("exact_tree", select="SELECT count(*) AS edges, round(sum(w), 6) AS weight FROM exact_tree"),
    "mst_rounds": query("exact_tree", select="SELECT count(*) AS edges, round(sum(w), 6) AS weight FROM exact_tree"),
    "mst_all": query("exact_tree", select=f"SELECT a, b, {r('w')} FROM exact_tree"),
    "mst_rounds_all": query("exact_tree", select=f"SELECT a, b, {r('w')} FROM exact_tree"),
    "mst_substrate": query("rough_tree", select="SELECT count(*) AS edges, round(sum(w), 6) AS weight FROM rough_tree"),
    "substrate_edges": query("rough_tree", select=f"SELECT a, b, {r('w')} FROM rough_tree"),
    "hdbscan_labels": cluster_query(select="SELECT row, date, label FROM labelled"),
    "hdbscan_stability": cluster_query(select="SELECT label, round(max(stability), 6) AS stability, count(*) AS n_days FROM labelled WHERE label >= 0 GROUP BY label"),
    "cluster_counts": cluster_query(select="SELECT count(*) AS n_rows, count(DISTINCT label) FILTER (label >= 0) AS n_clusters, count(*) FILTER (label < 0) AS n_noise, round(count(*) FILTER (label < 0) / count(*), 6) AS noise_share FROM labelled"),
    "cluster_persistence": cluster_query("c_runs", "c_lasting", select=f"SELECT label, n_days, CAST(n_runs AS BIGINT) AS n_runs, {r('mean_run')} FROM c_lasting"),
    "cluster_recurrence": cluster_query("c_opened", "c_recurring", select="SELECT label, n_days, CAST(n_episodes AS BIGINT) AS n_episodes, first_row, last_row FROM c_recurring"),
    "cluster_report": cluster_query("c_runs", "c_lasting", "c_opened", "c_recurring", "c_following", select=f"SELECT l.label AS label, l.n_days AS n_days, CAST(n_runs AS BIGINT) AS n_runs, {r('mean_run')}, CAST(n_episodes AS BIGINT) AS n_episodes, first_row, last_row, f.n AS n, {r('mean_vol', 'median_vol')} FROM c_lasting l LEFT JOIN c_recurring r ON r.label = l.label LEFT JOIN c_following f ON f.label = l.label"),
    "scaling_recall": query("near", "robust_near", select="SELECT round(avg(r), 6) AS recall FROM (SELECT n.row, count(x.row) / count(*) AS r FROM near n LEFT JOIN robust_near x ON x.row = n.row AND x.neighbor_row = n.neighbor_row GROUP BY n.row)"),
    "csv_round_trip": query("bars", select=f"SELECT date, {r('open', 'high', 'low', 'close', 'volume')}, day FROM bars"),
    "chart_rows": query("rows4", "proxy", "bars", select=f"SELECT x.row AS row, CAST(x.date AS VARCHAR) AS date, round(b.close, 2) AS close, {r(*['x.' + c for c in F4])}, p.label AS fine, p.label AS coarse FROM rows4 x JOIN bars b ON b.day = x.day JOIN proxy p ON p.row = x.row"),
    "persistence": query("lasting", select=f"SELECT label, n_days, CAST(n_runs AS BIGINT) AS n_runs, {r('mean_run')} FROM lasting"),
    "recurrence": query("recurring", select="SELECT label, n_days, CAST(n_episodes AS BIGINT) AS n_episodes, first_row, last_row FROM recurring"),
    "episodes": query("episodes", select="SELECT label, episode, n_days, first_row, last_row, first_date, last_date FROM episodes"),
    "forward_vol": query("following", select=f"SELECT label, n, {r('mean_vol', 'median_vol')} FROM following"),
    "regime_report": query("lasting", "recurring", "following", select=f"SELECT l.label AS label, l.n_days AS n_days, CAST(n_runs AS BIGINT) AS n_runs, {r('mean_run')}, CAST(n_episodes AS BIGINT) AS n_episodes, first_row, last_row, f.n AS n, {r('mean_vol', 'median_vol')} FROM lasting l LEFT JOIN recurring r ON r.label = l.label LEFT JOIN following f ON f.label = l.label"),
    "event_overlap": query("episodes", select=f"SELECT label, episode, first_date, last_date, (SELECT arg_min(event, n) FROM (VALUES {EVENT_ROWS}) v(n, event, a, b) WHERE a <= last_date AND b >= first_date) AS event FROM episodes"),
    "close_range": query("bars", select="SELECT round(min(close), 6) AS low, round(max(close), 6) AS high FROM bars"),
    "momentum_by_series": """WITH b AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY ALL),
      d AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS day, ln(close / lag(close) OVER (PARTITION BY series ORDER BY date)) AS ret FROM b),
      w AS (SELECT series, day, date, sum(ret) OVER t AS momentum, stddev_samp(ret) OVER t AS realized_vol FROM d WINDOW t AS (PARTITION BY series ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
      SELECT series, day - 20 AS row, date, round(momentum, 6) AS momentum, round(realized_vol, 6) AS realized_vol FROM w WHERE day >= 20""",
    "lookup_on_date": query("rows4", select=f"SELECT row, day, date, {r(*F4)} FROM rows4 WHERE date = DATE '1998-06-02'"),
    "neighbor_table": query("near", "rows4", select="SELECT n.row AS index, a.date AS date, rank, neighbor_row AS neighbor_index, b.date AS neighbor_date, round(n.dist, 6) AS distance FROM near n JOIN rows4 a ON a.row = n.row JOIN rows4 b ON b.row = neighbor_row WHERE rank <= 3"),
    "label_table": query("proxy", select="SELECT row AS index, date, label FROM proxy"),
    "distinct_labels": query("proxy", select="SELECT DISTINCT label FROM proxy WHERE label >= 0"),
    "label_counts": query("proxy", select="SELECT count(*) AS n_rows, count(DISTINCT label) FILTER (label >= 0) AS n_clusters, count(*) FILTER (label < 0) AS n_noise, round(count(*) FILTER (label < 0) / count(*), 6) AS noise_share FROM proxy"),
    "named_labels": query("proxy", select="SELECT CASE label WHEN 0 THEN 'calm' WHEN 1 THEN 'restless' ELSE '-1' END AS name, count(*) AS n_days FROM proxy GROUP BY 1"),
    "ari": query("vector_near", select="""SELECT round((s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t), 6) AS ari FROM
      (SELECT sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM (SELECT count(*) AS n FROM vector_near WHERE rank = 1 GROUP BY label, other)),
      (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT count(*) AS n FROM vector_near WHERE rank = 1 GROUP BY label)),
      (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT count(*) AS n FROM vector_near WHERE rank = 1 GROUP BY other))"""),
} | {f"{c}_{n}": feature(c) for c, n in (("realized_vol", 20), ("momentum", 20), ("max_drawdown", 20), ("skewness", 20), ("rel_volume", 252))}
