"""Operators on many documents: shards, fingerprints, near duplicates, the pipeline."""

import hashlib
import os
import random

import numpy as np
import pytest
import xxhash
from test_text_operators import ODD, documents, empty

import corpus_pipeline
from tidemark.llm import bpe, decontaminate, fingerprint, neardup, pii, quality, queries, sharding

SF = "/root/testdata/sf0.001"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(n))


# --- shards


def test_store_appends_compacts_and_keeps_versions(spark, tmp_path):
    r = random.Random(1)
    docs = documents(spark, ODD + [words(r, 50) for _ in range(300)]).repartition(6)
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.shards() == []
    assert store.append(docs, rows=10) == 1 and store.append(docs.limit(7), rows=10) == 2
    small = store.shards()
    assert len(small) >= 31
    store.compact(target=40_000)
    assert len(store.shards()) < len(small) and max(s.bytes for s in store.shards()) < 80_000
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(store.read(1)) == rows(docs)
    assert rows(store.read()) == rows(store.read(2))
    with pytest.raises(sharding.Conflict):
        store.commit(store.version(), store.schema(), [])
    before = rows(store.read())
    store.vacuum()
    assert rows(store.read()) == before
    assert len(store._names("manifests")) == 1


def test_plan_merges_similar_sizes_only():
    shards = [sharding.Shard(f"a{i}", 1 << 18) for i in range(9)] + [sharding.Shard("big", 60 << 20), sharding.Shard("mid", 5 << 20)]
    merges = sharding.planned(shards, 1 << 20, 4)
    assert sorted(len(m) for m in merges) == [4, 4] and all(s.name.startswith("a") for m in merges for s in m)
    assert sharding.planned(shards[:3], 1 << 20, 4) == []


def test_store_edges(spark, tmp_path):
    store = sharding.compacted(empty(spark), str(tmp_path / "e"))
    assert store.read().count() == 0
    store = sharding.ShardStore(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store.read()
    assert store.compact() == 0


# --- near duplicates


def brute_simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps, threshold=2):
    top = list(range(len(ids)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                top[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_neardup_equals_brute_force(spark):
    r = random.Random(2)
    texts = list(ODD) + ["A B c", "a  b\tC", "x\xa0y\u2003z w", "\x1cq w e"]
    for _ in range(25):
        base = words(r, r.randrange(1, 300)).split()
        for _ in range(r.randrange(1, 5)):
            copy = list(base)
            if r.random() < 0.7:
                copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    ids = [1000 - i for i in range(len(texts) - 1)] + [None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    found = {(x["doc_id"]): (x["fp"] & (1 << 64) - 1, x["component_id"]) for x in neardup.near_duplicates(df).collect()}
    fps = [brute_simhash(t) for t in texts]
    want = brute_components(ids, fps)
    assert found == {i: (f, c) for i, f, c in zip(ids, fps, want)}
    kept = neardup.drop_near_duplicates(df).collect()
    assert sorted(x["doc_id"] for x in kept if x["doc_id"] is not None) == sorted({c for c in want if c is not None})
    assert sum(x["doc_id"] is None for x in kept) == sum(c is None for c in want)


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = "a b c d e f g", "some other words stand here now", "and these are none of those two"
    kept = lambda rows: sorted((r["doc_id"] or 0, r["text"]) for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept([(1, a), (1, b), (2, c)]) == sorted([(1, a), (1, b), (2, c)])
    # Ids 5 are in two groups: each group keeps its smallest row.
    assert kept([(5, a), (3, a), (5, b), (9, b)]) == sorted([(3, a), (5, b)])
    assert kept([(None, a), (None, a), (None, b), (4, b)]) == sorted([(0, a), (4, b)])
    assert kept([(1, a)] * 7 + [(2, a)] * 5 + [(3, c)] * 4) == sorted([(1, a), (3, c)])
    maps = spark.createDataFrame([(1, a, {"k": 1}), (1, a, {"k": 1}), (2, a, None)], "doc_id long, text string, best map<string,int>")
    assert [(r["doc_id"], r["best"]) for r in neardup.drop_near_duplicates(maps).collect()] == [(1, {"k": 1})]


@pytest.mark.parametrize("limit", [0, 400_000])
def test_decisions_are_the_same_with_and_without_broadcast(spark, limit, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_KEYS", limit)
    r = random.Random(12)
    base = [words(r, 30) for _ in range(8)]
    rows = [(r.choice([None, *range(12)]), r.choice(base)) for _ in range(80)]
    component = brute_components(list(range(80)), [brute_simhash(t) for _, t in rows])
    want = sorted(min((i is None, i or 0) for (i, _), c in zip(rows, component) if c == k) for k in set(component))
    got = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in got) == want


def test_texts_are_not_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = neardup.drop_near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_the_third_code_finds_all_and_compares_few(spark, monkeypatch):
    r = random.Random(13)
    counted = []
    compare = neardup.compare
    monkeypatch.setattr(neardup, "compare", lambda x, lo, hi, fp, t: counted.append(int((hi - lo).sum())) or compare(x, lo, hi, fp, t))
    shares = []
    for n in (2000, 8000):  # all of one anchor: only bits 46 to 63 differ, and a few others
        fps = np.unique(np.array([neardup.signed(r.getrandbits(18) << 46 | (1 << r.randrange(46) if r.random() < 0.5 else 0)) for _ in range(n)]))
        counted.clear()
        a, b = neardup.probe(fps, fps, 2)
        shares.append(sum(counted) / len(fps) ** 2)
        x = fps.view(np.uint64)
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
        tops = list(range(len(fps)))
        at = {v: i for i, v in enumerate(fps.tolist())}

        def find(i):
            while tops[i] != i:
                i = tops[i]
            return i

        for u, v in zip(a.tolist(), b.tolist()):
            assert near[at[u], at[v]]
            tops[find(at[u])] = find(at[v])
        roots = np.array([find(i) for i in range(len(fps))])
        i, j = np.nonzero(near)
        assert (roots[i] == roots[j]).all()
    assert max(shares) < 0.03  # 36 of 2,048 codewords


@pytest.mark.parametrize("slice_rows", [20_000, 3])
def test_links_connect_what_all_pairs_connect(spark, slice_rows, monkeypatch):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:12]:  # chains and dense clusters
        for _ in range(15):
            x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(x)
            fps.add(x ^ 1 << r.randrange(3))
    fps = sorted(fps)
    df = spark.createDataFrame([(neardup.signed(x),) for x in fps], "fp long").repartition(3)
    edges = neardup.links(df, 2, slice_rows)
    for e in edges.collect():
        assert 1 <= ((e["a"] ^ e["b"]) & (1 << 64) - 1).bit_count() <= 2
    root = {x["node"]: x["root"] for x in neardup.components(edges).collect()}
    signed = [neardup.signed(x) for x in fps]
    got = [root.get(x, x) for x in signed]
    want = brute_components(signed, fps)
    assert got == want


def test_home_anchor_is_reached_by_all_within_the_threshold():
    r = random.Random(4)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        home = neardup.home_of(np.array([neardup.signed(x)]))[0]
        of, at, is_home = neardup.anchors(np.array([neardup.signed(y)]))
        assert home in at and is_home.sum() == 1 and len(set(at.tolist())) == len(at)


def test_neardup_edges(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    docs = documents(spark, ["a b c d"] * 3)
    assert {x["component_id"] for x in neardup.near_duplicates(docs).collect()} == {0}
    twice = docs.unionByName(docs)
    assert neardup.near_duplicates(twice).count() == 6
    assert [x["doc_id"] for x in neardup.drop_near_duplicates(twice).collect()] == [0]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {x["root"] for x in neardup.components(chain).collect()} == {0}


# --- fingerprints


def edits(rows):
    """doc_id to (n_chars, edited text, next id) of distinct ids in order."""
    order = sorted(rows)
    out = {}
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        text, other = rows[i] or "", rows[after] or ""
        q = len(text) // 4
        out[i] = (len(text), text[: len(text) - q] + other[:q], after)
    return out


def test_fingerprints_and_edits(spark):
    r = random.Random(5)
    texts = [t for t in ODD if t is None or len(t) < 1000] + [words(r, r.randrange(1, 80)) for _ in range(40)]
    rows = {7 * i + 3: t for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    found = {x["doc_id"]: x for x in fingerprint.fingerprint_documents(df).collect()}
    want = edits(rows)
    for i, (n, edited, after) in want.items():
        x = found[i]
        assert x["n_chars"] == n and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
        like = lambda b: max(0.0, np.cos(np.pi * b / 128))
        assert x["near_edited"] == pytest.approx(like(bits(x["fingerprint"], x["edited_fingerprint"])), abs=1e-12)
        assert x["near_next"] == pytest.approx(like(bits(x["fingerprint"], found[after]["fingerprint"])), abs=1e-12)
        if not (rows[i] or "").split():
            assert int(x["fingerprint"], 16) == 0
    # A text's fingerprint is the same wherever the text is.
    texts = spark.createDataFrame([(i, e) for i, (_, e, _) in want.items()], "doc_id long, text string")
    again = {x["doc_id"]: x["fingerprint"] for x in fingerprint.fingerprint_documents(texts).collect()}
    assert again == {i: found[i]["edited_fingerprint"] for i in want}


def test_fingerprint_votes_equal_plain_python(spark):
    text = words(random.Random(6), 30)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = fingerprint.fingerprints(df, ["doc_id"], "text").first()
    w = text.split()
    terms = spark.createDataFrame([tuple(w[i : i + 3]) for i in range(28)], "a string, b string, c string").selectExpr("xxhash64(a, b, c) as x", "xxhash64(1, a, b, c) as y").collect()
    vote = lambda c: neardup.signed(sum(1 << b for b in range(64) if sum((t[c] >> b & 1) for t in terms) * 2 > 28))
    assert (row["hi"], row["lo"]) == (vote("x"), vote("y"))


def test_tables_find_all_within_the_radius(spark):
    r = random.Random(7)
    base = [r.getrandbits(128) for _ in range(20)]
    every = list(base)
    for x in base:
        for k in (1, 2, 3, 4, 5):
            y = x
            for b in r.sample(range(128), k):
                y ^= 1 << b
            every.append(y)
    frame = lambda xs: spark.createDataFrame([(neardup.signed(x >> 64), neardup.signed(x & (1 << 64) - 1)) for x in xs], "hi long, lo long")
    whole = lambda h, l: (h & (1 << 64) - 1) << 64 | l & (1 << 64) - 1
    for radius in (1, 2, 3, 4):
        got = {(whole(p["hi"], p["lo"]), whole(p["hi2"], p["lo2"])) for p in fingerprint.within(frame(base), frame(every), radius).collect()}
        assert got == {(x, y) for x in base for y in every if (x ^ y).bit_count() <= radius}


def test_fingerprint_edges(spark, monkeypatch):
    assert fingerprint.fingerprint_documents(empty(spark)).count() == 0
    rows = [(100, "a b c d e"), (100, "a b c d e"), (100, "other text here"), (None, "no id at all"), (200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as key")
    found = fingerprint.fingerprint_documents(df).collect()
    assert len(found) == 5
    lost = next(x for x in found if x["doc_id"] is None)
    assert lost["near_next"] == 0 and lost["edited_sha256"] == hashlib.sha256(b"no id at ").hexdigest() and lost["n_chars"] == 12
    assert {x["n_near"] for x in found if x["doc_id"] == 100} == {1, 0} and next(x for x in found if x["doc_id"] is None)["n_near"] is None
    many = spark.createDataFrame([(1, "a b c d")] * 25 + [(2, "e f")], "doc_id long, text string")
    monkeypatch.setattr(fingerprint, "LOT_ROWS", 10)
    assert sorted(x["doc_id"] for x in fingerprint.fingerprint_documents(many).collect()) == [1] * 25 + [2]
    alone = fingerprint.fingerprint_documents(documents(spark, ["abcdefgh"])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


# --- pipeline and registered queries


def test_pipeline_equals_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    ids = sorted(good)
    component = brute_components(ids, [brute_simhash(rows[i]) for i in ids])
    kept = {i for i, c in zip(ids, component) if i == c}
    found = {r["doc_id"]: r["hits"] for r in decontaminate.find_leaks(docs, items).collect()}
    kept = {i for i in kept if not found[i]}
    b = bpe.loaded(bpe.default_vocabulary())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == kept and 0 < len(kept) < len(rows)
    for i in kept:
        text, end, out = rows[i], 0, []
        for kind, start, stop in sorted(pii.base_spans(text), key=lambda x: (x[1], -x[2])):
            if start >= end:
                out += [text[end:start], f"[{kind.upper()}]"]
            end = max(end, stop)
        clean = "".join(out) + text[end:]
        assert got[i]["decoded_sha256"] == hashlib.sha256(clean.encode()).hexdigest()
        assert got[i]["n_tokens"] == len(b.encode(clean))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.partition('.')[0]} as select * from '{SF}/{t}'")
    sql = c.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(sql.columns)]
    key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))
    assert key(got) == key(sql)


def test_an_append_with_other_columns_is_refused(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    store.append(first)
    for other in ("doc_id int, text string, extra string", "doc_id bigint, text string", "doc_id int"):
        row = (2, "b", "kept")[: other.count(",") + 1]
        with pytest.raises(ValueError, match="columns"):
            store.append(spark.createDataFrame([row], other))
    store.append(first.select("text", "doc_id"))
    assert [tuple(r) for r in store.read().collect()] == [(1, "a")] * 2 and store.version() == 2


def test_an_append_can_add_columns(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame([(0, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([("de", 10, "b")], "lang string, doc_id long, text string"), evolve=True)
    with pytest.raises(ValueError, match="columns"):
        store.append(spark.createDataFrame([("x", 1)], "doc_id string, lang int"), evolve=True)
    store.append(spark.createDataFrame([(20,)], "doc_id long"), evolve=True)
    want = {(0, "a", None), (10, "b", "de"), (20, None, None)}
    rows = lambda: {(r["doc_id"], r["text"], r["lang"]) for r in store.read().collect()}
    assert rows() == want
    store.compact(fan_in=2)
    store.vacuum()
    assert rows() == want and len(store.shards()) < 3
    assert [f.name for f in store.schema()] == ["doc_id", "text", "lang"]


def test_a_writer_that_loses_the_race_tries_again(spark, tmp_path, monkeypatch):
    docs = documents(spark, ["a", "b", "c"])
    store, other = (sharding.ShardStore(spark, str(tmp_path / "race")) for _ in range(2))
    store.append(docs)
    for _ in range(4):
        other.append(docs)
    version, races = store.version, []

    def late():
        found = version()
        if len(races) < 2:
            races.append(found)
            other.append(docs)  # takes the version that store is about to take
        return found

    monkeypatch.setattr(store, "version", late)
    store.append(docs)
    monkeypatch.setattr(store, "version", version)
    assert store.read().count() == 3 * (1 + 4 + len(races) + 1)
    # An append during a compaction stays beside the merged shards; a compaction that another has overtaken is dropped.
    merged = store._merged

    def meanwhile(merges):
        out = merged(merges)
        monkeypatch.setattr(store, "_merged", merged)
        other.append(docs)
        other.compact(fan_in=2)
        return out

    monkeypatch.setattr(store, "_merged", meanwhile)
    n = store.read().count()
    store.compact(fan_in=2)
    assert store.read().count() == n + 3


def test_object_stores_need_a_conditional_put(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RENAMES", frozenset())
    known: dict[str, bytes] = {}

    def put(path, content):
        if path in known:
            return False
        known[path] = content
        (tmp_path / "o" / "manifests" / path.rpartition("/")[2]).write_bytes(content)
        return True

    store = sharding.ShardStore(spark, str(tmp_path / "o"), put)
    assert store.append(documents(spark, ["a"])) == 1 and store.read().count() == 1
    with pytest.raises(sharding.Conflict):
        store.commit(1, store.schema(), [])


def test_arrivals_go_by_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = os.path.getsize(f"{SF}/documents.parquet")
    rows = sharding.arrival_rows(docs)
    assert rows == pytest.approx(docs.count() * sharding.ARRIVAL_BYTES / size, rel=0.05)
    assert sharding.arrival_rows(docs.limit(0)) == 1
