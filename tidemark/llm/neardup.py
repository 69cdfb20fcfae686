"""SimHash near duplicates by anchor-point covering.

A fingerprint is the bitwise majority of its document's shingle hashes. Two fingerprints are
linked at ``THRESHOLD`` or fewer differing bits; documents reachable over links are one group.

**Anchors.** A covering code of {0,1}^64 has a codeword (an anchor) within its covering radius of
every fingerprint. Ours is the product of two binary Golay codes [23,12] (perfect, radius 3) on
bits 0-22 and 23-45 and the single word 0 on the remaining 18 bits. Each fingerprint has its home,
the nearest anchor: in each Golay part the one codeword within 3 bits. If x and y differ in at
most t bits, then y is within radius + t of x's home, where the t bits beyond the radius are spent
over the two parts together. So y is replicated to every anchor whose distances exceed the radii
by at most t in all, and x and y meet at the home of x (and at that of y). There are 2^24 anchors
and about 70 replicas of a fingerprint for t = 2.

**Compare.** Only distinct fingerprints are replicated, so exact copies cost nothing. At an anchor
the homes are compared with all rows, by XOR and bit count in bounded blocks, and only the links
of spanning forests leave the task, never all pairs of a group; a fingerprint has at most 2080
others within 2 bits, so even in dense groups a row has few links. Replicas stream past the homes.
An anchor that is home to very many is split: its homes are dealt to slices and its replicas go to
each, so no task gathers an unbounded group. Where a slice has over ``PROBE_HOMES`` homes, a third
code cuts the comparisons: homes are sorted by their codeword of the Hamming code [15,11] on bits
46-60, and a row is compared with the homes of the 36 of 2,048 codewords within 1 + t of it only.
This needs no more replicas; it happens inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, narrowed, slices, stored

SHINGLE = 3
THRESHOLD = 2
SEED = 42
#: Shingles hashed before their bits are counted.
CHUNK = 1 << 16
#: Homes in a slice of an anchor (at least; and a 60,000th of all rows), and pairs compared at once.
SLICE_ROWS, BLOCK_PAIRS = 20_000, 1 << 22
#: Homes beyond which a slice is probed by the third code, and fingerprints that one task replicates.
PROBE_HOMES, SPREAD_ROWS = 1024, 20_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of what isn't a space or \\x09-\\x0D."""
    return text.encode().lower().split() if text else []  # bytes know only ASCII


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    votes, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(size))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """fp (the 64 bits as a signed long) of every row's text and all other columns; a null or empty
    text has 0."""
    at, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = pa.array([signed(simhash(t.as_py())) for t in part.column(at)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), fp], names=[*kept, "fp"])

    return map_batches(docs, run, ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept), "fp bigint"]))


class Cyclic:
    """A binary cyclic code that covers every word within its radius, as remainders modulo its generator."""

    def __init__(self, bits: int, radius: int, generator: int, reach: int):
        """reach: bits beyond the radius. patterns[e] has for each remainder the words of weight at
        most radius + reach with this remainder whose weight exceeds the radius by e (0: by none)."""
        self.checks = generator.bit_length() - 1
        self.generator = generator
        self.table = np.array([self._remainder(x) for x in range(1 << bits - self.checks)], np.int32)  # of the upper bits
        words = np.array([0], np.int64)
        weights = np.array([0], np.int64)
        for bit in range(bits):
            more = weights < radius + reach
            words, weights = np.concatenate([words, words[more] | 1 << bit]), np.concatenate([weights, weights[more] + 1])
        remainder = self.remainder(words)
        self.patterns = []
        for e in range(reach + 1):
            of = np.maximum(weights - radius, 0) == e
            by = np.lexsort((words[of], remainder[of]))
            starts = np.searchsorted(remainder[of][by], np.arange((1 << self.checks) + 1))
            self.patterns.append((words[of][by], starts))

    def _remainder(self, upper: int) -> int:
        x = upper << self.checks
        while x >> self.checks:
            x ^= self.generator << x.bit_length() - self.checks - 1
        return x

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return self.table[words >> self.checks] ^ (words & (1 << self.checks) - 1).astype(np.int32)

    def near(self, words: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Codewords whose distance exceeds the radius by e (0: none): the index of the word, the codeword."""
        patterns, starts = self.patterns[e]
        r = self.remainder(words)
        counts = starts[r + 1] - starts[r]
        index = np.repeat(np.arange(len(words)), counts)
        within = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
        return index, words[index] ^ patterns[starts[r][index] + within]


#: Bits, covering radius and generator polynomial of the Golay and the Hamming code.
GOLAY, HAMMING = (23, 3, 0b101011100011), (15, 1, 0b10011)
_CODES: dict[tuple, Cyclic] = {}


def code_of(kind: tuple[int, int, int], reach: int) -> Cyclic:
    """The code, made once in each worker."""
    if (kind, reach) not in _CODES:
        _CODES[kind, reach] = Cyclic(*kind, reach)
    return _CODES[kind, reach]


def golay_parts(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits 0-22 and 23-45."""
    return fps & (1 << 23) - 1, fps >> 23 & (1 << 23) - 1


def home_of(fps: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each fingerprint."""
    code = code_of(GOLAY, 0)
    low, high = (code.near(x, 0)[1] for x in golay_parts(fps))
    return low | high << 23


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (index of fingerprint, anchor, is home): the anchors whose distance exceeds the covering
    radius by threshold at most. The home is the anchor within the radius itself."""
    code = code_of(GOLAY, threshold)
    low, high = golay_parts(fps)
    of, at, home = [], [], []
    for e1 in range(threshold + 1):
        i, a = code.near(low, e1)
        for e2 in range(threshold + 1 - e1):
            j, b = code.near(high[i], e2)
            of.append(i[j])
            at.append(a[j] | b << 23)
            home.append(np.full(len(j), e1 == e2 == 0))
    return np.concatenate(of), np.concatenate(at), np.concatenate(home)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those that join two trees: they connect what all pairs connect."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    above: dict[int, int] = {}
    kept = []
    for k, (x, y) in enumerate(pairs.tolist()):
        while (p := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(p, p)
        while (p := above.setdefault(y, y)) != y:
            above[y] = y = above.setdefault(p, p)
        if x != y:
            above[max(x, y)] = min(x, y)
            kept.append(k)
    return pairs[kept, 0], pairs[kept, 1]


def compare(homes: np.ndarray, lo: np.ndarray, hi: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between each home and the rows fp[lo:hi] of its anchor, thinned to forests."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    total = np.cumsum(hi - lo)
    at = 0
    while at < len(homes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + BLOCK_PAIRS, "right")))
        counts = (hi - lo)[at:to]
        x = np.repeat(homes[at:to], counts)
        row = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts - lo[at:to], counts)
        y = fp[row]
        linked = (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= threshold) & (x != y)
        if linked.any():
            out.append(forest(x[linked], y[linked]))
        at = to
    return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1)) if out else (fp[:0], fp[:0])


def third_part(fps: np.ndarray) -> np.ndarray:
    """Bits 46-60."""
    return fps >> 46 & (1 << 15) - 1


def probe(homes: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """As compare for many homes of one anchor and all of fp: a row meets only the homes whose codeword
    of the third code is within the radius plus threshold of it."""
    code = code_of(HAMMING, threshold)
    word = code.near(third_part(homes), 0)[1]
    by = np.argsort(word, kind="stable")
    homes, word = homes[by], word[by]
    out, step = [], max(1, BLOCK_PAIRS // len(homes))
    for at in range(0, len(fp), step):
        rows = fp[at : at + step]
        near = [code.near(third_part(rows), e) for e in range(threshold + 1)]
        of, words = (np.concatenate([n[k] for n in near]) for k in (0, 1))
        lo, hi = np.searchsorted(word, words, "left"), np.searchsorted(word, words, "right")
        out.append(compare(rows[of], lo, hi, homes, threshold))
    return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1)) if out else (fp[:0], fp[:0])


def links(fps: DataFrame, threshold: int = THRESHOLD, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Links a, b that connect the same fingerprints as all pairs at threshold or fewer bits do.

    fps: distinct fingerprints, one column fp. A key is anchor, slice and whether the row is a
    replica, in 46, 16 and 1 bits, so a slice's homes are read first and its replicas stream by.
    """
    sc = fps.sparkSession.sparkContext
    total = fps.count()
    slice_rows = max(slice_rows, total // 60_000)
    fps = fps.repartition(max(sc.defaultParallelism, total // SPREAD_ROWS), "fp")  # a row becomes about 61

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(home_of(batch.column(0).to_numpy()))], names=["anchor"])

    # Fewer than 60,000 anchors can have more than a 60,000th of the rows at home.
    large = map_batches(fps, homes, "anchor bigint").groupBy("anchor").count().where(F.col("count") > slice_rows).collect()
    split = sc.broadcast({r["anchor"]: -(-r["count"] // slice_rows) for r in large})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = part.column(0).to_numpy()
                of, at, home = anchors(fp, threshold)
                fp = fp[of]
                key = at << 17 | ~home
                if split.value:
                    key, fp = dealt(key, at, fp, home, split.value)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["key", "fp"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, homes = -1, np.zeros(0, np.int64)  # of the slice that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            g, is_home = key >> 1, (key & 1) == 0
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            ends = np.append(starts[1:], len(g))
            if g[0] != group:
                homes = homes[:0]
            at = np.flatnonzero(is_home)
            own = np.searchsorted(starts, at, "right") - 1
            x = np.concatenate([homes, fp[at]])
            lo = np.concatenate([np.zeros(len(homes), np.int64), starts[own]])
            hi = np.concatenate([np.full(len(homes), ends[0]), ends[own]])
            # Homes of one slice stand together: x is in the order of their slices.
            first = np.flatnonzero(np.concatenate([[True], lo[1:] != lo[:-1]])) if len(x) else lo[:0]
            counts = np.diff(np.append(first, len(x)))
            many = np.repeat(counts > PROBE_HOMES, counts)
            found = [compare(x[~many], lo[~many], hi[~many], fp, threshold)]
            found += [probe(x[f : f + c], fp[lo[f] : hi[f]], threshold) for f, c in zip(first.tolist(), counts.tolist()) if c > PROBE_HOMES]
            a, b = (np.concatenate([y[k] for y in found]) for k in (0, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            homes = x[(hi == len(g)) & (hi > 0)] if len(starts) == 1 else fp[at[at >= starts[-1]]]
            group = g[-1]

    keyed = map_batches(fps, spread, "key bigint, fp bigint").repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return map_batches(keyed, match, "a bigint, b bigint")


def dealt(key: np.ndarray, at: np.ndarray, fp: np.ndarray, home: np.ndarray, split: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows where split anchors' homes are in one slice and their replicas, and homes as
    replicas, in the others."""
    of = np.fromiter(map(split.get, at.tolist(), repeat(1)), np.int64, len(at))
    own = (fp.view(np.uint64) % np.maximum(of, 1).astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(len(at)), of)
    part = np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of)
    replica = ~(home[row] & (part == own[row]))
    return at[row] << 17 | part << 1 | replica, fp[row]


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an edge (columns a, b).

    Large-star and small-star steps: each turns the edges so that nodes hang from smaller ones,
    until nothing changes; a chain of n nodes takes about log n rounds. A round's edges are a stored
    table. No star gathers its neighbours: the steps are minima by node and joins.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")
    state = None if edges.head(1) else (0, None)
    while True:
        # Large star: larger neighbours of u hang from the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: smaller neighbours of u and u itself hang from the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u != v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: A fingerprint of over this share of all rows is hot; there are fewer than 1000 of them.
HOT_SHARE = 0.001


def grouped(prints: DataFrame, best: Column, threshold: int = THRESHOLD) -> DataFrame:
    """prints with best: the least value of best in the row's component. prints: a stored table with fp."""
    by_fp = stored(prints.groupBy("fp").agg(F.min(best).alias("first"), F.count("*").alias("n")), "by_fp")
    roots = components(links(by_fp.select("fp"), threshold))
    roots = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    roots = stored(roots, "roots")
    firsts = roots.groupBy("root").agg(F.min("first").alias("best"))
    of_fp = stored(roots.join(firsts, "root").select("fp", "best", "n"), "of_fp")
    # The many rows of a hot fingerprint get their component from a broadcast of fewer than 1000 rows.
    hot = of_fp.where(F.col("n") > HOT_SHARE * prints.count()).select("fp", "best")
    marked = prints.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "fp", "left")
    cold = marked.where("hot is null").drop("hot", "best").join(of_fp.select("fp", "best"), "fp")
    names = [*prints.columns, "best"]
    return marked.where("hot").select(names).unionByName(cold.select(names))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Null and empty texts have the fingerprint 0 and are linked like others; texts of any length are
    taken whole. Repeated rows and ids stay repeated. Null ids aren't anyone's component_id, which is
    null if a group has no other. An empty table gives an empty table; other columns are ignored.
    """
    prints = stored(fingerprints(narrowed(docs, "doc_id", "text")), "prints")
    return grouped(prints, F.col("doc_id"), threshold).select("doc_id", "fp", F.col("best").alias("component_id"))


#: Keys of rows that go, up to which they are broadcast (about 100 bytes each); more are shuffled.
BROADCAST_KEYS = 400_000


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits of a row: equal for rows that are equal in all columns."""
    plain = [F.col(f"`{c}`") for c in docs.columns]
    every = F.struct(*plain) if "map<" in docs.schema.simpleString() else None
    values = [F.to_json(every)] if every is not None else plain
    return [F.xxhash64(*values).alias("_key_a"), F.xxhash64(F.lit(1), *values).alias("_key_b")]


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each group of near duplicates.

    The one with the smallest doc_id stays, null ids come last; of several texts with that doc_id the
    one whose row has the smallest digest, whichever it is, and of rows that are equal in all columns
    one. A row goes only if another one of its own group stays, whatever ids the rows share. Null and
    empty texts are one group; an empty table stays empty; all columns stay.

    Decisions are made on digests; the texts aren't shuffled unless over ``BROADCAST_KEYS`` rows go.
    """
    keyed = docs.select("*", *row_keys(docs))
    prints = stored(fingerprints(keyed.select("doc_id", "text", "_key_a", "_key_b")), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key_a", "_key_b")
    rows = grouped(prints, order)
    stays = (F.col("_key_a") == F.col("best._key_a")) & (F.col("_key_b") == F.col("best._key_b"))
    keys = rows.groupBy("_key_a", "_key_b").agg(F.bool_and(stays).alias("stays"), F.count("*").alias("n"))
    fates = stored(keys.where("not stays or n > 1").select("_key_a", "_key_b", "stays"), "fates")
    known = {r["stays"]: r["count"] for r in fates.groupBy("stays").count().collect()}
    fates = F.broadcast(fates) if sum(known.values()) <= BROADCAST_KEYS else fates
    found = keyed.join(fates, ["_key_a", "_key_b"], "left")
    kept = found.where("stays is null")
    if known.get(True):  # rows that are equal in all columns
        kept = kept.unionByName(first_in_task(found.where("stays")).dropDuplicates(["_key_a", "_key_b"]))
    return kept.select([kept[f"`{c}`"] for c in docs.columns])


def first_in_task(rows: DataFrame) -> DataFrame:
    """rows with one of each key in a task (at least), so that what follows shuffles few texts."""
    a, b = rows.columns.index("_key_a"), rows.columns.index("_key_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            new = []
            for key in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist()):
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))
            if len(seen) > BROADCAST_KEYS:
                seen.clear()

    return map_batches(rows, run, rows.schema)


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
