"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the benchmark items' windows of ten words (shorter items: the whole item), one
search for each window length m. A block is the last one or two words under the window. The
shift table says for each block that occurs in a pattern how far the window may move at least;
for others it moves past the block. Where the shift is 0, the block is the suffix of patterns,
its bucket (keyed by the pattern's first word too) has the candidates, and a direct comparison
confirms them.

The patterns are read from the benchmark in groups of bounded size; an item of any length is cut
into overlapping pieces. One group is one pass over the documents. Further groups are one pass
each that hands back the digests of texts with hits, and the hits; these are put together and
joined to the documents at the end, so texts are never written between groups, and no broadcast
grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, map_batches, narrowed, slices, stored

WINDOW = 10
#: Windows in one group of patterns (about 1 kB each in a worker).
GROUP_WINDOWS = 100_000

#: Lower-cases A-Z and turns what is no word byte into a space. Words are 0-9, a-z and all beyond
#: ASCII, so bytes of UTF-8 can be looked at one by one.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class WuManber:
    """Searches word lists for patterns of m words each. patterns: word tuple to what it stands for."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list]):
        self.m, self.size = m, min(2, m)
        self.far = m - self.size + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], list]]]] = {}
        for pattern, what in patterns.items():
            for end in range(self.size, m + 1):
                block = b" ".join(pattern[end - self.size : end])
                self.shift[block] = min(self.shift.get(block, self.far), m - end)
            self.buckets.setdefault(block, {}).setdefault(pattern[0], []).append((list(pattern), what))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """The start of each occurrence and what the pattern stands for."""
        m, n, shift, far, buckets = self.m, len(words), self.shift, self.far, self.buckets
        two = self.size == 2
        last = m - 1
        while last < n:
            block = words[last - 1] + b" " + words[last] if two else words[last]
            step = shift.get(block, far)
            if step:
                last += step
                continue
            start = last - m + 1
            for pattern, what in buckets[block].get(words[start], ()):
                if words[start : last + 1] == pattern:
                    yield start, what
            last += 1


def windows_of(items: list[tuple], size: int = WINDOW) -> dict[int, dict[tuple[bytes, ...], list]]:
    """By length: the windows of (item_id, text) rows, each with the ids of its items."""
    out: dict[int, dict[tuple[bytes, ...], list]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(size, len(words))
        for at in range(len(words) - m + 1 if m else 0):
            ids = out.setdefault(m, {}).setdefault(tuple(words[at : at + m]), [])
            if not ids or ids[-1] != item:
                ids.append(item)
    return out


def pattern_groups(benchmark: DataFrame, size: int, limit: int) -> Iterator[list[tuple]]:
    """The benchmark's rows, as (item_id, text), in groups of at most so many words (and size - 1 more).
    A longer text comes in pieces that overlap by size - 1 words, so each window is in one of them."""
    group, total = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        item = None if row["item_id"] is None else str(row["item_id"])
        for at in range(0, max(1, len(words) - size + 1) if words else 0, limit):
            piece = words[at : at + limit + size - 1]
            if group and total + len(piece) > limit:
                yield group
                group, total = [], 0
            group.append((item, b" ".join(piece).decode()))
            total += len(piece)
    yield group


RANGES = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
KINDS = {"n_words": "bigint", "hits": "array<struct<first:int,end:int>>", "items": "array<string>"}


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """doc_id with n_words, hits array<struct<first,end>> (disjoint word ranges inside any occurrence
    of a window, in order) and items array<string> (the items with occurring windows, distinct).

    Null and empty texts have no words; texts and items of any length are searched whole; a benchmark
    without words finds nothing; of items whose item_id is null the words are hits, but they aren't
    listed. Repeated documents give repeated rows, repeated items count once, other columns are
    ignored; an empty table of documents gives an empty one.
    """
    return _found(narrowed(docs, "doc_id", "text"), benchmark, size, group_windows, list(KINDS)).drop("text")


def _found(docs: DataFrame, benchmark: DataFrame, size: int, limit: int, names: list[str]) -> DataFrame:
    """docs with n_words, hits and items in columns called names, which docs hasn't."""
    groups = pattern_groups(benchmark, size, limit)
    first, second = next(groups), next(groups, None)
    if second is None:
        return _one_pass(docs, _searches(docs, first, size), names)
    keys = free_names(docs, "_text_a", "_text_b")
    digests = [F.xxhash64("text").alias(keys[0]), F.xxhash64(F.lit(1), "text").alias(keys[1])]
    texts, parts = docs.select("text", *digests), []
    for group in chain([first, second], groups):
        part = _one_pass(texts, _searches(docs, group, size), names).where(F.size(names[1]) > 0)
        parts.append(stored(part.groupBy(*keys).agg(F.first(names[1]).alias("h"), F.first(names[2]).alias("i")), "leaks"))
    whole = reduce(DataFrame.unionAll, parts).groupBy(*keys).agg(F.flatten(F.collect_list("h")).alias("h"), F.array_distinct(F.flatten(F.collect_list("i"))).alias("i"))
    whole = stored(whole, "leaks")  # one row for each text with hits
    counted = _one_pass(docs.select("*", *digests), _searches(docs, [], size), names).drop(*names[1:])
    found = counted.join(whole, keys, "left")
    return _merged_hits(found.select(*docs.columns, names[0], *[F.coalesce(c, F.expr(f"cast(array() as {KINDS[k]})")).alias(n) for c, k, n in (("h", "hits", names[1]), ("i", "items", names[2]))]), names[1])


def _searches(docs: DataFrame, group: list[tuple], size: int):
    return docs.sparkSession.sparkContext.broadcast([WuManber(m, p) for m, p in sorted(windows_of(group, size).items())])


def _one_pass(docs: DataFrame, searches, names: list[str]) -> DataFrame:
    at, every = docs.columns.index("text"), [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n_words, hits, items = [], [], []
                for text in part.column(at):
                    words, spans, ids = words_of(text.as_py()), [], set()
                    for search in searches.value:
                        for start, what in search.find(words):
                            spans.append((start, start + search.m))
                            ids.update(what)
                    ids.discard(None)
                    n_words.append(len(words))
                    hits.append([{"first": a, "end": b} for a, b in merged(spans)])
                    items.append(sorted(ids))
                new = (pa.array(n_words, pa.int64()), pa.array(hits, RANGES), pa.array(items, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=every)

    kinds = [T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, KINDS.values())]
    return map_batches(docs, run, T.StructType([*docs.schema.fields, *kinds]))


def _merged_hits(found: DataFrame, name: str) -> DataFrame:
    """found with the ranges of several groups made disjoint."""
    at = found.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[{"first": a, "end": b} for a, b in merged([(x["first"], x["end"]) for x in old])] for old in batch.column(at).to_pylist()]
            yield batch.set_column(at, name, pa.array(hits, RANGES))

    return map_batches(found, run, found.schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """The documents without any benchmark window, with the columns of docs, whatever their names.

    Null and empty texts have no words and stay; repeated rows stay or go together, null ids are like
    others; without benchmark words all stay; an empty table stays empty.
    """
    names = free_names(docs, "_words", "_hits", "_items")
    found = _found(docs, benchmark, WINDOW, group_windows, names)
    return found.where(F.size(names[1]) == 0).drop(*names)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items found of every document."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["first"]).cast("long"))
    found = find_leaks(docs, items).withColumn("n_hit", n_hit)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT k, i, m, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
o AS (SELECT k, i, g.m, item FROM g JOIN p ON g.m = p.m AND g.x = p.x),
h AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + m)) AS j FROM o) GROUP BY k),
s AS (SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT k, item FROM o) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items, sha256(coalesce(s.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN s USING (k)
"""
