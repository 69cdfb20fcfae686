"""Document fingerprints: 128-bit SimHash and permuted block tables, as DataFrame expressions.

**Fingerprint.** Terms are runs of three words (shorter texts: all their words); a term's weight is
how often it occurs. Each occurrence adds +1 or -1 to each of 128 counters, as the bits of two
64-bit hashes say; a bit is 1 where the sum is positive. The counters are 64 long sums: each holds
two bits' counts of ones in its halves, so one aggregation without arrays or Python makes them
all, and the sign follows from the ones and the number of terms. A count overflows at 2^31 terms.

**Search.** ``within`` cuts a fingerprint into radius + 1 blocks. In table k block k comes first and
is the key; two fingerprints with at most radius differing bits agree in at least one block, so
equi-joins on (k, block k) find all pairs. A bit count confirms them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrowed, stored

TERM_WORDS = 3
BITS = 128
RADIUS = 3
HALVES = 0x0000000100000001
#: Equal rows that one row stands for at most.
LOT_ROWS = 10_000
#: Documents in one range of ids, and ranges at most.
RANGE_ROWS, RANGES = 1000, 20_000


def term_hashes(words: Column, at: Column, size: int = TERM_WORDS) -> tuple[Column, Column]:
    """Two hashes of the term that begins at a word's position."""
    parts = [F.get(words, at + i) for i in range(size)]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def words_of(text: Column) -> Column:
    """The words of a text: lower-cased runs without white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def fingerprints(texts: DataFrame, keys: list[str], text: str, size: int = TERM_WORDS) -> DataFrame:
    """keys with hi and lo, the fingerprint's halves as signed longs, and rows.

    keys must tell different texts apart; rows that repeat keys and text become one (majorities
    don't change), and rows is their number. Texts without words, null and empty ones have the fingerprint 0.
    """
    words = texts.select(*keys, words_of(F.col(text)).alias("_words"))
    terms = words.select(*keys, "_words", F.posexplode_outer("_words").alias("_at", "_word"))
    terms = terms.where(F.col("_at").isNull() | (F.col("_at") <= F.greatest(F.size("_words") - size, F.lit(0))))
    a, b = term_hashes(F.col("_words"), F.col("_at"), size)
    first = F.when(F.coalesce("_at", F.lit(0)) == 0, 1)
    terms = terms.select(*keys, F.when(F.col("_word").isNotNull(), a).alias("_a"), b.alias("_b"), first.alias("_first"))
    ones = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(HALVES))).alias(f"{h}{i}") for h in ("_a", "_b") for i in range(32)]
    sums = terms.groupBy(*keys).agg(F.count("_a").alias("_n"), F.count("_first").alias("rows"), *ones)

    def half(h: str) -> Column:
        bits = []
        for i in range(32):
            for shift, ones in ((i, F.col(f"{h}{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"{h}{i}", 32))):
                bits.append(F.when(ones * 2 > F.col("_n"), F.lit(1 << shift if shift < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        while len(bits) > 1:  # a balanced tree: the expression stays shallow
            bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2])]
        return F.when(F.col("_n") > 0, bits[0]).otherwise(F.lit(0).cast("long"))

    return sums.select(*keys, "rows", half("_a").alias("hi"), half("_b").alias("lo"))


def distance(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    """Differing bits."""
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def likeness(bits: Column) -> Column:
    """The cosine that a share of differing bits stands for, 0 if it is negative."""
    return F.greatest(F.lit(0.0), F.cos(bits * (math.pi / BITS)))


def as_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def blocks(hi: Column, lo: Column, radius: int = RADIUS) -> list[Column]:
    """The keys of the permuted tables: radius + 1 blocks of neighbouring bits."""
    out, bounds = [], [BITS * k // (radius + 1) for k in range(radius + 2)]
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 64:
            raise ValueError("the radius has to be 1 at least")
        parts = []
        for word, base in ((lo, 0), (hi, 64)):
            x, y = max(a, base), min(b, base + 64)
            if x < y:
                parts.append(F.shiftrightunsigned(word, x - base).bitwiseAND(F.lit((1 << y - x) - 1 if y - x < 64 else -1)))
        out.append(parts[0] if len(parts) == 1 else F.xxhash64(*parts))
    return out


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (hi, lo of a query; hi2, lo2) with at most radius differing bits, equal ones too.

    Both sides: columns hi and lo; repeats count once.
    """
    def tables(df: DataFrame) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(k).alias("k"), b.alias("block")) for k, b in enumerate(blocks(F.col("hi"), F.col("lo"), radius))])
        return df.select("hi", "lo").distinct().select("hi", "lo", F.explode(keys).alias("t")).select("hi", "lo", "t.k", "t.block")

    right = tables(prints).select("k", "block", F.col("hi").alias("hi2"), F.col("lo").alias("lo2"))
    pairs = tables(queries).join(right, ["k", "block"])
    return pairs.where(distance(F.col("hi"), F.col("lo"), F.col("hi2"), F.col("lo2")) <= radius).select("hi", "lo", "hi2", "lo2").distinct()


def next_ids(docs: DataFrame) -> DataFrame:
    """doc_id, need and next_id: each distinct id, a quarter of the code points of its longest text
    and the next larger id; after the largest comes the smallest.

    Ids are dealt to ranges and ordered within each; the stored table fixes who is in which range.
    Only the ranges' smallest ids, at most RANGES rows, are ordered in one place.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("int").alias("need"))
    ranges = max(1, min(RANGES, docs.count() // RANGE_ROWS))
    ids = stored(ids.repartitionByRange(ranges, "doc_id").withColumn("range", F.spark_partition_id()), "ids")
    ids = ids.withColumn("follower", F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    firsts = ids.groupBy("range").agg(F.min("doc_id").alias("least"))
    order = Window.orderBy("range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("range", F.coalesce(F.lead("least").over(order), F.first("least").over(whole)).alias("least"))
    return ids.join(F.broadcast(firsts), "range").select("doc_id", "need", F.coalesce("follower", "least").alias("next_id"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, key, text, n_chars, edited, next_id and next_key of every row.

    key tells the texts of a repeated doc_id apart. edited: the last floor(n_chars / 4) code points
    replaced by the first as many, or all, of the next document's text. Where rows share the next
    id, the smallest of their texts counts. Null texts are empty. A row whose id is null has no next
    document, so nothing comes in its last quarter's place.
    """
    docs = narrowed(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = next_ids(docs)
    # Both joins want the texts by id, with the same filter and columns: Spark shuffles them once.
    known = docs.where("doc_id is not null")
    piece = F.struct(F.expr("left(text, need)").alias("piece"), F.xxhash64("text").alias("next_key"))
    order = order.withColumnRenamed("doc_id", "asker")
    donors = order.join(known, order["next_id"] == known["doc_id"])
    donors = donors.groupBy("asker", "next_id").agg(F.min(piece).alias("d")).select("asker", "next_id", "d.piece", "d.next_key")
    both = known.join(donors, known["doc_id"] == donors["asker"], "left").drop("asker")
    both = both.unionByName(docs.where("doc_id is null"), allowMissingColumns=True)
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.coalesce(F.substring(F.col("piece"), F.lit(1), quarter), F.lit("")))
    return both.select("doc_id", F.xxhash64("text").alias("key"), "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "next_id", "next_key")


def fingerprint_documents(docs: DataFrame, query_step: int = 100, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: n_chars, edited_sha256, the fingerprints of the text and of the
    edited text, near_edited and near_next, and n_near: for ids divisible by query_step, the number
    of other rows whose fingerprint is within radius (null for other ids).

    Null and empty texts have the fingerprint 0; texts of any length are taken whole. Equal rows have
    equal results and stay as many. A null id has no
    next document: its near_next is 0. An empty table gives an empty table; columns but doc_id
    and text are ignored.
    """
    pairs = with_edits(docs).select("doc_id", "key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_id", "next_key", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"))
    keys = ["doc_id", "key", "n_chars", "edited_sha256", "next_id", "next_key"]
    prints = fingerprints(pairs.select(*keys, "v.kind", "v.text"), [*keys, "kind"], "text")
    prints = prints.groupBy(*keys).agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("kind") == k, F.col(h))).alias(f"{h}{k}") for k in (0, 1) for h in ("hi", "lo")])
    prints = stored(prints, "prints")
    nexts = prints.where("doc_id is not null").select(F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), F.col("hi0").alias("hin"), F.col("lo0").alias("lon"))
    near = near_counts(prints.select("doc_id", "rows", F.col("hi0").alias("hi"), F.col("lo0").alias("lo")), query_step, radius)
    # Only the queries' rows meet the counts by fingerprint; all rows meet them by id, so a
    # fingerprint that very many documents have gathers nowhere.
    asked = prints.where(F.col("doc_id") % query_step == 0).select("doc_id", "key", F.col("hi0").alias("hi"), F.col("lo0").alias("lo"))
    near = asked.join(near, ["hi", "lo"]).select("doc_id", "key", "near")
    found = prints.join(nexts, ["next_id", "next_key"], "left").join(near, ["doc_id", "key"], "left")
    # Rows that repeat come back in lots; large ones are dealt to tasks first.
    lot = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / LOT_ROWS)))
    found = found.select("*", lot.alias("lot"))
    if (prints.agg(F.max("rows")).first()[0] or 0) > LOT_ROWS:
        found = found.repartition("doc_id", "key", "lot")
    copies = F.least(F.col("rows") - F.col("lot") * LOT_ROWS, F.lit(LOT_ROWS))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("hi0"), F.col("lo0")).alias("fingerprint"),
        as_hex(F.col("hi1"), F.col("lo1")).alias("edited_fingerprint"),
        likeness(distance(F.col("hi0"), F.col("lo0"), F.col("hi1"), F.col("lo1"))).alias("near_edited"),
        likeness(distance(F.col("hi0"), F.col("lo0"), F.col("hin"), F.col("lon"))).alias("near_next"),
        (F.col("near") - 1).alias("n_near"),
        F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"),
    ).drop("copy")


def near_counts(prints: DataFrame, query_step: int, radius: int) -> DataFrame:
    """hi, lo and near of the queries' fingerprints: the rows within radius, the query's own too."""
    asked = F.max(F.coalesce(F.col("doc_id") % query_step == 0, F.lit(False))).alias("asked")
    every = prints.groupBy("hi", "lo").agg(F.sum("rows").alias("rows"), asked)
    pairs = within(every.where("asked"), every, radius)
    return pairs.join(every.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "rows"), ["hi2", "lo2"]).groupBy("hi", "lo").agg(F.sum("rows").alias("near"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
