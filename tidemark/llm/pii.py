"""Personal data: exact patterns for four kinds, and contexts bootstrapped from what they find.

**Seeds.** ``base_spans`` finds emails, IP addresses, card and phone numbers by their form. A fifth
kind, secrets (keys, tokens), has no base spans: long hexadecimal strings are its seeds, which count
only where their context says so.

**Bootstrapping.** A text is a stream of words, ``=``, ``:`` and identifiers. A lexical pattern is two
words around an identifier's place: both before it (``phone number _``, ``token = _``), both after it, or
one on each side. Instances are the seeds' values and candidates: looser forms (a phone number
without ``+``, a card number that fails its check digit, an IPv6 address, an address without a
dot, a string of letters and digits) whose kind only their context can tell. Patterns and instances
make a bipartite graph, deduplicated, so copies of a document add no weight. In each round Spark
scores, for each kind, a pattern by the sum of its instances' scores over their number plus one, and
an instance by its best pattern of ``CONFIDENCE`` or more; seeds keep 1. The rounds end when no score
changes any more. The plus one asks for ``LEAST`` instances at least, so patterns with fewer leave
before the first round. Of the patterns that end at ``CONFIDENCE`` or more, those count whose words
announce an identifier: in at least that share of all places where they stand in the corpus, one
is there. Common words that happen to stand beside identifiers fail there. What passes marks the
candidates in it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, map_batches, narrowed, slices, stored

KINDS = ("email", "ip", "card", "phone", "secret")
CONFIDENCE = 0.8
#: Instances that a pattern needs: with fewer the score can't reach CONFIDENCE.
LEAST = math.ceil(CONFIDENCE / (1 - CONFIDENCE) - 1e-9)
#: A round that changes no score by more than this is the last.
STILL = 1e-6
#: Patterns that one pass over the texts applies; more patterns take more passes.
PASS_PATTERNS = 100_000

IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Candidates: runs that may hold a number, IPv6 addresses, at signs and their words, strings of letters and digits.
RUN = re.compile(r"[0-9(][0-9 ().-]*+")
RUN_START = re.compile(r"(?<![0-9+])[0-9(]")
IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
AT = re.compile(r"@| ?[\[(]at[\])] ?")
AT_END = re.compile(r"[^\s@]++")
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+")
HEX = re.compile(r"[0-9A-Fa-f]{32,}")
TOKEN = re.compile(r"[^\W\d_]+|[=:]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost matches of local part, @, domain: all goes by the at signs, so a long run of
    letters without one costs nothing."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kinds in the order of KINDS, each from left to right."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Runs from a digit or bracket (not behind a digit or +) to their last digit, 7 characters at least."""
    for m in RUN.finditer(text):
        end = m.start() + len(m[0].rstrip(" ().-"))
        if end - m.start() >= 7 and (first := RUN_START.search(text, m.start(), end)) and end - first.start() >= 7:
            yield first.start(), end


def at_words(text: str) -> Iterator[tuple[int, int]]:
    """An at sign, written as it is or as (at), with all that stands beside it without white space."""
    after = 0
    for m in AT.finditer(text):
        start = m.start()
        if start < after:
            continue
        while start > after and not text[start - 1].isspace() and text[start - 1] != "@":
            start -= 1
        end = AT_END.match(text, m.end()) if start < m.start() else None
        stop = m.end() + len(end[0].rstrip(".,;:!?\"')]")) if end else 0
        if stop >= m.end() + 2:
            yield start, stop
            after = stop


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[tuple[str, ...], int, int]]:
    """(possible kinds, start, end) of looser forms that overlap no base span nor each other."""
    found = []
    for a, b in numbers(text):
        n = sum(map(str.isdigit, text[a:b]))
        if kinds := tuple(k for k, least, most in (("card", 12, 19), ("phone", 7, 15)) if least <= n <= most):
            found.append((kinds, a, b))
    if ":" in text:
        found += [(("ip",), *m.span()) for m in IPV6.finditer(text)]
    if "@" in text or "at]" in text or "at)" in text:
        found += [(("email",), *span) for span in at_words(text)]
    for m in KEY.finditer(text):
        if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])):
            found.append((("secret",), *m.span()))
    taken = merged([(a, b) for _, a, b in base])
    out, after, at = [], 0, 0
    for kinds, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= after and (at == len(taken) or b <= taken[at][0]):
            out.append((kinds, a, b))
            after = b
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order: those that overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def stream(text: str, groups: list[tuple[int, int]]) -> tuple[list[str | None], list[int]]:
    """The text's words, = and : in lower case, with None for each identifier (groups, disjoint and in
    order), whose own words don't count; and where the Nones are."""
    if not groups:
        return TOKEN.findall(text.lower()), []
    out: list[str | None] = []
    places, g = [], 0
    for m in TOKEN.finditer(text):
        while g < len(groups) and groups[g][0] < m.end():
            places.append(len(out))
            out.append(None)
            g += 1
        if not g or m.start() >= groups[g - 1][1]:
            out.append(m[0].lower())
    for _ in range(g, len(groups)):
        places.append(len(out))
        out.append(None)
    return out, places


def patterns_at(items: list[str | None], at: int) -> list[str]:
    """The patterns around the identifier at a place of the stream; none goes over another identifier."""
    before, after = items[max(0, at - 2) : at], items[at + 1 : at + 3]
    out = [f"{before[0]} {before[1]} _"] if len(before) == 2 and None not in before else []
    if len(after) == 2 and None not in after:
        out.append(f"_ {after[0]} {after[1]}")
    if before and after and before[-1] is not None and after[0] is not None:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def marks(text: str) -> list[tuple[tuple[str, ...], int, int, bool, list[str]]]:
    """(possible kinds, start, end, is base, patterns) of all base spans, then of all candidates."""
    base = base_spans(text)
    loose = candidates(text, base)
    every = [((k,), a, b, True) for k, a, b in base] + [(*c, False) for c in loose]
    if not every:
        return []
    groups = merged([(a, b) for _, a, b, _ in every])
    items, places = stream(text, groups)
    starts = [a for a, _ in groups]
    return [(*x, patterns_at(items, places[bisect_right(starts, x[1]) - 1])) for x in every]


def mentions(docs: DataFrame) -> DataFrame:
    """pattern, value, kind, seed and n of everything that has a context; value is the MD5 of the
    identifier without blanks, so no personal data is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: Counter = Counter()
                for text in part.column(0):
                    text = text.as_py() or ""
                    for kinds, a, b, base, patterns in marks(text):
                        seed = base or kinds == ("secret",) and HEX.fullmatch(text, a, b) is not None
                        value = hashlib.md5("".join(text[a:b].split()).lower().encode()).hexdigest()
                        rows.update((pattern, value, k, seed) for k in kinds for pattern in patterns)
                cols = [*(list(zip(*rows)) or [[]] * 4), rows.values()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["pattern", "value", "kind", "seed", "n"])

    return map_batches(docs.select("text"), run, "pattern string, value string, kind string, seed boolean, n bigint")


def places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and places: how often a pattern's words stand so in the texts, whatever is at the place
    between or beside them."""
    total = docs.sparkSession.createDataFrame([], "pattern string, places bigint")
    for known in pattern_groups(patterns):
        if known:
            total = total.unionByName(_places(docs, docs.sparkSession.sparkContext.broadcast(sorted({p for _, p in known}))))
    return total.groupBy("pattern").agg(F.max("places").alias("places"))  # two kinds' groups count the same places


def _places(docs: DataFrame, known) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside: dict[tuple, list[str]] = {}  # words side by side: patterns before and after
        across = {}  # words with one thing between
        for p in known.value:
            words = tuple(w for w in p.split(" ") if w != "_")
            if p.split(" ")[1] == "_":
                across[words] = p
            else:
                beside.setdefault(words, []).append(p)
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    items, _ = stream(text, merged([x[-2:] for x in base + candidates(text, base)]))
                    if beside:
                        counts.update(p for pair in zip(items, items[1:]) if pair in beside for p in beside[pair])
                    if across:
                        counts.update(across[pair] for pair in zip(items, items[2:]) if pair in across)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["pattern", "places"])

    return map_batches(docs.select("text"), run, "pattern string, places bigint").groupBy("pattern").agg(F.sum("places").alias("places"))


def learn_patterns(docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """kind, pattern and score of the patterns with enough confidence."""
    texts = narrowed(docs, "text")
    edges = stored(mentions(texts).groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")), "mentions")
    good = stored(scored_patterns(edges, confidence), "patterns")
    followed = edges.groupBy("kind", "pattern").agg(F.sum("n").alias("followed"))
    sure = good.join(followed, ["kind", "pattern"]).join(places(texts, good), "pattern")
    return sure.where(F.col("followed") >= confidence * F.col("places")).select("kind", "pattern", "score")


def scored_patterns(edges: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """kind, pattern and score of the patterns that reach confidence. edges: kind, pattern, value, seed.

    A value that is a seed anywhere is one with every pattern.
    """
    many = edges.groupBy("kind", "pattern").agg(F.count("*").alias("m")).where(F.col("m") >= math.ceil(confidence / (1 - confidence) - 1e-9)).select("kind", "pattern")
    seeds = edges.where("seed").select("kind", "value").distinct().withColumn("is_seed", F.lit(True))
    seen = edges.join(many, ["kind", "pattern"], "left_semi").join(seeds, ["kind", "value"], "left")
    seen = stored(seen.select("kind", "pattern", "value", F.coalesce("is_seed", F.lit(False)).alias("seed")), "seen")
    scored, before = seen.withColumn("score", F.col("seed").cast("double")), None
    while True:
        patterns = stored(scored.groupBy("kind", "pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("p")), "scores")
        good = patterns.where(F.col("p") >= confidence)
        if before is not None:
            moved = good.join(before.withColumnRenamed("p", "q"), ["kind", "pattern"], "left").agg(F.max(F.col("p") - F.when(F.col("q") >= confidence, F.col("q")).otherwise(0.0))).first()[0]
            if moved is None or moved <= STILL:
                return good.select("kind", "pattern", F.col("p").alias("score"))
        best = seen.where("not seed").join(good, ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("p").alias("s"))
        scored = seen.join(best, ["kind", "value"], "left").select("kind", "pattern", "value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("s", F.lit(0.0))).alias("score"))
        before = patterns


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_spans(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """docs with base and spans, arrays of (kind, start, end), kinds in the order of KINDS, then by
    start; spans are the base spans and what patterns (default: learnt from docs) discover.

    Null and empty texts have none; texts of any length are searched whole, in time that grows with
    their length. Repeated rows and null ids stay as they are, an empty table stays empty; columns named
    base or spans are replaced.
    """
    return _marked(docs.drop("base", "spans"), patterns, ["base", "spans"], rewrite=False)


def _marked(docs: DataFrame, patterns: DataFrame | None, names: list[str], rewrite: bool) -> DataFrame:
    """docs with base and all spans in new columns called names. One pass over the texts for each group
    of patterns; with rewrite the last one also replaces the spans in the text."""
    patterns = learn_patterns(docs) if patterns is None else patterns
    found = docs.select("*", *[F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)").alias(c) for c in names])
    groups, first = pattern_groups(patterns), True
    known = next(groups)
    while known is not None:
        following = next(groups, None)
        found = _one_pass(found, docs.sparkSession.sparkContext.broadcast(known), names, first, rewrite and following is None)
        if following is not None:
            found = stored(found, "spans")
        known, first = following, False
    return found


def pattern_groups(patterns: DataFrame) -> Iterator[frozenset]:
    """The patterns (of two words alone: those before the place) in groups of bounded size; at least one."""
    group: list = []
    for row in patterns.select("kind", "pattern").toLocalIterator():
        if len(group) == PASS_PATTERNS:
            yield frozenset(group)
            group = []
        group.append((row["kind"], row["pattern"] if "_" in row["pattern"] else f"{row['pattern']} _"))
    yield frozenset(group)


def _one_pass(found: DataFrame, known, names: list[str], first: bool, rewrite: bool) -> DataFrame:
    at = {c: i for i, c in enumerate(found.columns)}
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bases, spans, texts = [], [], []
                for text, old in zip(part.column(at["text"]), part.column(at[names[1]])):
                    whole = text.as_py()
                    text = whole or ""
                    all_marks = marks(text) if known.value else [((k,), a, b, True, []) for k, a, b in base_spans(text)]
                    base = [(kinds[0], a, b) for kinds, a, b, is_base, _ in all_marks if is_base]
                    every = list(base) if first else [(x["kind"], x["start"], x["end"]) for x in old.as_py()]
                    marked = {(a, b) for _, a, b in every}  # by an earlier pass: candidates don't overlap each other
                    for kinds, a, b, is_base, around in all_marks:
                        if not is_base and (a, b) not in marked and (kind := next((k for k in kinds if any((k, p) in known.value for p in around)), None)):
                            every.append((kind, a, b))
                    bases.append(as_rows(base))
                    spans.append(as_rows(sorted(every, key=lambda x: (order[x[0]], x[1]))))
                    if rewrite:
                        texts.append(None if whole is None else replaced(text, every))
                new = {names[0]: pa.array(bases, SPANS), names[1]: pa.array(spans, SPANS)} | ({"text": pa.array(texts, pa.string())} if rewrite else {})
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(i)) for c, i in at.items()], names=list(at))

    return map_batches(found, run, found.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span as its kind in brackets; of spans that overlap the first, longest one
    gives the kind and all are gone."""
    out, end = [], 0
    for kind, start, stop in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join(out) + text[end:]


def as_rows(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def redact(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets, like [EMAIL], and n_chars
    (if there) counted anew. All other columns stay, whatever their names.

    Null texts stay null and empty ones empty; texts of any length are rewritten whole; repeated rows
    and null ids stay as they are; an empty table stays empty.
    """
    names = free_names(docs, "_base", "_spans")
    clean = _marked(docs, patterns, names, rewrite=True)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.drop(*names)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans and all spans of every document."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
