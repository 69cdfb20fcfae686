"""Byte-level BPE, encoded and decoded with a contiguous rank array.

A word's parts (the token ids between its boundaries) and the rank of each pair of neighbouring
parts lie in two short lists. Encoding scans for the smallest rank (the leftmost of equals),
deletes the boundary between its two parts and refreshes the two neighbouring ranks, until no
pair has a rank. That is quadratic in a word's bytes, so words over ``SCAN_BYTES`` bytes take the
same merges from a heap. Words repeat, so each worker keeps the ids of the words it met, up to
``CACHE_WORDS``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, narrowed, slices

#: Letters and digits that Unicode has got since version 16, which is the tokenizers
#: library's; there they're neither.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    r"\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The split of byte-level BPE, with the contractions first. White space is Unicode's.
PATTERN = (
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{NEWER}]]+| ?[\p{{N}}--[{NEWER}]]+"
    rf"| ?(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{NEWER}])+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+"
)
#: The same for texts within Latin-1, whose letters, digits and white space are spelt out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
SCAN_BYTES = 96
CACHE_WORDS = 200_000
#: Longer words aren't kept.
CACHE_CHARS = 64
NO_RANK = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself if it is
    visible in Latin-1, else the next free one from U+0100 on."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Encoder and decoder of one vocabulary file (the JSON form, a BPE with a byte-level split)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        if known["model"]["type"] != "BPE" or known["pre_tokenizer"]["type"] != "ByteLevel" or known["pre_tokenizer"]["add_prefix_space"] or known["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        symbols = byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        added = {x["content"]: x["id"] for x in known["added_tokens"]}
        self.ids = {as_bytes(s): i for s, i in known["model"]["vocab"].items() if s not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in known["model"]["merges"]]
        merges = [tuple(as_bytes(part) for part in m) for m in merges]
        #: Rank of two token ids side by side (the first shifted), and by rank the id they become.
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.merged = [self.ids[a + b] for a, b in merges]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.added = added
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *added.values()]))
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.split, self.split_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        longest_first = sorted(added, key=lambda s: (-len(s), s))
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.cache: dict[str, bytes] = {}

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of a word's tokens."""
        ids = [self.byte_ids[b] for b in word]
        if len(word) > SCAN_BYTES:
            return self._by_heap(ids)
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], NO_RANK)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """The same merges for long words: smallest rank first, the leftmost of equals."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int]] = []

        def offer(i: int) -> None:
            if (j := after[i]) >= 0 and (rank := self.ranks.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i))

        for i in range(n):
            offer(i)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) < 0 or self.ranks.get(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two parts has changed since
            ids[i], ids[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def _packed(self, word: str) -> bytes:
        ids = self.word_ids(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers. Strings of added tokens in
        the text become their ids."""
        cache, out = self.cache, []
        try:
            text.encode("latin-1")
            split = self.split_latin
        except UnicodeEncodeError:
            split = self.split
        for piece in self.special.split(text) if self.special else [text]:
            if piece in self.added:
                out.append(struct.pack("<I", self.added[piece]))
                continue
            words = split(piece)
            try:
                out.append(b"".join(map(cache.__getitem__, words)))
            except KeyError:
                get = cache.get
                out.append(b"".join([p if (p := get(w)) is not None else self._packed(w) for w in words]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(self._ids(self.encode_packed(text)))

    @staticmethod
    def _ids(packed: bytes) -> array:
        ids = array("I")
        ids.frombytes(packed)
        if struct.pack("=I", 1) != struct.pack("<I", 1):
            ids.byteswap()
        return ids

    def decode(self, ids) -> str:
        """The text of ids, added tokens as their strings; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The vocabulary, read once in each worker. The file has to be at path on every executor, as an
    installed package is."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column with ids array<int> and decoded string of every whole text.

    A null text counts as empty and has no ids. Repeated rows stay repeated, null ids stay null,
    an empty table gives an empty table; other columns are ignored.
    """
    return _encoded(docs, vocabulary, id_col, text_col, digests=False)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, with n_tokens, ids_sha256 and decoded_sha256 in place of ids and text."""
    return _encoded(docs, vocabulary, id_col, text_col, digests=True)


def _encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    docs = narrowed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            for part in slices(batch):
                a, b, c = [], [], []
                for text in part.column(1):
                    packed = bpe.encode_packed(text.as_py() or "")
                    ids = bpe._ids(packed)
                    text = bpe.decode(ids)
                    if digests:
                        a.append(len(ids))
                        b.append(hashlib.sha256(packed).hexdigest())
                        c.append(hashlib.sha256(text.encode()).hexdigest())
                    else:
                        a.append(list(ids))
                        b.append(text)
                if digests:
                    out = [pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    out, names = [pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.string())], ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *out], names=[id_col, *names])

    return map_batches(docs, run, f"`{id_col}` {kind}, {columns}")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
