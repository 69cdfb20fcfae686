"""Language-model scores: masked pseudo-likelihood of a bidirectional window network.

The network's tokens are the ``OWN`` most frequent words, and ``BUCKETS`` groups of all other words by
their last characters; a boundary stands around each document. One hidden layer over the embeddings
of two tokens on either side predicts the masked token between them. Its output is a softmax in two
levels, over classes of ``CLASS`` tokens by frequency and over the tokens of the class, both
depending on the context; output weights are the input embeddings. A grouped word's probability within its group is its
share of the group's count in the corpus. A document's score is the sum over its words of the log
probability of the word given both sides.

What is gathered grows with the corpus: the count of every word, and every masked position, which is trained
on in one of ``ROUNDS`` rounds. A round is local descent in numpy: every task starts
from the same weights, descends over its own documents' windows and hands back its weights, which are
averaged in two steps on the executors. The driver holds one model (under 2 MB), whatever the corpus.

Every word keeps its own count: those of the most frequent words go to the executors, those of all
others stay a distributed table that is joined with the documents' words.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, narrowed, slices, stored

#: Tokens: the boundary, words of their own, and groups by their last characters.
OWN, BUCKETS, LAST = 4095, 2048, 3
SYMBOLS = 1 + OWN + BUCKETS
#: Tokens of a class, neighbours on each side, and width of embeddings and hidden layer.
CLASS, SIDE, WIDTH = 64, 2, 32
CLASSES = SYMBOLS // CLASS
#: Words at most whose counts go to the executors; those of rarer ones are joined.
VOCABULARY = 100_000
#: Steps of word counts to a doubling, for the least count of the vocabulary.
COUNT_STEPS = 16
#: Where a position's neighbours are, from it.
NEAR = np.array([d for d in range(-SIDE, SIDE + 1) if d])
#: Training: rounds, each over its own share of all positions; positions of a run, which stay together; positions
#: of a step, step size, seed.
ROUNDS, RUN, BATCH, RATE, SEED = 2, 32, 4096, 0.15, 7
#: Rows whose products with the classes are made at once, so that they stay in a core's cache.
ROWS = 1024
#: Logits under this need no shift before they go into an exponential of 32 bits.
SMALL_LOGIT = 80
#: Groups in which the tasks' weights are averaged first, each in its own task.
FIRST_AVERAGES = 16
#: Steps of a summed logarithm: sums of whole steps are the same in any order.
LOG_STEPS = 2**30
#: Documents and words scored at once.
SCORED_ROWS, SCORED = 200, 1 << 13
#: Free memory that a worker may keep within a task.
KEPT_BYTES = 256 << 20
#: Bytes of words that a worker gathers before it counts them and hands the counts on.
HELD_BYTES = 96 << 20


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs without white space."""
    return text.lower().split() if text else []


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """words_of every text, in Arrow: how many each has, and all of them after one another."""
    lists = pc.utf8_split_whitespace(pa.array([(t.as_py() or "").lower() for t in texts], pa.string()))
    words, ends = lists.values, lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty words
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return np.diff(before[ends]), words.filter(full) if before[-1] < len(words) else words


def ending_symbol(word: str) -> int:
    """The token of a word that has none of its own, by its last characters."""
    return 1 + OWN + zlib.crc32(word[-LAST:].encode()) % BUCKETS


def ending_symbols(words: pa.Array) -> np.ndarray:
    """ending_symbol of every word, made once for each ending."""
    endings = pc.utf8_slice_codeunits(words, -LAST, None).dictionary_encode()
    return np.array([ending_symbol(e) for e in endings.dictionary.to_pylist()], np.int64)[endings.indices.to_numpy()]


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all documents. Each task sums its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                held.append(split_words(part.column(0))[1])
                size += held[-1].nbytes
                if size > HELD_BYTES:
                    yield as_batch(held)
                    held, size = [], 0
        yield as_batch(held)

    def as_batch(held: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(pa.chunked_array(held, pa.string()).value_counts().flatten(), names=["word", "n"])

    return map_batches(narrowed(docs, "text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """words by falling count; by id (also size + symbol for other words): symbol and log probability
    within it, of another word as if it was seen once. others: word and n of those seen more often."""

    words: list[str]
    symbol: np.ndarray
    within: np.ndarray
    total: np.ndarray  #: words of the corpus by token
    others: DataFrame

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        """counts: word and n. The driver gets a histogram of counts, VOCABULARY + OWN words at most and
        a sum for each ending.

        words are all from some step of the histogram on, as many steps as fit, and those with
        symbols of their own: no partition hands the driver words of its own that others outdo.
        """
        step = F.floor(F.log2("n") * COUNT_STEPS)
        least, room = None, VOCABULARY
        for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
            room -= r["count"]
            if room < 0:
                break
            least = r["step"]
        known, others = {}, counts.where("n > 1")
        if least is not None:
            top = counts.where(step >= least).toPandas()
            known = dict(zip(top["word"], top["n"]))
            others = others.where(step < least)
        if len(known) < OWN:  # else they are among those
            known |= {r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(OWN).collect()}
        words = sorted(known, key=lambda w: (-known[w], w))
        n = np.array([known[w] for w in words], float)
        symbol = np.array([1 + i if i < OWN else ending_symbol(w) for i, w in enumerate(words)], np.int64)
        ending = F.crc32(F.expr(f"right(word, {LAST})").cast("binary")) % BUCKETS + 1 + OWN
        total = np.ones(SYMBOLS)  # one more for a word that was never seen
        for r in counts.groupBy(ending.alias("s")).agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
            total[r["s"]] += r["n"]
        for i, (w, k) in enumerate(zip(words[:OWN], n)):
            total[ending_symbol(w)] -= k
            total[1 + i] = k
        within = np.where(np.arange(len(words)) < OWN, 0.0, np.log(n / total[symbol])) if words else np.zeros(0)
        return cls(words, np.concatenate([symbol, np.arange(SYMBOLS)]), np.concatenate([within, -np.log(total)]), total, others)

    def __getstate__(self) -> dict:
        """Without the table, which stays on the driver."""
        return self.__dict__ | {"others": None}

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Each word's id, the places of those that aren't in the vocabulary, and these words."""
        found = pc.index_in(words, value_set=pa.array(self.words, pa.string()))
        ids = found.fill_null(0).to_numpy().astype(np.int64)
        missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        others = words.take(pa.array(missing)).dictionary_encode()
        ids[missing] = len(self.words) + ending_symbols(others.dictionary)[others.indices.to_numpy()]
        return ids, missing, others


def in_line(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents' tokens after one another, SIDE boundaries (0) around each, and the places where documents begin."""
    begins = np.cumsum([SIDE] + [len(d) + SIDE for d in documents])
    line = np.zeros(begins[-1], documents[0].dtype if documents else np.int16)
    for at, tokens in zip(begins.tolist(), documents):
        line[at : at + len(tokens)] = tokens
    return line, begins[:-1]


def in_runs(documents: list[np.ndarray], offset: int) -> tuple[np.ndarray, np.ndarray]:
    """A line and the places in it that round offset trains on, by runs of RUN positions in random order, each with
    its neighbours around it. A document's runs take turns between the rounds, its checksum says who begins."""
    line, begins = in_line(documents)
    starts, stops = [], []
    for begin, tokens in zip(begins.tolist(), documents):
        stop, first = begin + len(tokens), (offset - zlib.crc32(tokens.tobytes())) % ROUNDS
        some = np.arange(begin + RUN * first, stop, RUN * ROUNDS)
        starts.append(some)
        stops.append(np.minimum(some + RUN, stop))
    if not starts:
        return line, np.zeros(0, np.int64)
    starts, stops = np.concatenate(starts), np.concatenate(stops)
    order = np.random.default_rng(SEED).permutation(len(starts))  # neighbours in a text go to different steps, but for runs
    starts, n = starts[order], (stops - starts)[order]
    ends, whole = np.cumsum(n), np.cumsum(n + 2 * SIDE)
    mixed = line[np.repeat(starts + n + SIDE - whole, n + 2 * SIDE) + np.arange(whole[-1] if len(n) else 0)]
    return mixed, np.repeat(whole - SIDE - ends, n) + np.arange(ends[-1] if len(n) else 0)


def alone(around: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A line of tokens, each between its own neighbours, and the tokens' places."""
    line = np.column_stack([around[:, :SIDE], tokens, around[:, SIDE:]]).ravel()
    return line, np.arange(SIDE, len(line), 2 * SIDE + 1)


@dataclass
class Network:
    """hidden = tanh(sum of embed[neighbour] @ place + bias); its products with classes and, in the class,
    with embed are logits."""

    embed: np.ndarray  #: SYMBOLS x WIDTH
    place: np.ndarray  #: 2 SIDE x WIDTH x WIDTH
    bias: np.ndarray
    classes: np.ndarray  #: CLASSES x WIDTH
    class_bias: np.ndarray
    token_bias: np.ndarray

    @classmethod
    def of_counts(cls, total: np.ndarray) -> Network:
        """Untrained: it predicts tokens by their counts, whatever stands around."""
        rng = np.random.default_rng(SEED)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        by_class = total.reshape(CLASSES, CLASS)
        bias = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).astype(np.float32)
        return cls(small(SYMBOLS, WIDTH), 3 * small(2 * SIDE, WIDTH, WIDTH), np.zeros(WIDTH, np.float32), np.zeros((CLASSES, WIDTH), np.float32), bias(by_class.sum(axis=1)), bias(by_class).ravel())

    def values(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.bias, self.classes, self.class_bias, self.token_bias]

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.values()])

    @classmethod
    def unpacked(cls, numbers: np.ndarray) -> Network:
        shapes = ((SYMBOLS, WIDTH), (2 * SIDE, WIDTH, WIDTH), (WIDTH,), (CLASSES, WIDTH), (CLASSES,), (SYMBOLS,))
        ends = np.cumsum([math.prod(s) for s in shapes])
        return cls(*(part.reshape(s).astype(np.float32) for part, s in zip(np.split(numbers, ends[:-1]), shapes)))

    def tables(self) -> np.ndarray:
        """What a token adds to the hidden layer at each place: 2 SIDE x SYMBOLS x WIDTH."""
        return np.matmul(self.embed[None], self.place)

    def with_biases(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Output weights of classes (WIDTH + 1 x CLASSES) and of each class's tokens (CLASSES x WIDTH + 1 x CLASS)
        with their biases as a last row, and whether all logits are so small that softmax needs no shift (hidden
        numbers are between -1 and 1)."""
        classes, own = np.empty((WIDTH + 1, CLASSES), self.embed.dtype), np.empty((CLASSES, WIDTH + 1, CLASS), self.embed.dtype)
        classes[:WIDTH], classes[WIDTH] = self.classes.T, self.class_bias
        own[:, :WIDTH] = self.embed.reshape(CLASSES, CLASS, WIDTH).transpose(0, 2, 1)  # small products are faster this way round
        own[:, WIDTH] = self.token_bias.reshape(CLASSES, CLASS)
        return classes, own, all(np.abs(w).sum(axis=-2).max() < SMALL_LOGIT for w in (classes, own))

    def hidden(self, sums: np.ndarray) -> np.ndarray:
        """The hidden layer and a last column of ones, for the biases. It overwrites sums, of what neighbours add."""
        sums += self.bias
        out = np.ones((len(sums), WIDTH + 1), sums.dtype)
        np.tanh(sums, out=out[:, :WIDTH])
        return out

    def log_probabilities(self, around: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The log probability of each token, given its neighbours."""
        return self.log_probabilities_at(*alone(around, tokens), self.tables(), *self.with_biases())

    def log_probabilities_at(self, line: np.ndarray, at: np.ndarray, tables: np.ndarray, classes: np.ndarray, own: np.ndarray, small: bool) -> np.ndarray:
        """The log probability of the token at each of the line's places, given its neighbours there."""
        order, of, tokens = by_class(line[at])
        near = at[order]
        sums = np.take(tables[0], line[near + NEAR[0]], axis=0)
        for k in range(1, 2 * SIDE):
            sums += np.take(tables[k], line[near + NEAR[k]], axis=0)
        hidden = self.hidden(sums)
        out = picked(within_classes(hidden, own, of), tokens % CLASS, small)
        for a in range(0, len(at), ROWS):
            part = slice(a, a + ROWS)
            out[part] += picked(hidden[part] @ classes, of[part], small)
        back = np.empty_like(out)
        back[order] = out
        return back

    def gradient(self, around: np.ndarray, tokens: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean of minus the log probabilities, and its derivative by each of values()."""
        return self.gradient_at(*alone(around, tokens))

    def gradient_at(self, line: np.ndarray, at: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """gradient of the tokens at different places of the line. A token that is the neighbour of several
        places is gathered into their slope first and then added to its embedding's once."""
        classes, own, small = self.with_biases()
        n = len(at)
        order, of, tokens = by_class(line[at])
        at = at[order]
        place = self.place.reshape(-1, WIDTH)
        inputs = np.take(self.embed, line[at[:, None] + NEAR], axis=0).reshape(n, -1)
        hidden = self.hidden(inputs @ place)
        inner = within_classes(hidden, own, of)
        loss, shares = descent(inner, tokens % CLASS, n, small)
        back, by_token, by_classes = np.empty((n, WIDTH), hidden.dtype), np.zeros((SYMBOLS, WIDTH + 1), hidden.dtype), np.zeros((CLASSES, WIDTH + 1), hidden.dtype)
        weighted = hidden * shares
        for c, part in parts(of):
            to = slice(c * CLASS, (c + 1) * CLASS)
            np.dot(inner[part], self.embed[to], out=back[part])
            np.dot(inner[part].T, weighted[part], out=by_token[to])
        back *= shares
        for a in range(0, n, ROWS):
            part = slice(a, a + ROWS)
            error = hidden[part] @ classes
            more, shares = descent(error, of[part], n, small)
            loss += more
            back[part] += (error @ self.classes) * shares
            by_classes += error.T @ (hidden[part] * shares)
        back *= 1 - hidden[:, :WIDTH] ** 2
        spread, slope = np.zeros((2, len(line), WIDTH), back.dtype)
        spread[at] = back
        toward = spread @ place.T
        for k, d in enumerate(NEAR.tolist()):  # places are SIDE or more from the line's ends
            slope[SIDE + d : len(line) - SIDE + d] += toward[SIDE : len(line) - SIDE, k * WIDTH : (k + 1) * WIDTH]
        embed = by_token[:, :WIDTH].ravel()
        pairs, half = np.result_type(embed, np.complex64), WIDTH // 2  # two numbers at once
        # Tokens repeat; add.at is fast in one dimension only.
        np.add.at(embed.view(pairs), ((line * half)[:, None] + np.arange(half)).ravel(), slope.ravel().view(pairs))
        return loss, [embed.reshape(SYMBOLS, WIDTH), (inputs.T @ back).reshape(self.place.shape), back.sum(axis=0), by_classes[:, :WIDTH], by_classes[:, WIDTH], by_token[:, WIDTH]]


def by_class(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the tokens by class, and in this order their classes and themselves."""
    of = tokens // CLASS
    order = np.argsort(of.astype(np.int16), kind="stable")  # small numbers sort faster
    return order, of[order], tokens[order]


def within_classes(hidden: np.ndarray, own: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The logits of the tokens of each row's class; of ascends."""
    out = np.empty((len(of), CLASS), hidden.dtype)
    for c, part in parts(of):
        np.dot(hidden[part], own[c], out=out[part])
    return out


def picked(logits: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """The log softmax of each row at one place. It overwrites logits. small: as of with_biases."""
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(at)), at]
    return own - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype))


def descent(logits: np.ndarray, at: np.ndarray, n: int, small: bool) -> tuple[float, np.ndarray]:
    """Minus the sum of log softmax at the places, over n, and what each row of logits, which are overwritten, is to
    be multiplied with to be its derivative: the narrower products get that factor."""
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    rows = np.arange(len(at))
    own = logits[rows, at]
    total = np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)
    logits[rows, at] -= total
    return float((np.log(total) - own).sum()) / n, (1 / (n * total))[:, None]


def keep_freed_memory() -> None:
    """Arrays that are freed leave their memory to the next ones, where the C library knows how; else each large
    array gets fresh pages, which cost a third of a step. A task's end gives all back (tidied)."""
    if set_option := getattr(ctypes.CDLL(None), "mallopt", None):
        set_option(-3, 32 << 20)  # M_MMAP_THRESHOLD: smaller arrays come from the heap
        set_option(-1, KEPT_BYTES)  # M_TRIM_THRESHOLD


def parts(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal numbers in an ascending array."""
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
        yield int(of[a]), slice(a, b)


class Descent:
    """Steps whose size falls with the gradients so far, for each number on its own."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate = network, rate
        self.squares = [np.full_like(v, 1e-6) for v in network.values()]
        self.room = [np.empty_like(v) for v in network.values()]

    def step(self, line: np.ndarray, at: np.ndarray) -> float:
        loss, gradients = self.network.gradient_at(line, at)
        for v, s, room, g in zip(self.network.values(), self.squares, self.room, gradients):
            s += np.multiply(g, g, out=room)
            np.divide(g, np.sqrt(s, out=room), out=room)
            v -= np.multiply(room, self.rate, out=room)
        return loss


def encode(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n_tokens, codes (the document's tokens as 16-bit numbers), within (the sum of the words' log
    shares of their tokens) and rest (words whose counts weren't sent, as if seen once in within)."""
    pairs = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        symbol, within = known.symbol.astype(np.int16), known.within
        for batch in batches:
            for part in slices(batch):
                n, words = split_words(part.column(1))
                ends = np.concatenate([[0], np.cumsum(n)])
                ids, missing, others = known.ids(words)
                shares = [float(x.sum()) for x in np.split(within[ids], ends[1:-1])]
                codes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(symbol[ids])])
                # A document's other words once each, with how often it has them.
                size = max(1, len(others.dictionary))
                pair, often = np.unique((np.searchsorted(ends, missing, "right") - 1) * size + others.indices.to_numpy(), return_counts=True)
                at = pa.array(np.searchsorted(pair, np.arange(len(n) + 1) * size), pa.int32())
                other = pa.StructArray.from_arrays([others.dictionary.take(pa.array(pair % size)), pa.array(often, pa.int64())], names=["word", "k"])
                rest = pa.ListArray.from_arrays(at, other).cast(pairs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), codes, pa.array(shares, pa.float64()), rest], names=["doc_id", "n_tokens", "codes", "within", "rest"])

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, codes binary, within double, rest array<struct<word: string, k: bigint>>")


def tokens_of(codes: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(c.as_py(), np.int16) for c in codes]


def one_round(encoded: DataFrame, network: Network, offset: int) -> Network:
    """The network after a round over every ROUNDS-th run of positions, offset says which: the rounds together
    train on every position once."""
    shared, rate = encoded.sparkSession.sparkContext.broadcast(network.packed()), RATE

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        own = Network.unpacked(shared.value.copy())
        steps, seen, task = Descent(own, rate), 0, -1
        for batch in batches:
            task = batch.column(1)[0].as_py() if batch.num_rows else task
            line, at = in_runs(tokens_of(batch.column(0)), offset)
            for k in range(0, len(at), BATCH):
                some = at[k : k + BATCH]
                low = some[0] - SIDE
                steps.step(line[low : some[-1] + SIDE + 1].astype(np.int64), some - low)
            seen += len(at)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([task % FIRST_AVERAGES], pa.int32()), pa.array([float(seen)]), pa.array([own.packed().tobytes()])], names=["lot", "n", "numbers"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for lot, n, numbers in zip(*(batch.column(k) for k in range(3))):
                kept = sums.setdefault(lot.as_py(), [0.0, 0.0])
                kept[0] += n.as_py()
                kept[1] = kept[1] + n.as_py() * np.frombuffer(numbers.as_py(), np.float32).astype(np.float64)
        for lot, (n, total) in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()])], names=["lot", "n", "numbers"])

    kinds = "lot int, n double, numbers binary"
    trained = map_batches(encoded.select("codes", F.spark_partition_id().alias("task")), descend, kinds)
    # Rows stream through both steps: a task holds one sum of weights for each lot it has.
    found = trained.repartition(FIRST_AVERAGES, "lot").sortWithinPartitions("lot", "n").mapInArrow(average, kinds).repartition(1).sortWithinPartitions("n").mapInArrow(average, kinds).collect()
    return Network.unpacked(np.frombuffer(found[0]["numbers"], np.float32)) if found else network


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network


def vocabulary_of(docs: DataFrame) -> Vocabulary:
    return Vocabulary.of(stored(word_counts(docs), "words"))


def train(docs: DataFrame) -> Model:
    """Vocabulary and network of all documents."""
    docs = narrowed(docs, "doc_id", "text")
    vocabulary = vocabulary_of(docs)
    return _trained(vocabulary, stored(encode(docs, docs.sparkSession.sparkContext.broadcast(vocabulary)), "encoded"))


def _trained(vocabulary: Vocabulary, encoded: DataFrame) -> Model:
    network = Network.of_counts(vocabulary.total)
    for k in range(ROUNDS):
        network = one_round(encoded, network, k)
    return Model(vocabulary, network)


def score_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum over all words, natural logarithm) and mean_log_prob of
    every row; model: default is trained on docs.

    Null and empty texts have no words, a log_prob of 0 and a null mean; texts of any length are scored
    whole. Repeated rows get equal scores (but for rounding, as sums go over batches), null ids stay null, an empty table stays empty, other columns
    are ignored.
    """
    docs = narrowed(docs, "doc_id", "text")
    sc = docs.sparkSession.sparkContext
    vocabulary = model.vocabulary if model else vocabulary_of(docs)
    encoded = encode(docs, sc.broadcast(vocabulary))
    encoded = stored(encoded.withColumn("at", F.monotonically_increasing_id()), "encoded")  # stored, so the numbers stay
    model = model or _trained(vocabulary, encoded)
    shared = sc.broadcast(model.network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        network = shared.value
        ready = network.tables(), *network.with_biases()
        for batch in batches:
            for part in slices(batch, SCORED_ROWS):
                tokens = tokens_of(part.column(3))
                n = np.array([len(t) for t in tokens])
                ends = np.cumsum(n)
                line, begins = in_line(tokens)
                line, at = line.astype(np.int64), np.repeat(begins - (ends - n), n) + np.arange(ends[-1])
                logs = [network.log_probabilities_at(line, at[k : k + SCORED], *ready) for k in range(0, len(at), SCORED)]
                logs = np.concatenate([[0.0], np.cumsum(np.concatenate(logs), dtype=np.float64)]) if logs else np.zeros(1)
                score = logs[ends] - logs[ends - n] + part.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(score)], names=["doc_id", "n_tokens", "at", "log_prob"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(encoded.select("doc_id", "n_tokens", "at", "codes", "within"), run, f"doc_id {kind}, n_tokens bigint, at bigint, log_prob double")
    # A word whose count wasn't sent was scored as if seen once: log(n) is missing, and nothing if n is 1.
    steps = F.round(F.col("k") * F.log("n") * LOG_STEPS).cast("bigint")
    more = encoded.select("at", F.inline("rest")).join(vocabulary.others, "word").groupBy("at").agg((F.sum(steps) / LOG_STEPS).alias("more"))
    scored = found.join(more, "at", "left").select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))
    return stored(scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))), "scores")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
