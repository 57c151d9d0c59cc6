"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax.

    P(word | history) = P(class | history) * P(member | class, history)

Classes: the ``HEAD`` most frequent training words are dealt by frequency over classes of ``MEMBERS`` words; every other
word, known or not, belongs to one of ``TAILS`` classes by a hash of its last two bytes, and there to one of ``WIDTH`` members
by a hash of the word. Both factors are softmaxes over a unigram term and sums of hashed weights of n-gram and skip features:
the last word, the last two, the last three, the word before the last, and the one before that. The words of a tail member
share its probability by add-one counts, with one place for unknown words: (c + 1) / (N_member + V_member + 1). So the
probabilities of a text's tokens sum to one over all continuations.

Training is by distributed gradient updates from the unigram model. The gradient of the log likelihood in a weight is how often
the weight's outcome came after its feature less how often the model expects it. Each round takes a share of the training texts
by hash: its tasks count what came, and draw one outcome for each token from the model as it is, by a hash of the token's
history and place, so that the drawn counts are an unbiased estimate of what is expected; in the first round the expected
counts of the unigram model are known in closed form. Counts of all tasks are summed by blocks of rows, and the step is the
gradient over the logarithmic mean of the two counts (each with ``PRIOR`` unigram tokens more), that is
rate * log((came + prior) / (expected + prior)), at a rate that falls with the rounds. ``ROUNDS`` rounds are an epoch, in which
every training token teaches once. Results don't depend on how rows are dealt over tasks.

Sizes of what is collected and broadcast are fixed by the parameters: the weights ((ROWS + MEMBER_ROWS) * WIDTH numbers), the
head's words and the words whose counts are looked up on the spot (``NEAR``). Counts of all other words are joined by Spark, so
vocabulary and corpus may be of any size.

Defined cases: null text is empty and has its end token only; a null doc_id is a training row; without training tokens every
word is unknown; repeated rows count and are scored each; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Stored, crc_of_id

#: Word that ends a text; a blank can't be in any other word.
END = b" "
HEAD, MEMBERS, TAILS = 2048, 64, 32
WIDTH = 64
#: Rows of weights for classes and, for all classes together, for members; each feature has its share of them, in sixteenths.
ROWS, MEMBER_ROWS = 1 << 15, 1 << 16
SHARES = (4, 4, 4, 2, 2)
#: Most frequent words whose counts are broadcast (a few MB); the rest is joined.
NEAR = 100_000
#: Rates of the five features, their fall by round, and the unigram tokens that each row is given.
RATES, FALL, PRIOR = (0.7, 0.3, 0.2, 0.4, 0.3), 0.8, 150.0
EPOCHS, ROUNDS = 1, 2
#: Most partitions of documents whose counts one task sums up before they are shuffled.
MERGED = 8
#: Bound of a weight.
MOST = 6.0
#: Tokens whose masses are held at once (they fit a core's cache), bytes of a group of texts, and of words counted at once.
CHUNK, GROUP, COUNTED = 1 << 11, 1 << 19, 1 << 25
HEADS = HEAD // MEMBERS
CLASSES = HEADS + TAILS
OWN_ROWS = MEMBER_ROWS // CLASSES
assert CLASSES <= WIDTH and MEMBERS <= WIDTH and MEMBER_ROWS % CLASSES == 0 and OWN_ROWS % 16 == 0 and sum(SHARES) == 16
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
FEATURES = len(SHARES)


def tokens_of(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, as ``tokens_of`` has them but without ends, and each text's number of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy()
    none = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)  # before a text's first blank and after its last
    if len(none):
        sizes = sizes - np.bincount(np.searchsorted(np.cumsum(sizes), none, "right"), minlength=len(sizes))
        words = words.filter(pc.not_equal(words, ""))
    return words, sizes


class Texts(NamedTuple):
    """Tokens of some texts: distinct words, each token's place among them, and the number of each text's tokens."""

    words: list[bytes]
    codes: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Texts:
        words, sizes = split_texts(texts)
        coded, sizes = words.dictionary_encode(), sizes + 1
        ends = np.zeros(sizes.sum(), bool)
        ends[np.cumsum(sizes) - 1] = True
        codes = np.full(len(ends), len(coded.dictionary), np.int64)
        codes[~ends] = coded.indices.to_numpy()
        return Texts([*coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), END], codes, sizes)

    @staticmethod
    def listed(texts: list[list[bytes]]) -> Texts:
        words = list(chain.from_iterable(texts))
        return Texts(words, np.arange(len(words)), np.array([len(t) for t in texts], np.int64))


def grouped(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes, or of one longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, size + (upto[a - 1] if a else 0), "right")))
        yield a, b
        a = b


def tail_place(word: bytes) -> tuple[int, int]:
    """Class and member of a word that isn't of the head."""
    return HEADS + xxhash.xxh32_intdigest(word[-2:]) % TAILS, xxhash.xxh32_intdigest(word) % WIDTH


def training(c: Column) -> Column:
    """Whether rows of an id teach: all but those of remainder 2."""
    return crc_of_id(c) % 7 != 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def features(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of each token's history: ids are the words' hashes, first the place of the token's text's first token."""
    n = len(ids)
    place = np.arange(n) - first
    p1, p2, p3 = (np.zeros(n, np.uint64) for _ in range(3))
    for k, prev in ((1, p1), (2, p2), (3, p3)):
        np.multiply(ids[:-k], place[k:] >= k, out=prev[k:])
    with np.errstate(over="ignore"):
        two = _mixed(p1 * _SALTS[0] + p2 * _SALTS[1])
        return np.stack([
            _mixed(p1 + _SALTS[0]), two + _SALTS[1], _mixed(two + p3 * _SALTS[2]), _mixed(p2 * _SALTS[3] + _SALTS[2]), _mixed(p3 * _SALTS[4] + _SALTS[3]),
        ])


class Vocabulary:
    """Classes of words, and counts of the frequent ones. near: word -> count, a bounded map; head in order of frequency.

    tail_n, tail_v: tokens and distinct words of each tail class and member.
    """

    def __init__(self, near: dict[bytes, int], head: list[bytes], total: int, distinct: int, tail_n: np.ndarray, tail_v: np.ndarray):
        self.near, self.total, self.distinct = near, total, distinct
        self.place = {w: (k // MEMBERS, k % MEMBERS) for k, w in enumerate(head)}
        mass = np.zeros((CLASSES, WIDTH))
        for w, (c, m) in self.place.items():
            mass[c, m] = near[w]
        mass[HEADS:] = tail_n + tail_v + 1.0
        whole = mass.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.members = np.where(mass > 0, np.log(mass) - np.log(whole), -1e9).astype(np.float32)
            self.classes = np.full(WIDTH, -1e9, np.float32)
            self.classes[:CLASSES] = np.where(whole[:, 0] > 0, np.log(whole[:, 0]) - math.log(whole.sum()), -1e9)
        self.tail_log = np.log10(mass[HEADS:])

    @cached_property
    def frequent(self) -> tuple[dict[bytes, int], list[np.ndarray]]:
        """Place of each word whose count is at hand, and arrays of what is known of them; made once in a process."""
        words = list(self.near)
        hashes, classes, members, head, has, logs = known_of(words)
        for k, w in enumerate(words):
            if w in self.place:
                classes[k], members[k] = self.place[w]
                head[k] = True
        has[:] = True
        logs[:] = [math.log10(c + 1) for c in self.near.values()]
        return {w: k for k, w in enumerate(words)}, [hashes, classes, members, head, has, logs]


def known_of(words: list[bytes]) -> list[np.ndarray]:
    """The arrays of ``Words`` for words whose counts aren't at hand."""
    n, ends = len(words), {w[-2:] for w in words}
    ends = {e: HEADS + xxhash.xxh32_intdigest(e) % TAILS for e in ends}
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    members = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, n) % WIDTH
    return [hashes, np.fromiter([ends[w[-2:]] for w in words], np.int64, n), members, np.zeros(n, bool), np.zeros(n, bool), np.zeros(n)]


class Words(dict):
    """Per task: word -> place in arrays of what is known of it; the frequent words, and a bounded number of others.

    Arrays: hash, class, member, whether of the head, whether the count is at hand, and log10(count + 1) if it is.
    """

    def __init__(self, vocabulary: Vocabulary):
        index, self.known = vocabulary.frequent
        super().__init__(index)
        self.v = vocabulary
        self.all = list(index)

    def __missing__(self, word: bytes) -> int:
        self.all.append(word)
        at = self[word] = len(self)
        return at

    def arrays(self, texts: Texts | list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Of each token: the word's place here, its arrays, and the place of its text's first token.

        Words are looked up once for all their tokens in texts.
        """
        if isinstance(texts, list):
            texts = Texts.listed(texts)
        index, own = self.v.frequent
        if len(self) > len(index) + 150_000:
            self.clear()
            self.update(index)
            del self.all[len(index) :]
            self.known = own
        at = np.fromiter(map(self.__getitem__, texts.words), np.int64, len(texts.words))
        if len(self.all) > len(self.known[0]):
            self.known = [np.concatenate(x) for x in zip(self.known, known_of(self.all[len(self.known[0]) :]))]
        first = np.repeat(np.cumsum(texts.sizes) - texts.sizes, texts.sizes)
        return at[texts.codes], *[x[at][texts.codes] for x in self.known], first


def _feature_rows(f: np.ndarray, rows: int) -> np.ndarray:
    """Each feature's row among ``rows``, of which each feature has its own run; sizes are powers of two."""
    size = np.array(SHARES, np.uint64)[:, None] * np.uint64(rows // 16)
    start = (np.cumsum((0, *SHARES[:-1])) * (rows // 16))[:, None]
    return ((f >> np.uint64(17)) & (size - np.uint64(1))).astype(np.int64) + start


def feature_of_row(rows: int) -> np.ndarray:
    return np.repeat(np.arange(FEATURES), np.array(SHARES) * (rows // 16))


class Weights:
    """Two tables of hashed rows: for classes, and for members, where each class has its own run of rows."""

    def __init__(self):
        self.tables = [np.zeros((ROWS, WIDTH), np.float32), np.zeros((MEMBER_ROWS, WIDTH), np.float32)]

    @staticmethod
    def rows(f: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _feature_rows(f, ROWS), _feature_rows(f, OWN_ROWS) + classes * OWN_ROWS

    def masses(self, table: int, rows: np.ndarray, classes: np.ndarray, v: Vocabulary) -> np.ndarray:
        """exp of the logits; weights are bounded, so these are too."""
        w = self.tables[table]
        out = w.take(rows[0], 0)
        for r in rows[1:]:
            out += w.take(r, 0)
        out += v.members.take(classes, 0) if table else v.classes
        return np.exp(out, out=out)


class Factors:
    """exp of weights, and of the unigram terms in the rows of the first feature, which every token has: masses are products
    of rows, so that no token takes an exp. Made once from the weights.
    """

    def __init__(self, w: Weights, v: Vocabulary):
        self.tables = [np.exp(x) for x in w.tables]
        self.tables[0][: ROWS // 16 * SHARES[0]] *= np.exp(v.classes)
        own = self.tables[1].reshape(CLASSES, OWN_ROWS, WIDTH)
        own[:, : OWN_ROWS // 16 * SHARES[0]] *= np.exp(v.members)[:, None]

    @cached_property
    def _spare(self) -> np.ndarray:
        return np.empty((2, CHUNK, WIDTH), np.float32)

    def masses(self, table: int, rows: np.ndarray, classes: np.ndarray, v: Vocabulary) -> np.ndarray:
        """As ``Weights.masses``, for at most CHUNK tokens; the next call writes over them."""
        out, more = self._spare[:, : len(classes)]
        np.take(self.tables[table], rows[0], 0, out, "clip")  # rows are all there; the other modes copy once more
        for r in rows[1:]:
            np.take(self.tables[table], r, 0, more, "clip")
            out *= more
        return out


def observe(counts: list[np.ndarray], rows: tuple[np.ndarray, np.ndarray], outcomes: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds to counts, flat for both tables, how often each outcome came after each row."""
    for own, r, o in zip(counts, rows, outcomes):
        one = own.dtype.type(1)  # of another type it would be cast token by token
        for k in r:
            np.add.at(own, k * WIDTH + o, one)


#: Sums over a row of masses, and running sums of eight numbers, as products of matrices.
_ONES, _UP_TO = np.ones(WIDTH, np.float32), np.triu(np.ones((8, 8), np.float32))
assert WIDTH == 64


def draw(mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An outcome for each row of masses, by numbers u in [0, 1): first an eighth of the row, then a place in it."""
    line, eighths = np.arange(len(mass)), mass.reshape(len(mass), 8, WIDTH // 8)
    up = (mass.reshape(-1, 8) @ _ONES[:8]).reshape(-1, 8) @ _UP_TO
    at = (u * up[:, -1]).astype(np.float32)
    k = np.minimum((up <= at[:, None]).sum(1), 7)
    at -= np.where(k, up[line, k - 1], 0)
    return k * (WIDTH // 8) + np.minimum((eighths[line, k] @ _UP_TO <= at[:, None]).sum(1), WIDTH // 8 - 1)


def chances(f: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in [0, 1) for each token, by its history and its place in the text."""
    with np.errstate(over="ignore"):
        h = _mixed(f[2] + place.astype(np.uint64) * _SALTS[0])
    return (h >> np.uint64(32)) / 2.0**32, (h & np.uint64(0xFFFFFFFF)) / 2.0**32


def expect(counts: list[np.ndarray], w: Factors, v: Vocabulary, f: np.ndarray, rows: tuple[np.ndarray, np.ndarray], classes: np.ndarray, place: np.ndarray) -> None:
    """Adds to counts one drawn outcome for each of at most CHUNK tokens: of its class, and of its member given the class."""
    u = chances(f, place)
    observe(counts, rows, tuple(draw(w.masses(t, rows[t], classes, v), u[t]) for t in range(2)))


def step_of(came: np.ndarray, expected: np.ndarray | None, unigram: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The update of rows of weights; without expected counts they are the unigram model's. 0 where nothing can come."""
    p = np.exp(np.minimum(unigram, 0).astype(np.float64))
    if expected is None:
        expected = came.sum(1, keepdims=True) * p
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log((came + PRIOR * p) / (expected + PRIOR * p))
    return np.where(unigram > -1e8, np.clip(out, -4, 4) * rate[:, None], 0).astype(np.float32)


def rates(rows: np.ndarray, table_rows: int, round_: int) -> np.ndarray:
    return np.array(RATES)[feature_of_row(table_rows)[rows]] * FALL**round_


def _slices(total: int) -> Iterator[tuple[int, int]]:
    for at in range(0, total, CHUNK):
        yield at, min(total, at + CHUNK)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all tokens of the training rows; summed in each batch before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(words: list[pa.Array], ends: int) -> pa.RecordBatch:
            n = pc.value_counts(pa.chunked_array(words, pa.binary())).flatten()
            word, n = pa.concat_arrays([n[0], pa.array([END], pa.binary())]), pa.concat_arrays([n[1], pa.array([ends], pa.int64())])
            return pa.RecordBatch.from_arrays([word, n], ["word", "n"])

        held, size, ends = [], 0, 0
        for part in batches:
            texts = part.column(0)
            for a, b in grouped(texts, 4 * GROUP):
                words, sizes = split_texts(texts[a:b])
                held.append(words.cast(pa.binary()))
                size, ends = size + words.nbytes, ends + len(sizes)
                if size > COUNTED:
                    yield summed(held, ends)
                    held, size, ends = [], 0, 0
        if ends:
            yield summed(held, ends)

    return docs.where(training(F.col("doc_id"))).select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Head and near words are the most frequent ones, by steps of their count's logarithm from the top down; of the step that
    NEAR cuts through, words by a hash. No task sends more than these."""
    step = F.floor(F.log2("n") * 32)
    least, room, share = None, NEAR, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r.s):
        least, share = r.s, min(1 << 20, (room << 20) // r.k)
        room -= r.k
        if room < 0:
            break
    picked = (step > least) | (step == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share) if least is not None else F.lit(False)
    near = {bytes(r.word): r.n for r in sorted(counts.where(picked).collect(), key=lambda r: (-r.n, bytes(r.word)))}
    head = list(near)[:HEAD]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, v = np.zeros(TAILS * WIDTH, np.int64), np.zeros(TAILS * WIDTH, np.int64)
        for part in batches:
            c = np.fromiter(((c - HEADS) * WIDTH + m for c, m in map(tail_place, map(bytes, part.word))), np.int64, len(part))
            n += np.bincount(c, part.n.values, len(n)).astype(np.int64)
            v += np.bincount(c, minlength=len(v))
        at = np.flatnonzero(v)
        yield pd.DataFrame({"c": at, "n": n[at], "v": v[at]})

    got = counts.mapInPandas(work, "c int, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros((TAILS, WIDTH), np.int64), np.zeros((TAILS, WIDTH), np.int64)
    for r in got:
        n.flat[r.c], v.flat[r.c] = r.n, r.v
    total, distinct = int(n.sum()), int(v.sum())
    for w in head:
        c, m = tail_place(w)
        n[c - HEADS, m] -= near[w]
        v[c - HEADS, m] -= 1
    return Vocabulary(near, head, total, distinct, n, v)


#: Rows of weights whose counts travel together.
_BLOCK = 256


def counts_of(groups: Iterator[Texts], v: Vocabulary, w: Factors | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What came, and what the model's draws give (nothing for w = None), flat for both tables."""
    words = Words(v)
    came, drawn = ([np.zeros(r * WIDTH, np.int32) for r in (ROWS, MEMBER_ROWS)] for _ in range(2))
    for group in groups:
        _, ids, classes, members, _, _, _, first = words.arrays(group)
        f, place = features(ids, first), np.arange(len(ids)) - first
        for a, b in _slices(len(ids)):
            rows = Weights.rows(f[:, a:b], classes[a:b])
            observe(came, rows, (classes[a:b], members[a:b]))
            if w is not None:
                expect(drawn, w, v, f[:, a:b], rows, classes[a:b], place[a:b])
    return came, drawn


def round_of(spark: SparkSession, docs: DataFrame, v: Vocabulary, w: Weights, k: int, rounds: int) -> None:
    """One update of w by the share of the training rows whose turn it is; counts are summed where the blocks of rows meet."""
    shared = spark.sparkContext.broadcast((v, Factors(w, v) if k else None))
    turn = F.pmod(F.xxhash64("text", F.lit(k // rounds)), F.lit(rounds)) == k % rounds

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (part.column(0) for part in batches)
        came, drawn = counts_of((Texts.of(t[a:b]) for t in texts for a, b in grouped(t, 2 * GROUP)), *shared.value)
        for t, both in enumerate(zip(came, drawn)):
            for b in range(len(both[0]) // (_BLOCK * WIDTH)):
                own = np.stack([x[b * _BLOCK * WIDTH : (b + 1) * _BLOCK * WIDTH] for x in both])
                at = np.flatnonzero(own.any(0))
                if len(at):  # counts in as few bytes as the largest needs
                    n = np.ascontiguousarray(own[:, at], np.min_scalar_type(int(own.max())))
                    yield pa.record_batch([pa.array([2 * b + t], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([n.tobytes()])], ["block", "at", "n"])

    texts = docs.where(training(F.col("doc_id")) & turn).select("text")
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(texts.rdd.getNumPartitions() / MERGED))
    counted = texts.coalesce(tasks).mapInArrow(work, "block int, at binary, n binary")
    v_classes, v_members = v.classes, v.members

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for block, at, n in zip(part.block, part["at"], part.n):
                if block not in sums:
                    sums[block] = np.zeros((2, _BLOCK * WIDTH))
                sums[block][:, np.frombuffer(at, np.uint16)] += np.frombuffer(n, f"u{len(n) // len(at)}").reshape(2, -1)
        for block, n in sums.items():
            rows = np.arange(block // 2 * _BLOCK, block // 2 * _BLOCK + _BLOCK)
            came, drawn = n.reshape(2, _BLOCK, WIDTH)
            own = (v_members[rows // OWN_ROWS], rates(rows % OWN_ROWS, OWN_ROWS, k)) if block % 2 else (v_classes, rates(rows, ROWS, k))
            yield pd.DataFrame({"block": [block], "w": [step_of(came, drawn if k else None, *own).tobytes()]})

    for r in counted.repartition((ROWS + MEMBER_ROWS) // _BLOCK // 8, "block").mapInPandas(add, "block int, w binary").collect():
        at = r.block // 2 * _BLOCK
        own = w.tables[r.block % 2][at : at + _BLOCK]
        np.clip(own + np.frombuffer(r.w, np.float32).reshape(_BLOCK, WIDTH), -MOST, MOST, out=own)
    shared.unpersist()


def train(spark: SparkSession, docs: DataFrame, v: Vocabulary, epochs: int = EPOCHS, rounds: int = ROUNDS) -> Weights:
    w = Weights()
    for k in range(epochs * rounds):
        round_of(spark, docs, v, w, k, rounds)
    return w


def token_logs(group: Texts | list[list[bytes]], words: Words, w: Factors | Weights, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """Of each token: the word's place in words, whether its count is at hand, log10(count + 1) or 0, and its log10 probability.

    A tail word's probability lacks the factor count + 1 where the count isn't at hand.
    """
    at, ids, classes, members, head, has, logs, first = words.arrays(group)
    f = features(ids, first)
    out = np.zeros(len(ids))
    for a, b in _slices(len(ids)):
        line, rows = np.arange(b - a), Weights.rows(f[:, a:b], classes[a:b])
        for t, o in ((0, classes), (1, members)):
            mass = w.masses(t, rows[t], classes[a:b], v)
            out[a:b] += np.log10(mass[line, o[a:b]]) - np.log10(mass @ _ONES)
    tail = ~head
    out[tail] += logs[tail] - v.tail_log[classes[tail] - HEADS, members[tail]]
    return at, has, logs, out


def score_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    A task scores what it can: the model, and the counts of frequent words. For the other words it writes (row, word, times);
    they meet the counts by word, and what the counts add is summed by row.
    """
    docs = docs.select("doc_id", "text")
    counts = Stored(count_words(docs))
    v = vocabulary(counts.df)
    shared = spark.sparkContext.broadcast((v, Factors(train(spark, docs, v), v)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = shared.value
        words = Words(v)

        def scored(group: Texts) -> list[pa.Array]:
            at, has, logs, model = token_logs(group, words, w, v)
            starts = np.cumsum(group.sizes) - group.sizes
            known, base, score = (np.add.reduceat(x, starts) for x in (has.astype(np.int64), logs, model))
            lost = np.flatnonzero(~has)
            text = np.repeat(np.arange(len(starts)), group.sizes)[lost]
            far, times = np.unique(text * len(words.all) + at[lost], return_counts=True)
            cuts = np.searchsorted(far, np.arange(len(starts) + 1) * len(words.all)).astype(np.int32)
            lists = pa.array([words.all[k] for k in (far % len(words.all)).tolist()], pa.binary()), pa.array(times, pa.int32())
            return [*map(pa.array, (group.sizes.astype(np.int64), known, base, score)), *(pa.ListArray.from_arrays(cuts, x) for x in lists)]

        for part in batches:
            texts = part.column("text")
            for a, b in grouped(texts, GROUP):  # rows go out by groups, so that few words are held at once
                yield pa.record_batch([part.column("doc_id")[a:b], part.column("rid")[a:b], *scored(Texts.of(texts[a:b]))], names)

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("rid"))
    schema = "doc_id long, rid long, n_tokens long, n_known long, base double, score double, far array<binary>, times array<int>"
    names = [c.split()[0] for c in schema.split(", ")]
    scored = Stored(numbered.mapInArrow(work, schema))
    far = scored.df.select("rid", F.inline(F.arrays_zip(F.col("far").alias("word"), F.col("times").alias("k"))))
    more = far.join(counts.df, "word").groupBy("rid").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more"))
    total, spread = v.total, math.log10(v.total + v.distinct + 1)
    more_known, add = F.coalesce("more_known", F.lit(0)), F.coalesce("more", F.lit(0.0))
    return scored.df.select("doc_id", "rid", "n_tokens", "n_known", "base", "score").join(more, "rid", "left").select(
        "doc_id",
        (~training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + more_known).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("score") + add).alias("score"),
    )
