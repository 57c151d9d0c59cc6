"""Toxicity by weak supervision.

Voters are lexicons and patterns: a stated list of insults, lists of words and of word beginnings that go along with the
training labels (found by a bound on their log odds, see ``induce``), each at one, two and three occurrences, and patterns of
shouting and of exclamation marks. The training labels themselves are one more voter, which abstains where there is none. A
generative label model estimates every voter's rates of firing in toxic and in clean texts by expectation maximisation
over a bounded sample, in which rows weigh as their class does among all documents, and the correlations of the voters given
the class; a voter's evidence is divided by the weight of the voters it goes along with. A linear classifier is trained on the
posterior labels of all rows of the sample, labelled or not, over votes and counts of the lexicon entries.

Held-out rows (crc32 of doc_id mod 5 is 0) teach nothing. Language, source, id and labels are no inputs of a score.

Defined cases: null or empty text has no words and its score is that of a text in which nothing fires; without labels
the stated voters alone decide; repeated rows each give a row; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import bounded_labels, bounded_rows, crc_of_id, labelled_texts, sigmoid

#: Bound of the training sample: labelled rows of each class, and unlabelled rows.
SAMPLE = 5000
THRESHOLD = 0.5
#: Bounds of the chances that the labeller says toxic: no label is quite sure.
MISLABELLED = (0.005, 0.995)
#: Lengths, in bytes, of word beginnings; 0 is the whole word.
LENGTHS = (0, 3, 4, 5, 6, 7, 8, 9, 10)
TIMES = 3
#: Words with any lexicon entry, for voters on all lexicons together.
TOTALS = (1, 2, 3, 4, 6)

# Insults.
INSULTS = frozenset("clown disgusting dumb garbage idiot idiots imbecile loser losers moron morons pathetic scum stupid trash vermin worthless".split())

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


def units(word: bytes) -> list[tuple[int, bytes]]:
    return [(0, word), *((k, word[:k]) for k in LENGTHS[1:] if len(word) >= k)]


def _counts(text: str | None, wanted=None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for u in units(word):
            if wanted is None or u in wanted:
                out[u] += n
    return out


def _document_counts(texts: DataFrame, wanted=None) -> DataFrame:
    """(k, unit, f1, f2, f3): in how many texts a unit comes at least once, twice, three times."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [Counter() for _ in range(TIMES)]
        for part in batches:
            for text in part.text:
                for u, n in _counts(text, wanted.value if wanted else None).items():
                    for t in range(min(n, TIMES)):
                        total[t][u] += 1
        rows = [(k, u, *[total[t][k, u] for t in range(TIMES)]) for k, u in total[0]]
        for at in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[at : at + 50_000], columns=["k", "unit", "f1", "f2", "f3"])

    out = texts.select("text").mapInPandas(work, "k int, unit binary, f1 long, f2 long, f3 long")
    return out.groupBy("k", "unit").agg(*[F.sum(f"f{t}").alias(f"f{t}") for t in (1, 2, 3)])


def induce(spark: SparkSession, toxic: DataFrame, clean: DataFrame, n1: int, n0: int) -> list[tuple[int, bytes, int]]:
    """Lexicon entries (length, unit, times): the lower bound of the log odds ratio of texts that have the unit so often."""
    if not n1 or not n0:
        return []
    least = max(3, n1 // 150)
    mine = _document_counts(toxic).where(F.col("f1") >= least)
    rest = _document_counts(clean).select("k", "unit", *[F.col(f"f{t}").alias(f"b{t}") for t in (1, 2, 3)])
    both = mine.join(rest, ["k", "unit"], "left").select("k", "unit", F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"f{t}").alias("a"), F.coalesce(f"b{t}", F.lit(0)).alias("b")) for t in (1, 2, 3)])))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
    bound = odds - 2.5 * F.sqrt(1 / a + 1 / (n1 + 1 - a) + 1 / b + 1 / (n0 + 1 - b))
    found = both.where(F.col("a") >= least).withColumn("bound", bound).where("bound > 1").collect()
    ranked = sorted(((r.bound * math.sqrt(r.a / n1), r.k, bytes(r.unit), r.t) for r in found), reverse=True)
    return [x[1:] for x in ranked]


class Voters:
    """Votes and features of a text, from the stated and the induced lexicon."""

    def __init__(self, entries: list[tuple[int, bytes, int]]):
        self.entries = entries
        self.at: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for i, (k, u, t) in enumerate(entries):
            self.at.setdefault((k, u), []).append((i, t))
        groups = sorted({(self.group(k, u), t) for k, u, t in entries})
        self.groups = {g: i for i, g in enumerate(groups)}
        self.of = [self.groups[self.group(k, u), t] for k, u, t in entries]
        self.votes = len(groups) + 5 + len(TOTALS)
        self.width = self.votes + len(entries) + 2
        self.known: dict[bytes, list[tuple[int, bytes]]] = {}

    @staticmethod
    def group(k: int, unit: bytes) -> tuple[int, int]:
        """Lexicons: whole words dealt over three lists, beginnings by length."""
        return (0, sum(unit) % 3) if k == 0 else (1 + (k - 3) // 2, 0)

    def _units(self, word: bytes) -> list[tuple[int, bytes]]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[word] = [u for u in units(word) if u in self.at]
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.width, np.float32)
        words, hits, insults, total = words_of(text), Counter(), 0, 0
        for word in words:
            if got := self._units(word):
                total += 1
                for u in got:
                    hits[u] += 1
            insults += word in _INSULTS
        base = self.votes - 5 - len(TOTALS)
        for u, n in hits.items():
            for i, t in self.at[u]:
                if n >= t:
                    out[self.of[i]] = 1
                    out[self.votes + i] = math.log2(1 + n)
        out[base + 5 : self.votes] = [total >= t for t in TOTALS]
        out[-2:] = math.log2(1 + total), min(6.0, 30 * total / max(10, len(words)))
        text = text or ""
        upper = len(text.encode().translate(None, _NOT_UPPER)) if text.isascii() else sum(map(str.isupper, text))
        out[base : base + 5] = insults >= 1, insults >= 2, insults >= 4, upper > 0.5 * len(text) > 0, text.count("!") * 20 > len(words) > 0
        return out


_INSULTS = frozenset(x.encode() for x in INSULTS)


class LabelModel:
    """Two classes, voters that fire or don't, and a labeller who may abstain; evidence discounted by correlations given the class.

    known: 1, 0 or -1 (no label) for each row; weight: of the rows. ``labeller``: the chance that a toxic row, and a clean
    one, is labelled toxic if it is labelled.
    """

    def __init__(self, votes: np.ndarray, known: np.ndarray, weight: np.ndarray | None = None, rounds: int = 25):
        n, m = votes.shape
        w = np.ones(n) if weight is None else weight * n / weight.sum()
        fires = votes.sum(1)
        q = np.where(known >= 0, 0.02 + 0.96 * known, np.where(fires >= 2, 0.9, 0.02))
        self.weight = np.ones(m)
        for _ in range(rounds):
            on, off = w * q, w * (1 - q)
            self.prior = np.clip((on.sum() + 1) / (n + 2), 0.005, 0.9)
            self.rate1 = np.clip((on @ votes + 0.5) / (on.sum() + 1), 1e-4, 1 - 1e-4)
            self.rate0 = np.clip((off @ votes + 0.5) / (off.sum() + 1), 1e-4, 1 - 1e-4)
            says, told = known == 1, known >= 0
            self.labeller = tuple(float(np.clip((x[says].sum() + a) / (x[told].sum() + 1), *MISLABELLED)) for x, a in ((on, 0.98), (off, 0.02)))
            residual = votes - q[:, None] * self.rate1 - (1 - q[:, None]) * self.rate0
            cov = (residual * w[:, None]).T @ residual / max(1, n)
            sd = np.sqrt(np.diag(cov)) + 1e-6
            self.correlation = cov / sd / sd[:, None]
            self.weight = 1 / np.maximum(1, np.abs(self.correlation).sum(1))
            q = self.posterior(votes, known)

    def posterior(self, votes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        on, off = np.log(self.rate1 / self.rate0), np.log((1 - self.rate1) / (1 - self.rate0))
        logit = math.log(self.prior / (1 - self.prior)) + (votes * on + (1 - votes) * off) @ self.weight
        if known is not None:
            a, b = self.labeller
            logit = logit + np.where(known == 1, math.log(a / b), np.where(known == 0, math.log((1 - a) / (1 - b)), 0.0))
        return sigmoid(logit)


class Sparse:
    """Rows of features by the places and values that aren't 0: as many bytes as entries that occur, however large the lexicon is."""

    def __init__(self, places: list[bytes], values: list[bytes], width: int):
        self.shape = len(places), width
        sizes = [len(p) // 4 for p in places]
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.at = np.frombuffer(b"".join(places), np.int32)
        self.value = np.frombuffer(b"".join(values), np.float16).astype(np.float32)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.shape[0])

    def summed(self, by: np.ndarray) -> np.ndarray:
        """The transposed matrix times by."""
        return np.bincount(self.at, self.value * by[self.row], self.shape[1])

    def first(self, n: int) -> np.ndarray:
        """The first n columns, filled."""
        out = np.zeros((self.shape[0], n), np.float32)
        own = self.at < n
        out[self.row[own], self.at[own]] = self.value[own]
        return out


def fit_linear(x: Sparse, q: np.ndarray, weight: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with an L2 penalty, by Adam over all rows."""
    n, d = x.shape
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    weight = weight / weight.sum()
    for step in range(1, rounds + 1):
        slope = weight * (sigmoid(x @ w + b) - q)
        g = np.append(x.summed(slope) + 2e-4 * w, slope.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.1 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w.astype(np.float32), float(b)


class Model:
    def __init__(self, voters: Voters, w: np.ndarray, b: float):
        self.voters, self.w, self.b = voters, w, b

    def score(self, texts: Iterator[str | None]) -> np.ndarray:
        return sigmoid(np.array([self.voters(t) @ self.w + self.b for t in texts], np.float64))


def _features(spark: SparkSession, rows: DataFrame, voters: Voters) -> tuple[Sparse, np.ndarray]:
    shared = spark.sparkContext.broadcast(voters)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in batches:
            at, x = [], []
            for t in part.text:
                row = own(t)
                places = np.flatnonzero(row).astype(np.int32)
                at.append(places.tobytes())
                x.append(row[places].astype(np.float16).tobytes())
            yield pd.DataFrame({"at": at, "x": x, "y": part.y})

    got = rows.select("text", "y").mapInPandas(work, "at binary, x binary, y int").collect()
    return Sparse([r["at"] for r in got], [r.x for r in got], voters.width), np.array([r.y for r in got])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    ids = bounded_labels(labels, "toxic", SAMPLE).persist()
    rows = labelled_texts(docs, ids).persist()
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    entries = induce(spark, rows.where("y = 1"), rows.where("y = 0"), n.get(1, 0), n.get(0, 0))
    voters = Voters(entries)
    free = bounded_rows(docs, SAMPLE).withColumn("y", F.lit(-1))
    x, y = _features(spark, rows.select("text", "y").unionByName(free.select("text", "y")), voters)
    share = labels.where("toxic is not null").where(crc_of_id(F.col("doc_id")) % 5 != 0).agg(F.avg("toxic")).first()[0]
    rows.unpersist()
    ids.unpersist()
    if not len(y):
        return Model(voters, np.zeros(voters.width, np.float32), -3.0)
    votes = x.first(voters.votes)
    share = min(0.9, max(0.01, share if share is not None else 0.05))
    # rows of a class weigh together what the class does among all labels; unlabelled rows as they are
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), np.where(y == 0, (1 - share) / max(1, (y == 0).sum()), 1 / max(1, (y < 0).sum())))
    model = LabelModel(votes, y, weight)
    return Model(voters, *fit_linear(x, model.posterior(votes, y), weight))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.score(part), dtype="float64")

    return F.pandas_udf(score, T.DoubleType())(text)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = docs.select("doc_id", score_column(spark, train(spark, docs, labels), F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that aren't predicted to be toxic."""
    return docs.where(score_column(spark, train(spark, docs, labels), F.col("text")) < THRESHOLD)
