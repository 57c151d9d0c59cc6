"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels.quality = 1) and unlabelled web text are each sampled up to ``SAMPLE`` rows. A network with one
hidden layer over shape statistics of the whole text minimises the non-negative unbiased risk (Kiryo et al., 2017)
    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)]),
whose class prior is estimated from the positives and the unlabelled text alone (see ``estimate_prior``). A last step fits two
numbers, scale and offset of the network's output, on the training labels, so that scores are probabilities.

Held-out rows (crc32 of doc_id mod 5 is 0) teach nothing. Language, source, id and labels are no inputs.

Defined cases: null or empty text has a score like any other (its statistics are zeros); without labels or without
documents every score is the prior, 0.5 if that is unknown; repeated rows each give a row; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import bounded_labels, bounded_rows, crc_of_id, labelled_texts, sigmoid

#: Bounds of the training sample: rows of trusted positives, of unlabelled text, and labelled rows for the last step.
SAMPLE = 8000
THRESHOLD = 0.3
_HIDDEN, _STEPS, _BATCH = 24, 1500, 512

# Kinds of bytes. 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 other mark,
# 7 outside ASCII, 8 control.
_KIND = np.array(
    [
        0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b in b"\n\r" else 3 if b in b" \t"
        else 5 if b in b".,;:?'\"-()" else 7 if b >= 128 else 6 if 33 <= b <= 126 else 8
        for b in range(256)
    ],
    np.uint8,
)
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_RUN = 100


def statistics(text: str | None) -> np.ndarray:
    """Shape of a text: shares of kinds of bytes, of their pairs and of marks, and of repeated words and lines."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    n = len(raw)
    pairs, marks, more = np.zeros(81), np.zeros(len(_MARKS)), np.zeros(14)
    if n:
        kinds = _KIND[raw]
        pairs = np.bincount(kinds[:-1] * np.uint8(9) + kinds[1:], minlength=81)[:81] / n
        marks = np.bincount(raw, minlength=256)[_MARKS] / n
        words = (text or "").split()
        lines = [x for x in (text or "").split("\n") if x]
        if words:
            sizes = np.fromiter(map(len, words), np.float64, len(words))
            fresh = [len(set(words[a : a + _RUN])) / len(words[a : a + _RUN]) for a in range(0, len(words), _RUN)]
            same = sum(a == b for a, b in zip(words, words[1:]))
            more[:8] = (
                math.log1p(len(words)) / 10, sizes.mean() / 10, sizes.std() / 10, np.mean(fresh), min(fresh), same / len(words),
                sum(w.isupper() for w in words) / len(words), sum(not w[-1:].isalnum() for w in words) / len(words),
            )
            more[8:11] = sum(not w.isalpha() for w in words) / len(words), len(set(words)) / len(words), sizes.max() > 40
        if lines:
            more[11:] = math.log1p(len(lines)) / 10, 1 - len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)) / 10
    shares = np.concatenate((pairs, marks))
    return np.concatenate((np.sqrt(shares), np.minimum(shares * 10, 3), more)).astype(np.float32)


_WIDTH = len(statistics(""))


def sample_statistics(rows: DataFrame) -> np.ndarray:
    """Statistics of a bounded table (text, y): one array row each, y last; computed where the rows are."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"x": [statistics(t).tobytes() for t in part.text], "y": part.y})

    got = rows.select("text", "y").mapInPandas(work, "x binary, y int").collect()
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(-1, _WIDTH)
    return np.column_stack((x, [r.y for r in got])) if len(got) else np.zeros((0, _WIDTH + 1), np.float32)


class Network:
    """Standardised inputs, one hidden layer of tanh, one output."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.p = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], _HIDDEN)), np.zeros(_HIDDEN), rng.normal(0, 0.3, _HIDDEN), np.zeros(1)]
        self.a, self.b = 1.0, 0.0

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return x, np.tanh(x @ self.p[0] + self.p[1])

    def output(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.p[2] + self.p[3]

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        x, h = self.hidden(x)
        back = slope[:, None] * self.p[2] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.output(x) + self.b)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> Network:
    """Minimises the non-negative risk with the logistic loss by Adam."""
    rng = np.random.default_rng(seed)
    net = Network(np.concatenate((positive, unlabelled)), rng)
    m = [np.zeros_like(p) for p in net.p]
    v = [np.zeros_like(p) for p in net.p]
    for step in range(1, _STEPS + 1):
        xp = positive[rng.integers(0, len(positive), _BATCH)]
        xu = unlabelled[rng.integers(0, len(unlabelled), _BATCH)]
        fp, fu = net.output(xp), net.output(xu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up = -prior * sigmoid(-fp) / len(fp)
        down_p, down_u = -prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
        if negative >= 0:
            slope_p, slope_u = up + down_p, down_u
        else:  # the negative part has been overfitted: it is walked back
            slope_p, slope_u = -down_p, -down_u
        g = [a + b + 1e-4 * p for a, b, p in zip(net.gradient(xp, slope_p), net.gradient(xu, slope_u), net.p)]
        rate = 0.01 * (1 - step / (_STEPS + 1))
        for k, gk in enumerate(g):
            m[k] += 0.1 * (gk - m[k])
            v[k] += 0.001 * (gk * gk - v[k])
            net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows, as mixture proportion: unlabelled = share * positive + (1 - share) * negative.

    Where a score is over t, unlabelled rows are at least share times as frequent as positives, and where only positives
    are, just that: the share is the least of P_unlabelled(score > t) / P_positive(score > t), each with one standard error
    more. The score is a linear discriminant fitted on one half of the rows; the ratios are those of the other half.
    """
    half = lambda x: (x[::2], x[1::2])
    (p0, p1), (u0, u1) = half(positive), half(unlabelled)
    if min(map(len, (p0, p1, u0, u1))) < 20:
        return 0.5
    both = np.concatenate((p0, u0)).astype(np.float64)
    centre, scale = both.mean(0), both.std(0) + 1e-3
    z = np.clip((both - centre) / scale, -6, 6)
    gap = z[: len(p0)].mean(0) - z[len(p0) :].mean(0)
    w = np.linalg.solve(np.cov(z.T) + 0.1 * np.eye(z.shape[1]), gap)
    sp, su = (np.clip((x - centre) / scale, -6, 6) @ w for x in (p1, u1))
    best = 1.0
    for t in np.quantile(sp, np.linspace(0, 0.9, 46)):
        a, b = (sp > t).mean(), (su > t).mean()
        if a > 0:
            best = min(best, (b + math.sqrt(b * (1 - b) / len(su))) / a * (1 + math.sqrt((1 - a) / (a * len(sp)))))
    return float(np.clip(best, 0.05, 0.95))


def calibrate(net: Network, x: np.ndarray, y: np.ndarray, share: float) -> None:
    """Scale and offset of the output by weighted logistic regression; classes weigh as they do among all labels."""
    f = net.output(x)
    f = (f - f.mean()) / (s := f.std() + 1e-6)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    a, b = 1.0, math.log(share / (1 - share))
    for _ in range(50):
        p = sigmoid(a * f + b)
        g = np.array([(weight * (p - y) * f).sum() + 1e-4 * a, (weight * (p - y)).sum()])
        d = weight * p * (1 - p)
        h = np.array([[(d * f * f).sum() + 1e-4, (d * f).sum()], [(d * f).sum(), d.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    net.a, net.b = a / s, b - a * net.output(x).mean() / s


def train(docs: DataFrame, labels: DataFrame) -> Network | float:
    """The network; or a constant score where there is too little to learn from."""
    known = labels.where("quality is not null and doc_id is not null").where(crc_of_id(F.col("doc_id")) % 5 != 0)
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not n:
        return 0.5
    prior = (ones + 1) / (n + 2)
    labelled = sample_statistics(labelled_texts(docs, bounded_labels(labels, "quality", SAMPLE)))
    unlabelled = sample_statistics(bounded_rows(docs, SAMPLE).withColumn("y", F.lit(-1)))
    x, y = labelled[:, :-1], labelled[:, -1]
    if not (y == 1).any() or not len(unlabelled):
        return prior
    net = fit(x[y == 1], unlabelled[:, :-1], estimate_prior(x[y == 1], unlabelled[:, :-1]))
    if (y == 0).any():
        calibrate(net, x, y, prior)
    return net


def score_column(spark: SparkSession, model: Network | float, text: Column) -> Column:
    if isinstance(model, float):
        return F.lit(model)
    shared = spark.sparkContext.broadcast(model)

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            x = np.stack([statistics(t) for t in part]) if len(part) else np.zeros((0, _WIDTH))
            yield pd.Series(shared.value.score(x), dtype="float64")

    return F.pandas_udf(score, T.DoubleType())(text)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(docs, labels)
    scored = docs.select("doc_id", score_column(spark, model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that aren't predicted to be of low quality."""
    return docs.where(score_column(spark, train(docs, labels), F.col("text")) >= THRESHOLD)
