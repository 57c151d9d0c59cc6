"""Token counts under a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens by the vocabulary's public pattern. A pre-token's tokens are the segmentation of its bytes
into vocabulary entries with the largest sum of scores (ties: the fewest tokens; sums are of doubles in the order of the
text, so sums that differ in their last bits are no ties). A task's distinct pre-tokens go into one trie, and the forward
score at a byte is computed once for all pre-tokens that share the prefix up to it; a terminal keeps its token count.

The vocabulary is a file of ranks (base64 of the token's bytes, a space, the rank); the score of rank r is the log of
its share under Zipf's law, -log(r + 1) - log(sum of 1 / (k + 1)). All 256 bytes are entries, so every text has a count.

Defined cases: null or empty text has no tokens; no rows give no rows; every row gives a row, repeated ones too; other columns aren't read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trie nodes kept in a task (some 300 bytes each); beyond that the trie starts anew, so that memory is bounded.
NODES = 1_000_000


def read_ranks(raw: bytes) -> dict[bytes, float]:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary has no entries for {len(missing)} bytes")
    return {t: -math.log(r + 1) - total for t, r in ranks.items()}


class Trie:
    """A node for each prefix of the pre-tokens so far, with the prefix's best score and the tokens that reach it.

    A pre-token walks down its prefixes; the forward step is only made for nodes that are new. Terminals keep their node,
    and so their count.
    """

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        ends: dict[int, set[int]] = {}
        for token in scores:
            ends.setdefault(token[-1], set()).add(len(token))
        self.sizes = [sorted(ends[b]) for b in range(256)]
        self.clear()

    def clear(self) -> None:
        self.kids: dict[int, int] = {}  # node * 256 + byte -> node
        self.score, self.tokens = [0.0], [0]
        self.terminals: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The word's terminal."""
        raw, node, way = word.encode(), 0, [0]
        kids, score, tokens, get = self.kids, self.score, self.tokens, self.scores.get
        for end, byte in enumerate(raw, 1):
            key = node * 256 + byte
            node = kids.get(key, -1)
            if node < 0:
                best, n = -math.inf, 0
                for size in self.sizes[byte]:
                    if size > end:
                        break
                    s = get(raw[end - size : end])
                    if s is not None:
                        before = way[end - size]
                        s += score[before]
                        k = tokens[before] + 1
                        if s > best or s == best and k < n:
                            best, n = s, k
                node = kids[key] = len(score)
                score.append(best)
                tokens.append(n)
            way.append(node)
        self.terminals[word] = node
        return node

    def count(self, words: list[str]) -> int:
        if len(self.score) > NODES:
            self.clear()
        at, tokens, insert, total = self.terminals.get, self.tokens, self.insert, 0
        for word in words:
            node = at(word)
            total += tokens[insert(word) if node is None else node]
        return total


@lru_cache(maxsize=2)
def _scores(name: str) -> dict[bytes, float]:
    with open(SparkFiles.get(name), "rb") as f:
        return read_ranks(f.read())


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_bytes for every row. Runs where the rows are; nothing is shuffled.

    vocabulary: the driver's path to the file of ranks, sent to executors by Spark (a few MB, of fixed size).
    """
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rpartition("/")[2]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        cut, trie = regex.compile(pattern).findall, Trie(_scores(name))
        for part in batches:
            texts = [x or "" for x in part.text]
            n, pre = [], []
            for text in texts:
                words = cut(text)
                pre.append(len(words))
                n.append(trie.count(words))
            yield pd.DataFrame({"doc_id": part.doc_id, "n_tokens": n, "n_pretokens": pre, "n_bytes": [len(x.encode()) for x in texts]})

    # ids go through pandas as text, which has no integers with nulls
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return slim.mapInPandas(work, "doc_id string, n_tokens long, n_pretokens long, n_bytes long").withColumn("doc_id", F.col("doc_id").cast("long"))
