"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as a whole, ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn, and encoded once with
offsets. The sorted spans of its assistant texts are intersected with the sorted token spans by binary search.

Escaping keeps the template's control strings out of roles and texts: wherever ``<`` and ``|`` stand together or have
only backslashes between them, one backslash more is written; unescaping takes one off. In roles, ``%`` and line feeds
are also written as ``%25`` and ``%0A``. The round trip is exact for every string.

Defined cases: null text or role is empty; turns are ordered by turn, then role, then text, nulls first; repeated rows
are turns of their own; rows with a null conv_id form one conversation; other columns aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END, TAIL = "<|im_start|>", "<|im_end|>", "\n"
LOSS_ROLE = "assistant"
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"
_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As a text, on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of assistant texts in it, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}{TAIL}")
        at += len(out[-1])
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def token_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[int]:
    """1 for every token whose offsets share a character with a span; both lists are sorted and free of overlaps."""
    mask = [0] * len(offsets)
    starts = [a for a, _ in offsets]
    ends = [b for _, b in offsets]
    for a, b in spans:
        if a < b:
            for k in range(bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)):
                mask[k] = int(offsets[k][0] < offsets[k][1])
    return mask


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    return t


def masked_spans(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The characters that the loss falls on: for each span the tokens that meet it, cut to the span and joined up.

    Bytes of one character are tokens with the same offsets; a token across a border counts only inside the span.
    """
    starts, ends, out = [a for a, _ in offsets], [b for _, b in offsets], []
    for a, b in spans:
        first, last = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        at = None
        for k in range(first, last):
            x, y = max(starts[k], a), min(ends[k], b)
            if at is not None and x <= at[1]:
                at = (at[0], max(at[1], y))
            elif x < y:
                out += [at] if at else []
                at = (x, y)
        out += [at] if at else []
    return out


_FORMAT = "conv_id string, formatted string, loss_spans array<array<int>>, n_tokens long, n_loss_tokens long"


#: Characters that are encoded at once; a longer conversation is encoded alone.
CHARS = 1 << 18


def _in_parts(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def format_conversations(conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per conversation: the rendered text, character spans under the loss mask, and token counts.

    A conversation's rows meet in one task as a sorted list; it is the unit of rendering and of a training example.
    tokenizer_path: the driver's path to a tokenizer file, sent to executors by Spark (a few MB); None leaves the token counts null.
    """
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"),
    )
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    # ids go through pandas as text, which has no integers with nulls
    grouped = grouped.select(F.col("conv_id").cast("string").alias("conv_id"), F.expr("transform(rows, r -> r.role)").alias("roles"), F.expr("transform(rows, r -> r.text)").alias("texts"))

    name = None
    if tokenizer_path:
        conversations.sparkSession.sparkContext.addFile(tokenizer_path)
        name = tokenizer_path.rpartition("/")[2]

    def encoded(texts: list[str]) -> Iterator:
        """Offsets of each text, held for CHARS of them at once."""
        for part in _in_parts(texts):
            for e in _tokenizer(SparkFiles.get(name)).encode_batch(part, add_special_tokens=False) if name else [None] * len(part):
                yield None if e is None else e.offsets

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            rendered = [render(list(zip(r, t))) for r, t in zip(part.roles, part.texts)]
            for conv, (text, spans), offsets in zip(part.conv_id, rendered, encoded([x for x, _ in rendered])):
                n = loss = None
                if offsets is not None:
                    mask = token_mask(offsets, spans)
                    n, loss = len(mask), sum(mask)
                    spans = masked_spans(offsets, spans)
                out.append((conv, text, [list(s) for s in spans], n, loss))
            frame = pd.DataFrame(out, columns=["conv_id", "formatted", "loss_spans", "n_tokens", "n_loss_tokens"])
            yield frame.astype({"n_tokens": "Int64", "n_loss_tokens": "Int64"})

    return grouped.mapInPandas(work, _FORMAT).withColumn("conv_id", F.col("conv_id").cast("long"))


def with_odd_one(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All rows, plus conversation -1, whose texts hold the template's own control strings."""
    odd = [(-1, k, role, ODD_TEXT) for k, role in enumerate(("user", "assistant"))]
    extra = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted text: turns, loss text and sizes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for conv, text, spans, n, loss in zip(part.conv_id, part.formatted, part.loss_spans, part.n_tokens, part.n_loss_tokens):
                turns = read_back(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                masked = "".join(unescape(text[a:b]) for a, b in spans)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text), n, loss))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"])
            yield frame.astype({"n_tokens": "Int64", "n_loss_tokens": "Int64"})

    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return formatted.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(work, schema).withColumn("conv_id", F.col("conv_id").cast("long"))


SQL = r"""
with c as (
  select cast(conv_id as bigint) as conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, turn, role, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) as v(turn, role)
), e as (
  select *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as n_text,
         length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g')) as n_role
  from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(n_text + n_role + 24) as bigint) as formatted_chars
from e group by conv_id
"""
