"""License scans: an exact set-similarity join between blocks of texts and license notices.

A text's words are runs of digits, letters and anything outside ASCII, with A-Z lower-cased. A template of n words is sought
in blocks of 2S words at every S words, S being the power of two from n up: each run of S words lies whole in one block.
A template T is found in a block B where at least k = ceil(threshold * |T|) of T's distinct words are in B.

1. Words of the templates are put in one global order, the rarest first, by the number of texts that hold them (a count over
   the whole table; ties by the word). Other words can't be shared with a template and have no place in it.
2. Prefix filter: of k shared words the first in the order is among the first |T| - k + 1 of T. Only blocks that hold
   a prefix word are made; a block is kept as its template words in the global order.
3. Prefixes of blocks and templates meet in an equi-join on the word. Length filter: a block of fewer than k words is no
   candidate. Positional filter: with the shared word at place i of T and j of B, 1 + min(|T| - i, |B| - j) bounds what
   is shared from there on, and has to reach k. The first shared word of a pair that qualifies passes all filters.
4. Candidates are verified on whole sets.

DataFrame functions only. The templates are a bounded table (``MOST_WORDS``, an error beyond it), so their index and
their words' counts may be broadcast or known to the driver; nothing else is. A text's blocks are rows of their own, so neither a long
text nor copies of one meet in one task.

Defined cases: null or empty text has no words, no blocks, score 0 and no labels; repeated rows each give a row; a null doc_id is kept;
other columns of docs aren't read; an empty table gives no rows; templates without words are left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Stored

#: Distinct words that all templates may have together.
MOST_WORDS = 5000
#: The score of a text in which a phrase stands but no template is found.
PHRASE_SCORE = 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    """threshold: the share of the distinct words of text that a block has to hold. One-line notices ask for all of theirs,
    since a word or two is what tells them apart."""

    label: str
    text: str
    threshold: float = 0.8


#: The wording of public license notices.
TEMPLATES = [
    Template("mit", "released under the MIT License", 1.0),
    Template("mit", "licensed under the MIT License", 1.0),
    Template("apache", "licensed under the Apache License, Version 2.0", 1.0),
    Template("gpl", "licensed under the GNU General Public License", 1.0),
    Template("lgpl", "licensed under the GNU Lesser General Public License", 1.0),
    Template("agpl", "licensed under the GNU Affero General Public License", 1.0),
    Template("bsd", "released under the BSD License", 1.0),
    Template("bsd", "licensed under the BSD 3-Clause License", 1.0),
    Template("cc", "licensed under CC BY 4.0", 1.0),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", 1.0),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", 1.0),
    Template("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License", 0.9),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("public-domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]


@dataclass(frozen=True)
class Notice:
    """A template made ready: its distinct words, how many of them a block has to hold, and the step of its blocks."""

    label: str
    words: frozenset[str]
    least: int
    step: int


def notices(templates: list[Template]) -> list[Notice]:
    out = []
    for t in templates:
        words = re.findall(WORD, t.text.translate(str.maketrans(UPPER, LOWER)))
        if words:
            held = frozenset(words)
            out.append(Notice(t.label, held, max(1, math.ceil(t.threshold * len(held) - 1e-9)), 1 << (len(words) - 1).bit_length()))
    if len({w for n in out for w in n.words}) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} distinct words: scan with some of them at a time")
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def global_order(docs: DataFrame, made: list[Notice]) -> list[str]:
    """The templates' words, those in the fewest texts first. At most MOST_WORDS rows come to the driver."""
    vocabulary = sorted({w for n in made for w in n.words})
    # the array is a column before it is searched, so that no rule of the optimizer puts its expression into the search
    held = docs.select(F.explode(F.array(words_of(F.col("text")))).alias("w")).select(F.explode(F.array_intersect(_array(vocabulary), "w")).alias("word"))
    counts = dict(held.groupBy("word").count().collect())
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _places(phrase: str) -> Column:
    """Where a phrase starts, of the places in column at of the words in column w."""
    words = phrase.split()
    return F.filter("at", lambda i: _all([F.get("w", i + k) == F.lit(x) for k, x in enumerate(words)]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def _blocks(step: int, order: list[str], made: list[Notice]) -> Column:
    """The blocks of one step that hold a prefix word: (step, block, words), words being those of templates in the global order."""
    of_step = [n for n in made if n.step == step]
    prefix = sorted({w for n in of_step for w in sorted(n.words, key=order.index)[: len(n.words) - n.least + 1]})
    known = {w for n in of_step for w in n.words}
    ordered = _array([w for w in order if w in known])
    near = F.filter("at", lambda i: F.get("w", i).isin(prefix))
    numbers = F.filter(F.array_distinct(F.flatten(F.transform(near, lambda i: F.array(F.floor(i / step).cast("int"), F.floor(i / step).cast("int") - 1)))), lambda b: b >= 0)
    return F.transform(numbers, lambda b: F.struct(F.lit(step).alias("step"), b.alias("block"), F.array_intersect(ordered, F.slice("w", b * step + 1, 2 * step)).alias("words")))


def prepare(docs: DataFrame, made: list[Notice], order: list[str], phrases: dict[str, str]) -> DataFrame:
    """(row, doc_id, n_words, places, blocks) for every row of docs: where phrases start, by phrase, and the blocks to be joined."""
    steps = sorted({n.step for n in made})
    prefix = {w for n in made for w in sorted(n.words, key=order.index)[: len(n.words) - n.least + 1]}
    marks = sorted(prefix | {p.split()[0] for p in phrases})
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    at = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(marks), i)))
    marked = words.select("row", "doc_id", "w", F.explode(F.array(at)).alias("at"))
    return marked.select(
        "row", "doc_id", F.size("w").cast("long").alias("n_words"),
        F.array(*[_places(p) for p in phrases]).cast("array<array<int>>").alias("places"),
        F.concat(*[_blocks(s, order, made) for s in steps]).alias("blocks"),
    )


def matching_blocks(spark: SparkSession, rows: DataFrame, made: list[Notice], order: list[str]) -> DataFrame:
    """(row, label, template, first_word, block_words, containment) for each pair of block and template that meets the threshold.

    rows: row and blocks, as of ``prepare``. template is the template's number; a notice that stands in two overlapping blocks is found in both.
    """
    index = []
    for k, n in enumerate(made):
        ordered = sorted(n.words, key=order.index)
        index += [(n.step, w, i + 1, k, n.label, n.least, ordered) for i, w in enumerate(ordered[: len(ordered) - n.least + 1])]
    held = F.broadcast(spark.createDataFrame(index, "step int, word string, i int, template int, label string, least int, template_words array<string>"))
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*").where(F.size("words") >= min((n.least for n in made), default=1))
    met = blocks.select("*", F.posexplode("words").alias("j", "word")).join(held, ["step", "word"])
    n_block, n_template, j = F.size("words"), F.size("template_words"), F.col("j") + 1
    met = met.where((n_block >= F.col("least")) & (1 + F.least(n_template - F.col("i"), n_block - j) >= F.col("least")))
    shared = F.size(F.array_intersect("words", "template_words"))
    met = met.withColumn("shared", shared).where("shared >= least")
    # of a pair's shared words that pass the filters the first one answers
    first = F.get(F.array_intersect("template_words", "words"), F.lit(0))
    return met.where(F.col("word") == first).select(
        "row", "label", "template", (F.col("block") * F.col("step")).cast("long").alias("first_word"), (2 * F.col("step")).cast("long").alias("block_words"), (F.col("shared") / n_template).alias("containment")
    )


def scan(spark: SparkSession, docs: DataFrame, templates: list[Template] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    n_base counts the places where phrases stand; first_word and last_word are their least and greatest starts, from 0. base_labels
    and labels are sorted arrays of distinct labels, the second with those of the templates. score: the greatest containment of a
    template that was found; else PHRASE_SCORE where a phrase stands; else 0. notices: (label, template, first_word, block_words,
    containment) of the blocks found, by first_word.
    """
    made, phrases = notices(TEMPLATES if templates is None else templates), PHRASES if phrases is None else phrases
    order = global_order(docs, made)
    rows = Stored(prepare(docs, made, order, phrases)).df
    found = matching_blocks(spark, rows.select("row", "blocks").where(F.size("blocks") > 0), made, order).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("most"),
        F.array_sort(F.collect_list(F.struct("first_word", "template", "label", "block_words", "containment"))).alias("notices"),
    )
    starts = F.flatten("places")
    named = F.transform("places", lambda p, i: F.when(F.size(p) > 0, F.get(_array(list(phrases.values())), i)))
    base = rows.select(
        "row", "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(named))).alias("base_labels"),
    )
    out = base.join(found, "row", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", _array([]))))
    score = F.coalesce("most", F.when(F.col("n_base") > 0, PHRASE_SCORE), F.lit(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), "notices")


def digests(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score"
    )


def oracle_sql() -> str:
    """For DuckDB: every block of every text against every template."""
    made = notices(TEMPLATES)
    table = ", ".join(f"('{n.label}', {n.step}, {n.least}, [{', '.join(f"'{w}'" for w in sorted(n.words))}])" for n in made)
    phrases = ", ".join(f"('{label}', [{', '.join(f"'{w}'" for w in p.split())}])" for p, label in PHRASES.items())
    return rf"""
with templates(label, step, least, words) as (values {table}), phrases(label, words) as (values {phrases}), d as (
  select doc_id, row_number() over () as rid,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents
), places as (
  select rid, label, i from (select rid, w, unnest(range(1, len(w) + 1)) as i from d) join phrases on w[i] = words[1] and w[i : i + len(words) - 1] = words
), base as (
  select rid, count(*) as n, min(i) - 1 as a, max(i) - 1 as z, list_sort(list_distinct(list(label))) as ls from places group by rid
), blocks as (
  select rid, step, w[b * step + 1 : b * step + 2 * step] as block
  from (select rid, w, step, unnest(range(0, (len(w) - 1) // step + 1)) as b from d, (select distinct step from templates) where len(w) > 0)
), found as (
  select rid, label, len(list_intersect(words, block)) / len(words) as c
  from blocks join templates using (step) where len(list_intersect(words, block)) >= least
), best as (
  select rid, max(c) as c, list_distinct(list(label)) as ls from found group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base, cast(a as bigint) as first_word, cast(z as bigint) as last_word,
       coalesce(array_to_string(base.ls, ','), '') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(best.ls, [])))), ',') as labels,
       cast(coalesce(best.c, case when n > 0 then {PHRASE_SCORE} end, 0) as double) as score
from d left join base using (rid) left join best using (rid)
"""
