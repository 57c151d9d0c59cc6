"""License scans, the Merkle manifest and importance resampling against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.llm import licenses, merkle, resample
from foliospark.llm.common import numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans(licenses.UPPER, licenses.LOWER)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long word " * 30_000
ODD = [(1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t ", "en", "src1", 4), (4, "Same text here.", "en", "src1", 15), (5, "Same text here.", "", "src1", 15), (5, "Same text here.", "", "src1", 15), (6, LONG + "MIT License", "de", "src2", 9), (None, "no id, Apache License", "fr", "src3", None), (None, None, None, None, None), (7, "ǅ 𝕏 word " * 30, "zz", "s", 2**63 - 1)]


def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("row", "w", "at", "g", "node", "position", "score", "rank", "weight", "labels", "id", "key", "path", "n_words", "block")})


def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_numbered(spark):
    rng = random.Random(1)
    data = [(rng.choice("aabbc"), rng.randrange(40), k % 7) for k in range(500)] + [("hot", 3, 3)] * 300
    df = spark.createDataFrame(data, "grp string, k int, extra int").repartition(5)
    want = []
    for g in {x[0] for x in data}:
        want += [(g, k, p) for p, k in enumerate(sorted(x[1] for x in data if x[0] == g))]
    assert sorted(map(tuple, numbered(df, ["k"], "grp").select("grp", "k", "position").collect())) == sorted(want)
    assert [r.position for r in numbered(df, ["k", "extra"]).orderBy("k", "extra", "position").collect()] == list(range(800))
    assert numbered(df.where("k < 0"), ["k"], "grp").count() == 0


# 11
def brute_scan(text, templates, phrases):
    words = WORD.findall((text or "").translate(ASCII))
    starts = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    found = []
    for n in licenses.notices(templates):
        for b in range(0, len(words), n.step):
            share = len(n.words & set(words[b : b + 2 * n.step]))
            if share >= n.least:
                found.append((share / len(n.words), n.label))
    labels = sorted({x for _, x in starts} | {x for _, x in found})
    score = max((s for s, _ in found), default=licenses.PHRASE_SCORE if starts else 0.0)
    at = [k for k, _ in starts]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in starts})), ",".join(labels), score


@pytest.mark.parametrize("templates", [licenses.TEMPLATES, [licenses.Template("x", "a b c d e", 0.6), licenses.Template("y", "c d e f g h i j", 0.5), licenses.Template("z", "a a a", 1.0), licenses.Template("none", " .. ")]])
def test_license_scan(spark, templates):
    rng = random.Random(3)
    vocabulary = [w for n in licenses.notices(templates) for w in n.words] + ["mit", "license", "general", "public", "apache", "filler", "über"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(90))) for _ in range(60)] + [None, "", "MIT License mit license", LONG[:3000] + licenses.TEMPLATES[-1].text]
    for t in templates:
        cut = t.text.split()
        texts += ["before " * rng.randrange(300) + " ".join(w for w in cut if rng.random() < p) + " after" * rng.randrange(300) for p in (0.7, 0.85, 1.0)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.digests(licenses.scan(spark, df, templates)).collect()}
    assert got == {k: brute_scan(x, templates, licenses.PHRASES) for k, x in enumerate(texts)}


def test_license_cases(spark):
    mine = "Copyright 2020 Somebody\n" + licenses.TEMPLATES[12].text.upper().replace(" ", "\n # ") + "\nTHE SOFTWARE IS PROVIDED"
    df = spark.createDataFrame([(1, "x " * 5000 + mine), (2, "Licensed under CC BY-NC 4.0."), (3, "The license of a driver, granted free of charge."), (4, "under the Apache license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(spark, df).collect()}
    assert (got[1].labels, got[1].n_base, got[1].score) == (["mit"], 0, 1.0) and any(x.first_word + x.block_words > 5000 for x in got[1].notices)
    assert got[2].labels == ["cc", "cc-by-nc"] and got[3].labels == [] and got[3].score == 0
    assert (got[4].base_labels, got[4].labels, got[4].score, got[4].first_word) == (["apache"], ["apache"], licenses.PHRASE_SCORE, 2)
    with pytest.raises(ValueError):
        licenses.notices([licenses.Template("big", " ".join(f"w{k}" for k in range(licenses.MOST_WORDS + 1)))])


def test_license_odd_input(spark):
    got = licenses.digests(licenses.scan(spark, odd(spark)))
    want = sorted(((i, *brute_scan(x, licenses.TEMPLATES, licenses.PHRASES)) for i, x, *_ in ODD), key=repr)
    assert rows(got, *got.columns) == want
    assert licenses.scan(spark, none(spark)).count() == 0


# 12
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """The root, and for each leaf its siblings and the fold of another leaf with them."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[k : k + 2]) for k in range(0, len(now), 2)])
    paths = []
    for k in range(len(leaves)):
        path = []
        for depth, level in enumerate(levels[:-1]):
            at = k >> depth
            path.append((at % 2 == 1, level[at ^ 1] if at ^ 1 < len(level) else None))
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(docs):
    def leaf(d, more=0):
        i, text, lang, source, n = d
        n = n if n is None or n + more >= 2**63 else n + more
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    groups = {}
    for d in docs:
        groups.setdefault(("" if d[2] is None else "=" + d[2]).encode(), []).append(d)
    trees = {}
    for g, ds in groups.items():
        ds.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[g] = (ds, *brute_tree([leaf(d) for d in ds]))
    order = sorted(trees)
    root, tops = brute_tree([trees[g][1] for g in order])
    out = []
    for g, top in zip(order, tops):
        ds, subroot, paths = trees[g]
        for d, path in zip(ds, paths):
            whole = path + top
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            node = leaf(d, 1 if hit else 0)
            for left, x in whole:
                node = sha(node) if x is None else sha(x, node) if left else sha(node, x)
            out.append((d[0], leaf(d), subroot, root, sha(*[x for _, x in whole if x]), node, node == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 33])
@pytest.mark.parametrize("subtree", [1, 2, 3, 9])
def test_traversal(n, subtree):
    leaves = [sha(str(k)) for k in range(n)]
    root, paths = brute_tree(leaves)
    height = (n - 1).bit_length()
    steps = merkle.traverse([x.encode() for x in leaves], height, subtree)
    assert next(steps)[0].decode() == root
    assert [[x and x.decode() for x in path] for path in steps] == [[x for _, x in path] for path in paths]


def test_traversal_of_a_block_below_others():
    """A block with few leaves in a tree of more levels: its last node goes up alone."""
    steps = merkle.traverse([b"a", b"b", b"c"], 4, 2)
    up = sha(sha(sha(sha("a", "b"), sha("c"))))
    assert next(steps)[0].decode() == up and [len(p) for p in steps] == [4, 4, 4]


@pytest.mark.parametrize(("height", "subtree"), [(1, 1), (2, 1), (3, 2), (10, 4)])
def test_manifest(spark, height, subtree):
    rng = random.Random(height)
    docs = [(k * 3, f"text {k}", rng.choice(["en", "en", "en", "de", "é", None]), rng.choice(["a", None]), rng.choice([None, k])) for k in range(90)] + [(600, "one", "xx", "s", 1)]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert rows(merkle.tamper_check(df, height, subtree), *COLUMNS) == brute_manifest(docs)


def test_manifest_odd_input(spark):
    assert rows(merkle.tamper_check(odd(spark), 2, 1), *COLUMNS) == brute_manifest(ODD)
    assert merkle.tamper_check(none(spark)).count() == 0
    lone = spark.createDataFrame([(5, "x", "en", "s", 1)], DOCS)
    assert rows(merkle.tamper_check(lone), *COLUMNS) == brute_manifest([(5, "x", "en", "s", 1)])
    ids = spark.createDataFrame([("b", "x", "en", "s", 1), ("a", "y", "en", "s", 1)], DOCS.replace("doc_id long", "doc_id string"))
    assert [r.doc_id for r in merkle.manifest(ids).orderBy("position").collect()] == ["a", "b"]


def test_verify(spark):
    docs = [(k, f"t{k}", "en" if k % 3 else "de", "s", k) for k in range(20)]
    df = spark.createDataFrame(docs, DOCS)
    held = merkle.manifest(df, ["source"])
    assert held.where("source = 's'").count() == 20
    later = df.withColumn("text", F.when(F.col("doc_id") == 4, "changed").otherwise(F.col("text"))).where("doc_id <> 7")
    assert {r.doc_id for r in merkle.verify(later, held).where("not verified").collect()} == {4, 7}


# 13
def brute_resample(docs, target, draw):
    def features(text):
        words = WORD.findall((text or "").translate(ASCII))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % draw.buckets for n in range(1, draw.n_words + 1) for k in range(len(words) - n + 1)]

    s, t = [0] * draw.buckets, [0] * draw.buckets
    for texts, into in ((docs, s), (target, t)):
        for _, text in texts:
            for b in features(text)[1]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + draw.buckets) / ((x + 1) * (sum(t) + draw.buckets)))) for x, y in zip(s, t)]
    scored = []
    for i, text in docs:
        n, fs = features(text)
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    can = sorted((x for x in scored if x[4] >= draw.least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    k = draw.percent * len(can) // 100
    ranks = {id(x): r for r, x in enumerate(can[:k], 1)}
    return sorted(((*x[:4], ranks.get(id(x))) for x in scored), key=repr)


@pytest.mark.parametrize("draw", [resample.Draw(), resample.Draw(percent=50, least_words=3), resample.Draw(n_words=2, buckets=64, percent=33, least_words=1), resample.Draw(percent=100, least_words=0), resample.Draw(percent=0)])
def test_resample(spark, draw):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(50)] + ["É", "x1"]
    docs = [(k * 7 - 500, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for k in range(300)]
    target = [(k, " ".join(rng.choice(vocabulary[:10]) for _ in range(30))) for k in range(20)]
    df = lambda xs: spark.createDataFrame(xs, "doc_id long, text string")
    got = resample.resample(spark, df(docs).repartition(4), df(target), draw, ["doc_id"])
    assert rows(got, "doc_id", "n_features", "weight", "score", "rank") == brute_resample(docs, target, draw)


def test_kth_key(spark):
    rng = random.Random(2)
    keys = sorted({"".join(rng.choice("0123456789ABCDEF") for _ in range(rng.choice((3, 9, 9, 20)))) + " " for _ in range(300)} | {"7" * 30 + f"{k:04X}" for k in range(200)})
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for k in (1, 2, 150, 300, len(keys)):
        assert resample.kth_key(df, "key", k, keys[0], keys[-1]) == keys[k - 1]


def test_resample_odd_input(spark):
    draw = resample.Draw(percent=60, least_words=0)
    got = resample.resample(spark, odd(spark), none(spark), draw)
    assert {"rank_1", "score_1", "weight_1", "text"} <= set(got.columns)
    assert rows(got.withColumnRenamed("rank_1", "r"), "doc_id", "n_features") == sorted(((i, len(WORD.findall((x or "").translate(ASCII)))) for i, x, *_ in ODD), key=repr)
    assert sorted(r.rank_1 for r in got.where("rank_1 is not null").collect()) == list(range(1, 7))
    assert resample.resample(spark, none(spark), none(spark)).count() == 0
    # equal rows, and equal scores by id: exactly as many as are due
    same = spark.createDataFrame([(1, "a b c")] * 30 + [(1, "c b a")] * 10, "doc_id long, text string")
    assert sorted(r.rank for r in resample.resample(spark, same, same, resample.Draw(percent=50, least_words=1)).where("rank is not null").collect()) == list(range(1, 21))
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    assert resample.resample(spark, named, same, resample.Draw(percent=100, least_words=1)).where("rank is not null").count() == 3
