"""The training-data operators against brute force, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import chat, covertree, decontaminate, html_main, maxent, mixing, quality, simhash, tokencount, toxicity
from foliospark.llm.common import Stored, bounded_rows, connected_components, fresh, labelled_texts

rng = random.Random(11)
WORDS = [f"w{k}" for k in range(60)]
LONG = "long " * 40_000
ODD = [(1, None, None, None), (2, "", "en", ""), (3, " \n\t ", "en", "src1"), (4, "Same text here.", "en", "src1"), (5, "Same text here.", "en", "src1"), (5, "Same text here.", "en", "src1"), (6, LONG, "de", "src2"), (None, "no id at all", "fr", "src3")]
DOCS = "doc_id long, text string, lang string, source string"


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("n_words", "score", "fp", "component_id", "domain", "epoch", "n_tokens", "hit_spans", "items", "kept_id", "label", "y")})


def none(spark):
    return spark.createDataFrame([], DOCS)


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def components(ids, linked):
    up = {i: i for i in range(len(ids))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(ids))]


def test_components(spark):
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    nodes = sorted({x for p in pairs for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    want = dict(zip(nodes, components(nodes, [(at[a], at[b]) for a, b in pairs])))
    got = dict(connected_components(spark.createDataFrame(pairs, "u long, v long")).df.collect())
    assert got == {a: r for a, r in want.items() if any(a in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).df.count() == 0


def test_fresh():
    assert fresh(["a", "A_1"], "a") == "a_2"


# 1
def water_fill(caps, weights, budget):
    """By rounds: who is above the cap gets the cap, the rest share what is left."""
    got, left, open_ = dict.fromkeys(caps, 0), budget, set(caps)
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * total <= left * weights[k]}
        if not full:
            for k in open_:
                got[k] = min(left * weights[k] // total, caps[k])
            break
        for k in full:
            got[k] = caps[k]
        left -= sum(caps[k] for k in full)
        open_ -= full
    return got


def test_mix_budgets_and_prefixes(spark):
    mix = mixing.Mix(seed=3, share=(3, 4), max_epochs=2, weights={"domain": {"a": 5, "b": 1}, "lang": {"en": 3}, "source": {"s1": 4}}, domain="case when source in ('s1', 's2') then 'a' else 'b' end")
    rows = [(k, text(rng.randrange(1, 9)), rng.choice(["en", "de"]), rng.choice(["s1", "s1", "s1", "s2", "s3", "s4"])) for k in range(200)]
    tokens, docs, texts = {}, {}, {i: t for i, t, *_ in rows}
    for i, t, lang, s in rows:
        leaf = ("a" if s in ("s1", "s2") else "b", lang, s)
        tokens[leaf] = tokens.get(leaf, 0) + len(t.split())
        docs.setdefault(leaf, []).append((i, len(t.split())))
    cap = {leaf: 2 * n for leaf, n in tokens.items()}
    weight = lambda level, v: mix.weights[level].get(v, 1)
    under = lambda depth, key: sum(c for leaf, c in cap.items() if leaf[:depth] == key)
    budget = {(): sum(tokens.values()) * 3 // 4}
    for depth, level in enumerate(mixing.LEVELS, 1):
        for parent in {leaf[: depth - 1] for leaf in cap}:
            kids = {leaf[:depth] for leaf in cap if leaf[: depth - 1] == parent}
            budget.update(water_fill({k: under(depth, k) for k in kids}, {k: weight(level, k[-1]) for k in kids}, budget[parent]))
    want = Counter()
    for leaf, own in docs.items():
        left, epoch = budget[leaf], 0
        while left > 0:
            whole = min(left // tokens[leaf], 1)
            for i, n in sorted(own, key=lambda d: hashlib.md5(f"3:{epoch}:{d[0]}:{hashlib.md5(texts[d[0]].encode()).hexdigest()}".encode()).hexdigest()):
                if left <= 0:
                    break
                want[i, epoch, min(n, left)] += 1
                left -= min(n, left)
            epoch += 1
            assert whole or left <= 0
    got = mixing.mix_documents(spark.createDataFrame(rows, DOCS), mix)
    assert Counter((r.doc_id, r.epoch, r.tokens_taken) for r in got.collect()) == want


def test_mix_leaves_out_what_has_no_weight(spark):
    rows = [(k, "a b c", "en" if k % 2 else "de", f"s{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_documents(df, mixing.Mix(share=(1, 1), weights={"lang": {"de": 0}, "source": {"s1": -1}})).collect()
    assert {(r.lang, r.source) for r in out} == {("en", "s0"), ("en", "s2")} and sum(r.tokens_taken for r in out) == 180
    assert mixing.mix_documents(df, mixing.Mix(weights={"lang": {"de": 0, "en": 0}})).count() == 0


def test_mix_with_one_id(spark):
    rows = [(None if k % 2 else 5, f"a b c {k}", "en", "s") for k in range(300)]
    out = mixing.mix_documents(spark.createDataFrame(rows, DOCS), mixing.Mix(share=(1, 3))).collect()
    assert sum(r.tokens_taken for r in out) == 400 and len(out) == 100


def test_mix_odd(spark):
    out = mixing.mix_documents(odd(spark)).collect()
    assert out and {"domain", "domain_1", "epoch", "epoch_1"} <= set(out[0].asDict()) and all(r.doc_id not in (1, 2, 3) for r in out)
    assert mixing.mix_documents(none(spark)).count() == 0


# 2
def test_vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 16))
    rows = [b + r.normal(size=16) * s for b in base for s in (0, 0.05, 0.1, 0.2, 0.3) for _ in range(6)]
    rows += [base[0]] * 3
    x = np.array(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    data = [(k, [float(v) for v in row]) for k, row in enumerate(rows)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, [])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(df).collect()}
    comp = components(list(range(len(rows))), [(a, b) for a, b in zip(*np.nonzero(s)) if a < b])
    assert all(got[k] == (s[k].sum() - 1, comp[k], comp[k] == k) for k in range(len(rows)))
    assert all(got[k] == (0, k, True) for k in (900, 901, 902, 903, 906)) and got[904] == (1, 904, True) and got[905] == (1, 904, False)
    assert covertree.near_duplicates(df.limit(0)).count() == 0


# 3
def brute_hits(doc, items, window=10):
    words = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t or "").split(" ") if w]
    w, hit, found = words(doc), set(), set()
    for item, t in items:
        p = words(t)
        n = min(window, len(p))
        for a in range(len(p) - n + 1) if n else ():
            for b in range(len(w) - n + 1):
                if w[b : b + n] == p[a : a + n]:
                    hit.update(range(b, b + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontaminate(spark, monkeypatch):
    few = [f"v{k}" for k in range(4)]
    items = [(k, " ".join(rng.choice(few) for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 14])))) for k in range(25)] + [(30, None), (31, "..."), (32, "Été X9")]
    docs = [(k, " ".join(rng.choice(few) for _ in range(rng.randrange(0, 80)))) for k in range(60)] + [(70, "a ÉTÉ été x9!"), (71, "été X9"), (72, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    check = lambda: {r[0]: tuple(r)[1:] for r in decontaminate.decontaminate(spark, d, b).collect()}
    want = {i: brute_hits(t, [x for x in items if x[1]]) for i, t in docs}
    assert check() == want
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 150)  # several passes
    assert check() == want
    clash = d.withColumns({c: F.lit("x") for c in ("row", "hit_row", "s", "i", "items")})
    kept = decontaminate.drop_contaminated(spark, clash, b)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {k for k, w in want.items() if not w[-1]}


def test_decontaminate_odd(spark):
    bench = spark.createDataFrame([(1, "same text here"), (None, "no id"), (2, "")], "item_id long, text string")
    got = decontaminate.drop_contaminated(spark, odd(spark), bench)
    assert got.columns == odd(spark).columns and Counter(r.doc_id for r in got.collect()) == Counter([1, 2, 3, 6, None])
    assert decontaminate.decontaminate(spark, none(spark), bench).count() == 0
    assert decontaminate.decontaminate(spark, odd(spark), bench.limit(0)).where("contaminated").count() == 0


# 4
def test_language_model(spark):
    line = "the cat sat on the mat and the dog sat on the rug"
    rows = [(k, " ".join(line.split()[rng.randrange(3) :])) for k in range(300)] + [(1000, None), (1001, "unseen Wörter only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in maxent.score_documents(spark, df).collect()}
    teach = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    count = Counter(w for i, t in rows if teach(i) for w in [*(t or "").lower().split(), "\0"])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        own = [*(t or "").lower().split(), "\0"]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not teach(i), len(own), sum(w in count for w in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for i, r in got.items() if r.held_out and i < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)



def test_maxent_looks_frequent_words_up_once(monkeypatch):
    """Words whose counts are at hand stay known however many others come, and all words have the arrays of a word by itself."""
    near = {b"a": 50, b"b": 30, maxent.END: 20, b"rare": 1}
    n = np.ones((maxent.TAILS, maxent.WIDTH))
    voc = maxent.Vocabulary(near, [b"a", b"b", maxent.END], 101, 4, n, n)
    looked, plain = [], maxent.known_of
    monkeypatch.setattr(maxent, "known_of", lambda words: looked.extend(words) or plain(words))
    words = maxent.Words(voc)
    words.arrays([[b"w%d" % k for k in range(150_001)]])
    for text in ([b"a", b"rare", b"new", maxent.END], [b"new", b"b", b"a"]):
        at, ids, classes, members, head, has, logs, _ = words.arrays([text])
        for k, w in enumerate(text):
            assert words.all[at[k]] == w and ids[k] == xxhash.xxh64_intdigest(w) and (head[k], has[k]) == (w in voc.place, w in near)
            assert (classes[k], members[k]) == voc.place.get(w, maxent.tail_place(w)) and math.isclose(logs[k], math.log10(near.get(w, 0) + 1))
    assert len(words) < 10 and all(looked.count(w) == 1 for w in near)
    maxent.Words(voc).arrays([[b"a", b"b"]])
    assert all(looked.count(w) == 1 for w in near)


def test_maxent_counts_touch_what_came():
    """Counting a few tokens makes no table of all rows, and gives their counts whatever the type of the table."""
    import tracemalloc

    r = np.random.default_rng(4)
    rows, outcomes = r.integers(0, 500, (maxent.FEATURES, 3000)), r.integers(0, maxent.WIDTH, 3000)
    for kind in (np.int32, np.float64):
        own = np.zeros(maxent.MEMBER_ROWS * maxent.WIDTH, kind)
        tracemalloc.start()
        maxent.observe([own], (rows,), (outcomes,))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (own == np.bincount((rows * maxent.WIDTH + outcomes).ravel(), minlength=len(own))).all() and most < 1 << 20


def small_model(seed=1):
    near = {b"a": 50, b"b": 30, maxent.END: 20, b"rare": 1}
    n, v = np.zeros((maxent.TAILS, maxent.WIDTH)), np.zeros((maxent.TAILS, maxent.WIDTH))
    c, m = maxent.tail_place(b"rare")
    n[c - maxent.HEADS, m], v[c - maxent.HEADS, m] = 1, 1
    voc = maxent.Vocabulary(near, [b"a", b"b", maxent.END], 101, 4, n, v)
    w = maxent.Weights()
    r = np.random.default_rng(seed)
    w.tables = [r.normal(size=x.shape).astype(np.float32) for x in w.tables]
    return voc, w


def test_language_model_sums_to_one():
    voc, w = small_model()
    words = maxent.Words(voc)
    last = lambda word: maxent.token_logs([[b"a", word]], words, w, voc)[3][-1]
    total = sum(10 ** last(word) for word in (b"a", b"b", maxent.END))
    seen, k = {}, 0
    while len(seen) < maxent.TAILS * maxent.WIDTH:  # a word for each tail member: all of its words, seen ones and the unknown
        word = b"%d" % k + bytes((97 + k % 26, 97 + k // 26 % 26))
        place = maxent.tail_place(word)
        if place not in seen:
            weight = 10 ** voc.tail_log[place[0] - maxent.HEADS, place[1]]
            seen[place] = 10 ** last(word) * weight
        k += 1
    assert math.isclose(total + sum(seen.values()), 1, rel_tol=1e-4)
    place = maxent.tail_place(b"rare")
    assert math.isclose(10 ** last(b"rare"), seen[place] * 2 / 3, rel_tol=1e-5)  # counts 1 and one unknown place: (1 + 1) / (1 + 1 + 1)


def test_gradient_by_finite_differences():
    """came - expected is the slope of the log likelihood; drawn outcomes have the expected counts as their mean."""
    voc, w = small_model(3)
    group = [[b"a", b"b", b"a", maxent.END], [b"b", b"rare", maxent.END]]
    words = maxent.Words(voc)
    _, ids, classes, members, _, _, _, first = words.arrays(group)
    f = maxent.features(ids, first)
    rows = maxent.Weights.rows(f, classes)
    n = len(ids)
    came = [np.zeros(r * maxent.WIDTH) for r in (maxent.ROWS, maxent.MEMBER_ROWS)]
    maxent.observe(came, rows, (classes, members))
    for t, o in ((0, classes), (1, members)):
        mass = w.masses(t, rows[t], classes, voc)
        p = mass / mass.sum(1, keepdims=True)
        expected = np.zeros_like(came[t])
        for k in range(maxent.FEATURES):
            np.add.at(expected.reshape(-1, maxent.WIDTH), rows[t][k], p)
        like = lambda: sum(maxent.token_logs(group, maxent.Words(voc), w, voc)[3]) * math.log(10)
        for k, i in ((0, 0), (1, 1), (2, 2), (4, n - 1)):
            at = (rows[t][k, i], o[i])
            old = w.tables[t][at]
            w.tables[t][at] = old + 0.01
            up = like()
            w.tables[t][at] = old - 0.01
            slope = (up - like()) / 0.02
            w.tables[t][at] = old
            assert math.isclose(slope, came[t].reshape(-1, maxent.WIDTH)[at] - expected.reshape(-1, maxent.WIDTH)[at], abs_tol=0.02)
        r = np.random.default_rng(0)
        drawn = np.stack([np.bincount(maxent.draw(mass[:1].repeat(20_000, 0), r.random(20_000)), minlength=maxent.WIDTH)])[0] / 20_000
        assert np.abs(drawn - p[0]).max() < 0.02


def test_maxent_looks_words_up_once_a_group():
    """Tokens split by Arrow are those of ``tokens_of``, and each distinct word of a group is looked up once."""
    texts = [" A b\x85 a", None, "", "b  \xdf\x1f\xc0\u3000d\t\x0b", "".join(map(chr, range(1, 256))), "b " * 40, "a b a"] * 20
    seen = []

    class Seen(maxent.Words):
        def __getitem__(self, word):
            seen.append(word)
            return super().__getitem__(word)

    words, plain = Seen(small_model()[0]), [maxent.tokens_of(t) for t in texts]
    group = maxent.Texts.of(pa.array(texts))
    at, *known, first = words.arrays(group)
    assert len(seen) == len(set(seen)) and group.sizes.tolist() == [len(t) for t in plain]
    assert [words.all[k] for k in at] == [w for t in plain for w in t]
    assert all((x == y).all() for x, y in zip([*known, first], maxent.Words(words.v).arrays(plain)[1:]))
    runs = list(maxent.grouped(pa.array(texts), 100))
    assert [k for a, b in runs for k in range(a, b)] == list(range(len(texts)))
    assert all(b - a == 1 or sum(len((t or "").encode()) for t in texts[a:b]) <= 100 for a, b in runs)


def test_maxent_takes_no_exp_a_token(monkeypatch):
    """Products of the rows' factors give the scores that sums of weights give."""
    voc, w = small_model(5)
    f, group = maxent.Factors(w, voc), maxent.Texts.of(pa.array(["a b rare new", None, "b b a odd " * 1500]))
    want = maxent.token_logs(group, maxent.Words(voc), w, voc)[3]
    monkeypatch.setattr(maxent.np, "exp", None)
    assert np.allclose(maxent.token_logs(group, maxent.Words(voc), f, voc)[3], want, rtol=1e-5, atol=1e-5)


def test_maxent_word_counts(spark):
    rows = [(k, t) for k, t in enumerate(["A b a", None, "", " b\t\xdf ", "x" * 5000, "a\x85b c"] * 30)] + [(None, "a B")]
    got = {bytes(r.word): r.n for r in maxent.count_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in maxent.tokens_of(t))
    assert maxent.count_words(none(spark)).count() == 0


def test_perplexity_falls_with_every_epoch(spark):
    r = random.Random(2)
    follow = {k: [r.randrange(40) for _ in range(3)] for k in range(40)}

    def walk():
        k, out = r.randrange(40), []
        for _ in range(60):
            out.append(f"w{k}")
            k = r.choice(follow[k])
        return " ".join(out)

    docs = spark.createDataFrame([(k, walk()) for k in range(400)], "doc_id long, text string")
    voc = maxent.vocabulary(maxent.count_words(docs))
    held = [maxent.tokens_of(walk()) for _ in range(60)]
    w, scores = maxent.Weights(), []
    for k in range(4):
        scores.append(maxent.token_logs(held, maxent.Words(voc), w, voc)[3].sum())
        maxent.round_of(spark, docs, voc, w, k, 2)
    assert scores[0] < scores[2] < maxent.token_logs(held, maxent.Words(voc), w, voc)[3].sum()


def test_near_words_are_cut_within_a_step(spark, monkeypatch):
    monkeypatch.setattr(maxent, "NEAR", 1000)
    counts = spark.range(5000).selectExpr("cast(concat('w', id) as binary) as word", "if(id < 10, 500L, 7L) as n")
    v = maxent.vocabulary(counts)
    assert 800 < len(v.near) < 1200 and {b"w%d" % k for k in range(10)} <= set(v.near) and v.total == 10 * 500 + 4990 * 7


def test_language_model_head_has_the_former_size(spark):
    counts = spark.range(3000).selectExpr("cast(concat('w', id) as binary) as word", "3001 - id as n")
    v = maxent.vocabulary(counts)
    assert {b"w%d" % k for k in range(2048)} <= set(v.place)


def test_language_model_odd(spark):
    assert maxent.score_documents(spark, odd(spark)).count() == len(ODD)
    assert maxent.score_documents(spark, none(spark)).count() == 0


# 5
def test_token_counts(spark):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as f:
        scores = tokencount.read_ranks(f.read())

    def brute(word):
        b = word.encode()
        best = [(0.0, 0)] + [None] * len(b)
        for e in range(1, len(b) + 1):
            found = [(best[s][0] + scores[b[s:e]], -best[s][1] - 1) for s in range(e) if b[s:e] in scores]
            top = max(found)
            best[e] = (top[0], -top[1])
        return best[-1][1]

    import regex

    texts = ["The quick brown fox's  tail, 123 times!", "héllo wörld 你好", "a" * 300, text(40), "thethethe thetheme theme them"]
    df = spark.createDataFrame([*enumerate(texts), (9, None), (10, "")], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(spark, df, path, public_tokenizers.PATTERN).collect()}
    assert got == {k: sum(map(brute, regex.findall(public_tokenizers.PATTERN, t))) for k, t in enumerate(texts)} | {9: 0, 10: 0}
    trie = tokencount.Trie(scores)
    assert [trie.count(x) for x in (["abc", "abd"], ["abc"])] == [brute("abc") + brute("abd"), brute("abc")]
    assert len(trie.score) == 1 + len("abc") + len("d")  # shared prefixes are nodes once, whichever call inserts them
    assert tokencount.count_tokens(spark, none(spark), path, public_tokenizers.PATTERN).count() == 0
    assert tokencount.count_tokens(spark, odd(spark), path, public_tokenizers.PATTERN).count() == len(ODD)


# 6
def brute_print(t):
    w = (t or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    texts = [text(rng.randrange(0, 40)) for _ in range(80)]
    for k in range(40):
        near = texts[k].split()
        if near:
            near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [texts[3], texts[3].upper(), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [brute_print(t) for t in texts]
    comp = components(list(range(len(texts))), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert got == {k: (f"{prints[k]:016x}", comp[k]) for k in range(len(texts))}
    kept = simhash.keep_one_of_each(df)
    assert {r.doc_id for r in kept.collect()} == {k for k in range(len(texts)) if comp[k] == k} and kept.columns == df.columns


def test_simhash_ball(spark):
    fps = [0, 1, 3, 7, 1 << 63, (1 << 63) | 5, 0xFFFF]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    fps = Stored(spark.createDataFrame([(x,) for x in signed], "fp long"), {"n": F.count(F.lit(1))})
    got = connected_components(simhash.link_fingerprints(fps)).df.collect()
    assert len(got) == 6


def test_simhash_odd(spark):
    out = simhash.keep_one_of_each(odd(spark))
    assert out.columns == odd(spark).columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "6", "None"]
    assert simhash.near_duplicates(none(spark)).count() == 0 and simhash.keep_one_of_each(none(spark)).count() == 0


def test_one_of_each_is_decided_by_row(spark):
    lines = [" ".join(f"{w}{k}" for k in range(40)) for w in "abcdefg"]
    rows = [(None, lines[0]), (None, lines[1]), (None, lines[2]), (5, lines[3]), (5, lines[4]), (3, lines[4]), (3, lines[4]), (6, lines[5]), (None, lines[5]), (None, lines[6]), (None, lines[6])]
    out = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(None, lines[0]), (None, lines[1]), (None, lines[2]), (5, lines[3]), (3, lines[4]), (6, lines[5]), (None, lines[6])]
    assert Counter(map(tuple, out.collect())) == Counter(want)


# 7 and 10
def labelled(spark, spoil):
    rows, marks = [], []
    for k in range(1200):
        bad = rng.random() < 0.25
        t = f"{text(rng.randrange(20, 60))}. {text(8)}."
        rows.append((k, spoil(t) if bad else t, "en", "s"))
        marks.append((k, int(not bad), int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(out, labels, name):
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", name, "score").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r[name] for r in rows) / len(rows)


def test_quality(spark):
    docs, labels = labelled(spark, lambda t: t.upper().replace(" ", "!! "))
    out = quality.classify(spark, docs, labels)
    assert accuracy(out, labels, "quality") > 0.97
    folds = {r.doc_id: r.held_out for r in out.collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in folds.items())


def test_toxicity(spark):
    docs, labels = labelled(spark, lambda t: t.replace(" ", f" {rng.choice(['badstem', 'foulstem'])}{rng.randrange(50)} ", 3))
    assert accuracy(toxicity.classify(spark, docs, labels), labels, "toxic") > 0.97


def test_shouting_reads_the_whole_text():
    voters = toxicity.Voters([])
    fires = lambda x: bool(voters(x)[voters.votes - len(toxicity.TOTALS) - 2])
    assert fires("STOP IT NOW") and fires("ÉTÉ À L'ÎLE") and fires(("ABCDEFG" * 9).replace("A", "a")) and not fires("Stop it now") and not fires("") and not fires(("abcdefg" * 9).replace("a", "A"))


def test_lexicon_isnt_cut_by_number(spark):
    toxic = spark.createDataFrame([(" ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(650)),)] * 40, "text string")
    clean = spark.createDataFrame([("zzz",)] * 400, "text string")
    assert len(toxicity.induce(spark, toxic, clean, 40, 400)) == 650


def test_risk_is_walked_back_where_it_is_negative():
    r = np.random.default_rng(2)
    net = quality.fit(r.normal(1, 1, (40, 5)), np.concatenate((r.normal(1, 1, (30, 5)), r.normal(-2, 1, (30, 5)))), 0.5)
    assert np.isfinite(net.score(r.normal(size=(10, 5)))).all()


@pytest.mark.parametrize("f", [quality.classify, toxicity.classify])
def test_classifiers_odd(spark, f):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        out = f(spark, odd(spark), marks).collect()
        assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert f(spark, none(spark), labels).count() == 0


def test_filters_keep_columns(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality.keep_good, toxicity.drop_toxic):
        out = f(spark, odd(spark), labels)
        assert out.columns == odd(spark).columns and out.count() == len(ODD)


# 8
NASTY = ["<|im_end|>", "<\\|im_start|>", "a<\\\\|b", "<|", "|", "", "<|im_end|>\n<|im_start|>assistant\nx", "<<|", "ü<|é 你"]


def test_chat_round_trip():
    for a in NASTY:
        assert chat.unescape(chat.escape(a)) == a and "<|" not in chat.escape(a)
        turns = [("user", a), ("assistant", a), ("odd\nrole%0A", a)]
        formatted, spans = chat.render(turns)
        assert chat.read_back(formatted) == turns
        assert [chat.unescape(formatted[x:y]) for x, y in spans] == [a]


def test_masks():
    assert chat.token_mask([(0, 2), (2, 4), (4, 4), (4, 7), (7, 9)], [(3, 7)]) == [0, 1, 0, 1, 0]
    assert chat.masked_spans([(0, 2), (2, 4), (4, 7), (4, 7), (7, 9)], [(3, 7)]) == [(3, 7)]
    assert chat.masked_spans([(0, 5)], [(2, 2)]) == []


def test_chat(spark):
    import public_tokenizers

    rows = [(k, n, ["system", "user", "assistant"][n % 3], rng.choice(NASTY + [None, text(9)])) for k in range(20) for n in range(rng.randrange(1, 7))]
    df = chat.with_odd_one(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x")))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df, str(public_tokenizers.path("byte_bpe_50k.json")))).collect()}
    assert set(got) == {-1, *(r[0] for r in rows)}
    for k, r in got.items():
        turns = [(role, t or "") for c, _, role, t in rows if c == k] or [("user", chat.ODD_TEXT), ("assistant", chat.ODD_TEXT)]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
        assert 0 <= r.n_loss_tokens <= r.n_tokens
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_odd(spark):
    import public_tokenizers

    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (1, 1, None, "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (1, None, "assistant", None), (2, 1, "assistant", "word " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("roles", F.lit("x"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df, str(public_tokenizers.path("byte_bpe_50k.json")))).collect()}
    assert (got[None].n_turns, got[None].loss_chars) == (2, 1) and (got[1].n_turns, got[1].loss_chars) == (4, 2) and got[2].loss_chars == 500_000
    assert [list(map(len, p)) for p in chat._in_parts(["a" * 10, "b" * chat.CHARS, "c", "d"])] == [[10], [chat.CHARS], [1, 1]]


# 9
def test_html(spark):
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; shoulders</h1><p>One&nbsp;two <b>three</b><br>four<p>Five <a href=y>six</a><ul><li>a<li>b</ul><div class=ad>Buy</div><script>var a='</p>';</script></article><section id=comments><p>Nice one</p></section><aside>Side</aside><form>Mail <input></form><footer>&copy; x</footer></body></html>"
    assert html_main.main_text(page) == "Head & shoulders\nOne two three four\nFive six\na\nb"
    plain = "<body><div class=menu><a href=1>a</a></div><div><div class=post><h2>Title</h2><p>A long paragraph with many words in it.</p><p>And one more long paragraph, as good.</p></div></div><div>short</div></body>"
    assert html_main.main_text(plain) == "Title\nA long paragraph with many words in it.\nAnd one more long paragraph, as good."
    assert [html_main.main_text(x) for x in (None, "", "text only", "<p>a<p>b", "<", "<div><span>")] == ["", "", "text only", "a\nb", "<", ""]
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert sorted((str(r.page_id), r.n_chars) for r in html_main.extract(df).collect()) == [("1", 48), ("1", 48), ("2", 0), ("None", 1)]
    assert html_main.extract(df.limit(0)).count() == 0


def test_html_fragments_and_bare_text():
    long = "many words are in here and more " * 16
    full = " ".join(long.split())
    for page in (f"<p>{long}<p>Short closing words.", f"<body><p>{long}<p>Short closing words.", f"<html><body><p>{long}</p><p>Short closing words.</p></body></html>"):
        assert html_main.main_text(page) == f"{full}\nShort closing words."
    assert html_main.main_text(f"Bare <b>words</b> first<p>{long}</p>and last") == f"Bare words first\n{full}\nand last"
    inner = f"<div><div><p>{long}</p><p>{long}</p></div></div>"
    for page in (f"Before <i>it</i>{inner}after", f"<body>Before <i>it</i>{inner}after</body>"):
        assert html_main.main_text(page) == f"Before it\n{full}\n{full}\nafter"


def test_very_deep_page():
    assert html_main.main_text("<div>" * 20_000 + "deep") == "deep"


PARAGRAPH = "This is a long paragraph with many words that say a lot of things about the topic at hand. " * 5
FULL = PARAGRAPH.strip()


def test_links_beside_the_article_go_with_and_without_a_wrapper():
    inner = f"<a href=1>Link one</a> <a href=2>Link two</a> <a href=3>Link three</a><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>Short.</p><a href=x>Older posts</a>"
    for page in (f"<body>{inner}</body>", f"<body><div id=wrap>{inner}</div></body>", f"<body><div><div id=wrap>{inner}</div></div><div><a href=1>More</a></div></body>"):
        assert html_main.main_text(page) == f"{FULL}\n{FULL}\nShort."


def test_names_that_only_look_like_noise_are_kept():
    for name in ("ad-hoc notes", "side-effects", "search-methods", "related-work", "notice"):  # the last holds all the text there is
        assert html_main.main_text(f"<body><div class='{name}'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div></body>") == f"{FULL}\n{FULL}"
    assert html_main.main_text(f"<article><p>{PARAGRAPH}</p><div class='search-methods'><p>{PARAGRAPH}</p></div></article>") == f"{FULL}\n{FULL}"
    page = f"<body><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div class='ad-slot-3'>Buy</div><div id='comment-list'><p>{PARAGRAPH * 9}</p></div></body>"
    assert html_main.main_text(page) == f"{FULL}\n{FULL}"


def test_an_article_keeps_its_links_and_short_parts():
    page = f"<body><nav><a href=1>x</a></nav><article><h1>T</h1><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><p><a href=2>The full report</a></p><div>End.</div></article></body>"
    assert html_main.main_text(page) == f"T\n{FULL}\n{FULL}\nThe full report\nEnd."


def test_no_block_of_the_article_is_lost():
    """Pages without an article element: sections, links and short parts of the article, and what is beside it."""
    two = f"<body><div class='main'><section><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></section><section><h2>Head</h2><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></section></div></body>"
    assert html_main.main_text(two) == "\n".join([FULL] * 3 + ["Head"] + [FULL] * 2)
    three = f"<body><div><section><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></section><section><p>short one</p></section><section><p>{PARAGRAPH}</p></section></div></body>"
    assert html_main.main_text(three) == "\n".join([FULL] * 3 + ["short one", FULL])
    links = f"<body><div><h1>T</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul><p>See <a href=z>this very long link text here</a></p></div></body>"
    assert html_main.main_text(links) == f"T\n{FULL}\n{FULL}\none\ntwo\nSee this very long link text here"
    beside = f"<body><div id='x'><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></div><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div>small print</div></body>"
    assert html_main.main_text(beside) == f"{FULL}\n{FULL}"
    cards = f"<body><h1>T</h1><article>{f'<p>{PARAGRAPH}</p>' * 6}</article><div><p>{PARAGRAPH} about us</p></div><article><p>{PARAGRAPH}</p></article></body>"
    assert html_main.main_text(cards) == "\n".join(["T"] + [FULL] * 7)


def test_names_decide_whatever_the_size():
    story = f"<div><h1>Story</h1><p>{PARAGRAPH}</p></div>"
    assert html_main.main_text(f"<body><div class='cookie-notice'><p>{PARAGRAPH * 9}</p></div>{story}</body>") == f"Story\n{FULL}"
    assert html_main.main_text(f"<body><div class='cookie-notice'><p>{PARAGRAPH}</p></div>{story}</body>") == f"Story\n{FULL}"
    assert html_main.main_text(f"<article><p>{PARAGRAPH}</p><p class='related'>{PARAGRAPH}</p><div class='related'>{PARAGRAPH}</div></article>") == f"{FULL}\n{FULL}"
    assert html_main.main_text(f"<article><p>{PARAGRAPH}</p><p class='advert'>{PARAGRAPH}</p></article>") == FULL
    assert html_main.main_text(f"<body><div class='sidebar content'>{story}</div></body>") == f"Story\n{FULL}"
    assert html_main.main_text(f"<body><div class='notice'><p>{PARAGRAPH}</p></div></body>") == FULL


def test_the_core_has_the_largest_density_sum():
    """Of pages of random nested sections the core by brute force is whole in the text, in order."""
    rng = random.Random(12)

    def section(depth):
        if depth and rng.random() < 0.6:
            return "<div>" + "".join(section(depth - 1) for _ in range(rng.randrange(1, 4))) + "</div>"
        if rng.random() < 0.25:
            return "<ul>" + "".join(f"<li><a href=x>menu{rng.randrange(9)}</a></li>" for _ in range(rng.randrange(2, 6))) + "</ul>"
        return "<section>" + "".join(f"<p>{' '.join('w' + str(rng.randrange(10**6)) for _ in range(rng.randrange(5, 60)))}</p>" for _ in range(rng.randrange(1, 5))) + "</section>"

    for _ in range(60):
        page = f"<body>{''.join(section(3) for _ in range(rng.randrange(1, 4)))}</body>"
        root = html_main.parse(page)
        html_main.prune(root)
        html_main.weigh(root)
        core = max(html_main.nodes_of(root), key=lambda n: n.score)
        if not core.score:
            continue
        want, got = html_main.blocks(core), html_main.main_text(page).split("\n")
        assert [x for x in got if x in set(want)] == want


def test_densities_by_brute_force():
    r = random.Random(4)

    def build(depth):
        out = []
        for _ in range(r.randrange(1, 5)):
            kind = r.choice("ttpdab") if depth else "t"
            out.append(text(r.randrange(1, 9)) if kind == "t" else f"<{kind if kind != 'd' else 'div'} href=x>{build(depth - 1)}</{kind if kind != 'd' else 'div'}>")
        return " ".join(out)

    for _ in range(30):
        root = html_main.parse(f"<div>{build(4)}</div>")
        share = html_main.weigh(root)

        def sums(node, link=False):
            link = link or node.name == "a"
            got = [0, 0, 0, int(node.name == "a")]
            for p in node.parts:
                if isinstance(p, str):
                    n = len("".join(p.split()))
                    got = [got[0] + n, got[1], got[2] + n * link, got[3]]
                else:
                    c = sums(p, link)
                    got = [got[0] + c[0], got[1] + c[1] + 1, got[2] + c[2], got[3] + c[3]]
            return got

        everything = sums(root)
        assert math.isclose(share, everything[2] / max(1, everything[0]))
        for node in html_main.nodes_of(root):
            c, t, lc, lt = sums(node)
            if any(n.name == "a" for n in iter(lambda a=[node]: a.__setitem__(0, a[0].parent) or a[0], None)):
                continue  # inside a link the link's characters count from the link on
            base = max(2, math.log(c / max(1, c - lc) * lc + share * c + math.e))
            want = c / max(1, t) * max(0, math.log(c / max(1, lc) * max(1, t) / max(1, lt), base)) if c else 0
            assert math.isclose(node.density, want, abs_tol=1e-9)


def test_hostile_pages_take_linear_time():
    import time

    n = 20_000
    html_main.main_text("<div>" * 1000)
    began = time.process_time()
    for page in ("<div>" * n + "</b>" * n, "<a " * n, '<a x="' * n, "<div>" * n + "<li>" * n, "<b>" * n + "<hr>" * n, "<a x='" * n + ">", "<table>" * n + "<td>" * n, "<!--" * n):
        html_main.main_text(page)
    assert time.process_time() - began < 30  # quadratic, each would take minutes


def test_traversal_prunes_and_loses_nothing():
    r = np.random.default_rng(6)
    centres = r.normal(size=(150, 24))
    x = np.concatenate([c + r.normal(size=(20, 24)) * s for c, s in zip(centres, r.choice([0.01, 0.1, 0.2], 150))])
    x = covertree.unit_rows(list(x))
    eps = covertree.chord(0.95)
    tree = covertree.Tree(x[::3])
    leaf, near = tree.nearest(x)
    assert np.allclose(near[:, -1], np.linalg.norm(x - tree.centres[-1][leaf], axis=1), atol=1e-6)
    leaves = np.unique(leaf)
    tree.cover(leaves, np.stack([near[leaf == k].max(0) for k in leaves]))
    for level, centres in enumerate(tree.centres):  # every vector is inside each of its ancestors' radii
        up = tree.above[level][leaf]
        assert (np.linalg.norm(x - centres[up], axis=1) <= tree.radii[level][up] + 1e-6).all()
    live, visited = tree.pairs(eps)
    close = x @ x.T >= 0.95
    assert all(live[leaf[i], leaf[j]] for i, j in zip(*np.nonzero(close)))
    assert live.sum() < 0.2 * len(leaves) ** 2 and visited < 0.5 * len(leaves) ** 2 / 2
    found = covertree.links_within(x, leaf, np.zeros(len(x), int), (0, 0), np.ones(len(x), int), live, 0.95)
    assert (found.count == close.sum(1) - 1).all() and found.compared < 0.1 * len(x) ** 2 / 2
    # the same in one ball that holds everything, which has to find its own levels
    alone = covertree.Links(x, np.ones(len(x), int), 0.95)
    whole = alone.ball(np.arange(len(x)))
    alone.meet(whole, whole)
    assert (alone.count == found.count).all() and (alone.labels == found.labels).all()


def test_vectors_odd(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (7, [-1.0, 0.001]), (None, None)]
    got = sorted(map(str, map(tuple, covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())))
    want = [(1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (None, 2, 1, False), (None, 1, 7, False), (7, 1, 7, True), (None, 0, None, True)]
    assert got == sorted(map(str, want))


def test_prior_is_estimated_without_negatives():
    r = np.random.default_rng(8)
    draw = lambda n, at: r.normal(at, 1, (n, 6))
    for share in (0.3, 0.6, 0.85):
        unlabelled = np.concatenate((draw(int(6000 * share), 1.5), draw(int(6000 * (1 - share)), -1.5)))
        r.shuffle(unlabelled)
        assert abs(quality.estimate_prior(draw(4000, 1.5), unlabelled) - share) < 0.06
    assert quality.estimate_prior(draw(5, 0), draw(5, 0)) == 0.5


def test_risk_gradient_by_finite_differences():
    r = np.random.default_rng(9)
    xp, xu, prior = r.normal(1, 1, (30, 4)), r.normal(-1, 1, (40, 4)), 0.4
    net = quality.Network(np.concatenate((xp, xu)), r)

    def risk():
        fp, fu = net.output(xp), net.output(xu)
        return prior * np.logaddexp(0, -fp).mean() + np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()

    fp, fu = net.output(xp), net.output(xu)
    up, down_p, down_u = -prior * quality.sigmoid(-fp) / len(fp), -prior * quality.sigmoid(fp) / len(fp), quality.sigmoid(fu) / len(fu)
    slopes = [a + b for a, b in zip(net.gradient(xp, up + down_p), net.gradient(xu, down_u))]
    for p, g in zip(net.p, slopes):
        for at in list(np.ndindex(p.shape))[:6]:
            old = p[at]
            p[at] = old + 1e-5
            more = risk()
            p[at] = old - 1e-5
            assert math.isclose((more - risk()) / 2e-5, g[at], abs_tol=1e-6)
            p[at] = old


def test_label_model_finds_rates_and_bad_labels():
    r = np.random.default_rng(10)
    y = r.random(4000) < 0.2
    rate1, rate0 = np.array([0.9, 0.8, 0.7, 0.6, 0.5]), np.array([0.02, 0.05, 0.1, 0.02, 0.2])
    votes = (r.random((4000, 5)) < np.where(y[:, None], rate1, rate0)).astype(float)
    votes = np.column_stack((votes, votes[:, 0]))  # one voter twice: its evidence counts once
    known = np.where(r.random(4000) < 0.3, np.where(r.random(4000) < 0.05, ~y, y), -1).astype(int)
    model = toxicity.LabelModel(votes, known)
    assert np.abs(model.rate1[:5] - rate1).max() < 0.06 and np.abs(model.rate0[:5] - rate0).max() < 0.06 and abs(model.prior - 0.2) < 0.03
    assert model.correlation[0, 5] > 0.9 and model.weight[0] < 0.6 < model.weight[3]
    assert abs(model.labeller[0] - 0.95) < 0.05 and abs(model.labeller[1] - 0.05) < 0.05
    q = model.posterior(votes, known)
    assert ((q > 0.5) == y).mean() > 0.95
    # brute force: Bayes' rule row by row
    for k in range(0, 4000, 400):
        logit = math.log(model.prior / (1 - model.prior))
        for v, a, b, w in zip(votes[k], model.rate1, model.rate0, model.weight):
            logit += w * (math.log(a / b) if v else math.log((1 - a) / (1 - b)))
        a, b = model.labeller
        logit += math.log(a / b) if known[k] == 1 else math.log((1 - a) / (1 - b)) if known[k] == 0 else 0
        assert math.isclose(q[k], 1 / (1 + math.exp(-logit)), rel_tol=1e-9)


def test_samples_are_of_rows(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert 800 < bounded_rows(docs, 1000).count() < 1200
    same = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one").alias("text"))
    assert bounded_rows(same, 1000).count() <= 1
    ids = spark.createDataFrame([(3, 1)], "doc_id long, y int")
    many = same.withColumn("text", F.rand(1).cast("string"))
    assert labelled_texts(many, ids).count() == 1


def test_linear_fit_by_dense_gradient():
    r = np.random.default_rng(12)
    dense = np.where(r.random((200, 7)) < 0.4, r.integers(1, 4, (200, 7)), 0).astype(np.float32)
    places = [np.flatnonzero(row).astype(np.int32) for row in dense]
    x = toxicity.Sparse([p.tobytes() for p in places], [row[p].astype(np.float16).tobytes() for row, p in zip(dense, places)], 7)
    by = r.normal(size=200)
    assert np.allclose(x @ np.arange(7.0), dense @ np.arange(7.0)) and np.allclose(x.summed(by), dense.T @ by, atol=1e-6) and np.allclose(x.first(3), dense[:, :3])
    q = quality.sigmoid(dense @ np.array([2, -1, 0, 1, 0, -2, 0.5]) - 1)
    w, b = toxicity.fit_linear(x, q, np.ones(200))
    assert np.abs(quality.sigmoid(dense @ w + b) - q).mean() < 0.03
