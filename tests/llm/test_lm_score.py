import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinfold.llm._ctw import Model, climb, deepest, descend, estimate, grams_of, log_gamma
from kinfold.llm.lm_score import Tree, op3_lm_score, score_texts, token_bytes, words_at


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute_base(docs, train):
    c = Counter(x for _, t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return {d: (len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) for d, t in docs}


def brute_tree(train, depth):
    """A recursive context-tree weighting: {(context, bits)} to counts, then predictions by definition."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for t in train:
        b = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(b)):
            for bit in range(8):
                node = (1 << bit) | (b[i] >> (8 - bit))
                for d in range(depth + 1):
                    counts[b[i - d : i], node][(b[i] >> (7 - bit)) & 1] += 1
                    if d:
                        children[b[i - d + 1 : i], node].add(b[i - d : i])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, node):
        own = kt(*counts[ctx, node])
        if len(ctx) == depth:
            return own, 1.0
        below = sum(weighted(c, node)[0] for c in children[ctx, node])
        w = math.log(0.5) + np.logaddexp(own, below)
        return w, math.exp(math.log(0.5) + own - w)

    def p1(ctx, node, least):
        sure, left = 0.0, 1.0
        for d in range(depth + 1):
            own = ctx[len(ctx) - d :]
            a, b = counts[own, node] if (own, node) in counts else (0, 0)
            if d == 0 and a + b == 0:
                return 0.5
            now = sure + left * (b + 0.5) / (a + b + 1)
            nxt = ctx[len(ctx) - d - 1 :]
            if d == depth or (nxt, node) not in counts or sum(counts[nxt, node]) < least:
                return now
            beta = weighted(own, node)[1]
            sure, left = sure + left * beta * (b + 0.5) / (a + b + 1), left * (1 - beta)

    def score(t, least):
        b, out = b"\xff" * depth + t + b"\xff", 0.0
        for i in range(depth, len(b)):
            for bit in range(8):
                p = p1(b[i - depth : i], (1 << bit) | (b[i] >> (8 - bit)), least)
                out += math.log10(p if (b[i] >> (7 - bit)) & 1 else 1 - p)
        return out

    return score


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 300.0, 1e7])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-9)
    assert np.allclose(estimate(np.array([1.0]), np.array([1.0])), math.log(1 / 8))


def test_grams_of():
    g, sizes = grams_of([b"ab", b"", b"c"], 2)
    assert sizes.tolist() == [3, 1, 2]
    assert [int(x).to_bytes(3, "big") for x in g] == [b"\xff\xffa", b"\xffab", b"ab\xff", b"\xff\xff\xff", b"\xff\xffc", b"\xffc\xff"]


@pytest.mark.parametrize("least", [1, 3])
def test_spark_tree_against_recursive_definition(spark, least):
    train = ["abracadabra", "abra kadabra é", "cabana", "", "aa"]
    docs = [(i, t) for i, t in enumerate([*train, "abba", "zzz", "ü"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(df, df.filter(f"doc_id < {len(train)}"), tree=Tree(depth=3, least=least)).collect()}
    score = brute_tree([t.encode() for t in train], 3)
    for d, t in docs:
        assert abs(got[d] - score(t.encode(), least)) < 1e-4 * max(1, abs(got[d])), t


@pytest.mark.parametrize("hot", [0, 30, 1_000_000])
def test_no_node_is_lost_to_what_goes_to_all_tasks(spark, hot):
    train = ["abracadabra " * 3, "abra kadabra é", "cabana", "", "aa"]
    docs = [(i, t) for i, t in enumerate([*train, "abba", "zzz abra", "ü"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(df, df.filter(f"doc_id < {len(train)}"), tree=Tree(depth=3, hot_grams=hot)).collect()}
    score = brute_tree([t.encode() for t in train], 3)
    for d, t in docs:
        assert abs(got[d] - score(t.encode(), 2)) < 1e-4 * max(1, abs(got[d])), t


def test_probabilities_sum_to_one():
    g, c = np.unique(grams_of([b"the cat sat on the mat", b"that hat"], 3)[0], return_counts=True)
    keys, p = [], []
    for bit in range(8):
        tiers, _ = climb(*deepest(g, c, bit), 3, 0)
        k, _, q, _ = descend(tiers, np.zeros(len(tiers[-1][1])), np.ones(len(tiers[-1][1])))
        keys.append(k), p.append(q)
    m = Model(np.concatenate(keys), np.concatenate(p), 3)
    for ctx in (b"the", b"xyz", b"\xff\xff\xff", b"at "):
        all_next = (np.uint64(int.from_bytes(ctx, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10.0 ** m.byte_log(all_next)).sum() - 1) < 1e-5
        assert np.allclose(m.log(all_next), m.byte_log(all_next)) and np.allclose(m.log(all_next), m.byte_log(all_next))


@pytest.mark.parametrize("hot", [0, 50, 1_000_000])
def test_base_against_brute_force(spark, small, hot):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    train = [(d, t) for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    ids = [d for d, _ in train]
    got = {r.doc_id: r for r in score_texts(df, df.filter(df.doc_id.isin(ids)), tree=Tree(depth=2, hot_words=hot)).collect()}
    want = brute_base(docs, train)
    assert got.keys() == want.keys()
    for d, (n, known, total, base) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))


def test_query_beats_the_base_on_held_out_rows(spark):
    rows = op3_lm_score(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a b", 7), (2, "x " * 50_000, 8), (2, "x " * 50_000, 8)], "doc_id long, text string, score int")
    out = score_texts(df, df, tree=Tree(depth=2)).collect()
    assert len(out) == 5 and len({(r.doc_id, r.score) for r in out}) == 3
    none = score_texts(df, df.filter("false"), tree=Tree(depth=2)).collect()
    assert len(none) == 5 and all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert all(abs(r.score + 8 * math.log10(2)) < 1e-9 for r in none if r.n_tokens == 1)
    assert score_texts(df.filter("false"), df).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_beats_the_base_on_small_corpora(spark, sf):
    held = [r for r in op3_lm_score(spark, f"/root/testdata/{sf}").collect() if r.held_out]
    assert all(math.isfinite(r.score) for r in held) and sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("hot_words, hot_grams", [(0, 0), (3, 20), (1000, 1_000_000)])
def test_spelling_is_what_unknown_words_cost(spark, hot_words, hot_grams):
    train = ["abracadabra abra", "abra kadabra é", "cabana", "", "aa abra"]
    docs = [(i, t) for i, t in enumerate([*train, " abba  abra zzz", "zzz zzz", "ü\n", "zaa aa"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(df, df.filter(f"doc_id < {len(train)}"), tree=Tree(depth=3, hot_words=hot_words, hot_grams=hot_grams)).collect()}
    g, c = np.unique(grams_of([t.encode() for t in train], 3)[0], return_counts=True)
    nodes, known = [], set(" ".join(train).split())
    for bit in range(8):
        tiers, _ = climb(*deepest(g, c, bit), 3, 0)
        k, n, p, _ = descend(tiers, np.zeros(len(tiers[-1][1])), np.ones(len(tiers[-1][1])))
        keep = (n >= 2) | (k < np.uint64(1 << 60))
        nodes.append((k[keep], p[keep]))
    model = Model(*map(np.concatenate, zip(*nodes)), 3)
    for d, t in docs:
        b = t.encode()
        cost = model.byte_log(grams_of([b], 3)[0])
        want = sum(sum(cost[m.start() : m.end()]) for m in re.finditer(rb"\S+\s*", b) if m.group().strip().decode() not in known)
        assert abs(got[d].spelling - want) < 1e-3 and abs(got[d].score - sum(cost)) < 1e-3 and got[d].train_once == 5, t


def test_words_at():
    g, sizes = grams_of([b" a  b", b"", b"cd "], 2)
    assert words_at(g, np.repeat(np.arange(3), sizes), np.array([2, 0, 1])).tolist() == [-1, 0, 0, 0, 1, -1, -1, 2, 2, 2, -1]


def test_a_bit_that_always_was_one_may_be_none():
    n = np.array([1e9])
    keys, _, p, _ = descend([(0, np.array([1], np.uint64), n, n, np.ones(1), None)], np.zeros(1), np.ones(1))
    m = Model(keys, p, 0)
    assert np.isfinite(m.byte_log(np.array([0, 255], np.uint64))).all()


def test_token_bytes():
    assert token_bytes(" A\tBÉ\n\n c\u00a0d ") == "a bÉ c\u00a0d".encode() and token_bytes(" ") == b""
