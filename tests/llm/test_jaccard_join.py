import os
import random
import re

import numpy as np
import pytest

from kinfold.llm import jaccard_join as J
from kinfold.llm._common import WordIds
from kinfold.llm.jaccard_join import Threshold, components, jaccard_components, one_of_each_group, shingles, signature, tile_keys
from kinfold.sources.shared import scratch, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute(docs, n, percent):
    """{id: (size, smallest id reached)} by comparing all pairs."""
    sets = [(d, sets_of(t, n)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), top(d)) for d, s in sets}


def corpus(seed, n_bases=14, copies=9):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(r.choice(words) for _ in range(18))
    out = []
    for _ in range(n_bases):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 4, 7, 9, 10, 12, 20, 35, 60, 150, 400]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                at = r.randrange(len(own) + 1)
                if r.random() < 0.5:
                    own.insert(at, r.choice(words))
                elif len(own) > 1:
                    own.pop(min(at, len(own) - 1))
            text = (line + "\n" if r.random() < 0.3 else "") + " ".join(own)
            out.append(text.upper() if r.random() < 0.1 else text)
    r.shuffle(out)
    return list(enumerate(out)) + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "Ünique ÜNIQUE"), (9005, "ünique ünique")]


@pytest.mark.parametrize("seed,words,percent", [(1, 3, 90), (2, 5, 80), (4, 2, 60)])
def test_against_brute_force(spark, seed, words, percent):
    docs = corpus(seed)
    rule = Threshold(words=words, percent=percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), rule=rule).collect()}
    assert got == brute(docs, words, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_tile(percent):
    rule, r = Threshold(words=3, percent=percent), np.random.default_rng(5)
    bands = rule.bands()
    for _ in range(1500):
        n = int(r.choice([1, 2, 3, 5, 8, 9, 10, 11, 15, 19, 20, 40, 90, 300]))
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        y = x.copy()
        for _ in range(int(r.integers(0, max(1, n // 4) + 1))):
            y = np.append(y, r.integers(0, 2**64, 1, dtype=np.uint64)) if r.random() < 0.5 else np.delete(y, r.integers(0, len(y))) if len(y) > 1 else y
        y = np.unique(y)
        shared = len(np.intersect1d(x, y))
        off = np.bitwise_count(np.frombuffer(signature(x), np.uint64) ^ np.frombuffer(signature(y), np.uint64)).sum()
        assert off <= len(x) + len(y) - 2 * shared
        if 100 * shared >= percent * (len(x) + len(y) - shared):
            assert len(np.intersect1d(tile_keys(x, rule, bands), tile_keys(y, rule, bands)))


def test_shingles_equal_sets():
    texts = ["a b c d", "A B c D", "a b", "a", "", " x\ty\x0bz ", "a a a a a"]
    got = shingles(texts, 3, WordIds())
    assert [len(g) for g in got] == [len(sets_of(t, 3)) for t in texts]
    assert (got[0] == got[1]).all()


def test_hot_tiles_are_compared_in_blocks(spark, monkeypatch):
    import kinfold.llm.jaccard_join as j

    monkeypatch.setattr(j, "BLOCK", 3)
    docs = corpus(7, n_bases=4, copies=30)
    rule = Threshold(words=3, percent=90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), rule=rule).collect()}
    assert got == brute(docs, 3, 90)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 3)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_nulls_repeats_clashing_columns_and_empty(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (2, "a b c d e f", None), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tiles string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 3), (True, 0, None)]
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (True, 0)]
    assert jaccard_components(df.filter("false")).count() == 0


def test_an_id_with_a_copy_and_another_text(spark):
    """Document 5 has the text of 3, and one that 7 nearly has; 10 has those of 3 and 9. All are one component."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    a, b = words(1, 60), words(2, 60)
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b + " end"), (8, a), (9, words(3, 60)), (10, a), (10, words(3, 60)), (11, words(4, 60))], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_components(df, rule=Threshold(words=3, percent=90)).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (8, 3), (9, 3), (10, 3), (11, 11)}


def test_wide_bitmaps_bound_the_difference():
    """Parities of any two lengths of bitmap differ in no more places than the sets."""
    r = np.random.default_rng(5)
    for n, m in ((1100, 1100), (1500, 5000), (9000, 9100), (40_000, 2000)):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: min(n, m) * 9 // 10], r.integers(0, 1 << 63, max(1, m - min(n, m) * 9 // 10)).astype(np.uint64)])
        apart = len(np.setxor1d(a, b))
        assert J.wide_differ(J.wide_signature(a), J.wide_signature(b)) <= apart
        if n == m:
            c = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            assert J.wide_differ(J.wide_signature(a), J.wide_signature(c)) > J.Threshold().differ(len(a), len(c))
    assert J.wide_signature(a[:1000]) == b""


def test_very_long_texts_and_one_dominant_component(spark, monkeypatch):
    """Copies with small changes of a long text, two long texts that share a passage, and a tile of one large component and a stranger."""
    monkeypatch.setattr(J, "BLOCK", 8)
    r = np.random.default_rng(2)
    long = [f"w{x}" for x in r.integers(0, 10**6, 20_000)]
    near = [*long[:5000], "other", *long[5001:]]
    far = [f"v{x}" for x in r.integers(0, 10**6, 18_000)] + long[:2000]
    hot = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega " * 2
    texts = [" ".join(long), " ".join(near), " ".join(far)] + [hot + f"tail{i}" for i in range(40)] + [hot.replace("alpha", "aleph").replace("kappa", "kaph")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in J.jaccard_components(df).collect()}
    want = brute([(i, t) for i, t in enumerate(texts)], 5, 80)
    assert got == {d: c for d, (_, c) in want.items()}
    kept = sorted(x.doc_id for x in J.one_of_each_group(df).collect())
    assert kept == sorted(set(got.values()))


def test_many_sets_with_copies_are_dealt_by_salt(spark, monkeypatch):
    rows = [(i, f"text number {i % 7} of some words that many have") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x.doc_id: x.component_id for x in J.jaccard_components(df).collect()}
    monkeypatch.setattr(J, "SENT_ROWS", 0)
    assert {x.doc_id: x.component_id for x in J.jaccard_components(df).collect()} == want == {i: i % 7 for i, _ in rows}


def test_stored_tables_go(spark):
    folder = lambda: set(os.listdir(f"{shared_dir(spark)}/kinfold"))
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    J.jaccard_components(df).collect()
    before = folder()
    with scratch(spark, everything=True):
        assert J.jaccard_components(df).count() == 2
        assert len(folder() - before) <= 3  # what the result reads
    assert folder() == before
