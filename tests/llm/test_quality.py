import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinfold.llm._common import WordIds
from kinfold.llm.quality_classifier import Fit, bradley_terry, features, fit_quality, score_quality
from kinfold.llm.quality_rules import Rules, kept_documents, measure, op8_quality_rules, quality_rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, covered, seen, dup = len(w), set(), set(), 0
    windows = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    for i in range(n - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    rep = len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, n < 20 or 100 * rep > 30 * n


TEXTS = [None, "", " \n\t", "a", "a b\na b\n a b", "x " * 500, "w1 w2 w3 w4 w5 w6 w7 w8 " * 2 + "z", "é ü ü x y", "| a | b #*$%&<>", "\n".join(["same line here"] * 9), "r\r\nr\r\nr", "long " * 100 + "x" * 100_000]


def test_base_columns_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in op8_quality_rules(spark, small).collect()}
    assert got == {r.doc_id: brute(r.text) for r in rows}
    m = measure([t or "" for t in TEXTS], Rules(), WordIds())
    for i, t in enumerate(TEXTS):
        assert tuple(m[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(t), t


def brute_repetition(t, rules=Rules()):
    """(dup_line_chars, dup_ngram_chars, top_ngram_chars, kept) by counting."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    chars = max(1, sum(map(len, w)))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += len(line) if line in seen else 0
            seen.add(line)
    shares = {}
    for n in {n for n, _ in (*rules.duplicate_ngrams, *rules.top_ngrams)}:
        runs = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        inside = {j for i in range(len(w) - n + 1) if runs[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        top = max((sum(map(len, g)) * c for g, c in runs.items() if c >= rules.top_ngram_times), default=0)
        shares[n] = (sum(len(w[j]) for j in inside) / chars, top / chars)
    line = dup / max(1, len(t))
    failed = line > rules.duplicate_line_chars or len(re.findall(r"[#*$%&|<>]", t)) > rules.symbols_per_word * len(w)
    failed |= any(shares[n][0] > most for n, most in rules.duplicate_ngrams) or any(shares[n][1] > most for n, most in rules.top_ngrams)
    return line, max(shares[n][0] for n, _ in rules.duplicate_ngrams), max(shares[n][1] for n, _ in rules.top_ngrams), not failed and not brute(t)[-1]


def test_repetition_columns_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op8_quality_rules(spark, small).collect()}
    for r in rows:
        o, want = got[r.doc_id], brute_repetition(r.text)
        assert (o.dup_line_chars, o.dup_ngram_chars, o.top_ngram_chars) == pytest.approx(want[:3]) and o.kept == want[3], r.doc_id
    long = "one two three four five six " * 3 + " ".join(f"w{i}" for i in range(30_000)) + " one two three four"
    texts = [*TEXTS, long]
    m = measure([t or "" for t in texts], Rules(), WordIds())
    for i, t in enumerate(texts):
        want = brute_repetition(t)
        assert tuple(m[c][i] for c in ("dup_line_chars", "dup_ngram_chars", "top_ngram_chars")) == pytest.approx(want[:3]) and m["kept"][i] == want[3], (t or "")[:40]


def test_small_word_memory_changes_nothing():
    texts = ["alpha beta gamma " * 20, "one two three four five six seven eight nine ten " * 3]
    few, many = WordIds(1), WordIds()
    for t in texts * 2:
        a, b = measure([t], Rules(), few), measure([t], Rules(), many)
        assert all((a[k] == b[k]).all() for k in a)


def test_rules_keep_clean_documents_and_drop_junk(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op8_quality_rules(spark, small).collect()}
    clean = [got[d].kept for d, q in labels.items() if q == 1 and not got[d].base_failed]
    junk = [got[d].kept for d, q in labels.items() if q == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.05


def test_columns_survive(spark):
    df = spark.createDataFrame([(i, t, "mine", i) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, kept string, __index long")
    assert quality_rules(df).count() == 2 * len(TEXTS)
    kept = kept_documents(df)
    assert kept.columns == df.columns
    assert quality_rules(df.filter("false")).count() == 0


def test_pairwise_ranking_recovers_an_order():
    r = np.random.default_rng(0)
    x = r.standard_normal((2000, 5))
    label = (x @ np.array([2, -1, 0, 0, 0.5]) + 0.3 * r.standard_normal(2000) > -1).astype(int)
    m = bradley_terry(x, label, Fit())
    s = m.score(x)
    assert ((s >= 0) & (s <= 1)).all() and ((s >= 0.3) == label).mean() > 0.94
    order = np.argsort(m.raw(x))
    assert (np.diff(s[order]) >= 0).all()
    one = bradley_terry(x, np.ones(2000, int), Fit())
    assert (one.score(x) == 0.5).all()


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = fit_quality(docs, labels)
    return docs, labels, model, {r.doc_id: r for r in score_quality(docs, model).collect()}


def test_classifier_on_held_out_rows(scored):
    docs, labels, _, got = scored
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def slow_features(t):
    """The features of one text, from its definition."""
    n, chars, symbols, lines, again, _ = brute(t)
    line, dup, top, _ = brute_repetition(t)
    b = t.encode()
    upper, lower = sum(65 <= x <= 90 for x in b), sum(97 <= x <= 122 for x in b)
    words, share = max(n, 1), lambda x: min(x**0.5, 1.5)
    out = [np.log1p(n) / 5, min(n, 20) / 20, min(max(chars, 1) / words, 20) / 10, share(symbols / words), share(lines / (b.count(b"\n") + 1)), again / words, line, dup, min(top, 1.5)]
    out += [share(upper / max(upper + lower, 1)), share(sum(48 <= x <= 57 for x in b) / max(len(b), 1)), min(b.count(b"\n") / words, 1), min(b.count(b" ") / words, 2), float(n == 0)]
    out += [share(b.count(bytes([x])) / words) for x in b"|#*$%&<>!?.,;:"]
    return np.array([*out, dup > 0.3, line > 0.3, symbols > 0.25 * words, upper > 0.5 * (upper + lower)], float)


def test_scores_against_a_plain_scorer(spark, scored):
    docs, _, model, got = scored
    want = lambda t: 1 / (1 + np.exp(-np.clip((((slow_features(t or "") - model.mean) / model.scale) @ model.w - model.cut) * model.steep + np.log(0.3 / 0.7), -40, 40)))
    for r in docs.orderBy("doc_id").limit(150).collect():
        assert got[r.doc_id].score == pytest.approx(want(r.text), abs=1e-9)
    odd = [*TEXTS, "Some words. " * 20_000]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert {r.doc_id: r.score for r in score_quality(df, model).collect()} == pytest.approx({i: want(t) for i, t in enumerate(odd)}, abs=1e-9)


def test_classifier_ignores_held_out_labels_and_odd_rows(spark, scored):
    docs, labels, model, got = scored
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(fit_quality(docs, flipped).w, model.w)
    odd = spark.createDataFrame([(1, None, 2.0), (None, "x", 1.0), (1, "", 3.0), (1, "", 3.0)], "doc_id long, text string, score double")
    out = score_quality(odd, model).collect()
    assert len(out) == 4 and len({r.score for r in out if r.doc_id == 1}) == 1
    assert score_quality(odd.filter("false"), model).count() == 0
    assert (fit_quality(docs, labels.filter("false")).score(np.zeros((2, len(model.w)))) == 0.5).all()


def test_classifier_learns_from_every_labelled_row(spark):
    """Few and many rows in a group, as one array has it; no row is left out of the model, and places are exact."""
    from kinfold.llm import quality_classifier as Q

    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["good", "words", "of", "a", "text.", "#", "$$"], int(r.integers(1, 60)), p=p)) for p in ([0.19] * 5 + [0.025] * 2, [0.1] * 5 + [0.25] * 2) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(120)], "doc_id long, quality int")
    train = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    x, y = features([texts[i] for i in train], WordIds()), np.array([int(i < 80) for i in train])
    for fit in (Fit(), Fit(rare=8, most=1, groups=3, few=5)):
        model = fit_quality(docs, labels, fit=fit)
        assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(np.where(x.std(0) < 1e-9, 1, x.std(0)))
        s, order = model.raw(x), np.sort(model.raw(x))
        assert model.cut == pytest.approx((order[(y == 0).sum() - 1] + order[(y == 0).sum()]) / 2)
        assert model.steep == pytest.approx(8 / (np.median(s[y == 1]) - np.median(s[y == 0])))
        one = bradley_terry(x, y, fit)
        if fit == Fit():
            assert model.w == pytest.approx(one.w, rel=1e-2, abs=1e-2)
    for good, bad in ((7, 3), (3, 7), (1, 20)):
        z = np.arange(good + bad, dtype=float)[:, None]
        d = list(Q.differences(z, np.arange(good + bad) < good, 2))
        assert len(d) == min(2, good, bad) and all(len(k) == max(good, bad) for k in d)
