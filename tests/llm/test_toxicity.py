import zlib

import numpy as np
import pytest

from kinfold.llm import toxicity as T
from kinfold.llm.toxicity import Inputs, Net, backward, fit_toxicity, forward, score_texts, score_toxicity, sigmoid, start_params, train, windows_of, word_codes, word_inputs

TINY = Net(window=6, step=3, word_buckets=64, gram_buckets=128, hidden=3, attention=2, word_dims=2, char_dims=2)


def test_windows_cover_every_word():
    for n in range(1, 70):
        w = windows_of(n, TINY)
        assert {i for s in w for i in range(s, min(n, s + TINY.window))} == set(range(n))
        assert all(b - a <= TINY.step for a, b in zip(w, w[1:]))


def test_word_codes():
    a = word_codes([b"Idiot!!", b"idiot", b"...", b"x"], TINY)
    assert a[0][0] == a[0][1] and len(a[2]) == 4
    one, two = (a[1][a[2][i] : a[2][i + 1]] for i in (0, 1))
    assert (one == two).all() and a[1][a[2][2]] == 0


def test_gradients_against_differences():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in start_params(TINY).items()}
    gates, mask = r.standard_normal((6, 4, 18)), np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    want = np.array([1.0, 0, 1, 0])
    loss = lambda g=gates: float(np.sum(np.logaddexp(0, z := forward(p, g, mask)) - want * z))
    run = forward(p, gates, mask, keep=True)
    d = backward(p, run, gates, mask, sigmoid(run[0]) - want)
    for name in ("uf", "ub", "wa", "ba", "va", "wo", "bo"):
        at = tuple(r.integers(0, n) for n in p[name].shape)
        old, eps = p[name][at], 1e-2
        p[name][at] = old + eps
        up = loss()
        p[name][at] = old - eps
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * eps) - d[name][at]) < 2e-3, name
    g = gates.copy()
    g[2, 1, 4] += 1e-2
    up = loss(g)
    g[2, 1, 4] -= 2e-2
    assert abs((up - loss(g)) / 2e-2 - d["gates"][2, 1, 4]) < 2e-3


def test_scores_do_not_depend_on_company():
    p = train(["good fine text"] * 5 + ["bad awful text"] * 5, np.array([0] * 5 + [1] * 5), TINY)
    texts = ["good fine", "", "awful " * 50, "bad text é", "\n \t"]
    together = score_texts(Inputs(p, TINY), texts, TINY)
    alone = np.concatenate([score_texts(Inputs(p, TINY, most=0), [t], TINY) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and ((together >= 0) & (together <= 1)).all()
    assert together[2] > together[0]


def slow_score(p, text, net):
    """The network word by word and window by window, in plain loops."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    words = text.encode().split()
    if not words:
        logits = [-8.0]
    else:
        x = []
        for w in words:
            code, grams, _ = word_codes([w], net)
            x.append(np.r_[p["words"][code[0]], p["chars"][grams].mean(0), p["word_odds"][code[0]], p["char_odds"][grams].max()])
        h, logits = net.hidden, []
        for start in windows_of(len(words), net):
            own = x[start : start + net.window]
            both = []
            for u, at, order in ((p["uf"], 0, range(len(own))), (p["ub"], 3 * h, range(len(own) - 1, -1, -1))):
                s, states = np.zeros(h), {}
                for i in order:
                    g = (own[i] @ p["wx"] + p["bx"])[at : at + 3 * h]
                    r = s @ u
                    z, a = sig(g[:h] + r[:h]), sig(g[h : 2 * h] + r[h : 2 * h])
                    s = z * s + (1 - z) * np.tanh(g[2 * h :] + a * r[2 * h :])
                    states[i] = s
                both.append(states)
            states = np.array([np.r_[both[0][i], both[1][i]] for i in range(len(own))])
            e = np.exp(np.tanh(states @ p["wa"] + p["ba"]) @ p["va"])
            logits.append(float((e / e.sum()) @ states @ p["wo"] + p["bo"][0]))
    top, mean, n = min(max(max(logits), -8), 8), float(np.mean([sig(v) for v in logits])), np.log(len(logits))
    level = np.log((mean + 0.01) / (1.01 - mean))
    z = np.array([top / 4, level, n, level * n / 4, 1]) @ p["read"]
    return sig((z - p["cut"][0]) * p["cut"][1] + np.log(net.cut_score / (1 - net.cut_score)))


def test_scores_against_a_plain_network():
    p = train(["good fine text and so on"] * 6 + ["bad awful text of hate"] * 6, np.array([0] * 6 + [1] * 6), TINY)
    texts = ["", " \n", "good", "bad awful", "Fine, FINE text! é", "x " * 5, "good text " * 300 + "awful hate " + "fine " * 700, "x" * 5000]
    got = score_texts(Inputs(p, TINY), texts, TINY)
    assert np.allclose(got, [slow_score(p, t, TINY) for t in texts], atol=1e-4)


def test_the_network_learns_without_counted_odds(monkeypatch, scored):
    """With the counted log-odds at 0 the recurrences alone tell most held-out texts apart."""
    docs, labels, params, got = scored
    monkeypatch.setattr(T, "_odds", lambda parts, label, size: np.zeros(size, np.float32))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    own = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    fit, held = [d for d in sorted(own) if not got[d].held_out], [d for d in sorted(own) if got[d].held_out]
    net, y = Net(epochs=8), np.array([own[d] for d in held])
    p = train([text[d] for d in fit], np.array([own[d] for d in fit]), net)
    assert not p["word_odds"].any() and not p["char_odds"].any()

    def area(s):
        rank = np.argsort(np.argsort(s))
        return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())

    def odds(t):
        code, grams, starts = word_codes(t.encode().split() or [b""], net)
        return np.maximum(params["word_odds"][code], np.maximum.reduceat(params["char_odds"][grams], starts)).max()

    alone, counted = area(score_texts(Inputs(p, net), [text[d] for d in held], net)), area(np.array([odds(text[d]) for d in held]))
    both = area(np.array([got[d].score for d in held]))
    assert alone > 0.9 and both > 0.95 and both > counted + 0.1


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"  # smaller tables have too few toxic texts to learn from
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    params = fit_toxicity(docs, labels)
    return docs, labels, params, {r.doc_id: r for r in score_toxicity(docs, params).collect()}


def test_held_out_accuracy(scored):
    docs, labels, _, got = scored
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p for t, p in held if t == 0]) < 0.05
    assert np.mean([p for t, p in held if t == 1]) > 0.7  # of some 300 toxic texts to learn from; the more, the better


def test_a_toxic_passage_in_a_long_text_counts(scored):
    """Held-out toxic texts inside long clean ones are seen, whatever stands around them, and clean ones alone are not."""
    docs, labels, params, got = scored
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    held = [r for r in labels.collect() if got[r.doc_id].held_out]
    clean = [text[r.doc_id] for r in held if r.toxic == 0 and len(text[r.doc_id].split()) > 60][:40]
    toxic = [text[r.doc_id] for r in held if r.toxic == 1 and got[r.doc_id].predicted][:10]
    score = lambda texts: score_texts(Inputs(params, Net()), texts, Net())
    alone, mixed = score(["\n".join(clean[k:] + clean[:k]) for k in range(len(toxic))]), score(["\n".join([*clean[k:], t, *clean[:k]]) for k, t in enumerate(toxic)])
    assert (mixed > alone).all()


def test_odd_rows_and_missing_classes(spark, scored):
    docs, labels, params, _ = scored
    odd = spark.createDataFrame([(1, None, 1), (None, "x", 2), (1, "", 3)], "doc_id long, text string, held_out int")
    out = score_toxicity(odd, params).collect()
    assert len(out) == 3 and len({r.score for r in out if r.doc_id == 1}) == 1
    assert score_toxicity(odd.filter("false"), params).count() == 0
    assert not fit_toxicity(docs, labels.selectExpr("-1 - doc_id as doc_id", "toxic"))["wo"].any()  # labels of other documents
    p = fit_toxicity(docs, labels.filter("toxic = 0"))
    assert len(set(score_texts(Inputs(p, Net()), ["", "a b", "idiot"], Net()).round(6))) == 1
