"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input joins a learned vector of the word, the mean of learned vectors of its character
n-grams, and two log-odds that are counted on the training texts. Two recurrences read a window of
words, attention weighs their states, and a logistic unit scores the window. Windows overlap by half and
cover the whole text; its score is read from its most toxic window and from how many are toxic. Everything is numpy, in training
as in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._common import bounded_batches, crc_remainder, mix, pieces, ragged, raw, texts_of, tidy
from kinfold.llm.quality_classifier import labelled

U = np.uint64
f4 = np.float32


@dataclass(frozen=True)
class Net:
    """Sizes and schedule. ``sample`` bounds the labelled texts of each class that are fitted on."""

    window: int = 32
    step: int = 16
    word_buckets: int = 1 << 14
    gram_buckets: int = 1 << 17
    grams: tuple[int, ...] = (3, 5, 6, 7, 8)
    word_dims: int = 8
    char_dims: int = 8
    hidden: int = 8
    attention: int = 8
    sample: int = 8000
    of_toxic: int = 1500
    of_clean: int = 2500
    epochs: int = 3  # with more, some 300 toxic texts are learnt by heart
    batch: int = 256
    rate: float = 0.02
    seed: int = 5
    cut_score: float = 0.7


#: A to Z become lower case; other ASCII that is neither letter nor digit goes, but for the line end between words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DROP = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b == 10))
POWERS = mix(np.arange(1, 65, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def word_codes(words: list[bytes], net: Net) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its bucket, the buckets of its character n-grams one after another, and where each word's begin.

    A word is taken without its punctuation and between two marks of its ends, which count as
    characters; a word that is too short for any n-gram has the one numbered 0.
    """
    data = (b"\n" + b"\n".join(words) + b"\n").translate(LOWER, DROP)
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    ends = np.flatnonzero(b == 10)
    before, sizes = ends[:-1], np.diff(ends) - 1
    place = np.arange(len(b)) - np.repeat(ends, np.diff(np.r_[ends, len(b)]))
    term = (b + U(1)) * POWERS[place & 63]
    total = np.r_[U(0), np.cumsum(term)]
    word = mix(total[ends[1:]] - total[ends[:-1] + 1]) % U(net.word_buckets)
    many = [np.maximum(sizes + 3 - n, 0) for n in net.grams]
    count = sum(many)
    none = count == 0
    starts = np.cumsum(count + none) - (count + none)
    grams = np.zeros(int((count + none).sum()), np.int32)
    at = starts.copy()
    for n, own in zip(net.grams, many):
        if len(b) >= n:
            key = np.full(len(b) - n + 1, U(n))
            for j in range(n):
                key = key * U(0x100000001B3) + b[j : len(b) - n + 1 + j]
            grams[ragged(at, own)] = (mix(key) % U(net.gram_buckets))[ragged(before, own)]
        at += own
    return word.astype(np.int32), grams, starts


class Inputs:
    """Word inputs, remembered for the distinct words a worker has seen lately."""

    def __init__(self, p: dict[str, np.ndarray], net: Net, most: int = 300_000) -> None:
        self.p, self.net, self.most = p, net, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 12, 6 * self.net.hidden), f4)

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > self.most:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            size = len(self.place)
            self.place.update(zip(new, range(size, size + len(new))))
            while len(self.rows) < size + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for k in range(0, len(new), 20_000):
                some = new[k : k + 20_000]
                x = word_inputs(self.p, *word_codes(some, self.net))
                self.rows[size + k : size + k + len(some)] = x @ self.p["wx"] + self.p["bx"]
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def word_inputs(p: dict[str, np.ndarray], word: np.ndarray, tri: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of (word vector, mean n-gram vector, word log-odds, largest n-gram log-odds)."""
    per = np.diff(np.r_[starts, len(tri)]).astype(f4)[:, None]
    chars = np.add.reduceat(p["chars"][tri], starts, axis=0) / per
    return np.concatenate([p["words"][word], chars, p["word_odds"][word][:, None], np.maximum.reduceat(p["char_odds"][tri], starts)[:, None]], axis=1).astype(f4)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return f4(0.5) * np.tanh(f4(0.5) * x) + f4(0.5)


def forward(p: dict[str, np.ndarray], gates: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. ``gates``: (time, windows, 6 hidden), the inputs' part of both directions' gates."""
    steps, n, _ = gates.shape
    h = p["uf"].shape[0]
    states = np.zeros((steps, n, 2 * h), f4)
    saved: list[list] = [[], []]
    for way, u in enumerate((p["uf"], p["ub"])):
        s = np.zeros((n, h), f4)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            g = gates[t, :, 3 * h * way : 3 * h * (way + 1)]
            r = s @ u
            zr = sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
            z, a = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h :] + a * r[:, 2 * h :])
            new = c + z * (s - c)
            m = mask[t]
            if not m.all():
                new = np.where(m[:, None], new, s)
            if keep:
                saved[way].append((t, s, z, a, c, r[:, 2 * h :]))
            s = new
            states[t, :, h * way : h * (way + 1)] = s
    q = np.tanh(states @ p["wa"] + p["ba"])
    e = np.where(mask, q @ p["va"], f4(-1e9))
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = np.einsum("tn,tnh->nh", e, states)
    logit = pooled @ p["wo"] + p["bo"][0]
    return (logit, states, saved, q, e, pooled) if keep else logit


def backward(p: dict[str, np.ndarray], run, gates: np.ndarray, mask: np.ndarray, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the loss by every parameter, and by ``gates``."""
    _, states, saved, q, e, pooled = run
    h = p["uf"].shape[0]
    d = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], f4)}
    dpool = dlogit[:, None] * p["wo"]
    de = np.einsum("nh,tnh->tn", dpool, states)
    dscore = e * (de - (e * de).sum(0))
    dq = dscore[:, :, None] * p["va"] * (1 - q * q)
    d["va"] = np.einsum("tn,tna->a", dscore, q)
    d["wa"] = np.einsum("tnh,tna->ha", states, dq)
    d["ba"] = dq.sum((0, 1))
    dstates = e[:, :, None] * dpool + dq @ p["wa"].T
    dgates = np.zeros_like(gates)
    for way, name in enumerate(("uf", "ub")):
        u, du = p[name], np.zeros_like(p[name])
        ds = np.zeros((gates.shape[1], h), f4)
        for t, s, z, a, c, rc in reversed(saved[way]):
            m = mask[t][:, None]
            dn = ds + dstates[t, :, h * way : h * (way + 1)]
            through = np.where(m, f4(0), dn)
            dn = np.where(m, dn, f4(0))
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (s - c) * z * (1 - z)
            da = dc * rc * a * (1 - a)
            g = np.concatenate([dz, da, dc], 1)
            dgates[t, :, 3 * h * way : 3 * h * (way + 1)] = g
            g = np.concatenate([dz, da, dc * a], 1)
            du += s.T @ g
            ds = through + dn * z + g @ u.T
        d[name] = du
    d["gates"] = dgates
    return d


def windows_of(n: int, net: Net) -> list[int]:
    """Where the windows over n words start: half over each other, the last at the text's end."""
    if n <= net.window:
        return [0]
    return [*range(0, n - net.window, net.step), n - net.window]


def start_params(net: Net) -> dict[str, np.ndarray]:
    r = np.random.default_rng(net.seed)
    draw = lambda *s, by=1.0: (r.standard_normal(s) * by).astype(f4)
    h, x = net.hidden, net.word_dims + net.char_dims + 2
    p = {"words": draw(net.word_buckets, net.word_dims, by=0.05), "chars": draw(net.gram_buckets, net.char_dims, by=0.05), "wx": draw(x, 6 * h, by=0.3), "bx": np.zeros(6 * h, f4)}
    p |= {"uf": draw(h, 3 * h, by=0.3), "ub": draw(h, 3 * h, by=0.3), "wa": draw(2 * h, net.attention, by=0.3), "ba": np.zeros(net.attention, f4), "va": draw(net.attention, by=0.3), "wo": draw(2 * h, by=0.3), "bo": np.zeros(1, f4)}
    return p


def _odds(parts: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray, size: int) -> np.ndarray:
    """Log-odds of a bucket between texts of label 1 and 0, drawn to 0 where rare.

    ``parts`` gives buckets and the texts they are of, some whole texts at a time; a text counts once.
    """
    pos, neg, a, b = np.zeros(size, np.int64), np.zeros(size, np.int64), 0, 0
    for buckets, own in parts:
        texts = np.unique(own)
        a, b = a + int((label[texts] == 1).sum()), b + int((label[texts] == 0).sum())
        pair = np.unique(own.astype(np.int64) * size + buckets)
        bucket, one = pair % size, label[pair // size] == 1
        pos += np.bincount(bucket[one], minlength=size)
        neg += np.bincount(bucket[~one], minlength=size)
    return np.clip(np.log((pos + 1) / (a + 2)) - np.log((neg + 1) / (b + 2)), -3, 5).astype(f4) * ((pos + neg) >= 3)


def train(texts: list[str], label: np.ndarray, net: Net) -> dict[str, np.ndarray]:
    """Fit on whole texts with labels 0 and 1; without both, every text scores the same.

    A toxic text teaches by its currently most toxic window, a clean one by its most toxic window and
    one at random. The readout and the threshold come from texts that were kept apart.
    """
    p = start_params(net)
    p["word_odds"], p["char_odds"] = np.zeros(net.word_buckets, f4), np.zeros(net.gram_buckets, f4)
    p["cut"], p["read"] = np.array([0.0, 1.0], f4), np.zeros(5)
    if not (label == 1).any() or not (label == 0).any():
        p["wo"][:] = 0
        return p
    r = np.random.default_rng(net.seed + 1)
    known: dict[bytes, int] = {}
    docs = []
    for t in texts:
        own = raw(t).split() or [b""]
        docs.append(np.array([known.setdefault(w, len(known)) for w in own], np.int64))
    word, tri, starts = word_codes(list(known), net)
    per_tri = np.diff(np.r_[starts, len(tri)])
    # Every fourth text of either class is kept apart: the readout and the threshold are fitted on these.
    apart = np.zeros(len(docs), bool)
    for v in (0, 1):
        of = np.flatnonzero(label == v)
        apart[of[3::4]] = len(of) >= 20
    if not apart.any() or len(set(label[apart])) < 2:
        apart[:] = False
    fitted = np.flatnonzero(~apart)
    if not apart.any():
        apart[:] = True

    def spread(grams: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(fitted), 50):
            at = fitted[k : k + 50]
            some = [np.unique(docs[i]) for i in at]
            own, words = np.repeat(at, [len(x) for x in some]), np.concatenate(some)
            yield (tri[ragged(starts[words], per_tri[words])], np.repeat(own, per_tri[words])) if grams else (word[words], own)

    p["word_odds"], p["char_odds"] = _odds(spread(False), label, net.word_buckets), _odds(spread(True), label, net.gram_buckets)
    offset = np.cumsum([0] + [len(x) for x in docs])
    flat_words = np.concatenate(docs)
    win_doc, win_at, win_len = [], [], []
    for k, x in enumerate(docs):
        for s in windows_of(len(x), net):
            win_doc.append(k), win_at.append(offset[k] + s), win_len.append(min(len(x) - s, net.window))
    win_doc, win_at, win_len = map(np.array, (win_doc, win_at, win_len))
    heads = np.flatnonzero(np.r_[True, win_doc[1:] != win_doc[:-1]])
    counts = np.diff(np.r_[heads, len(win_doc)])
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items() if k not in ("word_odds", "char_odds", "cut", "read")}
    tick = 0

    def ids_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.arange(net.window)[:, None]
        mask = t < win_len[rows]
        return flat_words[np.where(mask, win_at[rows] + t, 0)], mask

    def own_grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = per_tri[words]
        return tri[ragged(starts[words], sizes)], np.cumsum(sizes) - sizes

    def gates_of(words: np.ndarray) -> np.ndarray:
        return word_inputs(p, word[words], *own_grams(words)) @ p["wx"] + p["bx"]

    def all_logits() -> np.ndarray:
        table = np.concatenate([gates_of(np.arange(k, min(k + 20_000, len(word)))) for k in range(0, len(word), 20_000)])
        out = np.zeros(len(win_doc), f4)
        for k in range(0, len(out), 4096):
            ids, mask = ids_of(np.arange(k, min(k + 4096, len(out))))
            out[k : k + 4096] = forward(p, table[ids], mask)
        return out

    per_word = np.maximum(p["word_odds"][word], np.maximum.reduceat(p["char_odds"][tri], starts))
    first = np.array([per_word[flat_words[a : a + n]].max() for a, n in zip(win_at, win_len)], f4)
    for epoch in range(net.epochs):
        worst = first if epoch < 2 else all_logits()
        best = np.array([h + int(np.argmax(worst[h : h + c])) for h, c in zip(heads, counts)])
        random = heads + (r.random(len(heads)) * counts).astype(np.int64)
        clean = fitted[label[fitted] == 0]
        rows = np.concatenate([best[fitted], random[clean]])
        want = np.concatenate([label[fitted], np.zeros(len(clean), label.dtype)]).astype(f4)
        weigh = np.where(want == 1, f4((want == 0).sum() / max(1, (want == 1).sum())) ** 0.5, f4(1)).astype(f4)
        order = r.permutation(len(rows))
        for k in range(0, len(order), net.batch):
            pick = order[k : k + net.batch]
            ids, mask = ids_of(rows[pick])
            used, back = np.unique(ids, return_inverse=True)
            sizes = per_tri[used]
            own_tri, own_starts = own_grams(used)
            x = word_inputs(p, word[used], own_tri, own_starts)
            gates = (x @ p["wx"] + p["bx"])[back.reshape(ids.shape)]
            run = forward(p, gates, mask, keep=True)
            dlogit = ((sigmoid(run[0]) - want[pick]) * weigh[pick] / len(pick)).astype(f4)
            d = backward(p, run, gates, mask, dlogit)
            g = d.pop("gates").reshape(-1, gates.shape[2])
            per = np.zeros((len(used), g.shape[1]), f4)
            np.add.at(per, back.ravel(), g)
            d["wx"], d["bx"] = x.T @ per, per.sum(0)
            dx = per @ p["wx"].T
            d["words"], d["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
            np.add.at(d["words"], word[used], dx[:, : net.word_dims])
            np.add.at(d["chars"], own_tri, np.repeat(dx[:, net.word_dims : net.word_dims + net.char_dims] / sizes[:, None], sizes, axis=0))
            tick += 1
            for name, (m, v) in moment.items():
                m += 0.1 * (d[name] - m)
                v += 0.001 * (d[name] ** 2 - v)
                p[name] -= (net.rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)).astype(f4)
    read, own = readout(all_logits(), heads, counts)[apart], label[apart]
    p["read"] = _logistic(read, own)
    p["cut"] = _cut(np.c_[read, np.ones(len(read))] @ p["read"], own)
    return p


def readout(logits: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a text's score is made of: its most toxic window, how many windows are toxic, and both together."""
    top = np.clip(np.maximum.reduceat(logits, heads).astype(np.float64), -8, 8)
    mean = np.add.reduceat(sigmoid(logits).astype(np.float64), heads) / counts
    level = np.log((mean + 0.01) / (1.01 - mean))
    return np.stack([top / 4, level, np.log(counts), level * np.log(counts) / 4], 1)


def _logistic(x: np.ndarray, label: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights, the last of the constant, of a penalised logistic regression by Newton's method."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / len(x) + penalty * np.eye(len(w)), x.T @ (label - q) / len(x) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _cut(top: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The logit that parts the classes with the fewest errors, in the middle of the widest such gap; and a slope."""
    order = np.argsort(top)
    s, y = top[order], label[order]
    errors = np.r_[0, np.cumsum(y == 1)] + np.r_[np.cumsum((y == 0)[::-1])[::-1], 0]
    edge = np.r_[s[0] - 1, s, s[-1] + 1]
    gap = np.where(errors == errors.min(), edge[1:] - edge[:-1], -1)
    k = int(np.argmax(gap))
    return np.array([(edge[k] + edge[k + 1]) / 2, 1.0], f4)


def score_texts(inputs: Inputs, texts: list[str], net: Net, rows: int = 4096) -> np.ndarray:
    """The score of each text; one without words has a window without any sign of toxicity."""
    p = inputs.p
    words: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    blank = np.zeros(len(texts), bool)
    for k, t in enumerate(texts):
        own = raw(t).split()
        blank[k] = not own
        sizes[k] = len(own) or 1
        words += own or [b""]
    ids = inputs.ids(words)
    ends = np.cumsum(sizes)
    # the windows of windows_of, for all texts at once
    n = np.where(sizes <= net.window, 1, 1 - (net.window - sizes) // net.step)
    doc = np.repeat(np.arange(len(texts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * net.step, np.maximum(sizes[doc] - net.window, 0))
    at, length = start + (ends - sizes)[doc], np.minimum(sizes[doc], net.window)
    logits = np.zeros(len(doc), f4)
    full = length == net.window
    t = np.arange(net.window)[:, None]
    for part in (np.flatnonzero(full), np.flatnonzero(~full)):
        for s in range(0, len(part), rows):
            own = part[s : s + rows]
            mask = t < length[own]
            logits[own] = forward(p, inputs.rows[ids[np.where(mask, at[own] + t, 0)]], mask)
    if not len(texts):
        return np.zeros(0)
    logits[blank[doc]] = -8  # no words, so nothing toxic
    z = np.c_[readout(logits, np.cumsum(n) - n, n), np.ones(len(texts))] @ p["read"]
    z = (z - float(p["cut"][0])) * float(p["cut"][1]) + np.log(net.cut_score / (1 - net.cut_score))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1, net: Net = Net()) -> dict[str, np.ndarray]:
    """Fit on at most ``net.of_toxic`` and ``net.of_clean`` texts of the two labels among ``net.sample`` labelled rows; all bounds are fixed.

    One task gets these texts and trains; the driver sees ids, labels and the finished parameters only.
    A null text is an empty one, rows without id or label are left out, of several texts of an id the
    smallest counts. Without rows of both labels every text will score the same.
    """
    bounded_batches(docs.sparkSession)
    rows = labelled(docs, labels, label, id_column, text, folds, held, net.sample).select("__id", "label", "text")
    by = rows.select("__id", "label").distinct().orderBy("label", F.xxhash64("__id", F.lit(3)), "__id").collect()
    wanted = [r[0] for r in by if r.label == 1][: net.of_toxic] + [r[0] for r in by if r.label == 0][: net.of_clean]
    some = docs.sparkSession.createDataFrame([(i,) for i in wanted], rows.select("__id").schema)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        got = pa.Table.from_batches(some).to_pandas().sort_values(["__id", "text"]).drop_duplicates("__id")
        fitted = train(got["text"].tolist(), got["label"].to_numpy(np.int64), net)
        yield pa.RecordBatch.from_arrays([pa.array(fitted), pa.array([v.dtype.str for v in fitted.values()]), pa.array([v.shape for v in fitted.values()], pa.list_(pa.int64())), pa.array([v.tobytes() for v in fitted.values()], pa.binary())], names=["name", "kind", "shape", "data"])

    found = rows.join(F.broadcast(some), "__id").repartition(1).mapInArrow(work, "name string, kind string, shape array<long>, data binary").collect()
    if not found:
        return train([], np.zeros(0, np.int64), net)
    return {r.name: np.frombuffer(bytes(r.data), np.dtype(r.kind)).reshape(r.shape).copy() for r in found}


def score_toxicity(docs: DataFrame, params: dict[str, np.ndarray], id_column: str = "doc_id", text: str = "text", folds: int = 3, held: int = 1, net: Net = Net(), keep: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, score, predicted, and the columns to keep, for every row.

    A null text is scored as an empty one, which has no sign of toxicity. Repeated rows get repeated
    results and a null id is held out or not as an empty one; an empty table gives an empty result. Other
    columns are not looked at, whatever their names; one to keep must not have the name of a result.
    """
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(params)
    source = docs.select(*keep, F.col(id_column), F.col(text).alias("__text"), (crc_remainder(id_column, folds) == held).alias("held_out"))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = Inputs(shipped.value, net)
        for batch in pieces(batches, "__text"):
            s = score_texts(inputs, texts_of(batch, "__text"), net)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column(id_column), batch.column("held_out"), pa.array(s), pa.array((s >= net.cut_score).astype(np.int32))], names=[*keep, id_column, "held_out", "score", "predicted"])

    return source.mapInArrow(work, docs.select(*keep, id_column).schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; odd rows as in ``score_toxicity``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, fit_toxicity(docs, labels))
