"""A quality classifier by Bradley-Terry ranking.

Each preference pair says that one labelled text beats another. Document scores are linear in features,
P(a beats b) = sigmoid(w . (x_a - x_b)), and w maximises the pairs' likelihood. The cut between good
and bad is a quantile of the training scores, that of the share of bad labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._common import WordIds, bounded_batches, crc_remainder, pieces, raw, scratch, stored, texts_of, tidy
from kinfold.llm.quality_rules import Rules, measure

#: Bytes whose share of a text is a feature, one by one.
MARKS = b"|#*$%&<>!?.,;:"


@dataclass(frozen=True)
class Fit:
    """Every labelled row takes part: a row of the commoner label meets ``opponents`` of the other.

    Pairs are made within groups of ``rare`` rows of the rarer label, more beyond ``groups`` groups, and at
    most about ``most`` times as many of the commoner. ``few`` rows are sorted by the driver.
    """

    opponents: int = 8
    rare: int = 64
    most: int = 64
    groups: int = 2048
    penalty: float = 1e-3
    rounds: int = 30
    few: int = 4096
    cut_score: float = 0.3


def features(texts: list[str], known: WordIds) -> np.ndarray:
    """One row per text; all bounded, so that no text's features run away."""
    m = measure(texts, Rules(), known)
    out = np.zeros((len(texts), 14 + len(MARKS) + 4), np.float64)
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    counts = np.stack([np.bincount(np.frombuffer(raw(t), np.uint8), minlength=256) for t in texts]) if texts else np.zeros((0, 256))
    upper, lower, digit = counts[:, 65:91].sum(1), counts[:, 97:123].sum(1), counts[:, 48:58].sum(1)
    total = np.maximum(counts.sum(1), 1)
    share = lambda x: np.minimum(np.sqrt(x), 1.5)
    cols = [
        np.log1p(m["n_words"]) / 5, np.minimum(m["n_words"], 20) / 20, np.minimum(chars / words, 20) / 10,
        share(m["n_symbols"] / words), share(m["n_dup_lines"] / np.maximum(counts[:, 10] + 1, 1)), m["n_repeat_words"] / words,
        m["dup_line_chars"], m["dup_ngram_chars"], np.minimum(m["top_ngram_chars"], 1.5),
        share(upper / np.maximum(upper + lower, 1)), share(digit / total), np.minimum(counts[:, 10] / words, 1), np.minimum(counts[:, 32] / words, 2), (m["n_words"] == 0) * 1.0,
        *(share(counts[:, b] / words) for b in MARKS),
        (m["dup_ngram_chars"] > 0.3) * 1.0, (m["dup_line_chars"] > 0.3) * 1.0, (m["n_symbols"] > 0.25 * words) * 1.0, (upper > 0.5 * (upper + lower)) * 1.0,
    ]
    for k, c in enumerate(cols):
        out[:, k] = c
    return out


@dataclass(frozen=True)
class Ranking:
    """w in standardised features, and the raw score that the cut gives ``cut_score``."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    steep: float
    cut_score: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        """Monotone in the raw score, 0 to 1, ``cut_score`` exactly at the cut."""
        z = (self.raw(x) - self.cut) * self.steep + np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def differences(x: np.ndarray, label: np.ndarray, opponents: int) -> Iterator[np.ndarray]:
    """Good less bad, so that each row of the commoner label meets as many opponents as there are, up to ``opponents``, and all rows are in a pair."""
    good, bad = x[label == 1], x[label == 0]
    n = max(len(good), len(bad))
    for k in range(min(opponents, min(len(good), len(bad)))):
        yield good[(np.arange(n) + (k if len(good) < len(bad) else 0)) % len(good)] - bad[(np.arange(n) + (k if len(bad) <= len(good) else 0)) % len(bad)]


def slope(x: np.ndarray, label: np.ndarray, w: np.ndarray, opponents: int) -> np.ndarray:
    """The number of pairs, and their sums of the likelihood's gradient and Hessian, in one array."""
    n, grad, hess = 0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    for d in differences(x, label, opponents):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        n, grad, hess = n + len(d), grad + d.T @ (1 - p), hess + (d * (p * (1 - p))[:, None]).T @ d
    return np.r_[n, grad, hess.reshape(-1)]


def newton(width: int, slopes: Callable[[np.ndarray], np.ndarray], fit: Fit) -> np.ndarray:
    """The w of the highest penalised likelihood."""
    w = np.zeros(width)
    for _ in range(fit.rounds):
        s = slopes(w)
        n = max(s[0], 1)
        step = np.linalg.solve(s[1 + width :].reshape(width, width) / n + fit.penalty * np.eye(width), s[1 : 1 + width] / n - fit.penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _unlearnt(width: int) -> Ranking:
    return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, 0.5)


def _placed(n_bad: int, n: int) -> int:
    """The place of the cut: so many scores are below it, those of the bad labels' share."""
    return min(max(n_bad, 1), n - 1)


def bradley_terry(x: np.ndarray, label: np.ndarray, fit: Fit) -> Ranking:
    """Learn from pairs of a text with label 1 and one with label 0, of rows at hand.

    Newton's method on the penalised logistic loss of feature differences. Without both labels every
    text scores the same: 0.5.
    """
    if not (label == 1).any() or not (label == 0).any():
        return _unlearnt(x.shape[1])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    w = newton(x.shape[1], lambda w: slope(z, label, w, fit.opponents), fit)
    s = z @ w
    # The quantile of the bad labels' share is the cut, halfway to the score above it in the good labels.
    order = np.sort(s)
    k = _placed(int((label == 0).sum()), len(order))
    spread = max(float(np.median(s[label == 1]) - np.median(s[label == 0])), 1e-6)
    return Ranking(mean, scale, w, (order[k - 1] + order[k]) / 2, 8.0 / spread, fit.cut_score)


def places(scores: DataFrame, ranks: list[int], few: int) -> list[float]:
    """The values at these places (from 0) of a column ``s``, exactly: counted by ever narrower bins until ``few`` rows are left."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    found = []
    for rank in ranks:
        a, b, own = low, high, F.lit(True)
        while a < b:
            width = (b - a) / few
            at = F.least(F.floor((F.col("s") - F.lit(a)) / F.lit(width)), F.lit(few - 1))
            bins = scores.filter(own).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b")).orderBy("bin").collect()
            for x in bins:
                if rank < x.n:
                    break
                rank -= x.n
            a, b = x.a, x.b
            own = F.col("s").between(a, b)
            if x.n <= few and a < b:
                a = b = sorted(r.s for r in scores.filter(own).collect())[rank]
        found.append(a)
    return found


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_column: str, text: str, folds: int, held: int, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents outside the held-out fold.

    Of several labels of an id the largest counts, of several texts the smallest; rows without id or
    label are left out. The sample, of bounded size, is what gets broadcast; the documents stay where
    they are.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull() & (crc_remainder(id_column, folds) != held))
    sample = own.groupBy(F.col(id_column).alias("__id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    found = docs.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return found.join(F.broadcast(sample), "__id")


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0, fit: Fit = Fit()) -> Ranking:
    """Learn from all labelled rows outside the held-out fold.

    A null text is an empty one; rows without id or label are left out, and of several texts of an id one
    counts. Without both labels every text scores 0.5. Features of the labelled rows are stored; a round
    of Newton's method is one pass over them, of which the driver gets sums for each group of rows alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    width = features([""], WordIds()).shape[1]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in pieces(batches):
            x = features(texts_of(batch), known)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(list(x), pa.list_(pa.float64()))], names=["__id", "x"])

    kind = docs.schema[id_column].dataType.simpleString()
    learnt = lambda d: d.filter(F.col(id_column).isNotNull() & (crc_remainder(id_column, folds) != held))
    every = learnt(labels).filter(F.col(label).isNotNull()).groupBy(F.col(id_column).alias("__id")).agg(F.max(label).cast("int").alias("label"))
    # features first: they are what a join may shuffle, and texts stay where they are
    measured = learnt(docs).select(F.col(id_column).alias("__id"), F.col(text).alias("text")).mapInArrow(work, f"__id {kind}, x array<double>")
    rows = measured.join(every, "__id")
    with scratch(spark):
        rows = stored(rows.filter("label in (0, 1)").groupBy("__id", "label").agg(F.min("x").alias("x")), "features")
        counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(counts) < 2:
            return _unlearnt(width)
        groups, common = stored(_groups(rows, counts, fit), "groups"), max(counts, key=lambda k: counts[k])

        def each(find: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
            """Of each group's features, labels and whether it is the one that counts a row: an array of numbers."""

            @tidy
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for g, k, y, x in zip(b.column("group").to_pylist(), b.column("share").to_pylist(), b.column("labels"), b.column("xs")):
                        y = y.values.to_numpy()
                        out = find(x.values.to_numpy().reshape(-1, width), y, (y == common) | (k == 0))
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([k], pa.int32()), pa.array([out], pa.list_(pa.float64()))], names=["group", "share", "out"])

            return groups.mapInArrow(run, "group int, share int, out array<double>")

        # in a fixed order, so that reruns agree to the last bit
        total = lambda find: np.sum([r.out for r in sorted(each(find).collect())], 0)
        n = sum(counts.values())
        mean = total(lambda x, y, own: x[own].sum(0)) / n
        scale = np.sqrt(total(lambda x, y, own: ((x[own] - mean) ** 2).sum(0)) / n)
        scale[scale < 1e-9] = 1.0
        w = newton(width, lambda w: total(lambda x, y, own: slope(x / scale, y, w, fit.opponents)), fit)
        scores = stored(
            each(lambda x, y, own: np.stack([((x - mean) / scale) @ w, y], 1)[own].reshape(-1)).select(F.explode(F.expr("transform(sequence(0, size(out) div 2 - 1), i -> struct(out[2 * i] as s, out[2 * i + 1] as label))")).alias("x")).select("x.*"), "scores"
        )
        k = _placed(counts[0], n)
        below, above = places(scores, [k - 1, k], fit.few)
        good, bad = (np.mean(places(scores.filter(F.col("label") == c), [(counts[c] - 1) // 2, counts[c] // 2], fit.few)) for c in (1, 0))
        return Ranking(mean, scale, w, (below + above) / 2, 8.0 / max(float(good - bad), 1e-6), fit.cut_score)


def _groups(rows: DataFrame, counts: dict[int, int], fit: Fit) -> DataFrame:
    """(group, share, labels, xs): each group has its rows of the rarer label in all its shares, and those of the commoner in one."""
    common, few = max(counts, key=lambda k: counts[k]), min(counts.values())
    n = max(1, min(few // fit.rare, fit.groups))
    shares = max(1, -(-counts[common] // (max(fit.rare, few // n) * fit.most * n)))
    group = F.pmod(F.xxhash64("__id"), F.lit(n)).cast("int")
    own = F.array(F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(shares)).cast("int"))
    dealt = rows.select(group.alias("group"), F.explode(F.when(F.col("label") == common, own).otherwise(F.sequence(F.lit(0), F.lit(shares - 1)))).alias("share"), "__id", "label", "x")

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("__id")
        return pa.table({"group": pa.array([key[0].as_py()], pa.int32()), "share": pa.array([key[1].as_py()], pa.int32()), "labels": pa.array([t.column("label").to_numpy()], pa.list_(pa.int32())), "xs": pa.array([t.column("x").combine_chunks().flatten().to_numpy()], pa.list_(pa.float64()))})

    return dealt.groupBy("group", "share").applyInArrow(packed, "group int, share int, labels array<int>, xs array<double>")


def score_quality(docs: DataFrame, model: Ranking, id_column: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """id, held_out, score, predicted for every row.

    A null text is scored as an empty one; repeated rows get repeated results, and a null id is held out
    or not as an empty one. Other columns are not looked at; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_column), F.col(text).alias("text"), (crc_remainder(id_column, folds) == held).alias("held_out"))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in pieces(batches):
            s = model.score(features(texts_of(batch), known))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), batch.column("held_out"), pa.array(s), pa.array((s >= model.cut_score).astype(np.int32))], names=[id_column, "held_out", "score", "predicted"])

    return source.mapInArrow(work, docs.select(id_column).schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; odd rows as in ``score_quality``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs, fit_quality(docs, labels))
