"""Language-model scores by context-tree weighting, beside a unigram base.

Learning counts, over all training documents, every byte after its last ``depth`` bytes, and every
word. The tree's weights are computed where the counts lie, dealt by a context's last two bytes, since
the subtree below these is whole there; the few nodes above are computed once, from sums. There too,
each distinct gram of the texts to score gets its probability, from all nodes. Frequent grams' and
words' values go to all tasks, of bounded number; a document's other grams and words are joined with
theirs.

The unigram base has one class for all words that were never learnt, and does not spell them. So that both
speak of the same tokens, the query's score takes such a word as one event too, of the probability by which
Good and Turing expect new words; what spelling it costs is a column of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm._common import Table, WordIds, bounded_batches, crc_remainder, grouped_words, pieces, raw, stored, texts_of, tidy
from kinfold.llm._ctw import Model, climb, deepest, descend, grams_of

TOP = 2  # bytes of context by which the tree is dealt out
END = b""  # the token after a text's last word; no word is empty


@dataclass(frozen=True)
class Tree:
    """``least``: how often a node must be seen to be kept. The hot ones bound what goes to all tasks, and change no score.

    ``tokens``: texts are taken as ``token_bytes`` has them.
    """

    depth: int = 5
    least: int = 2
    hot_grams: int = 2_000_000
    hot_words: int = 500_000
    flush: int = 3_000_000
    tokens: bool = False


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def token_bytes(text: str) -> bytes:
    """The words of a text in small letters (A to Z alone), parted by single spaces."""
    return b" ".join(raw(text).lower().split())


def gram_counts(docs: DataFrame, text: str, tree: Tree) -> DataFrame:
    """(gram, n): all runs of context and byte in all texts, counted in each task before the shuffle."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        own = token_bytes if tree.tokens else raw

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(g)
            g = g[order]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            return g[first], np.add.reduceat(n[order], first)

        size = 0
        for batch in pieces(batches, text):
            g, _ = grams_of([own(t) for t in texts_of(batch, text)], tree.depth)
            if len(g):
                held.append(np.unique(g, return_counts=True))
                size += len(held[-1][0])
            if size > tree.flush:
                held = [merged()]
                size = len(held[0][0])
                if size > tree.flush // 2:
                    yield pa.RecordBatch.from_arrays([_signed(held[0][0]), pa.array(held[0][1])], names=["gram", "n"])
                    held, size = [], 0
        if held:
            g, n = merged()
            yield pa.RecordBatch.from_arrays([_signed(g), pa.array(n)], names=["gram", "n"])

    return docs.select(text).mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A whole partition of grams, sorted, with how often each was learnt and is asked for."""
    parts = [[b.column(x).to_numpy() for x in ("gram", "c", "n")] for b in batches if b.num_rows]
    g, c, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64) for _ in range(3))
    g = g.view(np.uint64)
    order = np.argsort(g)
    return g[order], c[order], n[order]


def gram_logs(docs: DataFrame, train: DataFrame, text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """(gram, n, log): every gram of docs, how often it occurs there, and log10 of its probability.

    The tree is that of ``train`` with all its nodes that were seen ``least`` times; no task and not the
    driver gets more of it than the subtrees dealt to it and the nodes above them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    learnt = gram_counts(train, text, tree).select("gram", F.col("n").alias("c"), F.lit(0).cast("long").alias("n"))
    asked = gram_counts(docs, text, tree).select("gram", F.lit(0).cast("long").alias("c"), "n")
    grams = stored(learnt.unionByName(asked).groupBy("gram").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "grams")
    parts = max(8, grams.count() // 400_000 + 1)
    suffix = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << (8 * TOP)) - 1))
    dealt = grams.repartition(parts, suffix)
    depth = tree.depth

    @tidy
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c, _ = _columns(batches)
        g, c = g[c > 0], c[c > 0]
        for bit in range(8) if len(g) else ():
            tiers, weighted = climb(*deepest(g, c, bit), depth, TOP)
            _, key, n, n1, _, _ = tiers[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), bit, np.int32)), _signed(key), pa.array(n), pa.array(n1), pa.array(weighted)], names=["bit", "node", "n", "n1", "weighted"])

    # Contexts of two bytes and what was decided: 2^24 nodes at most, whatever the corpus; some 10^6 in real text.
    found = dealt.mapInArrow(tops, "bit int, node long, n double, n1 double, weighted double").toArrow().to_pandas()
    passes, top_keys, top_p = {}, [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
    for bit, own in found.groupby("bit"):
        own = own.sort_values("node")
        key = own["node"].to_numpy().view(np.uint64)
        tiers, _ = climb(key, own["n"].to_numpy(), own["n1"].to_numpy(), own["weighted"].to_numpy(), TOP, 0)
        upper = tiers[1:]
        keys, n, p, passed = descend(upper, np.zeros(len(upper[-1][1])), np.ones(len(upper[-1][1])))
        keep = (n >= tree.least) | (keys < np.uint64(1 << 60))  # the root's nodes stay in any case
        top_keys.append(keys[keep]), top_p.append(p[keep])
        place = tiers[0][5]
        passes[int(bit)] = (key, passed[0][place], passed[1][place])
    shipped = spark.sparkContext.broadcast((passes, np.concatenate(top_keys), np.concatenate(top_p)))

    @tidy
    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c, asked = _columns(batches)
        passes, *top = shipped.value
        keys, p1 = ([x] for x in top)
        seen = c > 0
        for bit in range(8) if seen.any() else ():
            tiers, _ = climb(*deepest(g[seen], c[seen], bit), depth, TOP)
            key, sure, left = passes[bit]
            at = np.searchsorted(key, tiers[-1][1])
            own, n, p, _ = descend(tiers, sure[at], left[at])
            keep = n >= tree.least
            keys.append(own[keep]), p1.append(p[keep].astype(np.float32))
        model = Model(np.concatenate(keys), np.concatenate(p1), depth)
        g, asked = g[asked > 0], asked[asked > 0]
        for k in range(0, len(g), 100_000):
            part = g[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([_signed(part), pa.array(asked[k : k + 100_000]), pa.array(model.byte_log(part))], names=["gram", "n", "log"])

    return stored(dealt.mapInArrow(logs, "gram long, n long, log double"), "logs")


def token_counts(docs: DataFrame, text: str = "text", flush: int = 500_000) -> DataFrame:
    """(word, n): a 64-bit hash of each lower-cased word, and of a text's end, and how often it occurs."""
    bounded_batches(docs.sparkSession)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = WordIds(), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_signed(known.hashes(np.arange(len(n)))), pa.array(n)], names=["word", "n"])

        for batch in pieces(batches, text):
            words, _ = grouped_words(texts_of(batch, text), lower=True)
            ids = known.ids(words)
            end = known[END]
            more = np.bincount(ids, minlength=len(known))
            more[end] += batch.num_rows
            more[: len(n)] += n
            n = more
            if len(n) > flush:
                yield out()
                known, n = WordIds(), np.zeros(0, np.int64)
        if len(n):
            yield out()

    return docs.select(text).mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, most: int) -> tuple[pd.DataFrame, DataFrame]:
    """The most frequent rows, at most ``most``, cut between two tiers of counts so that ties stay together; and the others."""
    tier = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for r in sorted(counts.groupBy(tier.cast("int").alias("tier")).count().collect(), reverse=True):
        if total + r["count"] > most:
            break
        total, least = total + r["count"], r.tier
    hot = F.lit(False) if least is None else tier >= least
    return counts.filter(hot).toArrow().to_pandas(), counts.filter(~hot)


def score_texts(docs: DataFrame, train: DataFrame, id_column: str = "doc_id", text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """Per row of docs: id, n_tokens, n_known, train_tokens, train_once, base_score, score, spelling.

    ``score`` is that of every byte, and ``spelling`` the part of it that the words unknown to ``train`` make, with
    the white space after each. ``train_once``: the words, ends included, that are in ``train`` once.
    ``train``: the documents to learn from, with the same text column. A null text is an empty one: its
    end alone is scored. Repeated rows are scored each on their own; without training texts every bit
    has probability one half. Other columns are not looked at, whatever their names; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    hot_grams, cold_grams = _top(gram_logs(docs, train, text, tree), tree.hot_grams)
    counts = stored(token_counts(train, text), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    train_tokens, rest = int(total.n), float(np.log10(total.n + total.v + 1))
    hot_words, _ = _top(counts, tree.hot_words)
    unsigned = lambda rows, column: rows[column].to_numpy().view(np.uint64)
    shipped = spark.sparkContext.broadcast((unsigned(hot_grams, "gram"), hot_grams["log"].to_numpy(), unsigned(hot_words, "word"), hot_words["n"].to_numpy(np.float64)))
    del hot_grams, hot_words

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, log_frequent, hot, log_hot = _tables(shipped)
        known, row = WordIds(), TaskContext.get().partitionId() << 33
        for batch in pieces(batches, text, 400):
            n = batch.num_rows
            known.fresh()
            texts = texts_of(batch, text)
            grams, sizes = grams_of([(token_bytes if tree.tokens else raw)(t) for t in texts], tree.depth)
            at = frequent.find(grams)
            words, n_words = grouped_words(texts, lower=True)
            ids = known.ids(words)
            end = hot.find(known.hashes(np.array([known[END]])))
            all_hot = hot.find(known.hashes(np.arange(len(known))))
            value = np.where(all_hot >= 0, log_hot[all_hot], 0.0)
            is_hot = all_hot >= 0
            doc = np.repeat(np.arange(n), n_words)
            base = np.bincount(doc, weights=value[ids], minlength=n) + (log_hot[end[0]] if end[0] >= 0 else 0.0)
            n_hot = np.bincount(doc, weights=is_hot[ids], minlength=n).astype(np.int64) + int(end[0] >= 0)
            # the bytes of words that may be unknown are summed up by word, all others by document
            g_doc = np.repeat(np.arange(n), sizes)
            own = words_at(grams, g_doc, n_words)
            g_word = np.append(np.where(is_hot[ids], -1, ids), -1)[own]
            score = np.bincount(g_doc, np.where(g_word < 0, log_frequent[at], 0.0), n)
            cold = ~is_hot[ids]
            spelt = np.bincount(own[g_word >= 0], log_frequent[at][g_word >= 0], len(ids))[cold]
            c_doc, c_id = doc[cold], ids[cold]
            if end[0] < 0:
                c_doc, c_id, spelt = np.r_[c_doc, np.arange(n)], np.r_[c_id, np.full(n, known[END])], np.r_[spelt, np.zeros(n)]
            pair, back, times = np.unique(c_doc * (len(known) + 1) + c_id, return_inverse=True, return_counts=True)
            spelt = np.bincount(back, spelt, len(pair))
            c_doc, c_id = pair // (len(known) + 1), pair % (len(known) + 1)
            rare = np.flatnonzero(at < 0)
            own, g_id = np.unique(grams[rare], return_inverse=True)
            order = np.lexsort((g_id, g_word[rare], g_doc[rare]))
            g_doc, g_word, g_id = g_doc[rare][order], g_word[rare][order], g_id[order]
            new = np.flatnonzero(np.r_[True, (g_doc[1:] != g_doc[:-1]) | (g_word[1:] != g_word[:-1]) | (g_id[1:] != g_id[:-1])][: len(g_doc)])
            g_times = np.diff(np.r_[new, len(g_doc)])
            g_doc, g_word, g_id = g_doc[new], g_word[new], g_id[new]
            none = lambda kind, k: pa.nulls(k, kind)
            names = ["row", "id", "n_tokens", "n_hot", "base", "score", "word", "gram", "times"]
            k = len(pair)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column(id_column).cast(pa.int64()), pa.array(n_words + 1), pa.array(n_hot), pa.array(base), pa.array(score), *[none(pa.int64(), n)] * 3], names=names)
            g_hash = pa.array(known.hashes(g_word).view(np.int64), mask=g_word < 0)
            for doc, spelt, word, gram, times in ((c_doc, pa.array(spelt), _signed(known.hashes(c_id)), none(pa.int64(), k), times), (g_doc, none(pa.float64(), len(g_doc)), g_hash, _signed(own[g_id]), g_times)):
                if k := len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(row + doc), *[none(pa.int64(), k)] * 3, none(pa.float64(), k), spelt, word, gram, pa.array(times)], names=names)
            row += n

    # Stored, so that the row numbers given above hold for both uses.
    out = stored(docs.select(id_column, text).mapInArrow(work, "row long, id long, n_tokens long, n_hot long, base double, score double, word long, gram long, times long"), "scored")
    # of words that may be unknown what their bytes make, first with the grams that went to no task
    lost = out.filter(F.col("gram").isNotNull()).select("row", "word", "gram", "times").join(cold_grams.select("gram", "log"), "gram")
    lost = lost.select("row", "word", F.lit(0).cast("long").alias("times"), (F.col("times") * F.col("log")).alias("score"))
    spelt = out.filter(F.col("word").isNotNull() & F.col("gram").isNull()).select("row", "word", "times", "score").unionByName(lost)
    spelt = spelt.groupBy("row", "word").agg(F.sum("times").alias("times"), F.sum("score").alias("spelt"))
    c = F.coalesce("n", F.lit(0))
    cold = spelt.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 1)).alias("cold"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_cold"),
        F.sum("spelt").alias("rare"), F.sum(F.when((c == 0) & F.col("word").isNotNull(), F.col("spelt"))).alias("spelling"),
    )
    whole = out.filter(F.col("n_tokens").isNotNull()).join(cold, "row", "left")
    return whole.select(
        F.col("id").alias(id_column), "n_tokens", (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), F.lit(total.once).cast("long").alias("train_once"),
        (F.col("base") + F.coalesce("cold", F.lit(0.0)) - F.col("n_tokens") * F.lit(rest)).alias("base_score"),
        (F.col("score") + F.coalesce("rare", F.lit(0.0))).alias("score"), F.coalesce("spelling", F.lit(0.0)).alias("spelling"),
    )


def words_at(grams: np.ndarray, doc: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """For each byte of the texts and their ends the place of its word among all; -1 at an end and before the first word.

    The white space after a word is the word's.
    """
    byte = grams & np.uint64(255)
    out = (byte == 32) | ((byte >= 9) & (byte <= 13)) | (byte == 255)  # the latter is the text's end alone
    begins = ~out & np.r_[True, out[:-1]][: len(out)]
    at = np.cumsum(begins) - 1
    return np.where((byte == 255) | (at < (np.cumsum(n_words) - n_words)[doc]), -1, at)


def open_score() -> Column:
    """log10 of the probability of a row's tokens from ``score_texts``, where all unknown words are one event.

    Without anything learnt there are no known words, and all are spelt.
    """
    new = (F.col("train_once") + 0.5) / (F.col("train_tokens") + 1.0)
    tokens = F.col("n_known") * F.log10(1 - new) + (F.col("n_tokens") - F.col("n_known")) * F.log10(new)
    return F.when(F.col("train_tokens") == 0, F.col("score")).otherwise(F.col("score") - F.col("spelling") + tokens)


_LOADED: dict = {}


def _tables(shipped) -> tuple[Table, np.ndarray, Table, np.ndarray]:
    """Built once per Python worker; the values end with that of what was not found."""
    if shipped not in _LOADED:
        _LOADED.clear()
        grams, logs, words, n = shipped.value
        _LOADED[shipped] = (Table(grams, logs), np.append(logs, 0.0), Table(words, n), np.append(np.log10(n + 1), 0.0))
    return _LOADED[shipped]


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, learnt from those outside the held-out fold; odd rows as in ``score_texts``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = crc_remainder("doc_id", 7) == 2
    scored = score_texts(docs, docs.filter(~held), tree=Tree(tokens=True)).withColumn("held_out", held).withColumn("score", open_score())
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelling")
