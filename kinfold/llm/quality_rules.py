"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm._common import WordIds, bounded_batches, grouped_words, pieces, texts_of, tidy

BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """A text is rejected when a share of its characters, or a ratio, is above its limit."""

    duplicate_ngrams: tuple[tuple[int, float], ...] = ((3, 0.50), (4, 0.40), (5, 0.35), (6, 0.34), (8, 0.32), (10, 0.30))
    top_ngrams: tuple[tuple[int, float], ...] = ((2, 0.30), (3, 0.28), (4, 0.26))
    top_ngram_times: int = 3  # a phrase that merely occurs twice is left to the other rule
    duplicate_line_chars: float = 0.30
    symbols_per_word: float = 0.25
    min_words: int = 20
    window: int = 8
    window_percent: int = 30


COLUMNS = (
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    + [("dup_line_chars", pa.float64()), ("dup_ngram_chars", pa.float64()), ("top_ngram_chars", pa.float64())]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their characters."""
    seen: set[str] = set()
    n = chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            if line in seen:
                n += 1
                chars += len(line)
            else:
                seen.add(line)
    return n, chars


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every run of n words."""
    out = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        out = out * BASE + hashes[j : len(hashes) - n + 1 + j]
    return out


def repeated(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Where the runs start whose key occurs twice or more."""
    order = np.sort(keys[valid])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return np.flatnonzero((twice[at] == keys) & valid)


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in the runs of n words from these starts."""
    mark = np.bincount(starts, minlength=words + 1) - np.bincount(starts + n, minlength=words + 1)
    return np.cumsum(mark[:words]) > 0


def measure(texts: list[str], rules: Rules, known: WordIds) -> dict[str, np.ndarray]:
    known.fresh()
    words, n_words = grouped_words(texts)
    ids = known.ids(words)
    hashes, chars = known.hashes(ids), known.chars(ids)
    doc = np.repeat(np.arange(len(texts)), n_words)
    total = len(ids)

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=len(texts)) if total else np.zeros(len(texts))

    word_chars = per_text(chars)
    safe = np.maximum(word_chars, 1)
    ends = np.r_[0, np.cumsum(chars)]
    salt = doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    worst, top, failed = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
    repeat_words = np.zeros(len(texts))
    lengths = {n for n, _ in rules.duplicate_ngrams} | {n for n, _ in rules.top_ngrams} | {rules.window}
    limits, tops = dict(rules.duplicate_ngrams), dict(rules.top_ngrams)
    for n in sorted(lengths):
        if total < n:
            continue
        keys = rolling(hashes, n) ^ salt[: total - n + 1]
        valid = doc[: total - n + 1] == doc[n - 1 :]
        starts = repeated(keys, valid)
        if not len(starts):
            continue
        if n in limits or n == rules.window:
            hit = covered(starts, n, total)
            share = per_text(chars * hit) / safe
            if n == rules.window:
                repeat_words = per_text(hit)
            if n in limits:
                worst = np.maximum(worst, share)
                failed |= share > limits[n]
        if n in tops:
            order = starts[np.argsort(keys[starts])]
            start = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
            count = np.diff(np.r_[start, len(order)])
            first = order[start]
            size = (ends[first + n] - ends[first]) * count * (count >= rules.top_ngram_times)
            most = np.zeros(len(texts))
            np.maximum.at(most, doc[first], size)
            share = most / safe
            top = np.maximum(top, share)
            failed |= share > tops[n]
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 2)
    symbols = np.array([sum(map(t.count, "#*$%&|<>")) for t in texts], np.int64)
    line_share = lines[:, 1] / np.maximum([len(t) for t in texts], 1)
    base = (n_words < rules.min_words) | (100 * repeat_words > rules.window_percent * n_words)
    failed |= (line_share > rules.duplicate_line_chars) | (symbols > rules.symbols_per_word * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars.astype(np.int64), "n_symbols": symbols, "n_dup_lines": lines[:, 0], "n_repeat_words": repeat_words.astype(np.int64),
        "dup_line_chars": line_share, "dup_ngram_chars": worst, "top_ngram_chars": top, "base_failed": base, "kept": ~(base | failed),
    }


def quality_rules(docs: DataFrame, text: str = "text", rules: Rules = Rules(), prefix: str = "") -> DataFrame:
    """Append the measures and verdict of every row; nothing is dropped and no shuffle is made.

    A null text counts as empty: no words, ``base_failed`` and not kept. Every other column, whatever
    its name, is kept as it is unless it has the name of a measure, which then replaces it (``prefix``
    avoids that). Repeated rows get repeated results; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    names = [prefix + n for n, _ in COLUMNS]
    kept = docs.select(*[c for c in docs.columns if c not in names or c == text])
    keep = [c for c in kept.columns if c not in names]
    schema = kept.select(*keep).schema
    kinds = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    for (_, kind), name in zip(COLUMNS, names):
        schema = schema.add(name, kinds[kind])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in pieces(batches, text):
            m = measure(texts_of(batch, text), rules, known)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(m[n], kind) for n, kind in COLUMNS], names=keep + names)

    return kept.mapInArrow(work, schema)


def kept_documents(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Only the documents that the rules keep, with the columns they came with."""
    prefix = "__rule_"
    return quality_rules(docs, text, rules, prefix).filter(f"{prefix}kept").select(*docs.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The measures of every document (contract columns first)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).drop("text")
