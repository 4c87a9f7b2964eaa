"""Byte-pair encoding through a minimal acyclic transducer of frequent words.

Words are what the tokenizer's pre-tokenizer cuts a text into. The most frequent of the corpus are
compiled, with their id sequences, into an automaton that shares prefixes and suffixes; its arrays lie
in one file that each worker maps into memory. A word that the automaton does not know is merged
exactly. Results never depend on which words were compiled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm._common import Table, bounded_batches, pieces, ragged, stored, texts_of, tidy

#: The pre-tokenizer's pattern of byte-level BPE, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 192  # bytes of a word from which a heap replaces whole-array merging


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself, or U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """A byte-level BPE: the bytes of each id, merges by rank, and special strings."""

    token: list[bytes]
    byte_id: np.ndarray
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    special: dict[str, int]
    pairs: Table = field(init=False)

    def __post_init__(self) -> None:
        self.pairs = Table(pair_key(self.left, self.right), self.made)
        self.rank = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(self.left, self.right))}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for s, i in ids.items():
            token[i] = bytes(letters[c] for c in s)
        for s, i in special.items():
            token[i] = s.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        single = {letters[s]: i for s, i in ids.items() if len(s) == 1}
        a, b = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([ids[x + y] for x, y in merges], np.int64)
        return cls(token, np.array([single[b] for b in range(256)], np.int64), a, b, made, special)

    def cut_words(self, text: str) -> list[str]:
        """Pre-tokenised words, special strings among them as words of their own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.words(part)
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging of one word with a heap of ranked neighbours."""
        ids = [int(self.byte_id[b]) for b in word]
        n = len(ids)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in rank:
                    heapq.heappush(heap, (rank[p], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in rank:
                heapq.heappush(heap, (rank[p], h, *p))
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: the ids of all, and how many each has.

        Each round merges, in every word, all places of its lowest-ranked pair from left to right. A
        merged token's pairs rank below the merge that made it, so that is the order of one at a time.
        """
        n = len(words)
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        done_w, done_p, done_i = [], [], []
        for k in long:
            ids = np.array(self.merge_long(words[k]), np.int64)
            done_w.append(np.full(len(ids), k)), done_p.append(np.arange(len(ids))), done_i.append(ids)
        sizes = np.array([0 if len(w) > LONG else len(w) for w in words], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(w for w in words if len(w) <= LONG), np.uint8)]
        word = np.repeat(np.arange(n), sizes)
        none = len(self.made)
        while len(ids):
            rank = self.pairs.find(pair_key(ids[:-1], ids[1:])).astype(np.int64)
            rank[(rank < 0) | (word[:-1] != word[1:])] = none
            rank = np.append(rank, none)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            per = np.diff(np.r_[first, len(ids)])
            going = np.repeat(least < none, per)
            if not going.all():
                still = ~going
                done_w.append(word[still]), done_p.append((np.arange(len(ids)) - np.repeat(first, per))[still]), done_i.append(ids[still])
            low = np.repeat(least, per)[going]
            ids, word, rank = ids[going], word[going], rank[going]
            hit = rank == low
            if len(hit) > 1 and (both := hit[1:] & hit[:-1]).any():  # of overlapping places every other one, from the left
                for i in np.flatnonzero(both):
                    if hit[i]:
                        hit[i + 1] = False
            at = np.flatnonzero(hit)
            ids[at] = self.made[low[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        if not done_w:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        w, p, i = map(np.concatenate, (done_w, done_p, done_i))
        return i[np.lexsort((p, w))], np.bincount(w, minlength=n)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


class Transducer:
    """A minimal acyclic automaton over bytes whose paths number its words; numbers lead to ids.

    An edge carries how many words sort before those behind it, so the sum along a path is the word's
    place in sorted order, and suffixes can be shared although outputs differ.
    """

    FIELDS = ("edge", "target", "skip", "final", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, words: list[bytes], vocabulary: Vocabulary) -> Transducer:
        words = sorted(set(words))
        ids, sizes = vocabulary.merge(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # of unsettled nodes: final, edges
        last = b""
        for w in [*words, b""]:
            same = len(os.path.commonprefix([w, last]))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1][-1] = (path[-1][1][-1][0], settle(node))
            for b in w[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = path[-1][0] or (w == last[:same] + w[same:] and (w != b"" or b"" in words[:1]))
            last = w
        root = settle(path[0])
        behind = [0] * len(states)  # words from each state; targets are settled before their sources
        for s, (final, edges) in enumerate(states):
            behind[s] = final + sum(behind[t] for _, t in edges)
        number = lambda s: root - s  # noqa: E731  the root, settled last, becomes 0
        rows = []
        for s, (final, edges) in enumerate(states):
            before = int(final)
            for b, t in edges:
                rows.append((number(s) << 8 | b, number(t), before))
                before += behind[t]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        final = np.zeros(len(states), np.uint8)
        for s, (f, _) in enumerate(states):
            final[number(s)] = f
        return cls({"edge": table[:, 0].copy(), "target": table[:, 1].astype(np.int32), "skip": table[:, 2].astype(np.int32), "final": final, "start": np.r_[0, np.cumsum(sizes)].astype(np.int64), "ids": ids.astype(np.int32)})

    def to_bytes(self) -> bytes:
        """A header of names, kinds and sizes, then the arrays, each at a multiple of 64."""
        arrays = [np.ascontiguousarray(getattr(self, n)) for n in self.FIELDS]
        head = json.dumps([[n, a.dtype.str, len(a)] for n, a in zip(self.FIELDS, arrays)]).encode()
        out = len(head).to_bytes(8, "little") + head
        for a in arrays:
            out += b"\0" * (-len(out) % 64) + a.tobytes()
        return out

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        data = np.memmap(path, np.uint8, "r")
        at = 8 + int.from_bytes(data[:8].tobytes(), "little")
        arrays = {}
        for name, kind, n in json.loads(data[8:at].tobytes()):
            at += -at % 64
            arrays[name] = data[at : at + n * np.dtype(kind).itemsize].view(kind)
            at += n * np.dtype(kind).itemsize
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """For each word its number, or -1; all words walk the automaton side by side."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        starts = np.cumsum(sizes) - sizes
        number, state = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live, depth = np.flatnonzero(sizes > 0), 0
        number[sizes == 0] = 0 if self.final[0] else -1
        while len(live):
            key = (state[live] << 8) | data[starts[live] + depth]
            at = np.searchsorted(self.edge, key)
            at[at == len(self.edge)] = 0
            ok = self.edge[at] == key if len(self.edge) else np.zeros(len(live), bool)
            number[live[~ok]] = -1
            live, at, depth = live[ok], at[ok], depth + 1
            state[live] = self.target[at]
            number[live] += self.skip[at]
            ends = sizes[live] == depth
            over = live[ends]
            number[over[self.final[state[over]] == 0]] = -1
            live = live[~ends]
        return number


class Encoder:
    """One per Python worker: words seen lately, then the automaton, then exact merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None, most: int = 400_000) -> None:
        self.vocabulary, self.lexicon, self.most = vocabulary, lexicon, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.sizes, self.ids, self.parts = np.zeros(0, np.int64), np.zeros(0, np.int32), 0
        self.starts = np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        words = [w.encode("utf-8", "surrogatepass") for w in new]
        n = len(words)
        sizes, found = np.zeros(n, np.int64), np.full(n, -1)
        if self.lexicon is not None:
            found = self.lexicon.find(words)
        known, rest = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        special = [k for k in rest if new[k] in self.vocabulary.special]
        if special:
            rest = np.setdiff1d(rest, special)
        merged, merged_sizes = self.vocabulary.merge([words[k] for k in rest])
        pieces = [merged.astype(np.int32)]
        starts = np.zeros(n, np.int64)
        sizes[rest] = merged_sizes
        starts[rest] = np.cumsum(merged_sizes) - merged_sizes
        at = len(merged)
        if len(known):
            own = np.asarray(self.lexicon.start)
            sizes[known] = own[found[known] + 1] - own[found[known]]
            pieces.append(np.asarray(self.lexicon.ids)[ragged(own[found[known]], sizes[known])])
            starts[known] = at + np.cumsum(sizes[known]) - sizes[known]
            at += int(sizes[known].sum())
        for k in special:
            pieces.append(np.array([self.vocabulary.special[new[k]]], np.int32))
            starts[k], sizes[k], at = at, 1, at + 1
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, *pieces])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if len(self.place) > self.most:
            self.clear()
        words: list[str] = []
        n_words = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = self.vocabulary.cut_words(t)
            n_words[k] = len(own)
            words += own
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            size = len(self.place)
            self.place.update(zip(new, range(size, size + len(new))))
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(n_words)]]
        return self.ids[ragged(self.starts[at], sizes)], np.diff(ends)


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids; ids outside the vocabulary are skipped, broken UTF-8 becomes U+FFFD."""
    token = vocabulary.token
    return b"".join([token[i] for i in ids if 0 <= i < len(token)]).decode("utf-8", "replace")


def word_counts(docs: DataFrame, text: str, vocabulary: str, flush: int = 300_000) -> DataFrame:
    """How often each pre-tokenised word occurs in the whole corpus; counted per task before the shuffle."""
    bounded_batches(docs.sparkSession)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = Vocabulary.read(vocabulary).cut_words, {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return rows

        for batch in pieces(batches, text):
            for t in texts_of(batch, text):
                for w in cut(t):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > flush:
                    yield out()
        if counts:
            yield out()

    return docs.select(text).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str = "text", vocabulary: str | None = None, words: int = 50_000, longest: int = 64) -> bytes:
    """Count all words of all documents, and compile the most frequent that occur more than once.

    At most ``words`` go to the driver: the cut lies between two tiers of counts, found from the tiers'
    sizes alone. Null texts have no words; an empty table gives an automaton without words, with which
    all words are merged.
    """
    path = vocabulary or default_vocabulary()
    own = Vocabulary.read(path)
    counts = word_counts(docs, text, path).filter((F.col("n") > 1) & (F.octet_length("word") <= longest) & ~F.col("word").isin(*own.special))
    counts = stored(counts.select("word", F.floor(F.log2("n") * 16).cast("int").alias("tier")), "words")
    total, least = 0, None
    for tier, n in sorted(((r.tier, r["count"]) for r in counts.groupBy("tier").count().collect()), reverse=True):
        if total + n > words:
            break
        total, least = total + n, tier
    top = [] if least is None else [r.word.encode() for r in counts.filter(F.col("tier") >= least).select("word").collect()]
    return Transducer.compile(top, own).to_bytes()


def _mapped(data: bytes) -> Transducer:
    """Put the automaton into this worker's temporary folder, once, and map it."""
    path = os.path.join(tempfile.gettempdir(), f"kinfold-{hashlib.sha256(data).hexdigest()[:24]}.mat")
    if not os.path.exists(path):
        part = f"{path}.{os.getpid()}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
    return Transducer.mapped(path)


def _each(docs: DataFrame, keep: list[str], schema, lexicon: bytes | None, vocabulary: str | None, make, text: str) -> DataFrame:
    """make(vocabulary, encoder, texts) gives the new columns' arrays for a batch."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or default_vocabulary()
    shipped = spark.sparkContext.broadcast(lexicon) if lexicon is not None else None

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary.read(path)
        encoder = Encoder(own, _mapped(shipped.value) if shipped is not None else None)
        for batch in pieces(batches, text):
            arrays, names = make(own, encoder, texts_of(batch, text))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + arrays, names=keep + names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(work, schema)


def bpe_encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, lexicon: bytes | None = None) -> DataFrame:
    """Append the token ids of every whole text as array<int>.

    A null or empty text has no ids. All other columns are kept, but one already called ``ids`` is
    replaced. Rows are independent, so ties, repeats and empty tables need no rule.
    """
    keep = [c for c in docs.columns if c != ids]

    def make(own: Vocabulary, encoder: Encoder, texts: list[str]):
        values, sizes = encoder.encode(texts)
        return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.int32()))], [ids]

    return _each(docs, keep, docs.select(*keep).schema.add(ids, T.ArrayType(T.IntegerType())), lexicon, vocabulary, make, text)


def bpe_decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Append the text of an id column; null and empty lists, and null items, give no text.

    All other columns are kept, but one already called ``decoded`` is replaced; an empty table gives an
    empty result.
    """
    bounded_batches(df.sparkSession)
    path = vocabulary or default_vocabulary()
    keep = [c for c in df.columns if c != text]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary.read(path)
        for batch in batches:
            texts = [decode(own, [i for i in x or [] if i is not None]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, text])

    return df.select(*keep).mapInArrow(work, df.select(*keep).schema.add(text, "string"))


def bpe_digest(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None, lexicon: bytes | None = None) -> DataFrame:
    """Encode and decode every text in one pass; return counts and digests instead of the lists.

    A null text is an empty one, of no ids; repeated rows get repeated results, and other columns are not
    looked at. An empty table gives an empty result.
    """

    def make(own: Vocabulary, encoder: Encoder, texts: list[str]):
        values, sizes = encoder.encode(texts)
        names = make.names = getattr(make, "names", None) or [str(i) for i in range(len(own.token))]
        id_sha, text_sha, at = [], [], 0
        for n in sizes.tolist():
            own_ids = values[at : at + n].tolist()
            at += n
            id_sha.append(hashlib.sha256(",".join([names[i] for i in own_ids]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(decode(own, own_ids).encode("utf-8", "surrogatepass")).hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]

    schema = docs.select(id_column).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return _each(docs, [id_column], schema, lexicon, vocabulary, make, text)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; odd rows as in ``bpe_digest``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_digest(docs, lexicon=build_lexicon(docs))
