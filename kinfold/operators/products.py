"""The best pairs of two sides of sparse vectors, without a row for every token that a pair shares.

Both sides of a part are dealt into blocks, and each pair of blocks is one group that a task multiplies
in an array of fixed size. Of a group's pairs only those leave the task that are among the best of their
query, or of their target, within the group; the best of all groups are among these. So what is shuffled
are the vectors, once for each block of the other side, and never the products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES, TARGETS = 1024, 2048  # records of a block; their products are a few arrays of 16 MB
FLAT = 64  # a token of fewer products is multiplied together with others
DENSE, COLUMNS = 20_000, 512  # a token of as many goes into dense matrices of so many tokens
CHUNK = 1 << 20  # products of such tokens at a time
DIGITS = 6  # of a cosine; it is rounded once, before anything is ranked by it


@dataclass(frozen=True)
class Best:
    """What to keep: the best ``forward`` targets of a query and ``reverse`` queries of a target, from ``floor`` on.

    A pair's score is the sum of its first two channels, less ``penalty`` if both records have tokens in the
    third channel but none in common; ``bonus`` of the smaller of the two is added after the floor. With
    ``above`` the score must be above the floor. Ties go to the smaller id.
    """

    forward: int
    reverse: int = 0
    floor: float = 0.0
    above: bool = False
    bonus: float = 0.0
    penalty: float = 0.0


def vectors(weights: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """(part, id, keys, ws) from (part, entity_id, channel, token, w): a record's tokens as hashes that end in their channel's number."""
    number = F.lit(0)
    for k, name in enumerate(channels):
        number = F.when(F.col("channel") == name, k).otherwise(number)
    key = F.xxhash64("channel", "token").bitwiseAND(F.lit(~3)).bitwiseOR(number.cast("long"))
    rows = weights.filter("part is not null").select("part", F.col("entity_id").alias("id"), F.struct(key.alias("key"), "w").alias("x"))
    return rows.groupBy("part", "id").agg(F.sort_array(F.collect_list("x")).alias("v")).select("part", "id", F.col("v.key").alias("keys"), F.col("v.w").alias("ws"))


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _products(qk, qi, qw, tk, ti, tw, shape: tuple[int, int]) -> np.ndarray:
    """Sums of qw * tw over equal keys, by query and target. All are sorted by key."""
    out = np.zeros(shape)
    flat = out.reshape(-1)
    key_q, at_q, n_q = np.unique(qk, return_index=True, return_counts=True)
    key_t, at_t, n_t = np.unique(tk, return_index=True, return_counts=True)
    _, a, b = np.intersect1d(key_q, key_t, assume_unique=True, return_indices=True)
    at_q, n_q, at_t, n_t = at_q[a], n_q[a], at_t[b], n_t[b]
    dense = np.flatnonzero(n_q * n_t >= DENSE)
    for lo in range(0, len(dense), COLUMNS):
        own = dense[lo : lo + COLUMNS]
        sides = []
        for i, w, at, n, size in ((qi, qw, at_q, n_q, shape[0]), (ti, tw, at_t, n_t, shape[1])):
            columns = np.repeat(np.arange(len(own)), n[own])
            x = np.repeat(at[own] - np.r_[0, np.cumsum(n[own])[:-1]], n[own]) + np.arange(len(columns))
            sides.append(np.zeros((size, len(own))))
            sides[-1][i[x], columns] = w[x]
        out += sides[0] @ sides[1].T
    many = (n_q * n_t >= FLAT) & (n_q * n_t < DENSE)
    for sq, nq, st, nt in zip(at_q[many].tolist(), n_q[many].tolist(), at_t[many].tolist(), n_t[many].tolist()):
        out[qi[sq : sq + nq, None], ti[st : st + nt]] += qw[sq : sq + nq, None] * tw[st : st + nt]
    few = n_q * n_t < FLAT
    at_q, n_q, at_t, n_t = at_q[few], n_q[few], at_t[few], n_t[few]
    size = n_q * n_t
    ends = np.cumsum(size)
    for lo in range(0, len(size), CHUNK // FLAT):
        s = slice(lo, lo + CHUNK // FLAT)
        own = np.repeat(np.arange(len(size))[s], size[s])
        r = np.arange(len(own)) - np.repeat(ends[s] - size[s] - (ends[lo] - size[lo]), size[s])
        x, y = at_q[own] + r // n_t[own], at_t[own] + r % n_t[own]
        np.add.at(flat, qi[x] * shape[1] + ti[y], qw[x] * tw[y])
    return out


def _best(ok: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row's marked places the ``most`` of the highest scores, ties to the first."""
    keep = np.zeros_like(ok)
    for r in np.flatnonzero(ok.any(1)):
        at = np.flatnonzero(ok[r])
        if len(at) > most:
            v = score[r, at]
            least = np.partition(v, len(v) - most)[len(v) - most]
            over = at[v > least]
            at = np.r_[over, at[v == least][: most - len(over)]]
        keep[r, at] = True
    return keep


def _group(q: tuple, t: tuple, spec: Best) -> tuple[np.ndarray, ...]:
    """Rows and columns of the pairs to keep, with cn, ca and whether the third channel clashes."""
    shape = (len(q[0]), len(t[0]))
    side = lambda x, c: (lambda own, order: tuple(y[own][order] for y in x[1:]))(own := (x[1] & 3) == c, np.argsort(x[1][own], kind="stable"))
    cn, ca = (_half_up(_products(*side(q, c), *side(t, c), shape), DIGITS) for c in (0, 1))
    base, clash = cn + ca, np.zeros(shape, bool)
    ok = (base > 0) & (_half_up(base, 8) >= spec.floor)
    if spec.penalty:
        a, b = side(q, 2), side(t, 2)
        has_q, has_t = np.zeros(shape[0], bool), np.zeros(shape[1], bool)
        has_q[a[1]], has_t[b[1]] = True, True
        clash = has_q[:, None] & has_t & (_products(*a, *b, shape) == 0)
        base = base - spec.penalty * clash
        ok &= _half_up(base, 8) >= spec.floor
    score = _half_up(base + spec.bonus * np.minimum(cn, ca), 8)
    if spec.above:
        ok &= score > spec.floor
    keep = _best(ok, score, spec.forward)
    if spec.reverse:
        keep |= _best(ok.T, score.T, spec.reverse).T
    r, c = np.nonzero(keep)
    return r, c, cn[r, c], ca[r, c], clash[r, c]


def _side(rows: pa.Table) -> tuple:
    """(ids, keys, places, weights) of a group's side, a place for each token."""
    sizes = np.array(rows.column("keys").combine_chunks().value_lengths(), np.int64)
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("id").combine_chunks(), flat("keys"), np.repeat(np.arange(len(sizes)), sizes), flat("ws")


def best_pairs(q: DataFrame, t: DataFrame, spec: Best) -> DataFrame:
    """(part, s1, t, cn, ca, clash) from ``vectors`` of both sides, ids unique within a part.

    All pairs that are among the best of their query or target in the part are there, and others that
    are so in a group alone: rank again. A record without tokens, or of a part that the other side lacks,
    has no pairs; an empty side gives none.
    """
    many = lambda d, size, name: d.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = many(q, QUERIES, "nq").join(many(t, TARGETS, "nt"), "part")
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = q.join(blocks, "part").select("part", of("nq").alias("i"), every("nt").alias("j"), F.lit(0).alias("side"), "id", "keys", "ws")
    two = t.join(blocks, "part").select("part", every("nq").alias("i"), of("nt").alias("j"), F.lit(1).alias("side"), "id", "keys", "ws")
    dealt = one.unionByName(two).repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "side", "id")

    def result(part: str, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held)
        first = int((rows.column("side").to_numpy() == 0).sum())
        if not 0 < first < rows.num_rows:
            return None
        a, b = _side(rows.slice(0, first)), _side(rows.slice(first))
        r, c, cn, ca, clash = _group(a, b, spec)
        return pa.RecordBatch.from_arrays([pa.array([part] * len(r), pa.string()), a[0].take(pa.array(r)), b[0].take(pa.array(c)), pa.array(cn), pa.array(ca), pa.array(clash)], names=["part", "s1", "t", "cn", "ca", "clash"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "i", "j"))))
            at = 0
            while at < len(keys):
                if keys[at] != group:
                    if held and (out := result(group[0], held)) is not None:
                        yield out
                    group, held = keys[at], []
                end = at + 1
                while end < len(keys) and keys[end] == group:
                    end += 1
                held.append(batch.slice(at, end - at))
                at = end
        if held and (out := result(group[0], held)) is not None:
            yield out

    return dealt.mapInArrow(work, "part string, s1 string, t string, cn double, ca double, clash boolean")
