"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample of vectors: a node splits by the plane halfway between two of its
vectors, down to leaves. Every vector is then put into its leaf of each tree. A query visits the leaves
of all trees in one order of priority until these hold enough vectors; the vectors in them are
reranked by their exact cosine. The order is how likely a leaf is to hold a near vector: a plane
that the query lies far from leaves little chance to its other side, and the chances along a path multiply.

Vectors are dealt over parts of bounded size, with their leaves; each query goes to every part with the
leaves it visits, and a part returns its best few. So vectors are shuffled once, whatever the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm._common import bounded_batches, stored, tidy


#: How unlikely a side is, -log of 0.5 erfc(z), by z in steps; what lies beyond is as unlikely as the last.
REACH, GRID = 6, 4096
UNLIKELY = np.array([-log(max(0.5 * erfc(k / GRID), 1e-12)) for k in range(-REACH * GRID, REACH * GRID + 1)], np.float32)
CELLS = 1 << 21  # nodes and leaves of the queries that are looked at together


@dataclass(frozen=True)
class Forest:
    """``sample`` bounds the vectors that splits are fitted on, the first by a hash of the id, and
    ``plane_bytes`` what all planes take, which every task gets; ``part_bytes`` bounds a part's vectors.

    ``leaf`` is the size of a leaf aimed at. A query visits leaves that hold ``budget`` times the square
    root of the number of vectors together, at every size of table; ``near`` is the cosine of a vector
    that is worth finding, by which chances are reckoned.
    """

    trees: int = 32
    leaf: int = 32
    budget: float = 42.0
    near: float = 0.5
    sample: int = 40_000
    plane_bytes: int = 64 << 20
    part_bytes: int = 64 << 20
    seed: int = 3

    def sampled(self, dims: int) -> int:
        """How many vectors to fit on: a tree of as many leaves as vectors has a plane for each."""
        return max(self.leaf, min(self.sample, self.plane_bytes * self.leaf // (4 * max(1, dims) * self.trees)))


@dataclass
class Trees:
    """Nodes of all trees: a plane (normal, offset), its vectors' mean and spread across it, and two children; a negative child -1 - k is leaf k."""

    normal: np.ndarray
    offset: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    child: np.ndarray
    roots: list[int]
    leaf_share: np.ndarray  # of the sample that lies in each leaf

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, spec: Forest) -> Trees:
        """``sample``: unit vectors. Leaves get ``spec.leaf`` of ``rows``, as far as the sample can tell: one of its vectors at least."""
        r = np.random.default_rng(spec.seed)
        sample = sample.astype(np.float32)
        small = max(1, round(spec.leaf * len(sample) / max(1, rows)))
        planes, children, share = [], [], []

        def leaf(own: np.ndarray) -> int:
            share.append(len(own) / max(1, len(sample)))
            return -len(share)

        def grow(own: np.ndarray) -> int:
            if len(own) <= small:
                return leaf(own)
            for _ in range(5):
                a, b = sample[own[r.integers(0, len(own), 2)]]
                n = a - b
                size = float(np.sqrt(n @ n))
                if size < 1e-6:
                    continue
                n = n / np.float32(size)
                side = sample[own] @ n
                at = float(np.median(side))
                up = side > at
                if 0 < up.sum() < len(own):
                    break
            else:
                return leaf(own)  # (nearly) the same vector throughout
            k = len(planes)
            planes.append((n, at, float(side.mean()), float(side.std())))
            children.append([0, 0])
            children[k][0] = grow(own[~up])
            children[k][1] = grow(own[up])
            return k

        roots = [grow(np.arange(len(sample))) for _ in range(spec.trees)]
        dims = sample.shape[1] if sample.ndim == 2 else 0
        column = lambda i: np.array([p[i] for p in planes], np.float32)
        return cls(column(0).reshape(len(planes), dims), column(1), column(2), column(3), np.array(children, np.int64).reshape(-1, 2), roots, np.array(share))

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """For each vector its leaf of each tree."""
        unit = unit.astype(np.float32)
        out = np.zeros((len(unit), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            node = np.full(len(unit), root)
            live = np.flatnonzero(node >= 0)
            while len(live):
                own = node[live]
                up = np.einsum("ij,ij->i", unit[live], self.normal[own]) > self.offset[own]
                node[live] = self.child[own, up.astype(np.int64)]
                live = live[node[live] >= 0]
            out[:, t] = -1 - node
        return out

    def levels(self) -> list[np.ndarray]:
        """The nodes of all trees by depth."""
        out, nodes = [], np.array([r for r in self.roots if r >= 0], np.int64)
        while len(nodes):
            out.append(nodes)
            below = self.child[nodes].reshape(-1)
            nodes = below[below >= 0]
        return out

    def search(self, unit: np.ndarray, enough: float, near: float = 0.5) -> list[np.ndarray]:
        """For each query the leaves it visits, the likeliest first in all trees at once, until they hold ``enough`` samples' shares.

        No leaf is likelier than the nodes above it, so a queue that opens the likeliest node first yields leaves
        in the order of their own chances; these are reckoned for whole levels and many queries in arrays.
        """
        levels, share = self.levels(), self.leaf_share
        scale = 1 / np.maximum(self.spread * sqrt(2 * (1 - near * near)), 1e-6)
        base, unit = self.mean * (1 - near) - self.offset, unit.astype(np.float32)
        out = []
        step = max(1, CELLS // (len(self.offset) + len(share)))
        for lo in range(0, len(unit), step):
            own = unit[lo : lo + step]
            # where a near vector lies across a plane: about its mean, drawn towards the query
            z = self.normal @ own.T
            z *= np.float32(near)
            z += base[:, None].astype(np.float32)
            z *= scale[:, None].astype(np.float32)
            at = (np.clip(z, -REACH, REACH) * np.float32(GRID) + np.float32(REACH * GRID + 0.5)).astype(np.int32)
            cost, cells = np.zeros(z.shape, np.float32), np.zeros((len(share), len(own)), np.float32)
            for nodes in levels:
                for side in (0, 1):
                    below = self.child[nodes, side]
                    c = cost[nodes] + UNLIKELY[at[nodes] if side == 0 else len(UNLIKELY) - 1 - at[nodes]]
                    cost[below[below >= 0]] = c[below >= 0]
                    cells[-1 - below[below < 0]] = c[below < 0]
            for c in np.ascontiguousarray(cells.T):
                k = min(len(c), int(2 * enough / max(share.mean(), 1e-12)) + 64)
                while True:
                    few = np.argpartition(c, k - 1)[:k] if k < len(c) else np.arange(len(c))
                    few = few[np.lexsort((few, c[few]))]
                    held = np.cumsum(share[few])
                    if k == len(c) or held[-1] >= enough:
                        break
                    k = min(len(c), 2 * k)
                out.append(few[: int(np.searchsorted(held, enough)) + 1].astype(np.int32))
        return out


class Part:
    """A part's vectors and which of them each leaf holds."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, cells: np.ndarray) -> None:
        self.ids, self.v = ids, v
        order = np.argsort(cells, axis=None, kind="stable")
        self.rows = (order // max(1, cells.shape[1])).astype(np.int32)
        self.cells, self.starts = np.unique(cells.reshape(-1)[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(order)]

    def best(self, query: int, q: np.ndarray, visited: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the vectors in the leaves visited, but for the query itself."""
        at = np.searchsorted(self.cells, visited)
        at[at == len(self.cells)] = 0
        at = at[self.cells[at] == visited]
        rows = np.unique(np.concatenate([self.rows[s:e] for s, e in zip(self.starts[at], self.ends[at])])) if len(at) else np.zeros(0, np.int32)
        rows = rows[self.ids[rows] != query]
        score, ids = cosines(q, self.v[rows]), self.ids[rows]
        if len(rows) > 4 * k:
            few = score >= np.partition(score, -k)[-k]
            score, ids = score[few], ids[few]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a finite vector that is not zero, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.col(id_column).isNotNull()
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))


def matrix(column, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column))).astype(kind)


def unit_of(v: np.ndarray) -> np.ndarray:
    """Scaled first by the largest component, so that neither tiny nor huge vectors lose their length."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosines(query: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal numbers."""
    a, b = query / np.abs(query).max(), v / np.abs(v).max(1, keepdims=True)
    return (b * a).sum(1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))


def nearest(vectors: DataFrame, queries, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", spec: Forest = Forest()) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest rows by cosine, ties to the smaller id.

    ``queries`` is a condition on rows. Rows without id, or whose vector is null, zero, or holds nulls
    or non-finite numbers, take no part, nor do vectors whose length is not the most common one (ties:
    the larger). Rows that share a query's id are its own. All candidates come back if there are fewer
    than k; an empty table gives none. Of equal vectors only the k + 1 smallest ids can be among a
    query's k nearest, so no more are kept.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, id_column, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = sizes[0].d if sizes else 0
    rows = rows.filter(F.size("v") == dims)
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    kept = stored(rows.distinct().withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= k + 1).drop("__n"), "vectors", lasting=True)
    total = kept.count()
    sample = kept.orderBy(F.xxhash64("id", F.lit(spec.seed)), "id").limit(spec.sampled(dims)).toArrow()
    trees = Trees.fit(unit_of(matrix(sample.column("v"))) if total else np.zeros((0, 0)), total, spec)
    enough = spec.budget / sqrt(max(1, total))
    # Neither number changes a result: parts of bounded size, a few at least, and searches over more tasks than the rows take.
    parts = max(-(-total * dims * 8 // spec.part_bytes), min(16, total // 4096 + 1))
    shipped = spark.sparkContext.broadcast(trees)
    asked = rows.filter(queries(F.col("id"))).distinct().repartition(max(8, total // 4096), "id")

    def with_cells(find):
        @tidy
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cells = find(shipped.value, unit_of(matrix(b.column("v"))))
                    ends = np.r_[0, np.cumsum([len(c) for c in cells])]
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cells), pa.int32()))], names=["id", "v", "cells"])

        return work

    schema = "id long, v array<double>, cells array<int>"
    members = kept.mapInArrow(with_cells(lambda t, u: list(t.leaves(u))), schema).select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"), "id", "v", "cells")
    visits = asked.mapInArrow(with_cells(lambda t, u: t.search(u, enough, spec.near)), schema).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("side"), "id", "v", "cells")
    dealt = members.unionByName(visits).repartition(parts, "part").sortWithinPartitions("part", "side", "id")

    @tidy
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come in order: first a part's vectors, then the queries."""
        at, own, held = None, None, []
        for b in batches:
            part, side, ids = (b.column(c).to_numpy() for c in ("part", "side", "id"))
            if not b.num_rows:
                continue
            cut = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (side[1:] != side[:-1])])
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows]):
                if at != part[s]:
                    at, own, held = part[s], None, []
                run = b.slice(s, e - s)
                if side[s] == 0:
                    held.append((ids[s:e], matrix(run.column("v")), matrix(run.column("cells"), np.int32)))
                    continue
                if own is None and held:
                    own, held = Part(*(np.concatenate(x) for x in zip(*held))), []
                if own is not None:
                    visited, ends = run.column("cells").flatten().to_numpy(), np.cumsum(run.column("cells").value_lengths().to_numpy())
                    for query, q, a, z in zip(ids[s:e].tolist(), matrix(run.column("v")), [0, *ends.tolist()], ends.tolist()):
                        out.append((query, *own.best(query, q, visited[a:z], k)))
            if out:
                q = np.repeat([x[0] for x in out], [len(x[1]) for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate([x[1] for x in out]), pa.int64()), pa.array(np.concatenate([x[2] for x in out]), pa.float64())], names=["query_id", "id", "score"])

    found = dealt.mapInArrow(rerank, "query_id long, id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all others; odd vectors as in ``nearest``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, lambda i: i % 50 == 0)
