"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A text's set holds the hashes of its distinct word n-grams. Sizes are cut into bands. In a band, hash
space is cut into more parts than two linked sets can differ in elements, so linked sets agree on a
whole part: (band, part, content of the part) names a *tile*, and only texts in one tile are ever
compared. Passages that many texts share do not fill tiles, since a part holds whatever the text has
there. Inside a tile a 1024-bit signature (bit = parity of the elements that hash to it) bounds the
overlap from above: the differing bits of two signatures are at most the differing elements. Pairs
that pass get an exact intersection of sorted arrays.

Only links that join different components matter for the result, so a tile first gives each member
one candidate, the tile's smallest document; later rounds look at tiles that still hold members of
different components, pair by pair, hot tiles in blocks. No link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._common import WordIds, bounded_batches, grouped_words, mix, pieces, scratch, stored, texts_of, tidy

U = np.uint64
BITS = 1024
BASE = U(0x9E3779B97F4A7C15)
BLOCK = 1024  # members of a tile that one group compares
SENT_ROWS = 500_000  # rows of one or two numbers that are sent to all tasks at most; more are joined by a shuffle
PIECE = 256  # texts whose sets are made at a time
SALTS = 16  # tasks over which one set's documents are dealt, where sets are too many to be sent
FAITH = 6  # how often hash space is cut anew for a set that leaves parts empty


@dataclass(frozen=True)
class Threshold:
    """Texts link when 100 * intersection >= percent * union of their n-gram sets."""

    words: int = 5
    percent: int = 80
    ratio: float = 1.5  # of a band's ends

    def bands(self) -> np.ndarray:
        """The least size of each band; the last is beyond any text."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * self.ratio)))
        return np.array(out, np.int64)

    def differ(self, a, b):
        """Elements in which linked sets of these sizes can differ at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def differ_within(self, a: int, most: int) -> int:
        """The same for a set of size a and any that it may link to of size ``most`` or less."""
        return self.differ(a, min(most, a * 100 // self.percent))

    def parts(self, most: int) -> int:
        """Into how many parts hash space is cut for sets up to this size: more than they can differ in,
        and an eighth beyond, so that those left empty by chance do not matter."""
        d = self.differ(most, most)
        return d + 1 + d // 8


def shingles(texts: list[str], n: int, known: WordIds) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each lower-cased text; a shorter text is one n-gram."""
    known.fresh()
    words, sizes = grouped_words(texts, lower=True)
    h = known.hashes(known.ids(words))
    run = h[: max(0, len(h) - n + 1)].copy()
    for j in range(1, n):
        run = run * BASE + h[j : len(h) - n + 1 + j] if len(run) else run
    run = mix(run)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= n:
            out.append(np.unique(run[at : at + size - n + 1]))
        elif size:
            one = U(size)
            for x in h[at : at + size]:
                one = U((int(one) * int(BASE) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([one], U)))
        else:
            out.append(np.zeros(0, U))
        at += size
    return out


def signature(own: np.ndarray, bits: int = BITS) -> bytes:
    return np.packbits((np.bincount((own & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def wide_signature(own: np.ndarray) -> bytes:
    """As many bits as a large set has elements, so that its bound still tells; empty where ``BITS`` will do."""
    return signature(own, 1 << (len(own) - 1).bit_length()) if len(own) > BITS else b""


def folded(wide: np.ndarray, words: int) -> np.ndarray:
    """A signature's 64-bit words as those of a shorter one: parities of the bits that fall together."""
    return np.bitwise_xor.reduce(wide.reshape(-1, words), axis=0)


def wide_differ(x: bytes, y: bytes) -> int:
    """In how many bits two wide signatures differ, at the shorter one's length."""
    a, b = np.frombuffer(x, U), np.frombuffer(y, U)
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def _parts(own: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each part of hash space how many elements lie there, and a hash of them."""
    edges = ((np.arange(1, parts, dtype=np.uint64) << U(32)) // U(parts)) << U(32)
    cut = np.r_[0, np.searchsorted(own, edges), len(own)]
    total = np.r_[U(0), np.cumsum(mix(own + BASE))]
    return np.diff(cut), total[cut[1:]] - total[cut[:-1]]


def _part_keys(own: np.ndarray, parts: int, may_differ: int, prefix: int) -> list[np.ndarray]:
    """The keys of the parts that hold elements.

    Where more parts hold elements than linked sets can differ in, one of them must agree. Where not,
    which both sets of a pair that agrees on none of them can tell alone, space is cut again by
    another hash, and in the end empty parts count as agreeing.
    """
    out: list[np.ndarray] = []
    for depth in range(FAITH):
        count, content = _parts(own, parts)
        place = mix(np.arange(parts, dtype=np.uint64) + U(prefix + (depth << 36)))
        full = count > 0
        out.append(mix(content[full] ^ place[full]))
        if int(full.sum()) > may_differ:
            return out
        own = np.sort(mix(own ^ U(0xA0761D6478BD642F)))
    out.append(place[~full])
    return out


def tile_keys(own: np.ndarray, rule: Threshold, bands: np.ndarray) -> np.ndarray:
    """The tiles of a set: those of its own band, and of bands whose sets it may link to as the smaller one."""
    n = len(own)
    if not n:
        return np.zeros(0, np.int64)
    k = int(np.searchsorted(bands, n, "right")) - 1
    out: list[np.ndarray] = []
    while k + 1 < len(bands) and (bands[k] <= n or 100 * n >= rule.percent * int(bands[k])):
        most = int(bands[k + 1]) - 1
        out += _part_keys(own, rule.parts(most), rule.differ_within(n, most), (k + 1) << 40)
        k += 1
    return np.unique(np.concatenate(out)).view(np.int64)


def _sum(x: np.ndarray, salt: int) -> int:
    return int(np.array([mix(x ^ U(salt)).sum(dtype=np.uint64)], U).view(np.int64)[0])


def signatures(docs: DataFrame, rule: Threshold) -> DataFrame:
    """Per row (id, text): id, set size, two hashes of the set, the bitmap, and a large set's wide bitmap."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in pieces(batches, rows=PIECE):
            sets = shingles(texts_of(batch), rule.words, known)
            hashes = [pa.array([_sum(s, salt) for s in sets], pa.int64()) for salt in (1, 0x5851F42D4C957F2D)]
            bitmaps = [pa.array([f(s) for s in sets], pa.binary()) for f in (signature, wide_signature)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), *hashes, *bitmaps], names=["id", "n", "set1", "set2", "bits", "wide"])

    return docs.select("id", "text").mapInArrow(work, "id long, n long, set1 long, set2 long, bits binary, wide binary")


def tile_rows(docs: DataFrame, rule: Threshold) -> DataFrame:
    """(tile, id): the tiles of every document."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bands = WordIds(), rule.bands()
        for batch in pieces(batches, rows=PIECE):
            keys = [tile_keys(s, rule, bands) for s in shingles(texts_of(batch), rule.words, known)]
            ids = np.repeat(batch.column("id").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], names=["tile", "id"])

    return docs.select("id", "text").mapInArrow(work, "tile long, id long")


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _bounded(pairs: DataFrame, light: DataFrame, rule: Threshold) -> DataFrame:
    """Pairs (a, b), stored, whose signatures allow a link; ``same``: the sets are equal."""
    light = _only(light, stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids"))
    one = light.select(*[F.col(c).alias(f"{c}_a") for c in light.columns]).withColumnRenamed("id_a", "a")
    two = light.select(*[F.col(c).alias(f"{c}_b") for c in light.columns]).withColumnRenamed("id_b", "b")

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(c).to_numpy()
            n, m = get("n_a"), get("n_b")
            same = (n == m) & (get("set1_a") == get("set1_b")) & (get("set2_a") == get("set2_b"))
            off = np.bitwise_count(_bits(batch.column("bits_a")) ^ _bits(batch.column("bits_b"))).sum(axis=1, dtype=np.int64)
            ok = same | ((off <= rule.differ(n, m)) & (100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m)))
            for k in np.flatnonzero(ok & ~same & (np.minimum(n, m) > BITS)).tolist():
                ok[k] = wide_differ(batch.column("wide_a")[k].as_py(), batch.column("wide_b")[k].as_py()) <= rule.differ(int(n[k]), int(m[k]))
            yield pa.RecordBatch.from_arrays([pa.array(get("a")[ok]), pa.array(get("b")[ok]), pa.array(same[ok])], names=["a", "b", "same"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(work, "a long, b long, same boolean")


def _sent(table: DataFrame) -> DataFrame:
    """A stored table with a hint to send it to all tasks if it is of few enough rows; else as it is, to be shuffled."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is among ids (stored, distinct)."""
    return df.join(_sent(ids), "id", "left_semi")


def sets_of(docs: DataFrame, ids: DataFrame, rule: Threshold) -> DataFrame:
    """(id, own): the sorted n-gram hashes of the documents in question, from their texts, read again."""

    @tidy
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in pieces(batches, rows=PIECE):
            sets = shingles(texts_of(batch), rule.words, known)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "own"])

    return _only(docs.select("id", "text"), ids).mapInArrow(arrays, "id long, own binary")


def verified(pairs: DataFrame, light: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """Of the pairs (a, b) those that link: first by their bitmaps, then by exact intersection.

    Pairs are grouped by their first document, whose set goes once to each block of its partners.
    """
    maybe = stored(_bounded(pairs, light, rule), "maybe")
    unsure = maybe.filter(~F.col("same")).select("a", "b")
    blocks = unsure.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    partners = stored(unsure.join(blocks, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block")), "partners")
    heads = stored(partners.select(F.col("a").alias("id"), "block").distinct(), "heads")
    row = lambda key, side: [F.col(key).alias("a"), "block", F.lit(side).alias("side"), "id", "own"]
    both = sets.join(_sent(heads), "id").select(*row("id", 0)).unionByName(sets.join(_sent(partners), "id").select(*row("a", 1)))
    dealt = both.repartition("a", "block").sortWithinPartitions("a", "block", "side")

    @tidy
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tops = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for key, block, side, one, x in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "side", "id")), batch.column("own")):
                if head != (key, block):
                    head, tops = (key, block), []
                own = np.frombuffer(x.as_buffer(), U)
                if side == 0:
                    tops.append(own.copy())  # a repeated id has several sets
                elif any(_links(top, own, rule) for top in tops):
                    found.append((key, one))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return stored(maybe.filter("same").select("a", "b").unionByName(dealt.mapInArrow(exact, "a long, b long")).distinct(), "links")


def _links(a: np.ndarray, b: np.ndarray, rule: Threshold) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= rule.percent * (len(a) + len(b) - shared)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in a link (a, b).

    Alternates between hanging a node's larger neighbours and its smaller ones under the smallest of
    them, until nothing changes; each round is stored, so that lineage stays short.
    """

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.col("v").alias("u"), F.col("u").alias("v"))

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    e = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    before = state(e)
    while True:
        both = e.union(turned(e))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e = stored(e, "edges")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _compared(members: DataFrame, rule: Threshold, forest: bool) -> DataFrame:
    """Candidate pairs inside tiles between members of different components.

    ``members``: (tile, i, j, block, id, component, n, bits), a group being (tile, i, j). With
    ``forest`` a group gives pairs that join its components, nearest first; otherwise all that the
    bitmaps allow.
    """

    def group(ids, comp, n, bits, block, i, j) -> Iterator[tuple[int, int]]:
        order = np.lexsort((ids, n))
        ids, comp, n, bits, block = ids[order], comp[order], n[order], bits[order], block[order]
        found: list[tuple[int, int, int]] = []
        for r in range(len(ids) - 1):
            top = int(np.searchsorted(n, int(n[r]) * 100 // rule.percent, "right"))
            if top <= r + 1:
                continue
            s = slice(r + 1, top)
            off = np.bitwise_count(bits[s] ^ bits[r]).sum(axis=1, dtype=np.int64)
            ok = (off <= rule.differ(n[s], n[r])) & (comp[s] != comp[r])
            if i != j:
                ok &= block[s] != block[r]
            for k in np.flatnonzero(ok):
                found.append((int(off[k]), r, r + 1 + int(k)))
        if not forest:
            yield from ((int(ids[x]), int(ids[y])) for _, x, y in found)
            return
        root: dict[int, int] = {}

        def top_of(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        for _, x, y in sorted(found):
            a, b = top_of(int(comp[x])), top_of(int(comp[y]))
            if a != b:
                root[a] = b
                yield int(ids[x]), int(ids[y])

    names = ("tile", "i", "j", "block", "id", "component", "n")

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append((*(batch.column(c).to_numpy() for c in names), _bits(batch.column("bits"))))
            if not held:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            tile, i, j = cols[:3]
            new = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            ends = np.r_[new[1:], len(tile)]
            if batch is not None:  # the last group may go on
                held = [tuple(c[new[-1] :] for c in cols)]
                new, ends = new[:-1], ends[:-1]
            a, b = [], []
            for s, e in zip(new.tolist(), ends.tolist()):
                if e - s > 1:
                    for x, y in group(cols[4][s:e], cols[5][s:e], cols[6][s:e], cols[7][s:e], cols[3][s:e], i[s], j[s]):
                        a.append(min(x, y)), b.append(max(x, y))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.mapInArrow(work, "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def _mixed(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """(tile, id, component): the members of tiles that hold different components, stored. A tile has one member of each different text."""
    placed = tiles.select("tile", "id").join(_sent(labels), "id", "left").select("tile", "id", F.coalesce("component", "id").alias("component"))
    many = placed.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("tile")
    return stored(placed.join(_sent(stored(many, "many")), "tile"), "mixed")


def _grouped(mixed: DataFrame, light: DataFrame) -> DataFrame:
    """The members in blocks with what ``_compared`` looks at.

    The members of a tile's largest component meet those of the others alone, so that a hot tile that
    is nearly of one component costs its size and not its square.
    """
    per = mixed.groupBy("tile", "component").agg(F.count("*").alias("members"))
    many = per.groupBy("tile").agg(F.max(F.struct("members", "component")).alias("top"), F.sum("members").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    many = many.select("tile", F.col("top.component").alias("most"), blocks(F.col("top.members")).alias("large"), blocks(F.col("all") - F.col("top.members")).alias("small"))
    dealt = mixed.join(_sent(stored(many, "many")), "tile").withColumn("is_large", F.col("component") == F.col("most"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("is_large"), F.col("large")).otherwise(F.col("small"))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("is_large"), -1 - block).otherwise(block))  # the largest component's are below 0
    others = F.sequence(F.lit(0), F.col("small") - 1)
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("is_large"), others).otherwise(F.concat(F.sequence(-F.col("large"), F.lit(-1)), others))))
    # A merge join last: it brings a document's rows together, whose equal bitmaps then shrink to one in the shuffle.
    dealt = dealt.join(light.select("id", "n", "bits").hint("merge"), "id")
    dealt = dealt.select("tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n", "bits")
    return dealt.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "id")


def _copies(light: DataFrame) -> DataFrame:
    """(id, firsts, more): every document with a set that one of smaller id has as well, the smallest for each such set; ``more``: it has another set besides."""
    key = ["set1", "set2", "n"]
    firsts = stored(light.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select(*key, "first"), "firsts")
    rows = light.select("id", *key)
    if firsts.count() <= SENT_ROWS:
        marked = rows.join(F.broadcast(firsts), key, "left")
    else:  # a set that very many documents have is dealt over several tasks
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"], "left")
    marked = marked.withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    return marked.groupBy("id").agg(F.collect_set(F.when(F.col("copy"), F.col("first"))).alias("firsts"), F.max(~F.col("copy")).alias("more")).filter("size(firsts) > 0")


def _shared_tiles(keys: DataFrame) -> DataFrame:
    """(tile, id, lo, hi): the members of every tile that has more than one, and its smallest and largest.

    Keys are dealt by tile once, narrow as they are; the tiles that are shared, few of all, are found
    and joined with the keys in the same partitions. Near copies share many tiles of the very same
    members, known by their number and sums of their hashes; one of these tiles is enough.
    """
    dealt = keys.filter("tile is not null").repartition("tile")  # the filter that the join adds, so that both uses share one exchange
    hashed = F.xxhash64("id")
    members = [F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("members"), F.bit_xor(hashed).alias("x"), F.sum(F.shiftrightunsigned(hashed, 32)).alias("s")]
    shared = dealt.groupBy("tile").agg(*members).filter("lo < hi")
    once = shared.groupBy("lo", "hi", "members", "x", "s").agg(F.min("tile").alias("tile")).select("tile", "lo", "hi")
    return dealt.join(once.hint("shuffle_hash"), "tile").select("tile", "id", "lo", "hi")


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rule: Threshold = Threshold()) -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    A text without words (null, empty, blank) has size 0 and is its own component. Rows that share an
    id count as one document with several texts; rows with a null id are returned with a null
    component and link to nothing. Exact copies link through their equal sets.
    """
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
        table = stored(signatures(docs, rule), "signatures", lasting=True)
        light = table.filter("n > 0 and id is not null")
        copies = stored(_copies(light), "copies")
        first = docs.filter("id is not null").join(_sent(copies.filter("not more").select("id")), "id", "left_anti")
        tiles = stored(_shared_tiles(tile_rows(first, rule)), "tiles")
        ends = stored(tiles.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "ends")
        sets = stored(sets_of(docs, ends.select("id"), rule), "sets")
        pairs = [ends.filter(F.col("id") != F.col(c)).select(F.least("id", c).alias("a"), F.greatest("id", c).alias("b")) for c in ("lo", "hi")]
        links = [copies.select(F.col("id").alias("a"), F.explode("firsts").alias("b")), verified(stored(pairs[0].union(pairs[1]).distinct(), "candidates"), light, sets, rule)]
        labels = stored(components(links[0].unionByName(links[1])), "labels", lasting=True)
        light = stored(_only(light, ends.select("id")), "members")
        for forest in (True, False):
            tiles = _mixed(tiles, labels)
            candidates = stored(_compared(_grouped(tiles, light), rule, forest), "candidates")
            tried = candidates.count()
            if not tried:
                break
            new = verified(candidates, light, sets, rule)
            links.append(new)
            linked = new.count()
            if linked:
                labels = stored(components(reduce(DataFrame.unionByName, links)), "labels", lasting=True)
            if linked == tried:
                break  # every pair that joins a tile's components holds: nothing is left between them
        return table.join(labels, "id", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rule: Threshold = Threshold()) -> DataFrame:
    """The documents without near copies: of each component the row of the smallest id stays, once.

    Rows with a null id link to nothing and stay. Of rows with one id that head a component the smallest
    stays. Columns of any name are kept as they are; an empty table gives an empty result.
    """
    found = jaccard_components(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "id", "text", rule)
    gone = stored(found.filter("component_id <> id").select(F.col("id").alias("__gone")).distinct(), "gone", lasting=True)
    kept = docs.join(_sent(gone), F.col(id_column) == F.col("__gone"), "left_anti")
    if not _repeats(docs, id_column):
        return kept
    once = kept.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("key")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.select("row.*").unionByName(kept.filter(F.col(id_column).isNull()))


def _repeats(docs: DataFrame, id_column: str) -> bool:
    return bool(docs.select(id_column).filter(F.col(id_column).isNotNull()).groupBy(id_column).count().filter("count > 1").take(1))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; odd rows as in ``jaccard_components``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, rule=Threshold(words=3, percent=90))
