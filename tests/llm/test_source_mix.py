import re
from collections import Counter, defaultdict

from pyspark.sql import Row
from pyspark.sql import functions as F

from kinfold.llm.source_mix import Mix, _highest_quotients, mix_sources, mixed_documents, op7_source_mix


def expected_targets(sizes):
    """{source: target} by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, ws = total - sum(capped.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / ws > 3 * sizes[s]] if free else []
        if not over:
            return {**capped, **{s: left * w[s] / ws for s in free}}
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, text_size=None):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want, taken = expected_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(200, 0.02 * t), (s, taken[s], t)


def test_documents(spark, small):
    a = {(r.doc_id): r for r in op7_source_mix(spark, small).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(a) == len(docs)
    rows = [Row(**r.asDict(), source=docs[d].source) for d, r in a.items()]
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or ""))
    check(rows)
    assert {d: r.taken for d, r in a.items()} == {r.doc_id: r.taken for r in op7_source_mix(spark, small).repartition(3).collect()}


def test_skew_nulls_ties_and_tiny_sources(spark):
    rows = [(i, "w " * (30 + i % 50), "big") for i in range(900)] + [(1000 + i, "a b c " * 40, s) for s in ("a", "b", None, "c") for i in range(25)]
    rows += [(2000, None, "a"), (2001, "", "empty"), (None, "x y z " * 20, "a"), (1000, "a b c " * 40, "a"), (1000, "a b c " * 40, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix_sources(df, mix=Mix(shard_words=2500))
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    out = got.collect()
    assert len(out) == len(rows)
    check(out)
    assert mix_sources(df.filter("false")).count() == 0
    whole = mixed_documents(df.drop("size"))
    assert whole.columns == ["doc_id", "text", "source"] and whole.count() > 0
    assert mixed_documents(df.drop("size").filter("false")).count() == 0


def test_highest_quotients(spark):
    shares = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.4), ("e", 0.0), ("f", 6.6)]
    seats = 107
    q = sorted(((v / (2 * k + 1), -i, n) for i, (n, v) in enumerate(shares) for k in range(120) if v), reverse=True)[:seats]
    want = Counter(n for _, _, n in q)
    df = spark.createDataFrame([(n, v, seats) for n, v in shares], "s string, share double, seats long")
    assert {r.s: r.quota for r in _highest_quotients(df, "share", "seats", None, "s").collect()} == {n: want[n] for n, _ in shares}


def highest(shares, seats):
    """Seats by listing all quotients; shares are in the order that breaks ties."""
    got = [0] * len(shares)
    quotients = sorted((-v / (2 * k + 1), i, k) for i, v in enumerate(shares) if v > 0 for k in range(seats + 1))
    for _, i, _ in quotients[:seats]:
        got[i] += 1
    return got


def test_blocks_and_quotas_against_brute_force(spark):
    """Every shard's quota by all quotients, and every word's block by laying the words out."""
    mix = Mix(block_words=8, shard_words=300)
    rows = [(i, "w " * (5 + i * 7 % 60), ("big", "mid", None, "tiny")[0 if i % 10 < 6 else 1 if i % 10 < 8 else 2 if i < 350 else 3]) for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mix_sources(df, mix=mix).collect()}
    seen = df.select("doc_id", "source", F.size(F.split(F.trim("text"), " ")).alias("size"), F.xxhash64(F.lit(mix.seed), "doc_id").alias("h")).withColumn("deal", F.xxhash64(F.lit(mix.seed + 1), "h")).collect()
    sizes = Counter()
    for r in seen:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want, b = expected_targets(sizes), mix.block_words
    quotas = dict(zip(order, highest([want[s] / b for s in order], int(sum(sizes.values()) / b + 0.5))))
    for rank, s in enumerate(order, 1):
        n = max(1, -(-sizes[s] // mix.shard_words))
        shards = defaultdict(list)
        for r in seen:
            if r.source == s:
                shards[r.deal % n].append(r)
        own = highest([quotas[s] * sum(r.size for r in shards[k]) / sizes[s] for k in sorted(shards)], quotas[s])
        assert sum(own) == quotas[s]
        for k, blocks in zip(sorted(shards), own):
            words = sum(r.size for r in shards[k])
            has = max(1, int(words / b + 0.5))
            turn = spark.range(1).select(F.pmod(F.xxhash64(F.lit(mix.seed + 2), F.lit(rank), F.lit(k).cast("long")), F.lit(has)).alias("x")).first().x
            whole = min(blocks // has, mix.most)
            rest = 0 if blocks // has >= mix.most else blocks % has
            times = [whole + (p + 1 + turn) * rest // has - (p + turn) * rest // has for p in range(has)]
            of_word = [p for p in range(has) for _ in range((p + 1) * words // has - p * words // has)]
            at = 0
            for r in sorted(shards[k], key=lambda r: r.h):
                assert got[r.doc_id] == sum(times[p] for p in of_word[at : at + r.size]), (s, k, r.doc_id)
                at += r.size


def test_very_long_texts_and_a_text_column_of_a_taken_name(spark):
    df = spark.createDataFrame([(1, "word " * 200_000, "a"), (2, "x " * 50, "a"), (3, "y " * 70_000, "b")], "doc_id long, taken string, source string")
    got = {r.doc_id: r for r in mix_sources(df, text="taken").collect()}
    assert [got[i].size for i in (1, 2, 3)] == [200_000, 50, 70_000]
    assert abs(sum(r.taken for r in got.values()) - 270_050) < 1000 and all(0 <= r.taken <= 3 * r.size for r in got.values())
