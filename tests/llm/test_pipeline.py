from collections import Counter, defaultdict

import corpus_pipeline as c
from kinfold.llm._common import WordIds
from kinfold.llm.bpe import Encoder, Vocabulary, default_vocabulary
from kinfold.llm.quality_rules import Rules, measure
from kinfold.llm.toxicity import Inputs, Net, fit_toxicity, score_texts
from tests.llm.test_jaccard_join import brute
from tests.llm.test_source_mix import expected_targets


def test_stages_against_plain_versions(spark, small, tmp_path):
    """Every stage of a small corpus, each on what its predecessor kept, against the same by loops."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic")
        texts = [r.text or "" for r in before.values()]
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = Counter(r.doc_id for r in out.select("doc_id").collect())
        if k < len(c.STAGES) - 1:
            assert out.columns == columns, name
            assert all(r == before[r.doc_id] for r in out.collect()), name
        if k == 0:
            kept = measure(texts, Rules(), WordIds())["kept"]
            assert after == Counter(d for d, ok in zip(before, kept) if ok)
        elif k == 1:
            params = fit_toxicity(docs, labels)
            assert after == Counter(d for d, s in zip(before, score_texts(Inputs(params, Net()), texts, Net())) if s < 0.7)
        elif k == 2:
            assert after == Counter(d for d, (_, head) in brute([(d, r.text) for d, r in before.items()], 5, 80).items() if d == head)
        elif k == 3:
            sizes, taken = Counter(), defaultdict(int)
            for d, r in before.items():
                n = len((r.text or "").encode().split())
                sizes[r.source] += n
                taken[r.source] += n * after[d]
            assert set(after) <= set(before) and max(after.values()) <= 3
            largest = max(len(t.split()) for t in texts)
            for s, want in expected_targets(sizes).items():
                assert abs(taken[s] - want) <= max(3 * largest, 0.1 * want), (s, taken[s], want)
            mixed = after
        docs, before = out, before if k > 2 else {d: r for d, r in before.items() if d in after}
    encoder = Encoder(Vocabulary.read(default_vocabulary()), None)
    rows = docs.collect()
    assert Counter(r.doc_id for r in rows) == mixed
    for r in rows:
        ids, _ = encoder.encode([before[r.doc_id].text])
        assert r.n_tokens == len(ids) and r.ids == ids.tolist()


def test_stages_stand_odd_rows(spark, small):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "word " * 30, "en", "a", 150), (3, "word other third " * 40, "en", None, 9), (4, " ".join(f"w{i}" for i in range(20_000)), "en", "a", 9), (4, " ".join(f"w{i}" for i in range(20_000)), "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "1 as id", "'x' as side", "2 as kept", "3 as score", "4 as row", "5 as size", "6 as taken", "7 as component_id")
    for k, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, small).collect()
        out = stage(spark, clash, small)
        assert k == len(c.STAGES) - 1 or out.columns == clash.columns, name
        out.collect()
        assert stage(spark, docs.filter("false"), small).count() == 0, name


def test_run_removes_what_its_stages_stored(spark, small):
    import os

    from kinfold.sources.shared import shared_dir

    folder = f"{shared_dir(spark)}/kinfold"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert c.run(spark, small).count() > 0
    assert len(set(os.listdir(folder)) - before) == 1  # the result
