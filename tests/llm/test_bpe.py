import hashlib
import random

import pytest
from tokenizers import Tokenizer

from kinfold.llm.bpe import Encoder, Transducer, Vocabulary, bpe_decode, bpe_digest, bpe_encode, build_lexicon, decode, default_vocabulary, op2_bpe

R = random.Random(1)
TEXTS = [
    None, "", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c", "  \n\n  x  ", "日本語 テスト 😀😀", "aaaaaaaaaaaaaaaa" * 100, "x" * 5000 + " " * 500, "it's we'll don't\t\tfoo bar",
    "\x00\x01\x1f ñañá", "".join(R.choice("ab ") for _ in range(3000)), "".join(chr(R.randrange(1, 0xD7FF)) for _ in range(3000)), "ÀÈ " * 50, "aaaa aaa aa a aaaaa", "<|endoftext", "the the the", "<|endoftext|><|endoftext|>",
]


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(default_vocabulary())


def test_encoding_with_and_without_automaton(known):
    v = Vocabulary.read(default_vocabulary())
    words = ["the", " the", " tokens", "x" * 50, "日", " ", "a" * 64]
    for lexicon in (None, Transducer.compile([w.encode() for w in words], v)):
        e = Encoder(v, lexicon, most=5)
        for t in TEXTS * 2:
            ids, sizes = e.encode([t or ""])
            assert ids.tolist() == known.encode(t or "", add_special_tokens=False).ids and sizes.tolist() == [len(ids)]
            assert decode(v, ids.tolist()) == (t or "") == known.decode(ids.tolist(), skip_special_tokens=False)


def test_automaton_numbers_its_words(tmp_path):
    v = Vocabulary.read(default_vocabulary())
    words = sorted({"".join(R.choice("abc") for _ in range(R.randrange(1, 9))).encode() for _ in range(800)})
    t = Transducer.compile(words, v)
    (tmp_path / "x").write_bytes(t.to_bytes())
    for own in (t, Transducer.mapped(str(tmp_path / "x"))):
        assert own.find(words).tolist() == list(range(len(words)))
        assert set(own.find([b"", b"zzz", b"abcabcabcabc", words[3] + b"x"]).tolist()) == {-1}
    assert len(t.final) < sum(map(len, words))
    assert Transducer.compile([], v).find([b"a", b""]).tolist() == [-1, -1]


def test_columns_and_digests(spark, known):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", None), (0, None, "x")], "doc_id long, text string, ids string")
    lexicon = build_lexicon(df, words=20)
    got = bpe_decode(bpe_encode(df, ids="ids", lexicon=lexicon)).collect()
    assert len(got) == len(TEXTS) + 2 and all(r.decoded == (r.text or "") for r in got)
    for r in bpe_digest(df, lexicon=lexicon).collect():
        t = (TEXTS[r.doc_id] if r.doc_id is not None else "a b") or ""
        ids = known.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe_encode(df.filter("false"), lexicon=build_lexicon(df.filter("false"))).count() == 0


def test_documents(spark, small, known):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op2_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = known.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
