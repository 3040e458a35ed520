import base64
import random

import pyarrow as pa
import pytest

from folioweave.llm import bpe

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, reference):
    ids, off = bpe.Encoder(bpe.default_vocabulary()).encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == reference.encode_ordinary(t or ""), repr(t)[:80]


def test_random_texts(reference):
    rnd = random.Random(5)
    parts = ["'s", "'ll", "'re", "'", "''", " ", "  ", "\n", "\t", "a", "é", "ñ", "1", "²", "...", "　", " ", "<|endoftext|>", "日本", "😀", "I've", "é", "​", "--", "\r\n", "\x1c", "\x85", "ley", " de"]
    check(["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(2000)], reference)


def test_edges(reference):
    check([None, "", " ", "a" * 3000, "ab" * 2000, "é" * 300, " " * 2000 + "x", "\n" * 50, "x" * 65, "x" * 64, "ñ" * 128, "ñ" * 129], reference)


def test_whole_documents(reference, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got == {k: reference.encode_ordinary(t or "") for k, t in texts.items()}
    counts = {r.doc_id: r.tokens for r in bpe.count_tokens(docs, ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.encode_corpus(docs.limit(0)).count() == 0


def test_cache_may_be_emptied(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    enc = bpe.Encoder(bpe.default_vocabulary())
    for t in ("uno dos tres cuatro", "cinco seis uno", "x" * 400):
        ids, _ = enc.encode(pa.array([t]))
        assert ids.tolist() == reference.encode_ordinary(t)
