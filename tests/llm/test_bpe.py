import random
from hashlib import sha256

import pytest
from lotwise.llm import bpe
from lotwise.llm.vocabulary import ByteVocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "  two  blanks ", "it's we'll I'd", "aaaaaaaaaaaaaaa", "ababababab" * 30, "\n\n\t x\r\n", "é" * 77, "naïve façade",
    "日本語の文章です", "😀😀 👨‍👩‍👧", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|> <|endoftext|>", "<|endoftext", "\x00\x1c\x1d\x85 z",
    "1234567890 12,5 %", "x" * 5000, "Ġ ĠĠ", "The quick brown fox" * 40, "​﻿", "   x",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = __import__("tokenizers").Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(ByteVocabulary.read(PATH))


def some_texts():
    rnd = random.Random(7)
    alphabet = "abcdeéßñ  \n'stre0123.,!?|%日😀AB-_"
    return ODD + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 400))) for _ in range(400)]


def test_ids_equal_the_library(library, encoder):
    texts = some_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    packed = encoder.encode([t.encode() for t in texts])
    got = [list(memoryview(p).cast("I")) for p in packed]
    assert [t for t, a, b in zip(texts, want, got) if a != b] == []
    assert encoder.decode(packed) == [library.decode(i, skip_special_tokens=False) for i in want]


def test_a_full_memory_changes_nothing(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    for text in some_texts()[:60]:
        assert list(memoryview(encoder.encode([text.encode()])[0]).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_broken_bytes_and_unknown_ids_decode(encoder):
    import numpy as np

    half = [i for i, t in enumerate(encoder.tokens) if t == b"\xc3"]
    assert encoder.decode([np.array([*half, 10**9], "<u4").tobytes(), b""]) == ["�", ""]


def test_documents_with_null_empty_repeated_and_clashing_names(spark, library):
    texts = [None, "", "a b", "a b", "x" * 100_000, "it's 5"]
    docs = spark.createDataFrame([(i, t, "k", t) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(n.to_bytes(4, "little") for n in ids)
        assert tuple(rows[i]) == (i, len(ids), sha256(packed).hexdigest(), sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(docs.limit(0), PATH).collect() == []
    coded = bpe.decode(bpe.encode(docs.drop("ids"), PATH).drop("text"), PATH).collect()
    for r in coded:
        t = texts[r.doc_id] or ""
        assert (list(memoryview(bytes(r.ids)).cast("I")), r.decoded) == (library.encode(t, add_special_tokens=False).ids, t)


def test_query_equals_the_library(spark, tiny, library):
    from lotwise.llm.queries import QUERIES

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r.ids_sha256 for r in QUERIES["op8_bpe_round_trip"](spark, tiny).collect()}
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert rows[d.doc_id] == sha256(b"".join(n.to_bytes(4, "little") for n in ids)).hexdigest()
