import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lotwise.llm import token_counts
from lotwise.llm.token_counts import Automaton
from lotwise.llm.vocabulary import ByteVocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, pieces, start):
    """Pieces of one word, longest first; 1 when it cannot be spelled."""
    word, at, n = start + word, 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@given(
    st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
    st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
    st.lists(st.text("abcd", min_size=1, max_size=14), min_size=1, max_size=60),
)
@settings(max_examples=200, deadline=None)
def test_word_pieces_equal_greedy_search(first, later, words):
    automaton = Automaton.of_word_pieces([*first, *("##" + p for p in later)])
    start = automaton.start
    pieces = {start + p.encode() for p in first} | {p.encode() for p in later}
    assert automaton.count([w.encode() for w in words]).tolist() == [greedy(w.encode(), pieces, start) for w in words]


def test_public_vocabulary_and_long_words():
    vocabulary = ByteVocabulary.read(PATH)
    automaton = Automaton.of_byte_vocabulary(vocabulary)
    pieces = set(vocabulary.tokens) - {b"", b"<|endoftext|>"}
    rnd = random.Random(1)
    words = ["".join(rnd.choices("etaoinsrhé日1!", k=rnd.randint(1, 30))).encode() for _ in range(500)] + [b"x", b"ab" * 20_000, b"z" * 300]
    longest = max(map(len, pieces))

    def plain(word):
        word, at, n = b" " + word, 0, 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces)
            n += 1
        return n

    assert automaton.count(words).tolist() == [plain(w) for w in words]


def test_documents(spark, monkeypatch):
    automaton = Automaton.of_word_pieces(["a", "ab", "##c", "##ab"])
    texts = [None, "", " \t ", "abc abab", "abc abab", "zz a\x0bab", "a b"]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = sorted(tuple(r) for r in token_counts.token_counts(docs, automaton).collect())
    assert rows == [(0, 0, 0, 0), (1, 0, 0, 0), (2, 3, 0, 0), (3, 8, 2, 4), (4, 8, 2, 4), (5, 7, 3, 3), (6, 4, 1, 1)]
    assert token_counts.token_counts(docs.limit(0), automaton).collect() == []
    monkeypatch.setattr(token_counts, "REMEMBERED", 0)
    assert automaton.count_texts([b"abc abab", b"abc"]) == ([2, 1], [4, 2])


def test_query_equals_greedy_search(spark, tiny):
    from lotwise.llm.queries import QUERIES

    pieces = set(ByteVocabulary.read(PATH).tokens) - {b"", b"<|endoftext|>"}
    seen = {}

    def plain(word):
        if word not in seen:
            seen[word] = greedy(word, pieces, b" ")
        return seen[word]

    want = {
        r.doc_id: sum(map(plain, (r.text or "").encode().split()))
        for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()
    }
    got = {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, tiny).collect()}
    assert got == want
