import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from lotwise.llm import alignment
from lotwise.llm.vocabulary import ByteVocabulary, byte_of_character
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, digest string, copies int, pairs string"


@pytest.fixture(scope="module")
def sides():
    bpe, piece = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    first = Tokenizer.from_file(bpe)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=piece)
    return ByteVocabulary.read(bpe), alignment.Pieces.read(piece), first, second


def plain(rows, first, second):
    """By the tokenizers' own libraries and dictionaries, row by row."""
    to_byte = byte_of_character()
    per_row, counts = [], Counter()
    for _, text in rows:
        a = b = groups = ()
        if text:
            whole = (" " + text).encode()
            a, b = first.encode(" " + text, add_special_tokens=False), second.encode(text)
            bytes_a = [bytes(to_byte[c] for c in t) for t in a.tokens]
            bytes_b = [
                bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, second.id_to_piece(i)) for i in b)
            ]
            a = a.ids
            if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
                a, b = [], []
            ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
            if a:
                groups, i, j = [], 0, 0
                for end in sorted({*ends_a} & {*ends_b}):
                    k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    groups.append((a[i:k], b[j:m]))
                    i, j = k, m
        links = [(g[0][-1], g[1][-1]) for g in groups]
        counts.update(links)
        per_row.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (key, _), (n_a, n_b, groups, links) in zip(rows, per_row):
        told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        name = sha256(told.encode()).hexdigest() if groups else ""
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((key, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), name))
    return Counter(out)


def found(spark, rows, sides, parts=3):
    frame = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA).repartition(parts)
    got = alignment.alignment(frame, *sides[:2])
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(map(tuple, got.collect()))


def made():
    rnd = random.Random(1)
    lexicon = ["the", " of", "é", "日本", "\n", "\t", "  ", "🙂", "<|endoftext|>", "<0x41>", "<s>", "▁", "\x00", "Tokenization", "'s", "1234", "ﬁ", "é", " "]
    texts = [None, "", " ", "a", "▁x", "<|endoftext|>", "the the the", "﻿x", "\r\n\r\n"]
    texts += ["".join(rnd.choice(lexicon) for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    texts += ["the quick brown fox " * 8_000, "x" * 40_000]
    return list(enumerate(texts)) + [(None, "a"), (3, "a"), (3, "a"), (3, "b")] + [(500 + i, "the same text") for i in range(300)]


def test_rows_of_every_kind_equal_the_libraries(spark, sides, monkeypatch):
    rows = made()
    want = plain(rows, *sides[2:])
    assert found(spark, rows, sides) == want
    for share in (0.0, 1.0):  # all texts hot, none
        monkeypatch.setattr(alignment, "HOT_SHARE", share)
        assert found(spark, rows, sides, 5) == want
    assert any(r[1] == 0 for r in want if r[0] and r[0] > 2) and sum(n for r, n in want.items() if r[3] > 1) > 100


def test_empty_and_blank_tables(spark, sides):
    assert found(spark, [], sides) == Counter()
    assert found(spark, [(1, None), (None, "")], sides) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 1, (None, 0, 0, 0, 0, 0, 0, ""): 1})


def test_linked_pairs_are_suffixes_so_their_table_is_bounded(spark, sides):
    texts = spark.createDataFrame(made(), "doc_id long, text string")
    linked = alignment.pair_counts(alignment.aligned_texts(texts, *sides[:2])).collect()
    a, b = sides[0].tokens, sides[1].tokens
    assert linked and all(a[r.a].endswith(b[r.b]) or b[r.b].endswith(a[r.a]) for r in linked)
    assert sum(map(len, a)) + sum(map(len, b)) < 700_000


def test_query_equals_the_libraries(spark, tiny, sides):
    from lotwise.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = Counter(map(tuple, QUERIES["op13_alignment"](spark, tiny).collect()))
    assert got == plain(docs, *sides[2:])
