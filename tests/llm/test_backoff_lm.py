import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from lotwise.llm import backoff_lm

SCHEMA = "doc_id long, text string, score int, chunk string"


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1


def plain(docs, order, prior):
    """The model by dictionaries and recursion."""
    counts, n = Counter(), 0
    for key, text in docs:
        if not held(key):
            seen = ["begin", *tokens(text)]
            n += len(seen) - 1
            counts["begin",] += 1
            for k in range(1, order + 1):
                counts.update(tuple(seen[i : i + k]) for i in range(k == 1, len(seen) - k + 1))
    words = sum(1 for g in counts if len(g) == 1) - (counts["begin",] > 0)

    def p(word, context):
        if not context:
            return (counts[(word,)] + 0.5) / (n + 0.5 * (words + 1))
        return (counts[(*context, word)] + prior * p(word, context[1:])) / (counts[context] + prior)

    out = {}
    for key, text in docs:
        seen = ["begin", *tokens(text)]
        score = base = known = 0
        for i in range(1, len(seen)):
            score += math.log10(p(seen[i], tuple(seen[max(0, i - order + 1) : i])))
            base += math.log10(p(seen[i], ()))
            known += counts[(seen[i],)] > 0
        out[key, text] = (held(key), len(seen) - 1, known, n, base, score)
    return out


def made():
    rnd = random.Random(6)
    lexicon = [f"w{i}" for i in range(40)] + ["É", "\x00"]
    docs = [(i, " ".join(rnd.choice(lexicon[: rnd.randint(2, 42)]) for _ in range(rnd.randint(0, 80)))) for i in range(80)]
    return docs + [(100, None), (101, ""), (102, " \n"), (103, docs[0][1].upper()), (None, "no key w1"), (104, "w1 " * 20_000), (104, "w1 " * 20_000)]


@pytest.mark.parametrize("order, chunk_bytes", [(1, 10**9), (2, 4_000), (3, 30_000), (4, 10**9), (5, 9_000)])
def test_scores_equal_the_plain_model(spark, order, chunk_bytes):
    docs = made()
    random.Random(order).shuffle(docs)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA).repartition(3)
    text_of = {}
    for k, t in docs:
        text_of.setdefault(k, t)
    got = backoff_lm.scored(frame, order=order, prior=3.0, chunk_bytes=chunk_bytes).collect()
    want = plain(docs, order, 3.0)
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id, text_of[r.doc_id]]
        assert tuple(r)[1:5] == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9) and math.isclose(r.score, w[5], rel_tol=1e-9)


def test_keys_and_scores_do_not_depend_on_the_order_of_rows():
    rnd = random.Random(2)
    found = [(t or "").encode() for _, t in made()]
    for order in range(1, 6):
        one = backoff_lm.Chunk(found, order)
        total = one.counts(np.arange(len(found)) % 3 > 0)
        scores = one.scores(total, 900, 40, 3.0)
        for _ in range(10):
            turn = list(range(len(found)))
            rnd.shuffle(turn)
            other = backoff_lm.Chunk([found[i] for i in turn], order)
            assert (other.keys == one.keys).all()
            assert (other.counts(np.array(turn) % 3 > 0) == total).all()
            for a, b in zip(other.scores(total, 900, 40, 3.0), scores):
                assert np.allclose(a, b[turn])


def test_pieces_of_long_texts_carry_their_state(monkeypatch):
    found = [b"a b c a b d " * 50, b"a", b"", b"c a b " * 7]
    for order in range(1, 5):
        chunk = backoff_lm.Chunk(found, order)
        total = chunk.counts(np.ones(4, bool))
        monkeypatch.setattr(backoff_lm, "PIECE", 10**6)
        whole = chunk.scores(total, 400, 5, 2.0)[2]
        for piece in (1, 2, 7):
            monkeypatch.setattr(backoff_lm, "PIECE", piece)
            assert np.allclose(chunk.scores(total, 400, 5, 2.0)[2], whole, rtol=1e-12)


def test_probabilities_add_up():
    docs = [(i, t) for i, t in enumerate(["a b a", "b b", "a", "c a b", "a b"])]
    vocabulary = {w.decode() for _, t in docs if not held(_) for w in t.encode().split()}
    for context in ("a", "b", "c", "zz"):
        total = 0.0
        for word in [*sorted(vocabulary), "unknown"]:
            more = plain([*docs, (held_key(), f"{context} {word}")], 2, 5.0)[held_key(), f"{context} {word}"][5]
            less = plain([*docs, (held_key(), context)], 2, 5.0)[held_key(), context][5]
            total += 10 ** (more - last_step(docs, word) - (less - last_step(docs, context)))
        total += 10 ** last_step(docs, context)
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def held_key():
    return next(k for k in range(1000, 2000) if held(k))


def last_step(docs, word):
    """log10 p(end | word)."""
    n, counts = 0, Counter()
    for key, text in docs:
        if not held(key):
            seen = [*text.encode().split(), "end"]
            n += len(seen)
            counts.update((w,) for w in seen)
            counts.update(zip(seen, seen[1:]))
    w = word.encode()
    end = (counts["end",] + 0.5) / (n + 0.5 * (len([g for g in counts if len(g) == 1]) + 1))
    return math.log10((counts[w, "end"] + 5.0 * end) / (counts[w,] + 5.0))


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert backoff_lm.scored(frame).collect() == []
    key = held_key()
    alone = backoff_lm.scored(spark.createDataFrame([(key, "a b", 1, "x")], SCHEMA)).first()
    assert (alone.held_out, alone.n_tokens, alone.n_known, alone.train_tokens) == (True, 3, 0, 0)
    assert math.isclose(alone.score, alone.base_score) and math.isclose(alone.score, 0.0, abs_tol=1e-9)


def test_query_equals_the_plain_model_and_beats_single_words(spark, tiny):
    from lotwise.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    want = {k: v for (k, _), v in plain(docs, backoff_lm.ORDER, backoff_lm.PRIOR).items()}
    rows = QUERIES["op3_backoff_lm"](spark, tiny).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][5], rel_tol=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
