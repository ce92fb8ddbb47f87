import pytest
import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lotwise.llm import decontaminate
from lotwise.llm.fm_index import FmIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    """{(id, text): (n_words, n_hit, items, spans, contaminated)} by trying every window everywhere."""
    owners = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - 12)):
                owners[tuple(w[i : i + 13])].add(str(item))
    lengths = {len(w) for w in owners}
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in owners:
                    hit |= set(range(i, i + n))
                    found |= owners[tuple(w[i : i + n])]
        edges = sorted(i for i in hit if i - 1 not in hit), sorted(i + 1 for i in hit if i + 1 not in hit)
        spans = [x for pair in zip(*edges) for x in pair]
        out.append((key, len(w), len(hit), len(found), ",".join(sorted(found)), spans, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@given(st.lists(st.lists(st.integers(1, 4), max_size=30), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_the_index_counts_and_locates(runs, phrases):
    text = np.array([s for r in runs for s in [*r, 0]])
    index = FmIndex(text, 5)
    table = np.zeros((len(phrases), 5), np.int32)
    for i, p in enumerate(phrases):
        table[i, : len(p)] = p
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def cases():
    rnd = random.Random(2)
    lexicon = [f"w{i}" for i in range(25)] + ["é", "Ünder", "ÀB"]
    passage = lambda n: [rnd.choice(lexicon) for _ in range(n)]
    items = [(i, " ".join(passage(rnd.randint(13, 40)))) for i in range(12)]
    items += [(20, "short item Here"), (21, "same words"), (22, "Same, words"), (23, None), (24, "..."), (None, "w1 w2"), (0, "second row of zero")]
    docs = []
    for i in range(60):
        w = passage(rnd.randint(0, 200)) + [f"own{j}" for j in range(rnd.randint(0, 300))]
        for _ in range(rnd.randint(0, 3)):
            _, text = rnd.choice(items[:12])
            part = text.split()
            a = rnd.randrange(len(part))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = part[a:] if rnd.random() < 0.5 else part
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    docs += [(90, None), (91, ""), (92, "!?"), (93, "a same WORDS same words b"), (93, "a same WORDS same words b"), (94, " ".join(["short item here"] * 9000)), (None, "same words")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_words int, `__words` string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def got(spark, docs, items):
    found = decontaminate.contamination(*frames(spark, docs, items))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_equals_brute_force(spark):
    docs, items = cases()
    assert got(spark, docs, items) == plain(docs, items)


def test_several_blocks_and_small_shards_change_nothing(spark, monkeypatch):
    docs, items = cases()
    want = plain(docs, items)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", ("item_id", "text", 250))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 500)
    monkeypatch.setattr(decontaminate, "LOCATED", 3)
    assert len(decontaminate.blocks(frames(spark, docs, items)[1])) > 2
    assert got(spark, docs, items) == want
    cleaned = decontaminate.clean(*frames(spark, docs, items))
    left = sorted((w[0] for w in want if not w[-1]), key=repr)
    assert sorted((r.doc_id for r in cleaned.collect()), key=repr) == left
    frame, benchmark = frames(spark, docs, items)
    clashing = decontaminate.clean(frame.selectExpr("*", "7 as __row"), benchmark).collect()
    assert sorted((r.doc_id for r in clashing), key=repr) == left and {r["__row"] for r in clashing} == {7}


def test_clean_documents_stay_as_they_are(spark):
    docs, items = cases()
    frame, benchmark = frames(spark, docs, items)
    bad = {(w[0], w[1]) for w in plain(docs, items) if w[-1]}
    cleaned = [tuple(r) for r in decontaminate.clean(frame.drop("__words"), benchmark).collect()]
    assert sorted(cleaned, key=repr) == sorted(((*d, 1) for d in docs if (d[0], len(words(d[1]))) not in bad), key=repr)


def test_empty_tables(spark):
    docs, items = cases()
    frame, benchmark = frames(spark, docs, items)
    assert decontaminate.contamination(frame.limit(0), benchmark).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.contamination(frame, benchmark.limit(0)).collect())


def test_query_equals_brute_force(spark, tiny):
    from lotwise.llm.queries import QUERIES

    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{tiny}/{name}.parquet").collect()]
    want = plain([(r[0], r[1]) for r in read("documents")], read("benchmark"))
    assert any(w[-1] for w in want)
    mine = sorted((tuple(r) for r in QUERIES["op10_decontaminate"](spark, tiny).collect()), key=repr)
    assert mine == sorted(((k, n, h, i, sha256(x.encode()).hexdigest(), c) for k, n, h, i, x, _, c in want), key=repr)


@pytest.mark.parametrize("most", [10**9, 40])
def test_item_ids_may_be_empty_hold_commas_or_be_missing(spark, monkeypatch, most):
    benchmark = spark.createDataFrame([("a,b", "one two three"), ("", "four five"), ("c", "six"), (None, "seven")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "one two three six"), (2, "four five"), (3, "seven"), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", ("item_id", "text", most))
    got = {r.doc_id: (r.n_items, r["items"], r.n_hit) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert got == {1: (2, "a,b,c", 4), 2: (1, "", 2), 3: (0, "", 0), 4: (0, "", 0)}
