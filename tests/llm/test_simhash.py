import random
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from lotwise.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(ids, edges):
    """{id: root} of given edges."""
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {i: top(i) for i in ids}


def plain_components(prints):
    """{id: root} by comparing all pairs."""
    return joined(prints, [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
@settings(max_examples=300, deadline=None)
def test_fingerprints_two_bits_apart_share_a_key(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    keys = [set(simhash.keys(np.array([v], np.uint64))[1].tolist()) for v in (x, y)]
    assert keys[0] & keys[1]


def test_the_code_is_perfect():
    _, weight, fours = simhash.error_patterns()
    assert np.bincount(weight).tolist() == [1, 23, 253, 1771]
    assert fours.shape == (2048, 5)


def made_texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = []
    for group in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(4, 900))]
        for copy in range(rnd.randint(1, 8)):
            text = list(base)
            for _ in range(copy // 2):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            out.append(" ".join(text))
    out += [None, "", " \t\n", "A b", "a B", "one", "É é x", out[0], out[0].upper()]
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.fp % 2**64, r.root) for r in simhash.near_copies(docs).collect()}
    prints = {i * 3 + 1: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {k: v[0] for k, v in got.items()} == prints
    assert {k: v[1] for k, v in got.items()} == plain_components(prints)


def test_components_equal_brute_force(spark):
    check(spark, made_texts())


def test_links_through_pairs_and_through_hubs_reach_the_same(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(6)]
    prints = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(40)} | set(base)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = plain_components({s: s % 2**64 for s in signed})
    for paired in (2, 7, 1000):
        edges = [(r.a, r.b) for r in simhash.links(frame, paired).collect()]
        assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in edges)
        assert joined(signed, edges) == want


def test_components_of_long_chains_stars_and_repeated_edges(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(100)] + [(5, 5), (7, None), (2000, 1999)]
    edges += [(b, a) for a, b in edges]
    rnd.shuffle(edges)
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({n for e in edges for n in e if n is not None})
    assert found == joined(nodes, [e for e in edges if None not in e])


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame(
        [(2, "a b c d", "x"), (1, "A b c d", "y"), (1, "A b c d", "y"), (5, "other words are here", "z"), (None, "a b c d", "n"), (8, None, "e"), (9, "", "e")],
        "doc_id long, text string, __rows string",
    )
    kept = sorted(simhash.one_of_each(docs).collect(), key=repr)
    assert [tuple(r) for r in kept] == [(1, "A b c d", "y"), (5, "other words are here", "z"), (8, None, "e"), (None, "a b c d", "n")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_copies(empty).collect() == []
    assert simhash.one_of_each(empty).collect() == []
