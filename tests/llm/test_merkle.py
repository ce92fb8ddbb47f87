import zlib
from hashlib import sha256

import pytest
from lotwise.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at string, range int, hash string"


def h(*parts):
    return sha256(b"".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def field(v):
    if v is None:
        return b"-"
    raw = str(v).encode()
    return str(len(raw)).encode() + b":" + raw


def leaf(row, text=None):
    return h(*map(field, (*row[:4], row[4] if text is None else text)))


def grown(nodes):
    """Root and siblings (left, right) per node, bottom up."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for i in spans[a + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            above.append(h(*run))
            held.append([i for s in spans[a : a + 16] for i in s])
        nodes, spans = above, held
    return nodes[0], paths


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for held in trees.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    grew = {s: grown([leaf(r) for r in trees[s]]) for s in order}
    root, tops = grown([grew[s][0] for s in order])
    for s, top in zip(order, tops):
        for r, path in zip(trees[s], grew[s][1]):
            own, whole = leaf(r), path + top
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                own = leaf(r, lower(r[4]))
            for left, right in whole:
                own = h(*left, own, *right)
            out.append((r[0], leaf(r), grew[s][0], root, h(*[x for l, g in whole for x in (*l, *g)]), own, own == root))
    return sorted(out, key=repr)


def check(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "x", "y", 7, "z") for r in rows], SCHEMA).repartition(parts)
    got = merkle.manifest(frame, tampered=merkle.tampered_fifth("doc_id", "text"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == plain(rows)
    return got


def test_trees_of_all_sizes_and_odd_rows(spark):
    rows = []
    for source, n in (("a", 1), ("b", 2), ("c", 16), ("d", 17), ("é", 256), ("", 257), (None, 5), ("hot", 4_500)):
        rows += [(len(rows) + i, source, "en", i, f"Text {i} É") for i in range(n)]
    rows += [(None, "a", None, None, None), (None, "a", None, None, None), (3, "a", "", 0, ""), (3, "a", "", 0, ""), (4, None, "-", None, "X" * 300_000)]
    got = check(spark, rows)
    assert len({r[3] for r in got}) == 1 and 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("n", [1, 2, 300])
def test_many_groups_and_single_rows(spark, n):
    check(spark, [(i, f"s{i}", "en", 1, "A") for i in range(n)])


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_whole_manifest_verifies_and_ignores_partitions(spark):
    rows = [(i % 900, f"s{i % 3}", "en", i, f"t{i}") for i in range(1_000)]
    one, many = (
        sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(p)).collect()))
        for p in (1, 9)
    )
    assert one == many and all(r[-1] for r in one)


def test_query_equals_its_sql(spark, tiny):
    from lotwise.llm.queries import ORACLES, QUERIES
    from oracle import connect, differences

    assert differences(spark, connect(tiny), tiny, QUERIES["op11_merkle"], ORACLES["op11_merkle"]) is None
