import math

import numpy as np
from lotwise.llm import ann

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, asked, k):
    """{query: [(id, cosine), ...]} over (id, vector) rows."""
    out = {}
    for q, v in rows:
        if asked(q):
            near = sorted((-float(np.dot(v, w) / math.sqrt(np.dot(v, v)) / math.sqrt(np.dot(w, w))), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(spark, rows, k=5, asks="id % 50 = 0", router=None):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(ann.search(frame, asks, k, router=router).collect()):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def same(got, want):
    assert got.keys() == {q for q, near in want.items() if near}
    for q, near in got.items():
        assert [r for r, *_ in near] == list(range(1, len(near) + 1))
        assert [i for _, i, _ in near] == [i for i, _ in want[q]]
        assert np.allclose([s for *_, s in near], [s for _, s in want[q]], rtol=0, atol=1e-14)


def test_small_tables_are_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6)) for i in range(120)]
    rows += [(200 + i, np.ones(6)) for i in range(60)] + [(300, 2 * np.ones(6))]
    rows += [(350, np.full(6, 1e200)), (400, -np.full(6, 1e-200))]
    odd = [(150, None), (500, [0.0] * 6), (550, [1, None, 1, 1, 1, 1]), (600, [math.nan] + [1] * 5), (650, [math.inf] + [1] * 5), (700, []), (750, [1.0, 2.0]), (None, [1.0] * 6)]
    want = brute([(i, ann.scaled(np.array([v]))[0]) for i, v in rows], lambda i: i % 50 == 0, 5)
    same(found(spark, rows + odd + rows[:30]), want)


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ann, "AT_ONCE", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8)) for i in range(300)] + [(1000 + i, np.arange(8) + 1) for i in range(100)]
    same(found(spark, rows, k=4, asks="id % 10 = 0"), brute(rows, lambda i: i % 10 == 0, 4))


def test_few_rows(spark):
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0, 2.0])]) == {}
    same(found(spark, [(0, [1.0, 2.0]), (1, [1.0, 0.0])]), brute([(0, [1.0, 2.0]), (1, [1.0, 0.0])], lambda i: i == 0, 5))


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16)) * 3
    points = ann.unit(centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)))
    like = points @ points.T
    np.fill_diagonal(like, -2)
    near = np.argsort(-like, axis=1)[:, :8]
    part = ann.balanced_parts(points, near, 6, rng)
    assert np.bincount(part, minlength=6).max() <= math.ceil(ann.SLACK * 250)
    assert (part[near] == part[:, None]).mean() > 0.6
    target = np.eye(6)[part]
    router = ann.learned(points, target, rng)
    assert (router.parts(points, 1)[:, 0] == part).mean() > 0.9


def test_recall_with_learned_parts_on_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    rows = [(i, centres[rng.integers(60)] + 0.4 * rng.normal(size=24)) for i in range(5_000)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    router = ann.fit(ann.usable(frame, "vec_id", "embedding"), sample=3_000)
    assert router.w2.shape[1] == 8 and router.probes < 6
    got = found(spark, rows, router=router)
    want = brute(rows, lambda i: i % 50 == 0, 5)
    hits = [len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9


def test_queries_that_find_too_few_go_to_the_other_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4) + (8, 0, 0, 0)) for i in range(200)] + [(1000 + 50 * i, rng.normal(size=4) - (8, 0, 0, 0)) for i in range(2)]
    # Part 0 is right of the origin, part 1 left of it, part 2 stays empty; one probe finds a single row on the left.
    router = ann.Router(np.eye(4), np.zeros(4), np.array([[1.0, 0, 0]] + [[0.0, 0, 0]] * 3), np.array([0.0, 1e-9, -9]), 1)
    router.w1[0, 1], router.w1[1, 1] = -1.0, 0.0
    router.w2[:] = [[1, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 0]]
    placed = router.parts(np.array([v for _, v in rows]), 1)[:, 0]
    assert set(placed) == {0, 1} and (placed == 1).sum() == 2
    got, want = found(spark, rows, router=router), brute(rows, lambda i: i % 50 == 0, 5)
    same(got, want)


def test_recall_outside_the_sample_on_the_given_vectors(spark):
    """Fitted on half of the vectors: the other half of the rows and queries is new to the router."""
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    router = ann.fit(ann.usable(frame, "vec_id", "embedding"), sample=len(rows) // 2)
    assert 1 < router.w2.shape[1]
    got, want = found(spark, rows, router=router), brute(rows, lambda i: i % 50 == 0, 5)
    hits = [len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9


def test_query_recall_against_brute_force(spark):
    from lotwise.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    got = QUERIES["op2_ann"](spark, folder).collect()
    assert len(got) == 5 * len(want)
    scores = {(q, i): s for q, near in want.items() for i, s in near}
    hits = [(r.query_id, r.vec_id) in scores for r in got]
    assert np.mean(hits) >= 0.9
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in scores)
