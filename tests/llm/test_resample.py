import math
import random
from collections import Counter

import numpy as np
import pytest
from lotwise.llm import resample
from pyspark.sql import functions as F


def made(n=600):
    rnd = random.Random(8)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    rows = []
    for i in range(n):
        fine = rnd.random() < 0.6
        rows.append((i, " ".join(rnd.choice(good if fine or rnd.random() < 0.3 else bad) for _ in range(rnd.randint(5, 400))), fine))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), "doc_id long, text string, score boolean")


@pytest.fixture(scope="module")
def ratio(docs):
    return resample.fit(docs, docs.where("score and doc_id % 2 = 0").select("doc_id"))


def test_counts_equal_a_plain_count(ratio):
    raw, target = Counter(), Counter()
    for i, text, fine in made():
        _, bucket = resample.hashed_ngrams([text.encode()])
        raw.update(bucket.tolist())
        if fine and i % 2 == 0:
            target.update(bucket.tolist())
    size = resample.BUCKETS
    totals = sum(target.values()) + size, sum(raw.values()) + size
    for b in list(raw)[:500]:
        assert math.isclose(ratio.log_ratio[b], math.log((target[b] + 1) / totals[0]) - math.log((raw[b] + 1) / totals[1]), abs_tol=1e-9)


def test_ngrams_stay_within_their_text():
    together = resample.hashed_ngrams([b"a b", b"", b"A b c"])
    alone = [resample.hashed_ngrams([t])[1].tolist() for t in (b"a b", b"", b"a b c")]
    assert [sorted(together[1][together[0] == i].tolist()) for i in range(3)] == [sorted(a) for a in alone]
    assert [len(a) for a in alone] == [3, 0, 5]


def test_target_like_documents_are_drawn(docs, ratio):
    rows = resample.resampled(resample.weighted(docs, ratio), 300).collect()
    fine = {i: f for i, _, f in made()}
    drawn = [r.doc_id for r in rows if r.selected]
    assert len(drawn) == 300 and np.mean([fine[i] for i in drawn]) > 0.95
    assert min(r.score for r in rows if r.selected) > max(r.score for r in rows if not r.selected)


def test_gumbel_top_k_draws_in_proportion_to_weights(spark, ratio):
    flat = resample.Ratio(np.zeros(resample.BUCKETS))
    docs = spark.range(4_000).selectExpr("id as doc_id", "cast(null as string) as text")
    rows = resample.weighted(docs, flat).collect()
    noise = {r.doc_id: r.score for r in rows}
    wins = Counter(max(range(3), key=lambda j: noise[i + j] + math.log((1, 2, 4)[j])) for i in range(0, 3_999, 3))
    assert abs(wins[2] / 1333 - 4 / 7) < 0.05 and abs(wins[0] / 1333 - 1 / 7) < 0.04


def test_edges_found_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(resample, "NARROW", 5)
    monkeypatch.setattr(resample, "PARTS", 4)
    rnd = random.Random(0)
    values = [rnd.choice([0.5, -1e300, 3.25, rnd.random(), rnd.gauss(0, 1e6)]) for _ in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").persist()
    for k in (1, 2, 77, 150, 299, 300):
        assert resample.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_odd_rows(spark, ratio):
    texts = [None, "", "g1 g2", "g1 g2", "b1 " * 50_000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)] + [(2, "g1 g2", 1)], "doc_id long, text string, n_grams int")
    rows = resample.weighted(docs, ratio).collect()
    assert sorted(r.n_grams for r in rows) == [0, 0, 3, 3, 3, 99_999]
    for k in range(8):
        drawn = resample.resampled(resample.weighted(docs, ratio), k).where("selected").count()
        assert drawn in (min(k, 6), min(k, 6) + 1)
    assert resample.resampled(resample.weighted(docs.limit(0), ratio), 3).collect() == []
    none = resample.fit(docs, docs.limit(0).select("doc_id"))
    assert not none.log_ratio.any()


def test_tied_scores_are_settled_by_key(spark):
    scores = spark.createDataFrame([(i, 0, 0.0, 1.0 if i < 9 else 2.0) for i in range(10)], "doc_id long, n_grams long, log_weight double, score double")
    assert sorted(r.doc_id for r in resample.resampled(scores, 4).where("selected").collect()) == [0, 1, 2, 9]


def test_query_keeps_good_documents(spark):
    from lotwise.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    out = QUERIES["op9_resample"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    share = {r.quality: r.s for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()}
    assert share[1] > 0.95 and share[0] < 0.3


def test_repeated_rows_and_target_keys(spark, docs):
    keys = docs.where("score").select("doc_id")
    rows = docs.union(docs.where("doc_id < 7")).union(spark.createDataFrame([(None, "g1 g2", True)], docs.schema))
    got, again = resample.fit(rows, keys), resample.fit(rows, keys.union(keys))
    assert np.array_equal(got.log_ratio, again.log_ratio)
    target = Counter()
    for i, text, fine in made() + made()[:7]:
        if fine:
            target.update(resample.hashed_ngrams([text.encode()])[1].tolist())
    marked = rows.where("score and doc_id is not null")
    assert np.array_equal(resample.counted(marked.select("text")), np.bincount(list(target.elements()), minlength=resample.BUCKETS))


def test_weights_scores_and_drawn_set_equal_a_plain_version(spark):
    """The registered query against Python: every log weight, every score, and the k largest."""
    from lotwise.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()
    good = {r.doc_id for r in labels if r.quality == 1}
    grams = {i: resample.hashed_ngrams([t.encode()])[1].tolist() for i, t in docs}
    raw, target = Counter(), Counter()
    for i, found in grams.items():
        raw.update(found)
        if i in good:
            target.update(found)
    sizes = sum(target.values()) + resample.BUCKETS, sum(raw.values()) + resample.BUCKETS
    weight = {i: math.fsum(math.log((target[b] + 1) / sizes[0]) - math.log((raw[b] + 1) / sizes[1]) for b in g) for i, g in grams.items()}
    keyed = spark.createDataFrame([(i,) for i, _ in docs], "doc_id long").selectExpr("doc_id", f"xxhash64({resample.SEED}, cast(doc_id as string)) as h").collect()
    noise = {r.doc_id: -math.log(-math.log(((r.h % 2**64 >> 11) + 0.5) / 2**53)) for r in keyed}
    rows = QUERIES["op9_resample"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(grams) and len(rows) == len(docs)
    for r in rows:
        assert r.n_grams == len(grams[r.doc_id]) and math.isclose(r.log_weight, weight[r.doc_id], rel_tol=1e-9, abs_tol=1e-7)
        assert math.isclose(r.score, weight[r.doc_id] + noise[r.doc_id], rel_tol=1e-9, abs_tol=1e-7)
    k = round(sum(r.quality == 1 for r in labels) / len([r for r in labels if r.quality is not None]) * len(docs))
    best = sorted(weight, key=lambda i: -(weight[i] + noise[i]))[:k]
    assert {r.doc_id for r in rows if r.selected} == set(best)


def test_no_default_bound_on_target_documents(spark):
    docs = spark.range(21_000).selectExpr("id as doc_id", "concat('w', id) as text")
    got = resample.fit(docs, docs.select("doc_id"))
    assert np.array_equal(got.log_ratio, np.zeros(resample.BUCKETS))
