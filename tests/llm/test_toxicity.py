import random

import numpy as np
import pytest
from lotwise.llm import toxicity
from pyspark.sql import functions as F

CATEGORIES = {"poor": "quality = 0", "toxic": "toxic = 1"}


def made(n=900):
    rnd = random.Random(4)
    calm = [f"calm{i}" for i in range(400)]
    out = []
    for i in range(n):
        poor, toxic = rnd.random() < 0.3, rnd.random() < 0.25
        words = [rnd.choice(calm) for _ in range(rnd.randint(3, 120))]
        for _ in range(2 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "nasty", f"hatef{rnd.choice('abcdefgh')}{i % 37}"]))
        out.append((i, " ".join(w + "!!" * poor for w in words), 1 - int(poor), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 3], "doc_id long, quality int, toxic int")
    return rows, docs, labels


@pytest.fixture(scope="module")
def chain(tables):
    _, docs, labels = tables
    return toxicity.fit(docs, labels, CATEGORIES)


def test_held_out_documents_are_told_apart(tables, chain):
    rows, docs, _ = tables
    got = {r.doc_id: (r.p_poor > 0.5, r.p_toxic >= chain.threshold) for r in toxicity.scored(docs, chain, ["p_poor", "p_toxic"]).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([got[i][0] == (q == 0) for i, _, q, _ in held]) > 0.97
    assert np.mean([got[i][1] == bool(x) for i, _, _, x in held]) > 0.95


def test_later_models_see_earlier_odds(chain):
    assert [len(m.dense) for m in chain.models] == [4, 5]


def test_the_fit_does_not_depend_on_order_or_partitions(tables, chain):
    _, docs, labels = tables
    other = toxicity.fit(docs.orderBy(F.rand(3)).repartition(7), labels.repartition(3), CATEGORIES)
    assert other.place == chain.place
    for a, b in zip(other.models, chain.models):
        assert np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.dense, b.dense, atol=1e-6)


def test_logistic_regression_ends_where_the_gradient_is_small():
    rng = np.random.default_rng(0)
    x = rng.random((400, 6)) < 0.3
    dense = rng.normal(size=(400, 2))
    y = (x[:, 0] * 2.0 - x[:, 1] + dense[:, 0] + rng.normal(size=400) > 0.4).astype(float)
    owner, column = np.nonzero(x)
    model = toxicity._logistic(owner, column, dense, y, 6)
    z = model.intercept + x @ model.weights + dense @ model.dense
    r = 1 / (1 + np.exp(-z)) - y
    assert abs(r.sum()) < 0.01
    assert np.abs(x.T @ r + toxicity.RIDGE * model.weights).max() < 0.01
    assert np.abs(dense.T @ r + toxicity.RIDGE * model.dense).max() < 0.01


def test_odd_texts_repeated_rows_and_clashing_names(spark, chain):
    texts = [None, "", "  ", "vile nasty vile", "vile nasty vile", "calm1 " * 30_000, "\x00 日本 !!"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, __p1 int")
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 5 in ids and not {3, 4} & ids and ({0, 1, 2} <= ids or not {0, 1, 2} & ids)
    assert toxicity.without_toxic(docs.limit(0), chain).collect() == []


def test_the_smallest_text_of_a_repeated_key_is_learned_from(spark, tables, chain):
    _, docs, labels = tables
    larger = docs.withColumn("text", F.concat(F.lit("~ "), "text"))
    again = toxicity.fit(larger.unionByName(docs).repartition(5), labels, CATEGORIES)
    assert again.place == chain.place
    for a, b in zip(again.models, chain.models):
        assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_labels_that_teach_nothing(spark, tables):
    _, docs, labels = tables
    nothing = toxicity.fit(docs, labels.limit(0), CATEGORIES)
    assert {r.b for r in toxicity.scored(docs, nothing, ["a", "b"]).collect()} == {0.0}
    one = toxicity.fit(docs, labels.where("toxic = 0").unionByName(labels.where("toxic = 0").withColumn("toxic", F.lit(None).cast("int"))), CATEGORIES)
    assert max(r.b for r in toxicity.scored(docs, one, ["a", "b"]).collect()) < 1e-6


def test_query_finds_the_labelled_ones(spark):
    from lotwise.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    right = [bool(labels[r.doc_id]) == r.toxic for r in rows if r.doc_id in labels]
    assert np.mean(right) > 0.95
