import zlib
from collections import Counter

import pytest
from lotwise.llm import sharding
from pyspark.sql import functions as F


def dealt(spark, n, weights):
    return {r.id: r.shard for r in spark.range(n).select("id", sharding.rendezvous("id", weights).alias("shard")).collect()}


def test_one_more_shard_only_takes_into_itself(spark):
    before, after = dealt(spark, 20_000, [1] * 16), dealt(spark, 20_000, [1] * 17)
    moved = [k for k in before if before[k] != after[k]]
    assert {after[k] for k in moved} == {16}
    assert abs(len(moved) - 20_000 / 17) < 200
    assert all(abs(n - 1250) < 200 for n in Counter(before.values()).values())


def test_weights_set_the_shares_and_a_change_moves_only_to_that_shard(spark):
    light, heavy = dealt(spark, 30_000, [1, 1, 2]), dealt(spark, 30_000, [1, 1, 4])
    shares = Counter(light.values())
    assert abs(shares[2] - 15_000) < 500 and abs(shares[0] - 7_500) < 400
    assert {heavy[k] for k in light if light[k] != heavy[k]} == {2}
    assert set(dealt(spark, 2_000, [1, 0, 1]).values()) == {0, 2}
    for bad in ([], [0, 0], [1, -1]):
        with pytest.raises(ValueError):
            sharding.rendezvous("id", bad)


def test_rows_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    texts = [None, "", "é", "a", "a"] + ["same"] * 60
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(texts)] + [(64, "same", 1)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.sharded(docs, [1] * 4, [1] * 5).collect()
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id == 64}) == 1
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    assert sharding.sharded(docs.limit(0), [1], [1, 1]).collect() == []


def test_query_over_the_whole_table(spark, tiny):
    from lotwise.llm.queries import QUERIES

    out = QUERIES["op6_sharding"](spark, tiny)
    assert out.count() == spark.read.parquet(f"{tiny}/documents.parquet").count()
    held = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert all(r.n == r.last + 1 == r.slots for r in held)
    assert out.where("grown_shard != shard and grown_shard != 16").count() == 0


def plain_shard(spark, key, weights):
    """The law by plain arithmetic over Spark's published hash."""
    import math

    text = "\0" if key is None else str(key)
    first = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    best = None
    for shard, weight in enumerate(weights):
        mixed = spark.range(1).select(F.xxhash64(F.lit(first).cast("long"), F.lit(shard))).first()[0] % 2**64 >> 11
        claim = -weight / math.log((mixed + 0.5) / 2**53)
        if weight and (best is None or claim > best[0]):
            best = (claim, shard)
    return best[1]


def test_choice_equals_a_plain_one(spark):
    keys, weights = [None, 0, 7, -3, 123456789012], [1.0, 0.0, 2.5, 1.0]
    frame = spark.createDataFrame([(k,) for k in keys], "id long")
    got = {r.id: r.shard for r in frame.select("id", sharding.rendezvous("id", weights).alias("shard")).collect()}
    assert got == {k: plain_shard(spark, k, weights) for k in keys}


def test_rows_of_one_key_are_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(2_000)], "doc_id long, text string")
    got = sharding.sharded(docs, [1] * 4, [1] * 5).collect()
    assert sorted(r.slot for r in got) == list(range(2_000)) and len({r.shard for r in got}) == 1
    sizes = Counter(hash((r.text_crc32, r.size)) % 40 for r in got)
    assert len(sizes) > 30
