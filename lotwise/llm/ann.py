"""Nearest neighbours by cosine over learned partitions.

A bounded sample is joined to its nearest neighbours; that graph is cut into balanced parts by moving vertices to where
their neighbours are, within a bound on each part's size. A small network learns which parts a vector's neighbours are in.
It then places every row in its most probable part and sends each query to several, as many as the sample needs for
``RECALL``; a query that finds fewer than k there goes to all other parts as well. Rows of a part meet its queries in blocks of bounded size, however full the part is, and scores
are computed anew in double precision.

Vectors that are NULL, zero, of another length than the most frequent one, or hold NULL or non-finite components
take no part. Rows without a key are left out; rows that repeat a key count once (the smallest vector). Ties go to
the smaller key. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.corpus import written

# Rows the partitions are learned from, at most, neighbours of each in the graph, and rows per part among them.
SAMPLE = 12_000
GRAPH_NEIGHBOURS = 10
PART_ROWS = 375
MOST_PARTS = 64
SLACK = 1.05
# Network: hidden units, passes over the sample, rows per step, step size.
HIDDEN, PASSES, STEP_ROWS, STEP = 128, 30, 128, 0.003
# Share of the sample's neighbours that the routing must reach.
RECALL = 0.97
# Rows and queries that meet in one task, and queries compared at a time.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 20_000, 4_000, 256
SEED = 3


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, one row per key."""
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & finite).groupBy("id").agg(F.min("v").alias("v"))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares stay in range; cosines do not change in any bit."""
    _, power = np.frexp(np.abs(rows).max(axis=1, initial=0.0))
    return np.ldexp(rows, -power[:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def neighbour_graph(sample: DataFrame, points: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest other sample points of each, worked out by Spark in blocks."""
    shared = sample.sparkSession.sparkContext.broadcast(points)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            for start in range(0, len(at), AT_ONCE):
                mine = at[start : start + AT_ONCE]
                like = every[mine] @ every.T
                like[np.arange(len(mine)), mine] = -2
                best = np.argpartition(-like, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(like, best, axis=1), axis=1, kind="stable")
                best = np.take_along_axis(best, order, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(best.tolist(), pa.list_(pa.int64()))], names=["at", "near"])

    spark = sample.sparkSession
    parts = max(1, min(spark.sparkContext.defaultParallelism, len(points) // AT_ONCE))
    got = spark.range(0, len(points), 1, parts).mapInArrow(near, "at long, near array<long>").toArrow()
    out = np.empty((len(points), k), np.int64)
    out[got["at"].to_numpy()] = np.array(got["near"].to_pylist())
    return out


def balanced_parts(points: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """The part of each vertex: halves along main directions at first, then moves towards neighbours within bounds."""
    n = len(points)
    part = np.zeros(n, np.int64)
    groups = [(np.arange(n), 0, parts)]
    while groups:
        members, first, many = groups.pop()
        part[members] = first
        if many > 1:
            x = points[members] - points[members].mean(axis=0)
            way = rng.normal(size=x.shape[1])
            for _ in range(20):
                way = x.T @ (x @ way)
                way /= max(np.linalg.norm(way), 1e-300)
            order, left = np.argsort(x @ way, kind="stable"), many // 2
            cut = len(members) * left // many
            groups += [(members[order[:cut]], first, left), (members[order[cut:]], first + left, many - left)]
    most = int(np.ceil(SLACK * n / parts))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), near.shape[1]), near.ravel()]), np.stack([near.ravel(), np.repeat(np.arange(n), near.shape[1])])], axis=1)
    size = np.bincount(part, minlength=parts)
    for _ in range(30):
        pull = np.zeros((n, parts))
        np.add.at(pull, (both[0], part[both[1]]), 1.0)
        best = pull.argmax(axis=1)
        gain = pull[np.arange(n), best] - pull[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if rng.random() < 0.7 and size[best[v]] < most:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if moved < n // 500:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer from unit vectors to log-probabilities of parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, points: np.ndarray) -> np.ndarray:
        return np.maximum(points @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, points: np.ndarray, many: int) -> np.ndarray:
        """The most probable parts of each point, best first."""
        return np.argsort(-self.scores(points), axis=1, kind="stable")[:, :many]


def learned(points: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    """A router fitted to shares of parts, by Adam on the cross-entropy."""
    n, width, parts = len(points), points.shape[1], target.shape[1]
    weights = [rng.normal(size=(width, HIDDEN)) * (2 / width) ** 0.5 * width**0.25, np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) * HIDDEN**-0.5, np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    total = PASSES * -(-n // STEP_ROWS)
    for _ in range(PASSES):
        order = rng.permutation(n)
        for start in range(0, n, STEP_ROWS):
            step += 1
            x, y = points[order[start : start + STEP_ROWS]], target[order[start : start + STEP_ROWS]]
            hidden = np.maximum(x @ weights[0] + weights[1], 0)
            z = hidden @ weights[2] + weights[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            off = (z / z.sum(axis=1, keepdims=True) - y) / len(x)
            back = (off @ weights[2].T) * (hidden > 0)
            for i, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ off, off.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                rate = STEP * (1 - step / (total + 1)) / (1 - 0.9**step)
                weights[i] = weights[i] - rate * first[i] / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def fit(rows: DataFrame, sample: int = SAMPLE, k: int = 5) -> Router:
    """A router from at most ``sample`` rows (id, v), those whose id has the smallest hash."""
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample)
    got = chosen.toArrow()
    points = unit(np.array(got["v"].to_pylist(), float).reshape(got.num_rows, -1))
    rng = np.random.default_rng(SEED)
    parts = max(1, min(MOST_PARTS, len(points) // PART_ROWS))
    near = max(1, min(GRAPH_NEIGHBOURS, len(points) - 1))
    if parts == 1:
        return Router(np.zeros((points.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(chosen, points, near)
    part = balanced_parts(points, graph, parts, rng)
    target = np.zeros((len(points), parts))
    np.add.at(target, (np.repeat(np.arange(len(points)), near), part[graph].ravel()), 1.0)
    target[np.arange(len(points)), part] += near / 2
    target /= target.sum(axis=1, keepdims=True)
    # As many probes as reach the neighbours of points that a router has not seen.
    seen = rng.random(len(points)) < 0.8
    trial = learned(points[seen], target[seen], rng)
    placed = trial.parts(points, 1)[:, 0]
    asked = np.flatnonzero(~seen)
    ranked = trial.parts(points[asked], parts)
    place_of = np.argsort(ranked, axis=1)
    needed = np.take_along_axis(place_of, placed[graph[asked][:, :k]], axis=1)
    reached = np.array([(needed < p).mean() for p in range(1, parts + 1)])
    router = learned(points, target, rng)
    router.probes = int(np.argmax(reached >= RECALL)) + 1 if (reached >= RECALL).any() else parts
    return router


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the k nearest other rows of each query, exactly, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    rows, ids = scaled(rows[order]), ids[order]
    # Of equal vectors only the k + 1 smallest ids can be among the nearest.
    _, kind = np.unique(np.ascontiguousarray(rows + 0.0).view(np.dtype((np.void, rows.shape[1] * 8)))[:, 0], return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")
    sorted_kind = kind[by_kind]
    rank = np.arange(len(kind)) - np.searchsorted(sorted_kind, sorted_kind)
    kept = np.sort(by_kind[rank <= k])
    rows, ids = rows[kept], ids[kept]
    queries = scaled(queries)
    length, own = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    out = []
    for start in range(0, len(queries), AT_ONCE):
        q, q_ids, q_own = (x[start : start + AT_ONCE] for x in (queries, query_ids, own))
        like = (q @ rows.T) / length / q_own[:, None]
        like[q_ids[:, None] == ids[None, :]] = -np.inf
        edge = np.partition(like, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
        a, b = np.nonzero((like >= edge[:, None] - 1e-9) & (like > -np.inf))
        exact = (q[a] * rows[b]).sum(axis=1) / (q_own[a] * length[b])
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        first = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((q_ids[a[first]], ids[b[first]], exact[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (query_ids, query_ids, own)


def search(vectors: DataFrame, asks: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", router: Router | None = None) -> DataFrame:
    """(query_id, rank, key, score): the k nearest other rows found for every row that asks.

    ``asks`` is an SQL condition on ``id``, the key. Ranks count from 1. Every row is indexed and can be found.
    """
    rows = written(usable(vectors, key, vector), "vectors")
    spark = rows.sparkSession
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = f"query_id long, rank int, `{key}` long, score double"
    if lengths is None:
        return spark.createDataFrame([], kind)
    rows = rows.where(F.size("v") == lengths["n"])
    router = router or fit(rows, k=k)
    shared = spark.sparkContext.broadcast(router)
    many = router.probes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = unit(_matrix(batch.column(1)))
            parts = shared.value.parts(points, many)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts.tolist(), pa.list_(pa.int64()))], names=["id", "v", "parts"])

    placed = written(rows.mapInArrow(route, "id long, v array<double>, parts array<long>"), "placed")
    base = placed.select("id", "v", F.col("parts")[0].alias("part"))
    asked = placed.where(asks)
    found = _met(base, asked.select("id", "v", F.explode("parts").alias("part")), k)
    if many < router.w2.shape[1]:
        found = written(found, "found")
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short = asked.join(enough, asked.id == enough.query_id, "left_anti")
        others = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(router.w2.shape[1] - 1).cast("long")), "parts")
        found = found.unionByName(_met(base, short.select("id", "v", F.explode(others).alias("part")), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _met(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k nearest rows of ``base`` (id, v, part) in every part that a row of ``asked`` (id, v, part) names."""
    full = base.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    wanted = asked.groupBy("part").agg(F.count(F.lit(1)).alias("queries"))
    # At most as many rows as there are parts.
    blocks = full.join(wanted, "part").select(
        "part",
        F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("row_blocks"),
        F.ceil(F.col("queries") / BLOCK_QUERIES).cast("int").alias("query_blocks"),
    )
    blocks = F.broadcast(blocks)
    left = base.join(blocks, "part").select(
        "part", F.pmod(F.xxhash64("id"), F.col("row_blocks")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("q"), "id", "v"
    )
    right = asked.join(blocks, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("r"), F.pmod(F.xxhash64("id"), F.col("query_blocks")).cast("int").alias("q"), F.col("id").alias("ask"), F.col("v").alias("w")
    )

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        else:
            found = nearest(_matrix(theirs["w"]), theirs["ask"].to_numpy(), _matrix(mine["v"]), mine["id"].to_numpy(), k)
        return pa.table(dict(zip(("query_id", "id", "score"), map(pa.array, found), strict=True)))

    keys = ("part", "r", "q")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, score double")


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)
