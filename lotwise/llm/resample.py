"""Quality selection by importance resampling.

Target and raw text are each described by a bag of hashed word 1- and 2-grams. A document's log weight is the
log ratio of the two smoothed models over its n-grams. Adding Gumbel noise and taking the k largest draws k documents
without replacement in proportion to their weights; the noise is a hash of the key, so a draw can be repeated.

The log weight is the plain sum over all n-grams of a text, whatever its length: long texts are more surely told apart than
short ones, and noise matters where the two models hardly differ.

Raw counts cover all documents and target counts all target documents: one pass over the texts for each, however many target keys
there are. Target texts meet their keys in a shuffle by key. NULL, empty and blank texts have no n-grams and the log weight 0. Repeated rows share
noise and fate; a tie at the edge is settled by the key. Without target texts all weights are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.corpus import DOUBLE, LONG, slices, with_text_columns, written

BUCKETS = 1 << 16
# Added to every bucket's count.
SMOOTHING = 1.0
BATCH_BYTES = 4 << 20
SEED = 11
# Values between two bounds that are looked at one by one, and parts a range is cut into otherwise.
NARROW = 2_000
PARTS = 256


def hashed_ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every two words in a row, lower-cased A-Z."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    get = ids.__getitem__
    words = [np.fromiter(map(get, t.lower().split()), np.int64) for t in texts]
    marks = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat, owner = marks[np.concatenate(words)], np.repeat(np.arange(len(texts)), sizes)
    both = owner[1:] == owner[:-1]
    pairs = (flat[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ flat[1:])[both]
    mixed = np.concatenate([flat, pairs])
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([owner, owner[1:][both]]), (mixed >> np.uint64(40) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Ratio:
    """Log ratio of target to raw by bucket."""

    log_ratio: np.ndarray

    def weigh(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log weight, n-grams) of each text."""
        owner, bucket = hashed_ngrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        total = np.bincount(owner, self.log_ratio[bucket], minlength=len(texts))
        return total, n


def counted(texts: DataFrame) -> np.ndarray:
    """N-grams of a text column by bucket, over all its rows."""
    name = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, found in slices(batch, name, BATCH_BYTES):
                every += np.bincount(hashed_ngrams(found)[1], minlength=BUCKETS)
        seen = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(every[seen])], names=["bucket", "n"])

    got = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(docs: DataFrame, target_keys: DataFrame, key: str = "doc_id", text: str = "text") -> Ratio:
    """Counts n-grams over all documents (raw) and over those with a key in ``target_keys`` (NULL is none)."""
    keys = target_keys.select(F.col(key).alias("__key")).where("__key is not null").distinct()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    raw = counted(rows.select("text"))
    # Always by shuffle, so that the cost per byte is the same at every size; only the distinct keys are held, texts stream past them.
    target = counted(rows.where("__key is not null").join(keys.hint("shuffle_hash"), "__key", "left_semi").select("text"))
    if not target.sum():
        return Ratio(np.zeros(BUCKETS))
    raw, target = raw + SMOOTHING, target + SMOOTHING
    return Ratio(np.log(target / target.sum()) - np.log(raw / raw.sum()))


def weighted(docs: DataFrame, ratio: Ratio, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, n_grams, log_weight, score) of every document; ``score`` is the log weight plus Gumbel noise."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def prepare():
        own = shared.value

        def work(found: list[bytes]) -> list:
            weight, n = own.weigh(found)
            return [weight, n]

        return work

    out = with_text_columns(docs.select(key, text), text, [("log_weight", *DOUBLE), ("n_grams", *LONG)], prepare, BATCH_BYTES)
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("\0"))), 11) + 0.5) / float(2**53)
    return out.select(key, "n_grams", "log_weight", (F.col("log_weight") - F.ln(-F.ln(unit))).alias("score"))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column that holds at least k, by narrowing bounds; no rows beyond ``NARROW`` leave the cluster."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        inside = values.where(F.col(column).between(low, high))
        if inside.limit(NARROW + 1).count() <= NARROW:
            found = sorted((r[0] for r in inside.select(column).collect()), reverse=True)
            return found[k - values.where(F.col(column) > high).count() - 1]
        width = (high - low) / PARTS
        if not width or not math.isfinite(width) or low + width == low:
            width = None
        edges = [low + i * width for i in range(1, PARTS)] if width else [low]
        counts = inside.select(sum(((F.col(column) > e).cast("int") for e in edges), F.lit(0)).alias("part")).groupBy("part").count()
        by_part = {r["part"]: r["count"] for r in counts.collect()}
        above = values.where(F.col(column) > high).count()
        for part in sorted(by_part, reverse=True):
            if above + by_part[part] >= k:
                bounds = values.where(F.col(column).between(low, high))
                if part:
                    bounds = bounds.where(F.col(column) > edges[part - 1])
                if part < len(edges):
                    bounds = bounds.where(F.col(column) <= edges[part])
                low, high = bounds.agg(F.min(column), F.max(column)).first()
                break
            above += by_part[part]
    return low


def resampled(scores: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``scores`` plus ``selected``: the k largest scores (more when rows of the last key repeat)."""
    kept = written(scores, "scores")
    if k <= 0 or not kept.limit(1).count():
        return kept.withColumn("selected", F.lit(False))
    k = min(k, kept.count())
    edge = kth_largest(kept, "score", k)
    above = kept.where(F.col("score") > edge).count()
    # Equal scores at the edge come from one key as good as always; the smallest keys go first, NULL last.
    tied = kept.where(F.col("score") == edge).groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    last, left = None, k - above
    for row in tied.orderBy(F.col(key).asc_nulls_last()).toLocalIterator():
        last, left = row[key], left - row["__rows"]
        if left <= 0:
            break
    inside = F.lit(True) if last is None else F.coalesce(F.col(key) <= F.lit(last), F.lit(False))
    return kept.withColumn("selected", (F.col("score") > edge) | ((F.col("score") == edge) & inside))
