"""Near copies by 64-bit SimHash, found through Golay-code fuzzy hashing.

Two fingerprints link when they differ in few bits (two at most, here). Cut into three segments, such a
pair has a segment without errors whose next or next but one has at most one, so one of the three cyclic
(exact segment, fuzzy segment) keys fits both. The fuzzy half is a Golay index: the (23, 12) code is
perfect, so a word lies within three bits of one codeword; a word at exactly three bits also takes
the five codewords at four. Words one bit apart then always share an index. Keys are joined, pairs
checked bit by bit.

A key shared by many fingerprints would give their square in pairs. Those fingerprints link through hubs
instead: all words within one bit of a fingerprint. Two fingerprints share a hub exactly when they differ in at
most two bits, so that way is exact too, and linear.

NULL, empty and blank texts have the fingerprint zero and link like any other. Rows without an id take no
part in naming a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.components import components
from lotwise.llm.corpus import LONG, unused, with_text_columns, written

MOST_BITS = 2
WORDS = 3
SEED = 42
# Keys of more fingerprints than this are linked through hubs.
PAIRED = 32
# Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator polynomial of the binary Golay code.
GOLAY = 0b110001110101


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the word shingles of a text, repeats included: a bit is 1 if it is in over half of their hashes."""
    found = text.lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    shingles = map(b" ".join, zip(*[found[i:] for i in range(words)], strict=False))
    n = len(found) - words + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, name: str = "fp") -> DataFrame:
    """``docs`` plus the fingerprint of each text as a signed long."""

    def prepare():
        def work(found: list[bytes]) -> list:
            prints = np.array([fingerprint(t, words) for t in found], np.uint64)
            return [prints.view(np.int64)]

        return work

    return with_text_columns(docs, text, [(name, *LONG)], prepare)


def syndromes(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GOLAY << bit - 11, 0)
    return x


@cache
def error_patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of least weight, that weight, and the five errors of weight four where it is three."""
    least, weight = np.zeros(2048, np.int64), np.full(2048, 9)
    fours: list[list[int]] = [[] for _ in range(2048)]
    for size in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), size)], np.int64)
        for error, s in zip(errors.tolist(), syndromes(errors).tolist(), strict=True):
            if size < 4:
                least[s], weight[s] = error, size
            elif weight[s] == 3:
                fours[s].append(error)
    return least, weight, np.array([f or [0] * 5 for f in fours], np.int64)


def golay_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of 23-bit words, as (place in ``x``, index): one, or six for a word three bits off."""
    least, weight, fours = error_patterns()
    s = syndromes(x)
    off = np.flatnonzero(weight[s] == 3)
    place = np.concatenate([np.arange(len(x)), np.repeat(off, 5)])
    words = np.concatenate([x ^ least[s], (x[off, None] ^ fours[s[off]]).ravel()])
    return place, words >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fuzzy keys of unsigned fingerprints, as (place, key)."""
    parts = [(prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    places, made = [], []
    for i, exact in enumerate(parts):
        place, index = golay_indices(parts[(i + 1) % 3])
        places.append(place)
        made.append((i << 34) | (exact[place] << 12) | index)
    return np.concatenate(places), np.concatenate(made)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        place, key = keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[place])], names=["key", "fp"])


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp`` of at most two different bits, enough to join all that are reachable."""
    keyed = written(prints.select("fp").mapInArrow(_keyed, "key long, fp long"), "golay-keys")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(shared, "key")
    lists = sized.where(F.col("n") <= paired).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.expr(
        f"""flatten(transform(fps, (x, i) -> transform(
              filter(slice(fps, i + 2, {paired}), y -> bit_count(x ^ y) <= {MOST_BITS}), y -> struct(x as a, y as b))))"""
    )
    pairs = lists.select(F.explode(near).alias("e")).select("e.a", "e.b")
    crowded = sized.where(F.col("n") > paired).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    hubs = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    through = hubs.join(least, "hub").where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(through).distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp, root): one row per document with its fingerprint and the smallest key reachable over links."""
    prints = written(with_fingerprints(docs.select(key, text), text, words).select(key, "fp"), "fingerprints")
    first = prints.groupBy("fp").agg(F.min(key).alias("first"))
    parts = components(links(first.select("fp")))
    linked = first.join(parts, first.fp == parts.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("part")
    )
    roots = linked.groupBy("part").agg(F.min("first").alias("root"))
    named = linked.join(roots, "part").select("fp", "root")
    return prints.join(named, "fp").select(key, "fp", "root")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The document of smallest key of every group of near copies, with all its columns.

    Of rows that repeat a key one stays. Rows without a key cannot be named and stay as they are.
    """
    found = near_copies(docs.where(F.col(key).isNotNull()), key, text, words).where(F.col(key) == F.col("root"))
    (rows,) = unused(docs, "__rows")
    kept = written(found.groupBy(key).agg(F.count(F.lit(1)).alias(rows)), "kept")
    mine = docs.join(kept, key)
    once = mine.where(F.col(rows) == 1).select(*docs.columns)
    again = mine.where(F.col(rows) > 1).select(*docs.columns).dropDuplicates([key])
    return once.unionByName(again).unionByName(docs.where(F.col(key).isNull()))
