"""Benchmark passages in documents, found by an FM-index per shard of documents.

A shard is some megabytes of documents inside a task. Its words become symbols of the benchmark's vocabulary; runs
of known words at least as long as the shortest window are indexed (no window can touch anything else),
all windows are searched backwards together, their occurrences located from sampled suffix positions, and
overlapping spans merged.

Words are runs of digits, letters and non-ASCII bytes, A-Z in lower case. A window is 13 words in a row; an item of
fewer words, but not none, is one window. NULL and empty texts have no words and are clean. Items without an id or
words take no part; rows of one item id count as one item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.corpus import INTS, LONG, STRINGS, unused, with_text_columns
from lotwise.llm.fm_index import FmIndex

WINDOW = 13
# A document is contaminated when at least one word in so many is hit.
ONE_IN = 20
# Benchmark text searched at a time (it is broadcast), text of one shard, occurrences located at a time.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
LOCATED = 500_000
# Lower-case word bytes, and blanks for all others.
WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Windows:
    """Distinct windows of a block of benchmark items."""

    symbol: dict[bytes, int]
    phrases: np.ndarray
    lengths: np.ndarray
    owner_window: np.ndarray
    owner_item: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], window: int = WINDOW) -> Windows:
        symbol: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for item, text in rows:
            words = words_of((text or "").encode())
            if item is None or not words:
                continue
            ids = [symbol.setdefault(w, len(symbol) + 1) for w in words]
            name = names.setdefault(str(item), len(names))
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i : i + window]), set()).add(name)
        phrases = np.zeros((len(found), window), np.int32)
        for i, w in enumerate(found):
            phrases[i, : len(w)] = w
        owners = [(i, n) for i, s in enumerate(found.values()) for n in s]
        pairs = np.array(owners, np.int64).reshape(-1, 2)
        return cls(symbol, phrases, np.array([len(w) for w in found], np.int64), pairs[:, 0], pairs[:, 1], list(names))

    def search(self, texts: list[bytes]) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """Of one shard: words, merged spans [start, end, ...] in words, and item ids of each text."""
        get, zero = self.symbol.get, np.zeros(1, np.int32)
        parts, sizes = [], []
        for t in texts:
            words = words_of(t)
            sizes.append(len(words))
            parts += [np.array([get(w, 0) for w in words], np.int32), zero]
        begin = np.cumsum([0, *[n + 1 for n in sizes]])
        stream = np.concatenate(parts) if parts else zero[:0]
        spans: list[list[int]] = [[] for _ in texts]
        items: list[list[str]] = [[] for _ in texts]
        if not len(self.lengths):
            return sizes, spans, items
        edges = np.diff((stream > 0).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        long = ends - starts >= self.lengths.min()
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return sizes, spans, items
        widths = ends - starts + 1  # with the 0 behind each run
        origin = np.repeat(starts - (np.cumsum(widths) - widths), widths) + np.arange(int(widths.sum()))
        index = FmIndex(stream[origin], len(self.symbol) + 1)
        low, high = index.search(self.phrases, self.lengths)
        hits, pairs = np.zeros(len(stream) + 1, np.int64), []
        found = np.flatnonzero(high > low)
        total = np.cumsum(high[found] - low[found])
        at = 0
        while at < len(found):
            done = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + LOCATED, "right")))
            window = found[at:to]
            many = high[window] - low[window]
            which = np.repeat(window, many)
            row = np.repeat(low[window] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            place = origin[index.locate(row)]
            np.add.at(hits, place, 1)
            np.add.at(hits, place + self.lengths[which], -1)
            doc = np.searchsorted(begin, place, "right") - 1
            pairs.append(np.unique(doc * len(self.lengths) + which))
            at = to
        edges = np.diff((np.cumsum(hits) > 0).astype(np.int8), prepend=0)
        for a, b in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True):
            doc = int(np.searchsorted(begin, a, "right")) - 1
            spans[doc] += [int(a - begin[doc]), int(b - begin[doc])]
        if pairs:
            doc, window = np.divmod(np.unique(np.concatenate(pairs)), len(self.lengths))
            order = np.argsort(self.owner_window, kind="stable")
            by_window = self.owner_window[order]
            left, right = np.searchsorted(by_window, window), np.searchsorted(by_window, window, "right")
            many = right - left
            at = np.repeat(left - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            both = np.unique(np.repeat(doc, many) * len(self.items) + self.owner_item[order][at])
            for d, item in zip(*np.divmod(both, len(self.items)), strict=True):
                items[int(d)].append(self.items[int(item)])
        return sizes, spans, [sorted(i) for i in items]


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark in parts of about ``most`` text bytes: each is broadcast on its own."""
    whole = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where(F.col("item").isNotNull())
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most))
    return [whole.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b) for b in range(n)]


def _searched(docs: DataFrame, block: DataFrame, text: str, window: int, names: tuple[str, str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Windows.of([tuple(r) for r in block.collect()], window))

    def prepare():
        windows = shared.value

        def work(found: list[bytes]) -> list:
            return list(windows.search(found))

        return work

    fields = [(names[0], *LONG), (names[1], *INTS), (names[2], *STRINGS)]
    return with_text_columns(docs, text, fields, prepare, SHARD_BYTES)


def _hit(spans: str) -> Column:
    """Words inside merged spans: starts and ends take turns, so each step turns the sum so far around."""
    return F.expr(f"cast(aggregate({spans}, 0, (n, x) -> x - n) as long)")


def _contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (ONE_IN * n_hit >= n_words)


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, spans, contaminated) of every document.

    ``items`` holds the ids of items with occurring windows, sorted as strings and joined by commas; ``n_items`` counts the ids, which
    may be empty or hold commas themselves. Items without an id are left out. ``spans`` the merged hits as
    [start, end, start, end, ...] in words.
    """
    names = ("__words", "__spans", "__items")
    rows, parts = docs.select(key, text), blocks(benchmark, item)
    if len(parts) == 1:
        found = _searched(rows, parts[0], text, window, names).select(key, *names)
    else:  # equal rows have equal results, so a key and a checksum stand for them
        mark = F.xxhash64(text).alias("__mark")
        each = [_searched(rows, p, text, window, names).select(key, mark, *names) for p in parts]
        all_ = each[0]
        for other in each[1:]:
            all_ = all_.unionByName(other)
        joined = all_.groupBy(key, "__mark", "__words").agg(
            F.flatten(F.collect_list("__spans")).alias("__spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
            (F.count(F.lit(1)) / len(parts)).cast("int").alias("__rows"),
        )
        pairs = F.expr("array_sort(transform(sequence(1, cast(size(__spans) / 2 as int)), i -> struct(__spans[2 * i - 2] as a, __spans[2 * i - 1] as b)))")
        pairs = F.when(F.size("__spans") > 0, pairs).otherwise(F.expr("cast(array() as array<struct<a:int,b:int>>)"))
        merged = F.expr(
            """aggregate(__pairs, cast(array() as array<int>), (done, p) ->
                 if(size(done) > 0 and p.a <= done[size(done) - 1],
                    concat(slice(done, 1, size(done) - 1), array(greatest(done[size(done) - 1], p.b))),
                    concat(done, array(p.a, p.b))))"""
        )
        found = joined.withColumn("__pairs", pairs).withColumn("__spans", merged)
        found = found.withColumn("__each", F.explode(F.expr("array_repeat(0, __rows)"))).select(key, *names)
    n_hit = _hit("__spans")
    return found.select(
        key,
        F.col("__words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.array_join("__items", ",").alias("items"),
        F.col("__spans").alias("spans"),
        _contaminated(F.col("__words"), n_hit).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents that are not contaminated, with all their columns, unchanged."""
    parts = blocks(benchmark, item)
    if len(parts) == 1:
        names = unused(docs, "__words", "__spans", "__items")
        found = _searched(docs, parts[0], text, WINDOW, names)
        return found.where(~_contaminated(F.col(names[0]), _hit(names[1]))).select(*docs.columns)
    own = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("mark"))
    (name,) = unused(docs, "__row")
    bad = contamination(docs.select(own.alias(name), text), benchmark, name, text, item).where("contaminated").select(name).distinct()
    return docs.join(bad, own.eqNullSafe(F.col(name)), "left_anti")
