"""Language-model scores by a weighted backoff automaton over the whole corpus.

States are the contexts seen in training, arcs the seen n-grams, and a failure arc drops a context's oldest word. With c
the training count, an arc weighs log10((c(context word) + M * p(word | shorter context)) / (c(context) + M)) and a failure arc
log10(M / (c(context) + M)), so that probabilities add up to one; single words have (c + 0.5) / (N + 0.5 * (V + 1)),
where one unknown word stands for all. Reading a text from left to right, a word without an arc at the state takes failure
arcs until there is one (the empty context takes every word), the state after a word is the longest known context that it ends,
and the weights of all arcs taken add up.

The counts of a corpus fit no machine, so each chunk of documents gets those it can reach. A chunk sends
the hashes of its distinct n-grams, with their training counts, to buckets by hash; a bucket adds up and answers
with total counts in the same order; from them the chunk builds its part of the automaton and walks its texts side by side.
Long texts are walked in pieces: a piece reads the few words before it first, after which its state is that of the whole text.
Repeated n-grams travel once per chunk, however common. N and V come from a pass before. Chunks and buckets grow in number
with the text. A chunk is a hash of key, text and input partition, so no key and no text that many rows repeat fills one.

Words are runs of anything but the six ASCII blanks, A-Z in lower case; every text ends with one more token. NULL, empty
and blank texts are that token alone. Equal rows get equal scores. Rows with a NULL key belong to training.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.corpus import slices

ORDER = 2
# M: how many sightings the shorter context's answer is worth.
PRIOR = 200.0
# Text bytes of a chunk of documents, and words counted by a task before it sends them on.
CHUNK_BYTES = 12 << 20
HELD_WORDS = 1_000_000
# Text bytes of a chunk that are unpacked at a time.
SLICE_BYTES = 1 << 20
# Tokens of a text that are walked in a row.
PIECE = 512
# Neither an empty word nor a blank one can be in a text.
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(w)) for w in (b"", b" "))
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts with one more word."""
    with np.errstate(over="ignore"):
        x = context * MIX[0] + word
        x = (x ^ x >> np.uint64(30)) * MIX[1]
        x = (x ^ x >> np.uint64(27)) * MIX[2]
    return x ^ x >> np.uint64(31)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, equal bytes side by side so that they compress."""
    both = np.stack([np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint64)])
    return np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)).tobytes()


def unpacked(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(message, np.uint8).reshape(2, 8, -1).transpose(0, 2, 1)
    steps, counts = np.ascontiguousarray(planes).view(np.uint64)[..., 0]
    return np.cumsum(steps, dtype=np.uint64), counts


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes: those of sorted keys lie in a row."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cut_by_bucket(keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    own = bucket_of(keys, buckets)
    edges = np.searchsorted(own, np.arange(buckets + 1))
    for b in np.unique(own).tolist():
        part = slice(edges[b], edges[b + 1])
        yield b, packed(keys[part], counts[part])


class Chunk:
    """The n-grams of some texts: distinct hashes, and which one ends at each token."""

    def __init__(self, found: Iterable[bytes], order: int) -> None:
        ids: dict[bytes, int] = defaultdict(count(1).__next__)
        get = ids.__getitem__
        sequences = [np.fromiter(map(get, t.lower().split()), np.int32) for t in found]
        self.sizes = np.array([len(s) + 1 for s in sequences], np.int64)
        self.owner = np.repeat(np.arange(len(sequences), dtype=np.int32), self.sizes)
        last = np.cumsum(self.sizes) - 1
        flat = np.zeros(int(self.sizes.sum()), np.int32)  # 0: the end
        inner = np.ones(len(flat), bool)
        inner[last] = False
        flat[inner] = np.concatenate([*sequences, flat[:0]])
        del sequences
        words = np.append(END, np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids)))
        del ids, get
        hashed = words[flat]
        self.order, self.flat, self.first = order, flat, last - self.sizes + 1
        place = (np.arange(len(flat)) - np.repeat(self.first, self.sizes)).astype(np.int32)
        # Where an n-gram ends: from the text's second word on for three words, as the begin is the first one.
        self.valid = [np.flatnonzero(place >= n - 2).astype(np.int32) for n in range(1, order + 1)]
        grams, distinct = hashed, [(words, flat)]
        for n in range(2, order + 1):
            before = np.full_like(hashed, BEGIN)
            before[1:] = np.where(place[1:] > 0, grams[:-1], BEGIN)
            grams = longer(before, hashed)
            del before
            if n == order:
                del hashed, place
            keys, at = np.unique(grams[self.valid[n - 1]], return_inverse=True)
            distinct.append((keys, at.astype(np.int32)))
            del at
        del grams
        self.keys, where = np.unique(np.concatenate([d[0] for d in distinct]), return_inverse=True)
        starts, where = np.cumsum([0, *[len(d[0]) for d in distinct]]), where.astype(np.int32)
        # Of each n-gram's places, the number of its key.
        self.at = [where[s:][d[1]] for s, d in zip(starts, distinct, strict=False)]
        self.word, self.end = where[: len(words)], int(where[0])

    def counts(self, training: np.ndarray) -> np.ndarray:
        """Of each distinct n-gram in the training texts."""
        mine, total = training[self.owner], np.zeros(len(self.keys), np.int64)
        for at, valid in zip(self.at, self.valid, strict=True):
            total += np.bincount(at[mine[valid]], minlength=len(self.keys))
        return total

    def scores(self, total: np.ndarray, n_tokens: int, n_words: int, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, single-word score and automaton score of each text, from total counts of the n-grams."""
        total = total.astype(float)
        sum_ = lambda values: np.bincount(self.owner, values, minlength=len(self.sizes))
        known = total[self.at[0]]
        single = np.log10((total[self.word] + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        walked = Automaton(self, total, single, prior).walk(self)
        return sum_(known > 0).astype(np.int64), sum_(single[self.flat]), sum_(walked)


class Automaton:
    """The states, arcs and failure arcs that the texts of a chunk can reach.

    A state is the number of its context's key; behind them come the empty context and the begin of a text.
    """

    def __init__(self, chunk: Chunk, total: np.ndarray, single: np.ndarray, prior: float) -> None:
        n = len(chunk.keys)
        self.empty, self.begin, self.words = n, n + 1, len(chunk.word)
        self.single = single
        log_p, fails = np.zeros(n), np.full(n + 2, self.empty)
        log_p[chunk.word] = single
        seen = np.concatenate([total, [0.0, total[chunk.end]]])
        # The empty context takes every word; only seen words are contexts.
        self.after = np.where((total[chunk.word] > 0) & (chunk.order > 1), chunk.word, self.empty)
        keys, weights, ends = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        number = chunk.at[0].copy()  # of the n-gram one word shorter, by place
        begins = np.zeros(len(number), bool)
        begins[chunk.first] = True
        for order in range(2, chunk.order + 1):
            places, at = chunk.valid[order - 1], chunk.at[order - 1]
            one = np.full(n, -1, np.int32)  # a place of each n-gram
            one[at] = places
            gram = np.flatnonzero((one >= 0) & (total > 0))
            place = one[gram].astype(np.int64)
            shorter = number[place].astype(np.int64)
            context = number[place - 1].astype(np.int64)
            if order == 2:
                context[begins[place]] = self.begin
            log_p[gram] = np.log10((total[gram] + prior * 10.0 ** log_p[shorter]) / (seen[context] + prior))
            keys.append(context * self.words + chunk.flat[place])
            weights.append(log_p[gram])
            longest = order == chunk.order
            ends.append(shorter if longest else gram)
            if not longest:
                fails[gram] = shorter
            number[places] = at
        arc = np.concatenate(keys)
        by_key = np.argsort(arc)
        # One key beyond all real ones keeps the search in bounds.
        self.keys = np.append(arc[by_key], np.iinfo(np.int64).max)
        self.weights, self.ends = (np.concatenate(v)[by_key] for v in (weights, ends))
        self.fails, self.fail_weights = fails, np.log10(prior / (seen + prior))

    def walk(self, chunk: Chunk) -> np.ndarray:
        """The weight that each token adds. All texts, and pieces of long ones, go on by a token at a time."""
        pieces = -(-chunk.sizes // PIECE)
        text = np.repeat(np.arange(len(chunk.sizes)), pieces)
        start = chunk.first[text] + PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(start + PIECE, (chunk.first + chunk.sizes)[text])
        # The words before a piece decide its state.
        at = np.maximum(start - (chunk.order - 1), chunk.first[text])
        long_first = np.argsort(at - stop, kind="stable")
        start, stop, at, first = start[long_first], stop[long_first], at[long_first], chunk.first[text][long_first]
        state = np.where((at == first) & (chunk.order > 1), self.begin, self.empty)
        lengths, out = stop - at, np.zeros(len(chunk.flat))
        for step in range(int(lengths.max(initial=0))):
            going = int(np.searchsorted(-lengths, -step))
            place = at[:going] + step
            word, weight, now = chunk.flat[place], np.zeros(going), state[:going].copy()
            todo = np.arange(going)
            while len(todo):
                free = now[todo] == self.empty
                done = todo[free]
                weight[done] += self.single[word[done]]
                now[done] = self.after[word[done]]
                todo = todo[~free]
                wanted = now[todo] * self.words + word[todo]
                found = np.searchsorted(self.keys, wanted)
                taken = self.keys[found] == wanted
                done, arc = todo[taken], found[taken]
                weight[done] += self.weights[arc]
                now[done] = self.ends[arc]
                todo = todo[~taken]
                weight[todo] += self.fail_weights[now[todo]]
                now[todo] = self.fails[now[todo]]
            state[:going] = now
            own = place >= start[:going]
            out[place[own]] = weight[own]
        return out


def corpus_size(docs: DataFrame, text: str, buckets: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of texts, ends included."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)

        def sent() -> pa.RecordBatch:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held))
            order = np.argsort(keys)
            rows = list(cut_by_bucket(keys[order], np.fromiter(held.values(), np.int64, len(held))[order], buckets))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int32()), pa.array([m for _, m in rows], pa.binary())], names=["bucket", "message"]
            )

        for batch in batches:
            for _, found in slices(batch, text):
                for t in found:
                    for w in t.lower().split():
                        held[w] += 1
                held[b""] += len(found)
                if len(held) > HELD_WORDS:
                    yield sent()
        if held:
            yield sent()

    def added(table: pa.Table) -> pa.Table:
        parts = [unpacked(m) for m in table["message"].to_pylist()]
        keys = np.concatenate([p[0] for p in parts])
        tokens = sum(int(p[1].sum()) for p in parts)
        return pa.table({"tokens": pa.array([tokens], pa.int64()), "words": pa.array([len(np.unique(keys))], pa.int64())})

    sent = docs.select(text).mapInArrow(local, "bucket int, message binary")
    total = sent.groupBy("bucket").applyInArrow(added, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    return int(total[0] or 0), int(total[1] or 0)


def held_out(key: str) -> Column:
    """A fifth of the keys, by checksum of the key as text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, prior: float = PRIOR, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    The model is of order ``order`` and learns from the rows that are not held out.
    """
    if order < 1 or prior <= 0:
        raise ValueError("the order is 1 at least, and the prior positive")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out(key).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    n_tokens, n_words = corpus_size(rows.where(~F.col("held")), "text", chunks)
    # One exchange of the texts serves both the counting and the scoring side.
    mixed = F.xxhash64("key", "text", F.spark_partition_id())
    dealt = rows.withColumn("chunk", F.pmod(mixed, F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    def ask(table: pa.Table) -> pa.Table:
        chunk = Chunk(_texts(table), order)
        rows_ = list(cut_by_bucket(chunk.keys, chunk.counts(~_flags(table, "held")), chunks))
        n = len(rows_)
        return pa.table(
            {
                "chunk": pa.array([table["chunk"][0].as_py()] * n, pa.int32()),
                "bucket": pa.array([b for b, _ in rows_], pa.int32()),
                "message": pa.array([m for _, m in rows_], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        parts = [unpacked(m) for m in table["message"].to_pylist()]
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.zeros(len(keys), np.uint64)
        np.add.at(total, where, np.concatenate([p[1] for p in parts]))
        edges = np.cumsum([0, *[len(p[0]) for p in parts]])
        back = [total[where[a:b]] for a, b in zip(edges, edges[1:], strict=False)]
        message = [np.ascontiguousarray(t.view(np.uint8).reshape(-1, 8).T).tobytes() for t in back]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "message": pa.array(message, pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(_texts(left), order)
        answers = sorted(zip(right["bucket"].to_pylist(), right["message"].to_pylist(), strict=True))
        total = [np.ascontiguousarray(np.frombuffer(m, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0] for _, m in answers]
        known, base, own = chunk.scores(np.concatenate(total), n_tokens, n_words, prior)
        return pa.table(
            {
                key: left["key"],
                "held_out": left["held"],
                "n_tokens": pa.array(chunk.sizes, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([n_tokens] * len(known), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(own, pa.float64()),
            }
        )

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk int, bucket int, message binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, message binary")
    kind = dict(docs.dtypes)[key]
    out = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(score, out)


def _texts(table: pa.Table) -> Iterator[bytes]:
    for batch in table.select(["text"]).to_batches():
        for _, found in slices(batch, "text", SLICE_BYTES):
            yield from found


def _flags(table: pa.Table, name: str) -> np.ndarray:
    return np.array(table[name].to_pylist(), bool)
