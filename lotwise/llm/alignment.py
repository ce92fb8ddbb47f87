"""Two tokenizers held beside each other: where their tokens end together, and which ids that links.

Texts are shuffled whole, so that each distinct text is tokenised and aligned once, in tasks; its pairs of ids count
as often as the text occurs. Byte offsets where a token of either side ends cut both sequences into groups; the two tokens
that end there are linked.

Tokens that end together are suffixes of one another in bytes, and a token of L bytes has L of them. So the table of linked
pairs has at most as many rows as both vocabularies have bytes (about half a million for those of 50,000 and 32,000
tokens), whatever the corpus: its size is proven, and it is broadcast to the pairs of every distinct text.

Measures go back to the rows by a digest of their text. Texts of more than a thousandth of all rows are at most a thousand:
their measures are broadcast, the others' are joined by a shuffle, in which no text has more rows than that.

NULL and empty texts, and texts that either side cannot give back byte by byte, have no tokens: zeros and an empty string.
Rows that repeat a key keep a row each. Special tokens' strings inside texts are plain text. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bpe import PATTERN, Encoder
from lotwise.llm.corpus import slices, written
from lotwise.llm.vocabulary import ByteVocabulary

# Text bytes that a task works on at a time.
SLICE_BYTES = 512 << 10
# Texts with a longer run of characters without a blank are merged in rounds: the ready-made encoder is quadratic in it.
LONG_RUN = 1_000
# Texts of more than this share of all rows are hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
# Fixed: the sign that stands for a blank in pieces.
BLANK = "▁"


@dataclass(frozen=True)
class Pieces:
    """A piece model as its file's bytes, and the bytes that each piece stands for."""

    model: bytes
    tokens: tuple[bytes, ...]

    @classmethod
    def read(cls, path: str) -> Pieces:
        with open(path, "rb") as file:
            model = file.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        known = (
            bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(BLANK, " ").encode()
            for i in range(sp.vocab_size())
        )
        return cls(model, tuple(known))


def ready_made(vocabulary: ByteVocabulary) -> tiktoken.Encoding | None:
    """The installed encoder of such vocabularies, if their ids follow the order of their merges, as it expects."""
    by_bytes = {t: i for i, t in enumerate(vocabulary.tokens) if t and t.decode("utf-8", "replace") not in vocabulary.added}
    merged = [by_bytes.get(vocabulary.tokens[a] + vocabulary.tokens[b], -1) for a, b in vocabulary.merges]
    if sorted(merged) != merged or len(by_bytes) != len(merged) + 256:
        return None
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=by_bytes, special_tokens={})


class Aligner:
    """Both tokenizers, and the alignment of texts that they cover byte by byte."""

    def __init__(self, vocabulary: ByteVocabulary, pieces: Pieces) -> None:
        self.first, self.quick = Encoder(replace(vocabulary, added={})), ready_made(vocabulary)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces.model)
        self.bytes_a, self.bytes_b = vocabulary.tokens, pieces.tokens
        self.length_a, self.length_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        width = len(str(most))
        # The digits of every id, right-aligned, with room for the mark behind them, and which of them are shown.
        self.digits = np.array([list(f"{i:0{width}d},".encode()) for i in range(most)], np.uint8)
        self.shown = np.array([[j >= width - len(str(i)) for j in range(width + 1)] for i in range(most)], bool)

    def encoded(self, text: bytes) -> np.ndarray:
        """The first side's ids."""
        told = text.decode()
        if self.quick is None or max(map(len, told.split()), default=0) > LONG_RUN:
            return np.frombuffer(self.first.encode([text])[0], "<u4").astype(np.int64)
        return np.array(self.quick.encode_ordinary(told), np.int64)

    def tokens(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both sides; none for a text that a side does not give back."""
        spaced = [b" " + t if t else b"" for t in texts]
        firsts = [self.encoded(s) for s in spaced]
        seconds = [np.array(s, np.int64) for s in self.second.encode([t.decode() for t in texts], num_threads=1)]
        for i, whole in enumerate(spaced):
            # The first side merges the bytes themselves, so its length tells; the second may know a piece by other bytes.
            told = b"".join(map(self.bytes_b.__getitem__, seconds[i].tolist()))
            if told != whole or self.length_a[firsts[i]].sum() != len(whole):
                firsts[i] = seconds[i] = np.zeros(0, np.int64)
        return firsts, seconds

    def aligned(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text: tokens of either side, groups, the groups' digest, linked ids of either side (one link per group)."""
        firsts, seconds = self.tokens(texts)
        a, b = np.concatenate([*firsts, np.zeros(0, np.int64)]), np.concatenate([*seconds, np.zeros(0, np.int64)])
        # The texts lie one after the other; both sides cover the same bytes, so a text ends with a common end.
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        near = np.minimum(np.searchsorted(end_b, end_a), max(len(end_b) - 1, 0))
        at_a = np.flatnonzero(end_b[near] == end_a) if len(a) else np.zeros(0, np.int64)
        at_b = near[at_a]
        told, ends = self.groups_text(a, b, at_a, at_b)
        starts_a, starts_b = (np.cumsum([0, *map(len, side)]) for side in (firsts, seconds))
        cuts = np.searchsorted(at_a, starts_a)
        # Where a text's part of the digits begins: the groups before it are told completely.
        places = np.append(0, ends)[cuts]
        for i in range(len(texts)):
            g, n = slice(cuts[i], cuts[i + 1]), cuts[i + 1] - cuts[i]
            name = sha256(told[places[i] : places[i + 1] - 1]).hexdigest() if n else ""
            yield starts_a[i + 1] - starts_a[i], starts_b[i + 1] - starts_b[i], n, name, a[at_a[g]], b[at_b[g]]

    def groups_text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of all groups, whose last tokens are given, and where each group's part ends."""
        if not len(last_a):
            return b"", np.zeros(0, np.int64)
        # Tokens of A stand before those of B of their group.
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(last_b + 1 - size_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, size_b)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        text, shown = self.digits[ids], self.shown[ids]
        text[place_a[last_a], -1], text[place_b[last_b], -1] = ord("|"), ord(";")
        ends = np.cumsum(shown.sum(1))
        return text[shown].tobytes(), ends[place_b[last_b]]


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(vocabulary: ByteVocabulary, pieces: Pieces) -> Aligner:
    """One aligner per worker process and pair of vocabularies."""
    mark = sha256(b"\0".join(vocabulary.tokens) + pieces.model).hexdigest()
    if mark not in _ALIGNERS:
        _ALIGNERS[mark] = Aligner(vocabulary, pieces)
    return _ALIGNERS[mark]


ALIGNED = (
    "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<struct<a:int,b:int,n:int>>"
)
_PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def aligned_texts(docs: DataFrame, vocabulary: ByteVocabulary, pieces: Pieces, text: str = "text") -> DataFrame:
    """One row per distinct text: its digest, how often it occurs, token and group counts, linked pairs with their number."""
    distinct = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    distinct = distinct.select("text", "copies", text_digest(F.col("text")).alias("digest"))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            for part, found in slices(batch, "text", SLICE_BYTES):
                counts, names, sizes, a, b, n = [], [], [], [], [], []
                for n_a, n_b, groups, name, ids_a, ids_b in aligner.aligned(found):
                    counts.append((n_a, n_b, groups, len(ids_a)))
                    names.append(name)
                    pairs, often = np.unique(ids_a << 32 | ids_b, return_counts=True)
                    sizes.append(len(pairs))
                    a.append((pairs >> 32).astype(np.int32))
                    b.append((pairs & 0xFFFFFFFF).astype(np.int32))
                    n.append(often.astype(np.int32))
                columns = [pa.array(np.concatenate(v)) for v in (a, b, n)]
                pairs = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_PAIRS.value_type))
                )
                numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["digest"], part["copies"], *numbers, pa.array(names, pa.string()), pairs],
                    names=["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"],
                )

    return distinct.mapInArrow(run, ALIGNED)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(a, b, count, best) of every linked pair: its links in the whole corpus, and whether no pair of its b has more."""
    links = texts.select("copies", F.inline("pairs"))
    counted = links.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("copies")).alias("count"))
    counted = written(counted, "pair-counts")
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return counted.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def measured(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per distinct text with all its measures."""
    links = texts.select("digest", F.inline("pairs")).join(F.broadcast(pairs), ["a", "b"])
    sums = links.groupBy("digest").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    whole = texts.drop("pairs").join(sums, "digest", "left")
    return whole.na.fill(0, ["n_best", "count_sum"])


def alignment(docs: DataFrame, vocabulary: ByteVocabulary, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    texts = written(aligned_texts(docs, vocabulary, pieces, text), "aligned-texts")
    measures = written(measured(texts, pair_counts(texts)), "text-measures")
    rows = docs.select(F.col(f"`{key}`").alias(key), text_digest(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"))
    total = measures.agg(F.sum("copies")).first()[0] or 0
    out = [*MEASURES, "groups_sha256"]
    hot = measures.where(F.col("copies") > HOT_SHARE * total).select("digest", *out)
    others = measures.where(F.col("copies") <= HOT_SHARE * total).select("digest", *out)
    # Either join drops the rows of the other one.
    return rows.join(F.broadcast(hot), "digest").unionByName(rows.join(others, "digest")).select(key, *out)
