"""Byte-level BPE encoding in batched merge rounds, and decoding.

A round works on many words at once: their symbols lie in one flat array, neighbouring pairs are looked up by
binary search among sorted pair keys, and every word merges its pair of lowest rank wherever it stands.
Words without a known pair leave the array. Words met before come from a bounded memory.

NULL and empty texts have no tokens and decode to the empty text. Texts of any length are encoded whole. An
added token's own text inside a document is that token, as in the tokenizers library.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import regex
from pyspark.sql import DataFrame

from lotwise.llm.corpus import BINARY, LONG, STRING, with_text_columns
from lotwise.llm.vocabulary import ByteVocabulary

# Fixed value: the pattern that cuts text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Words remembered by a worker, and the text bytes it cuts into words at a time.
REMEMBERED = 150_000
BATCH_BYTES = 2 << 20
NEVER = np.iinfo(np.int64).max


class Encoder:
    """Words to ids and back for one vocabulary."""

    def __init__(self, vocabulary: ByteVocabulary) -> None:
        self.tokens = vocabulary.tokens
        by_bytes = {t: i for i, t in enumerate(vocabulary.tokens)}
        self.of_byte = np.array([by_bytes[bytes([b])] for b in range(256)], np.int64)
        pairs = np.array(vocabulary.merges, np.int64).reshape(-1, 2)
        merged = [by_bytes[vocabulary.tokens[a] + vocabulary.tokens[b]] for a, b in vocabulary.merges]
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        # One key beyond all real ones keeps the search in bounds and merges hold for an empty list.
        self.keys = np.append(keys[order], NEVER)
        self.ranks = np.append(order, NEVER)
        self.merged = np.append(np.array(merged, np.int64)[order], -1)
        self.words = regex.compile(PATTERN)
        self.added = vocabulary.added
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.memory: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of non-empty words, packed as little-endian unsigned 32-bit integers."""
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols, owners = [], []
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            place = np.searchsorted(self.keys, key)
            known = (self.keys[place] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, self.ranks[place], NEVER), NEVER)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
            over = least == NEVER
            symbols.append(symbol[over])
            owners.append(owner[over])
            joins = np.flatnonzero((rank == least) & ~over)
            # A pair of equal symbols can overlap itself: every other one of such a run merges.
            run = np.maximum.accumulate(np.where(np.diff(joins, prepend=-2) > 1, joins, -1))
            joins = joins[(joins - run) % 2 == 0]
            symbol[joins] = self.merged[place[joins]]
            stays = ~over
            stays[joins + 1] = False
            symbol, owner = symbol[stays], owner[stays]
        if not symbols:
            return []
        symbol, owner = np.concatenate(symbols), np.concatenate(owners)
        packed = symbol[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def cut(self, text: str) -> list[str]:
        """The words of a text; added tokens stand alone."""
        if self.cuts is None or not (marks := list(self.cuts.finditer(text))):
            return self.words.findall(text)
        out, at = [], 0
        for mark in marks:
            out += self.words.findall(text[at : mark.start()])
            out.append(mark.group())
            at = mark.end()
        return out + self.words.findall(text[at:])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of whole texts."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        for word, i in self.added.items():
            memory[word] = np.array([i], "<u4").tobytes()
        cut = [self.cut(t.decode()) for t in texts]
        new = list(set().union(*cut).difference(memory)) if cut else []
        memory.update(zip(new, self.merge([w.encode() for w in new]), strict=True))
        return [b"".join(map(memory.__getitem__, words)) for words in cut]

    def decode(self, packed: list[bytes]) -> list[str]:
        """Texts of packed ids; broken UTF-8 gets replacement characters, unknown ids nothing."""
        tokens, end = self.tokens, len(self.tokens)
        out = []
        for p in packed:
            ids = np.frombuffer(p, "<u4")
            if len(ids) and ids.max() >= end:
                ids = ids[ids < end]
            out.append(b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace"))
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: ByteVocabulary) -> Encoder:
    """One encoder per worker process and vocabulary."""
    mark = sha256(repr((len(vocabulary.tokens), vocabulary.tokens, vocabulary.merges)).encode()).hexdigest()
    if mark not in _ENCODERS:
        _ENCODERS[mark] = Encoder(vocabulary)
    return _ENCODERS[mark]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` plus packed ids (little-endian unsigned 32-bit integers) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteVocabulary.read(path))

    def prepare():
        encoder = _encoder(shared.value)
        return lambda found: [encoder.encode(found)]

    return with_text_columns(docs, text, [(ids, *BINARY)], prepare, BATCH_BYTES)


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` plus the text of its packed ids."""
    shared = coded.sparkSession.sparkContext.broadcast(ByteVocabulary.read(path))

    def prepare():
        encoder = _encoder(shared.value)
        return lambda found: [encoder.decode(found)]

    return with_text_columns(coded, ids, [(text, *STRING)], prepare)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every document: encoded, then decoded from the ids alone.

    Both ways run in one pass, some texts at a time, and only digests leave it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ByteVocabulary.read(path))

    def prepare():
        encoder = _encoder(shared.value)

        def work(found: list[bytes]) -> list:
            packed = encoder.encode(found)
            decoded = encoder.decode(packed)
            return [
                [len(p) // 4 for p in packed],
                [sha256(p).hexdigest() for p in packed],
                [sha256(d.encode()).hexdigest() for d in decoded],
            ]

        return work

    fields = [("n_tokens", *LONG), ("ids_sha256", *STRING), ("decoded_sha256", *STRING)]
    return with_text_columns(docs.select(key, text), text, fields, prepare, BATCH_BYTES).select(key, *[f[0] for f in fields])
