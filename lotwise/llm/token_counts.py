"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. A state without the next byte falls along its failure link, which says how many
pieces that settles, so every byte is looked at once and no piece is ever built. Words are walked side by side,
one byte position at a time; words met before come from a bounded memory.

Words are runs of anything but the six ASCII blanks. A word that the vocabulary cannot spell is one token.
NULL, empty and blank texts have no words and no tokens. Words and texts may have any length.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from lotwise.llm.corpus import LONG, with_text_columns
from lotwise.llm.vocabulary import ByteVocabulary

# Words remembered by a worker, the text bytes it cuts at a time, and how few words are walked one by one.
REMEMBERED = 500_000
BATCH_BYTES = 4 << 20
FEW = 48


@dataclass
class Automaton:
    """Trie with failure links. State 0 is the root; ``start`` stands before every word."""

    start: bytes
    keys: np.ndarray  # state * 256 + byte, sorted
    child: np.ndarray
    fail: np.ndarray  # -1: no way on
    pops: np.ndarray  # pieces settled by falling
    finish: np.ndarray  # pieces settled from here to the word's end; -1: not spelled
    memory: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def build(cls, pieces: Iterable[bytes], start: bytes) -> Automaton:
        """``pieces``: byte strings; the ones that begin a word begin with ``start``."""
        step: dict[int, int] = {}
        parent, byte, ends = [0], [0], [False]
        for piece in pieces:
            state = 0
            for b in piece:
                new = step.setdefault(state << 8 | b, len(parent))
                if new == len(parent):
                    parent.append(state)
                    byte.append(b)
                    ends.append(False)
                state = new
            if state:
                ends[state] = True
        size = len(parent)
        depth = np.zeros(size, np.int64)
        for s in range(1, size):  # a parent is always older than its child
            depth[s] = depth[parent[s]] + 1
        fail, pops, finish = [-1] * size, [0] * size, [0] + [-1] * (size - 1)
        for s in np.argsort(depth, kind="stable")[1:].tolist():
            if ends[s]:
                fail[s], pops[s] = 0, 1
            else:
                up, b = parent[s], byte[s]
                at, settled = fail[up], pops[up]
                while at >= 0 and (at << 8 | b) not in step:
                    at, settled = fail[at], settled + pops[at]
                if at >= 0:
                    fail[s], pops[s] = step[at << 8 | b], settled
            if fail[s] >= 0 and finish[fail[s]] >= 0:
                finish[s] = pops[s] + finish[fail[s]]
        keys = np.fromiter(step.keys(), np.int64, len(step))
        child = np.fromiter(step.values(), np.int64, len(step))
        order = np.argsort(keys)
        far = np.iinfo(np.int64).max
        return cls(start, np.append(keys[order], far), np.append(child[order], 0), np.array(fail), np.array(pops), np.array(finish))

    @classmethod
    def of_byte_vocabulary(cls, vocabulary: ByteVocabulary) -> Automaton:
        """A piece that begins a word begins with a blank; all others may follow."""
        special = set(vocabulary.added.values())
        return cls.build((t for i, t in enumerate(vocabulary.tokens) if t and i not in special), b" ")

    @classmethod
    def of_word_pieces(cls, pieces: Iterable[str], follows: str = "##") -> Automaton:
        """Pieces that follow another one carry a prefix, the others begin a word."""
        start = b"\xff"  # in no UTF-8 text
        return cls.build(
            (p[len(follows) :].encode() if p.startswith(follows) else start + p.encode() for p in pieces), start
        )

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word."""
        lengths = np.array([len(w) + len(self.start) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(self.start + words[i] for i in order), np.uint8).astype(np.int64)
        lengths = lengths[order]
        offset = np.cumsum(lengths) - lengths
        state, total, lost = (np.zeros(len(words), np.int64) for _ in range(3))
        # Long words of which few are left walk alone.
        common = int(lengths[FEW - 1]) if len(words) >= FEW else 0
        for position in range(common):
            active = int(np.searchsorted(-lengths, -position))  # longer than the position
            walking = np.flatnonzero(lost[:active] == 0)
            while len(walking):
                key = state[walking] << 8 | flat[offset[walking] + position]
                place = np.searchsorted(self.keys, key)
                found = self.keys[place] == key
                state[walking[found]] = self.child[place[found]]
                walking = walking[~found]
                at = state[walking]
                total[walking] += self.pops[at]
                state[walking] = self.fail[at]
                gone = walking[self.fail[at] < 0]
                lost[gone] = 1
                walking = walking[self.fail[at] >= 0]
        for w in np.flatnonzero(lengths > common).tolist():
            if not lost[w]:
                state[w], total[w] = self._walk(int(state[w]), int(total[w]), flat[offset[w] + common : offset[w] + lengths[w]].tolist())
                lost[w] = state[w] < 0
        last = self.finish[np.maximum(state, 0)]
        out = np.empty(len(words), np.int64)
        out[order] = np.where((lost > 0) | (last < 0), 1, total + last)
        return out

    def _walk(self, state: int, total: int, rest: list[int]) -> tuple[int, int]:
        if not hasattr(self, "_step"):
            self._step = dict(zip(self.keys[:-1].tolist(), self.child[:-1].tolist(), strict=True))
            self._fail, self._pops = self.fail.tolist(), self.pops.tolist()
        step, fail, pops = self._step, self._fail, self._pops
        for b in rest:
            while (new := step.get(state << 8 | b)) is None:
                total += pops[state]
                state = fail[state]
                if state < 0:
                    return -1, 0
            state = new
        return state, total

    def count_texts(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """Words and pieces of each text."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        cut = [t.split() for t in texts]  # on bytes: the six ASCII blanks
        new = list(set().union(*cut).difference(memory)) if cut else []
        if new:
            memory.update(zip(new, self.count(new).tolist(), strict=True))
        return [len(words) for words in cut], [sum(map(memory.__getitem__, words)) for words in cut]


def token_counts(docs: DataFrame, automaton: Automaton, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_words, n_tokens) of every document. The vocabulary bounds what is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def prepare():
        own = shared.value

        def work(found: list[bytes]) -> list:
            return [[len(t) for t in found], *own.count_texts(found)]

        return work

    fields = [("n_bytes", *LONG), ("n_words", *LONG), ("n_tokens", *LONG)]
    return with_text_columns(docs.select(key, text), text, fields, prepare, BATCH_BYTES).select(key, *[f[0] for f in fields])
