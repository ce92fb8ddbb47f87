"""Reading public byte-level tokenizer files; their path is always a parameter."""

from __future__ import annotations

import json
from dataclasses import dataclass


def byte_of_character() -> dict[str, int]:
    """Byte-level files write printable bytes as themselves and the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class ByteVocabulary:
    """Tokens by id as bytes, the merges in order as pairs of ids, and the added tokens' ids by text."""

    tokens: tuple[bytes, ...]
    merges: tuple[tuple[int, int], ...]
    added: dict[str, int]

    @classmethod
    def read(cls, path: str) -> ByteVocabulary:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        to_byte, model = byte_of_character(), told["model"]
        added = {t["content"]: t["id"] for t in told.get("added_tokens") or []}
        ids: dict[str, int] = model["vocab"]
        tokens = [b""] * (1 + max([*ids.values(), *added.values()]))
        for word, i in ids.items():
            tokens[i] = bytes(map(to_byte.__getitem__, word))
        for word, i in added.items():
            tokens[i] = word.encode()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return cls(tuple(tokens), tuple((ids[a], ids[b]) for a, b in pairs), added)
