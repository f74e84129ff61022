"""Texts as segments that a tokenizer can encode one by one, with a bounded memory of segments.

Byte-level pre-tokenizers never put a boundary inside a run of white space that ends before a word
in another place because of what stands earlier, so a text falls apart before each space or line
end that follows a character that is not white space. Marks that end a segment after a letter or
digit are a piece of their own. A text in which white space meets white space is handed over whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa

_MEETS = re.compile(r"\s[\x20\n]")
_MARKS = ".,;:!?"


class Words:
    """Encodes lists of texts through `encode(heads, segments)`; values of segments must add up.

    A head has nothing before it. A segment is a space or a line end and what follows it. About
    `limit` segments are remembered, in two generations: what is met again moves to the younger."""

    def __init__(self, encode: Callable[[list[str], list[str]], tuple[list[Any], list[Any]]], limit: int = 200_000, longest: int = 64) -> None:
        self.encode, self.limit, self.longest = encode, limit, longest
        self.known: dict[str, Any] = {}
        self.older: dict[str, Any] = {}

    def __call__(self, texts: list[str]) -> list[list[Any]]:
        if 2 * len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        heads: list[str] = []
        parts: list[list[str]] = []
        for t in texts:
            if _MEETS.search(t):
                heads.append(t)
                parts.append([])
            else:
                head, *words = t.replace("\n", " \n").split(" ")
                heads.append(head)
                parts.append(words)
        new = [w for w in set().union(*parts) if w not in known]
        known.update([(w, older[w]) for w in new if w in older])
        new = [w for w in new if w not in known]
        cut: list[tuple[str, str, str]] = []
        ask: dict[str, None] = {}
        for w in new:
            if w[-1:] not in _MARKS:
                ask[w] = None
                continue
            base = w.rstrip(_MARKS)
            if base and base[-1].isalpha():
                cut.append((w, base, w[len(base) :]))
                if base in older:
                    known[base] = older[base]
                elif base not in known:
                    ask[base] = None
            else:
                ask[w] = None
        marks = list({m for _, _, m in cut})
        asked = list(ask)
        alone, got = self.encode([*heads, *marks], [w if w[:1] == "\n" else f" {w}" for w in asked])
        known.update(zip(asked, got))
        tails = dict(zip(marks, alone[len(heads) :]))
        known.update((w, known[base] + tails[m]) for w, base, m in cut)
        out = [[h, *map(known.__getitem__, p)] for h, p in zip(alone, parts)]
        for w in new:
            if len(w) > self.longest:
                del known[w]
        return out


#: Bytes that end a character which is not white space, and pairs of bytes that may end one that is (or another).
_SOLID = np.array([33 <= b <= 126 or b >= 128 for b in range(256)])
_LAST = np.isin(np.arange(256), [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F])
_BEFORE = np.isin(np.arange(256), [0xC2, 0x9A, 0x80, 0x81])


def _solid(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether surely no white space stands before each place."""
    last = raw[at - 1]
    return _SOLID[last] & ~(_LAST[last] & _BEFORE[raw[at - 2]])


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words and where each begins, then where the last ends."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32 if words.type == pa.binary() else np.int64)[words.offset : words.offset + len(words) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at.astype(np.int64) - at[0]


class Joined:
    """Encodes lists of texts: their different segments are encoded as one text, and the ids of each are told by the
    bytes that its tokens stand for. A segment begins where a space or a line end follows what is not white space.
    Nothing is remembered from one list to the next."""

    def __init__(self, model: Any, ranks: dict[bytes, int]) -> None:
        """A tiktoken encoding without special tokens; ids are below 65,536."""
        self.model = model
        self.size = np.zeros(max(ranks.values()) + 1, np.int32)
        self.size[list(ranks.values())] = list(map(len, ranks))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 16-bit."""
        blobs = [t.encode() for t in texts]
        ends = np.cumsum([0, *map(len, blobs)])
        joined = b"".join(blobs)
        del blobs
        if not joined:
            return [b""] * len(texts)
        raw = np.frombuffer(joined, np.uint8)
        at = np.flatnonzero((raw == 32) | (raw == 10))
        begins = np.zeros(len(raw) + 1, bool)
        begins[at[_solid(raw, at)]] = True
        begins[ends] = True
        begins = np.flatnonzero(begins)
        kind, offsets = (pa.binary(), np.int32) if len(raw) < 1 << 31 else (pa.large_binary(), np.int64)
        coded = pa.Array.from_buffers(kind, len(begins) - 1, [None, pa.py_buffer(begins.astype(offsets)), pa.py_buffer(joined)]).dictionary_encode()
        first, n, ids = self._words(coded.dictionary)
        code = coded.indices.to_numpy()
        n, first = n[code], first[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        found = ids[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        cuts = (2 * upto[np.searchsorted(begins, ends)]).tolist()
        return [found[a:b] for a, b in zip(cuts, cuts[1:])]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each segment begin, how many they are, and all ids."""
        raw, ends = _flat(words)
        begin = raw[ends[:-1]]
        inner = ((begin == 32) | (begin == 10)) & _solid(raw, ends[1:])  # the others stand at a text's beginning or end
        first, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        text, bounds = _flat(words.filter(pa.array(inner)))
        ids = np.array(self.model.encode_ordinary(text.tobytes().decode()), "<u2")
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        cuts = np.searchsorted(upto, bounds)
        if (upto[cuts] != bounds).any():
            raise ValueError("a token spans two segments")
        first[inner], n[inner] = cuts[:-1], np.diff(cuts)
        parts, total = [ids], len(ids)
        for i in np.flatnonzero(~inner).tolist():
            parts.append(np.array(self.model.encode_ordinary(words[i].as_py().decode()), "<u2"))
            first[i], n[i] = total, len(parts[-1])
            total += len(parts[-1])
        return first, n, np.concatenate(parts)
