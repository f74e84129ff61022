"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

The leaves of a tree stand for the byte positions of one piece. A live token's leaf holds the rank
of merging it with its right neighbour, the root the leftmost smallest rank. A merge changes the
leaves of the token, of its left neighbour and of the token that goes, each in as many steps as the
tree is high. Short pieces of one tree size are worked on side by side in numpy arrays, long ones
in lists.

Defined results: null and empty texts have no ids and decode to no bytes (null ids give null); lone
surrogates can't be in a Spark string; special tokens are ordinary text; repeated rows are encoded
one by one; an empty table gives an empty result; extra columns are ignored; texts of any length are
encoded whole. No shuffle is used; the words that a task remembers are bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lorekeep.llm.common import slices, table
from lorekeep.llm.segments import Words

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NONE = np.iinfo(np.int32).max
#: Larger trees are worked on one by one.
SIDE_BY_SIDE = 256
#: Leaves that are worked on side by side: few enough to stay in a core's cache.
LEAVES = 1 << 16
#: Words that a task remembers, about.
REMEMBERED = 400_000


class Pairs:
    """Ranks of pairs of ids, looked up in bulk: open addressing in flat arrays."""

    def __init__(self, pairs: dict[int, int]) -> None:
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.vals = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, vals = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = np.nonzero(self.keys[at] < 0)[0]
            taken, first = np.unique(at[free], return_index=True)
            self.keys[taken], self.vals[taken] = keys[free[first]], vals[free[first]]
            left = self.keys[at] != keys
            keys, vals, at = keys[left], vals[left], (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, -1 for pairs that don't merge."""
        key = a.astype(np.int64) << 24 | b
        at = self._slot(key)
        found = self.keys[at]
        rank = np.where(found == key, self.vals[at], np.int32(-1))
        todo = np.nonzero((found != key) & (found >= 0))
        while len(todo[0]):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            rank[tuple(t[hit] for t in todo)] = self.vals[at[todo]][hit]
            todo = tuple(t[~hit & (found >= 0)] for t in todo)
        return rank


class Bpe:
    """Ranks are ids. Encodes pieces; a piece that is a token as a whole is that token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self.pairs = pairs
        self._rank = Pairs(pairs)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, little-endian unsigned 32-bit."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        ranks = self.ranks
        for i, p in enumerate(pieces):
            if (r := ranks.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif p:
                by_size.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for size, rows in by_size.items():
            if size > SIDE_BY_SIDE:
                for i in rows:
                    out[i] = self._one(pieces[i], size)
                continue
            step = LEAVES // size
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._many([pieces[i] for i in part], size)):
                    out[i] = ids
        return out

    def _many(self, pieces: list[bytes], size: int) -> list[bytes]:
        n, bits = len(pieces), size.bit_length() - 1
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(n, size)
        lens = np.fromiter(map(len, pieces), np.int32, n)
        place = np.arange(size, dtype=np.int32)
        tok = np.full((n, size + 1), -1, np.int32)
        tok[:, :size] = np.where(place < lens[:, None], self.byte[raw], -1)
        nxt = np.minimum(np.broadcast_to(place + 1, (n, size)), lens[:, None])
        prv = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE, np.int32)  # ranks have 24 bits at most, places 8 minus
        rank = self._rank(tok[:, : size - 1], tok[:, 1:size])
        ok = (rank >= 0) & (place[1:] < lens[:, None])
        tree[:, size : 2 * size - 1] = np.where(ok, rank << bits | place[:-1], NONE)
        for lo in (size >> k for k in range(1, bits + 1)):
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        flat = tree.ravel()

        def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            base, at = r * (2 * size), leaf + size
            flat[base + at] = value
            for _ in range(bits):
                at = at >> 1
                two = base + 2 * at
                flat[base + at] = np.minimum(flat[two], flat[two + 1])

        live = np.nonzero(tree[:, 1] != NONE)[0]
        while len(live):
            best = tree[live, 1]
            at, new = best & (size - 1), best >> bits
            gone = nxt[live, at]
            after = nxt[live, gone]
            tok[live, at] = new
            tok[live, gone] = -1
            nxt[live, at] = after
            has = after < lens[live]
            prv[live[has], after[has]] = at[has]
            put(live, gone, NONE)
            right = np.where(has, self._rank(new, np.where(has, tok[live, after], 0)), -1)
            put(live, at, np.where(right >= 0, right << bits | at, NONE))
            before = prv[live, at]
            has = before >= 0
            rows, left = live[has], before[has]
            rank = self._rank(tok[rows, left], new[has])
            put(rows, left, np.where(rank >= 0, rank << bits | left, NONE))
            live = live[tree[live, 1] != NONE]
        tok = tok[:, :size]
        used = tok >= 0
        blob, ends = tok[used].astype("<u4").tobytes(), (4 * np.cumsum(used.sum(1))).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends)]

    def _one(self, piece: bytes, size: int) -> bytes:
        bits, n = size.bit_length() - 1, len(piece)
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv, none, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), int(NONE), self.pairs
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := pairs.get(tok[i] << 24 | tok[i + 1])) is not None:
                tree[size + i] = r << bits | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            at = leaf + size
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                tree[at] = a if a < b else b

        while (best := tree[1]) != none:
            at, new = best & (size - 1), best >> bits
            gone = nxt[at]
            after, before = nxt[gone], prv[at]
            tok[at], tok[gone], nxt[at] = new, -1, after
            put(gone, none)
            right = None
            if after < n:
                prv[after] = at
                right = pairs.get(new << 24 | tok[after])
            put(at, none if right is None else right << bits | at)
            if before >= 0:
                left = pairs.get(tok[before] << 24 | new)
                put(before, none if left is None else left << bits | before)
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    pattern, model = regex.compile(public_tokenizers.PATTERN), bpe(path)

    def encode(heads: list[str], segments: list[str]) -> tuple[list[bytes], list[bytes]]:
        whole = [s for s in segments if s[:1] == " " and s[1:].isalpha()]  # letters are one piece
        split = {s: pattern.findall(s) for s in (*heads, *segments) if not (s[:1] == " " and s[1:].isalpha())}
        pieces = list({*whole, *(p for ps in split.values() for p in ps)})
        ids = dict(zip(pieces, model.encode([p.encode() for p in pieces])))
        got = [b"".join([ids[p] for p in split[s]]) if s in split else ids[s] for s in (*heads, *segments)]
        return got[: len(heads)], got[len(heads) :]

    return Words(encode, REMEMBERED)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, little-endian unsigned 32-bit."""
    return [np.frombuffer(b"".join(x), "<u4") for x in _words(path)(texts)]


def with_ids(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` and a column of token ids."""

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [x for part in slices(texts) for x in encode_texts(part, path)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)))

    return docs.withColumn(out, arrow_udf(ids, "array<int>")(F.col(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """`docs` and the bytes that a column of ids stands for. Null ids give null."""

    def back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = bpe(path)
        for rows in batches:
            yield pa.array([None if r is None else model.decode(r) for r in rows.to_pylist()], pa.binary())

    return docs.withColumn(out, arrow_udf(back, "binary")(F.col(ids)))


def op7_segment_tree_bpe(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)

    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = bpe(path)
        number = [b"%d" % i for i in range(len(model.tokens))]
        for texts in batches:
            rows = []
            for part in slices(texts):
                for x in encode_texts(part, path):
                    ids = x.tolist()
                    rows.append((len(ids), hashlib.sha256(b",".join(map(number.__getitem__, ids))).hexdigest(), hashlib.sha256(model.decode(ids)).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", arrow_udf(digest, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")("text").alias("d")).select("doc_id", "d.*")
