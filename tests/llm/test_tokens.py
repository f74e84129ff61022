"""BPE, packing and unigram counts against the tokenizer libraries; exact round trips."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from lorekeep.llm import byte_bpe, curve_packing, token_counts

LETTERS = list("aab'stre lled., .,!? \n\t\x0b\x1c\x85\xa0 　ñÉ漢字١٢3🙂́‍▁")


def texts(n=600):
    rng = random.Random(1)
    made = ["".join(rng.choices(LETTERS, k=rng.randint(0, 60))) for _ in range(n)]
    return [*made, "", "  ", "a" * 3000, "ab" * 2000 + "!" * 300, "<|endoftext|> a<|endoftext|>.", "the cat, sat. on\nthe mat!"]


def test_segment_tree_gives_the_library_s_ids():
    path = P.path(byte_bpe.VOCABULARY)
    model = byte_bpe.bpe(path)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    some = texts()
    got = byte_bpe.encode_texts(some, path)
    assert [g.tolist() for g in got] == [own.encode_ordinary(t) for t in some]
    assert [model.decode(g.tolist()).decode() for g in got] == some


def test_packing_s_ids_are_those_of_tokenizers():
    path = P.path(curve_packing.VOCABULARY)
    model = Tokenizer.from_file(path)
    some = [*texts(), "a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|><|endoftext|> "]
    got = [np.frombuffer(x, "<u2").tolist() for x in curve_packing.encode_texts(some, path)]
    assert got[-3] == [64, 220, 50256, 275]
    assert got == [e.ids for e in model.encode_batch(some, add_special_tokens=False)]
    assert curve_packing.byte_ranks(path)[b"a"] == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}[b"a"]


def test_packing_encodes_the_different_words_of_texts_together(monkeypatch):
    """One call for all words inside the texts and one for each text's beginning or blank end, whatever the words."""
    path, asked, real = P.path(curve_packing.VOCABULARY), [], tiktoken.Encoding.encode_ordinary
    curve_packing.encode_texts(["warm"], path)
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, t: asked.append(t) or real(self, t))
    rng = random.Random(2)
    some = [" ".join("".join(rng.choices("abcdé漢", k=9)) for _ in range(400)) + end for end in ("", " ", "\n\u3000 ", " \u2003\n", "\x85 \n")]
    got = [np.frombuffer(x, "<u2").tolist() for x in curve_packing.encode_texts(some, path)]
    assert len(asked) <= 1 + 2 * len(some)
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def test_counts_follow_the_library_s_tie_rules():
    pieces = token_counts.vocabulary(P.path(token_counts.VOCABULARY))
    tied = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("aba", -3.0)]
    for vocabulary, fallback in ((pieces, True), (tied, False)):
        model = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        model.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        own = token_counts.Counter(vocabulary)
        for t in [*texts(300), "abab ba aab", "xabx xx"]:
            assert own.text(t) == len(model.encode(t, add_special_tokens=False).ids), t


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(curve_packing.hilbert_index(grid, 3))]
    assert len(set(curve_packing.hilbert_index(grid, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_pieces_fill_sequences(spark, sf_dir):
    path = P.path(curve_packing.VOCABULARY)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = curve_packing.pack(docs, path).toPandas()
    full = p.groupby("sequence_id").length.sum().sort_index()
    assert (full.iloc[: (full == 2048).sum()] == 2048).all() and all(n & (n - 1) == 0 for n in full)
    p = p.sort_values(["sequence_id", "offset"])
    assert (p.offset == p.groupby("sequence_id").length.cumsum() - p.length).all()
    model = Tokenizer.from_file(path)
    ids = {r["doc_id"]: np.array([*model.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    for r in p.itertuples():
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tobytes() and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert p.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
