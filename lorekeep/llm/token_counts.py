"""Token counts under a unigram vocabulary, without building the tokens.

Aho-Corasick enumerates the vocabulary's matches in a word; dynamic programming over end positions
carries the best score, its number of pieces and the run of unknown characters it ends in, so no
path is kept or walked back. Tie rules are those of the tokenizers library's
Unigram model behind a Metaspace pre-tokenizer: a candidate replaces the best path to an end only
with a strictly better score, candidates come by start from the left; a character that no piece
covers alone is an unknown of the least score minus 10; neighbouring unknowns fuse, and become
their bytes where the vocabulary has all of those.

Defined results: null and empty texts have no tokens; repeated rows are counted one by one; an empty
table gives an empty result; texts of any length are counted whole; extra columns are ignored. No shuffle is used; the words that a task remembers are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lorekeep.llm.common import slices, table

VOCABULARY = "piece_bpe_32k.model"
#: Stands for a space in pieces.
META = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], limit: int = 200_000) -> None:
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10.0
        names = {p for p, _ in pieces}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in names}
        self.known: dict[str, int] = {}
        self.limit = limit

    def word(self, word: str) -> int:
        """Tokens of one pre-token."""
        n = len(word)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        alone = [False] * n
        for end, (size, s) in self.auto.iter(word):
            matches[end].append((end + 1 - size, s))
            if size == 1:
                alone[end] = True
        # of the best path to each end: score, closed pieces, tokens of the unknown run it ends in if
        # that is spelt in bytes (0: no run), whether the vocabulary has those bytes
        score, count, run, spelt = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [True] * (n + 1)
        for end in range(1, n + 1):
            best, at, known = None, 0, True
            for begin, s in matches[end - 1]:  # the longest first, so starts go from the left
                new = score[begin] + s
                if best is None or new > best:
                    best, at = new, begin
            if not alone[end - 1]:
                new = score[end - 1] + self.unknown
                if best is None or new > best:
                    best, at, known = new, end - 1, False
            score[end] = best
            if known:
                count[end] = self._closed(count[at], run[at], spelt[at]) + 1
            else:
                raw = word[end - 1].encode()
                count[end], run[end], spelt[end] = count[at], run[at] + len(raw), spelt[at] and all(b in self.bytes for b in raw)
        return self._closed(count[n], run[n], spelt[n])

    @staticmethod
    def _closed(count: int, run: int, spelt: bool) -> int:
        """Pieces when the run of unknowns ends: its bytes, or one unknown."""
        return count + (run if spelt else 1) if run else count

    def text(self, text: str) -> int:
        """Tokens of a text: a mark stands before its first character and for each space, and each
        mark begins a pre-token."""
        if not text:
            return 0
        words = text.replace(META, " ").split(" ")
        if words[0] == "" and len(words) > 1:  # the text has its own mark at the front
            words = words[1:]
        known, total = self.known, 0
        for w in words:
            c = known.get(w)
            if c is None:
                c = self.word(META + w)
                if len(known) > self.limit:
                    known.clear()
                if len(w) <= 64:
                    known[w] = c
            total += c
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a column of whole texts."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = counter(path)
        for texts in batches:
            yield pa.array([model.text(t) for part in slices(texts) for t in part], pa.int64())

    return arrow_udf(count, "bigint")(text)


def op8_unigram_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_count(F.col("text"), public_tokenizers.path(VOCABULARY)).alias("n_tokens"))
