"""Many words looked for in many texts at once.

One automaton of all words is built in each task and read once along each text, so the work follows
the texts' length and the hits, not the number of words. Words go to tasks in blocks of up to
`BLOCK_CHARS` characters; more words take more passes, never more memory.

Defined results: null texts hold nothing; null words are ignored; an empty word is in every text; words
found several times in a text are one row with their number (overlaps count)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the words that one automaton holds.
BLOCK_CHARS = 4_000_000


def _blocks(words: DataFrame, limit: int) -> Iterator[list[str]]:
    """The different words in blocks; the driver holds one block at a time."""
    d = words.where("word IS NOT NULL").select("word").distinct()
    chars = d.agg(F.sum(F.length("word") + 16)).first()[0] or 0
    count = max(1, -(-chars // limit))
    for i in range(count):
        yield [r["word"] for r in d.where(F.pmod(F.xxhash64("word"), F.lit(count)) == i).collect()]


def hits(texts: DataFrame, key: list[str], text: str, words: DataFrame, limit: int = BLOCK_CHARS) -> DataFrame:
    """(key ..., word, n): which of `words` (word) each text holds, and how often. Case counts."""
    source = texts.select(*key, F.coalesce(F.col(text), F.lit("")).alias("__text"), F.col(text).isNotNull().alias("__there"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[: len(key)])
    found = [source.mapInArrow(_search(block, key), f"{fields}, word string, n bigint") for block in _blocks(words, limit)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(words: list[str], key: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for w in words:
            if w:
                machine.add_word(w, w)
        machine.make_automaton()
        empty = "" in words
        for batch in batches:
            at, name, n = [], [], []
            texts, there = batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist()
            for i, (t, ok) in enumerate(zip(texts, there)):
                counts = Counter(w for _, w in machine.iter(t)) if len(machine) and ok else {}
                if empty and ok:
                    counts = {**counts, "": len(t) + 1}
                for w, c in counts.items():
                    at.append(i)
                    name.append(w)
                    n.append(c)
            keys = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(len(key))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(name, pa.string()), pa.array(n, pa.int64())], names=[*key, "word", "n"])

    return run
