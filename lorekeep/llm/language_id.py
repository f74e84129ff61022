"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of slices of training texts. A text is
cut into blocks; every block is compressed with every dictionary and the language with the smallest
total wins. Where the best two are closer than `MARGIN`, the row is marked as rejected.

Training rows are a bounded sample: for each language about `SAMPLE` rows are chosen by the hash of
their id (2 * SAMPLE at most), and a dictionary holds at most `DICTIONARY` bytes of their slices.

Defined results: a null text or one without a letter is `und` with score 0; without any training
row all texts are `und`; ties go to the language with more training rows; repeated rows get equal results;
an empty table gives an empty result; whole texts of any length are read, one at a time; extra
columns are ignored. Nothing is shuffled but counts and the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lorekeep.llm.common import slices, table

UNDETERMINED = "und"
SAMPLE = 120
DICTIONARY = 112 * 1024
#: Bytes of a slice of a training text, and of a block that is compressed at once.
SLICE, BLOCK = 1500, 4096
LEVEL = 9
MARGIN = 0.01
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """What tells languages apart: lower-case letters, other runs as one space."""
    return _NO_LETTERS.sub(" ", text.lower())


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """Dictionary content of each language from (doc_id, text, lang), of a bounded sample."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    middle = F.greatest(F.lit(1), (F.length("text") - SLICE) / 2).cast("int")
    parts = chosen.select("doc_id", "lang", F.substring("text", middle, F.lit(SLICE)).alias("part"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "part"), "doc_id")
    rows = parts.withColumn("rn", F.row_number().over(by_hash)).where(F.col("rn") <= 2 * sample).collect()
    found: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rn"])):
        own, part = found.setdefault(r["lang"], []), letters(r["part"]).encode()
        if sum(map(len, own)) + len(own) + len(part) <= DICTIONARY:
            own.append(part)
    return {k: b"\n".join(found[k]) for k in sorted(found, key=lambda k: (-counts[k], k))}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keys: list[str], margin: float = MARGIN) -> DataFrame:
    """keys, lang_pred, score, rejected for each row's whole text."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = [(k, zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in dictionaries.items()]
        for _, d in made:
            d.precompute_compress(level=LEVEL)
        tools = [(k, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)) for k, d in made]
        for texts in batches:
            rows = []
            for part in slices(texts):
                for text in part:
                    if not tools or not _LETTER.search(text):
                        rows.append((UNDETERMINED, 0.0, True))
                        continue
                    raw = letters(text).encode()
                    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
                    sizes = sorted(((sum(len(t.compress(b)) for b in blocks), k) for k, t in tools), key=lambda x: x[0])
                    least, lang = sizes[0]
                    gap = (sizes[1][0] - least) / sizes[1][0] if len(sizes) > 1 else 1.0
                    rows.append((lang, gap, gap < margin))
            lang, score, rejected = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    d = docs.select(*keys, arrow_udf(predict, "struct<lang_pred:string,score:double,rejected:boolean>")("text").alias("__lk_p"))
    return d.select(*keys, "__lk_p.*")


def op6_zstd_languages(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), dictionaries, ["doc_id", "held_out"])
