"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are near when one edit (a character put in, taken out or replaced) turns one into the
other after trimming and lower-casing. A line goes when an earlier line of the corpus is equal or
near; earlier is by doc_id, then the text's hash, then the line's number. Blank lines stay; all
others are compared, however short (`min_chars` leaves shorter ones alone for callers who want that).

All variants with one character deleted would be as many rows as the corpus has characters, so the
neighbourhood is built where the edit can be. Cut both lines of a near pair at the same places:
the edit lies in one segment and the rest of the lines is equal. Keys of "the line without this
segment" (two halves first, then eight parts of the half, and so on while a segment is longer than
`LONG`) find lines that share all but one short segment; only there are variants with one deleted
character emitted as hashed keys. This loses no pair, and the work on a line follows its length. Variants
that replace at the same place are all near one another, so each is compared with the earliest only;
a shorter line and the longer ones around it form a star. Nothing lists all pairs of a group. Candidates are verified by edit distance on whole lines.

Equal lines are aggregated before any of this. A line that holds more than a thousandth of all
lines of that length is joined by broadcast (at most a thousand such lines exist), all others by shuffle.

Hashes and places of all lines are written once and read by what needs no text.

Defined results: null text stays null, an empty one stays empty; rows equal in doc_id and text are
one document and share its fate; null ids come first; an empty table gives an empty result; extra
columns pass through. Lines of any length are compared whole. The edit bound is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, cut, row_key, table, written

MIN_CHARS = 1
HOT_SHARE = 1000
#: Parts of a half line, and of longer segments, in which an edit is looked for.
PARTS = 8
#: Segments up to this length have all their variants emitted.
LONG = 2048
#: Different lines that share a half with another, up to which their hashes are broadcast.
FEW = 500_000


def normalised(line: Column) -> Column:
    return F.lower(F.trim(line))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Every line of `min_chars` or more: its document's key, number, normal form and hashes."""
    d = docs.select(*row_key(), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    d = d.select("__lk_id", "__lk_th", "no", normalised(F.col("raw")).alias("line")).where(F.length("line") >= min_chars)
    return d.select(F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(7)).alias("h2"), F.struct("__lk_id", "__lk_th", "no").alias("pos"), "line")


def _segments(rows: DataFrame, parts: int, carried: list[str]) -> DataFrame:
    """Rows (k, seg, m) -> rows for each way to leave out one of `parts` segments.

    m is the length of the shorter line of a pair inside `seg`, so seg has m or m + 1 characters;
    places are counted from the left before the segment and from the right after it."""
    i = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    d = rows.select(*carried, "k", "seg", "m", i.alias("i"))
    a, b = F.floor(F.col("m") * F.col("i") / parts).cast("int"), F.floor(F.col("m") * (F.col("i") + 1) / parts).cast("int")
    d = d.withColumns({"a": a, "after": F.col("m") - b, "n": F.length("seg")})
    rest = F.concat(F.substr("seg", F.lit(1), F.col("a")), F.lit("\n"), F.substr("seg", F.col("n") - F.col("after") + 1, F.col("after")))
    return d.select(*carried, F.xxhash64("k", "i", "m", rest).alias("k"), F.substr("seg", F.col("a") + 1, F.col("n") - F.col("after") - F.col("a")).alias("seg"), (F.col("m") - F.col("after") - F.col("a")).alias("m"))


def _shared(rows: DataFrame) -> DataFrame:
    """The keys that two different lines have."""
    return rows.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("k")


def near_pairs(occurrences: DataFrame) -> DataFrame:
    """(h1, h2): the distinct lines that have an earlier line near them, of rows h1, h2, pos, line."""
    lengths = F.explode(F.array(F.length("line"), F.length("line") - 1))
    # hashes alone tell which lines share a half; they are few bytes beside the lines
    halves = lambda m: [F.xxhash64(m, F.lit(0), F.substr("line", F.lit(1), F.floor(m / 2).cast("int"))), F.xxhash64(m, F.lit(1), F.right(F.col("line"), m - F.floor(m / 2).cast("int")))]
    four = dict(zip(("k0", "k1", "k2", "k3"), halves(F.length("line")) + halves(F.length("line") - 1)))
    keys = occurrences.select("h1", "h2", *[k.alias(c) for c, k in four.items()]).distinct().select("h1", "h2", F.explode(F.array(*four)).alias("k"))
    found = keys.join(_shared(keys), "k").select(F.col("h1").alias("g1"), F.col("h2").alias("g2")).distinct()
    found, same = cut(found), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    # while they are few, the others' texts drop out where they are read; else each text is shuffled once
    some = bounded(found, FEW)
    few = occurrences.join(some, same, "left_semi") if some is not found else occurrences
    lines = few.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.first("line").alias("line"))
    lines = cut(lines.join(found, same).drop("g1", "g2") if some is found else lines)
    again = _segments(lines.select("h1", "h2", "pos", F.lit(0).alias("k"), F.col("line").alias("seg"), lengths.alias("m")), 2, ["h1", "h2", "pos"])
    first = again.join(_shared(again), "k")
    second = cut(_segments(first, PARTS, ["h1", "h2", "pos"]))
    shared = second.join(_shared(second), "k")
    size = (lines.agg(F.max(F.length("line"))).first()[0] or 0) / (2 * PARTS)
    while size > LONG:  # only the long segments go on
        shared = cut(shared)
        deeper = _segments(shared.where(F.length("seg") > LONG).select("h1", "h2", "pos", "k", "seg", "m"), PARTS, ["h1", "h2", "pos"])
        shared = shared.where(F.length("seg") <= LONG).select("h1", "h2", "pos", "k", "seg", "m").unionByName(deeper.join(_shared(deeper), "k").select("h1", "h2", "pos", "k", "seg", "m"))
        size = size / PARTS
    leaf = shared.select("h1", "h2", "pos", "k", "seg", (F.length("seg") > F.col("m")).alias("longer"))

    places = F.sequence(F.lit(1), F.length("seg"))
    without = lambda p: F.concat(F.substr("seg", F.lit(1), p - 1), F.substr("seg", p + 1, F.length("seg")))
    none = F.array().cast("array<bigint>")
    replaced = F.when(~F.col("longer") & (F.length("seg") > 0), F.transform(places, lambda p: F.xxhash64("k", F.lit("r"), p, without(p)))).otherwise(none)
    shorter = F.when(F.col("longer"), F.array_distinct(F.transform(places, lambda p: F.xxhash64("k", F.lit("d"), without(p))))).otherwise(F.array(F.xxhash64("k", F.lit("d"), F.col("seg"))))
    role = lambda v, r: F.transform(v, lambda x: F.struct(x.alias("v"), r.alias("role")))
    keys = F.concat(role(replaced, F.lit(0)), role(shorter, F.when(F.col("longer"), F.lit(2)).otherwise(F.lit(1))))
    variants = leaf.select(F.struct("pos", "h1", "h2").alias("at"), F.explode(keys).alias("x")).select("at", "x.v", "x.role")
    least = variants.groupBy("v").agg(*[F.min(F.when(F.col("role") == r, F.col("at"))).alias(f"r{r}") for r in range(3)], F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    pairs = variants.join(least, "v").select("at", other.alias("early")).where("early.pos < at.pos")
    pairs = pairs.select("at.h1", "at.h2", F.col("early.h1").alias("e1"), F.col("early.h2").alias("e2")).distinct()
    text = lambda a, b, name: lines.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("line").alias(name))
    pairs = pairs.join(text("h1", "h2", "late"), ["h1", "h2"]).join(text("e1", "e2", "early"), ["e1", "e2"])
    return cut(pairs.where(F.levenshtein("late", "early", 1) >= 0).select("h1", "h2").distinct())


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__lk_id, __lk_th, dropped): the numbers, from 0, of the lines that go, by document."""
    occurrences = _lines(docs, min_chars)
    hashes = written(occurrences.select("h1", "h2", "pos"), "lines")
    near = near_pairs(occurrences)
    total = hashes.count()
    fate = hashes.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.count("*").alias("times")).join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    fate = cut(fate.where("near OR times > 1").select("h1", "h2", F.col("pos").alias("first"), F.coalesce("near", F.lit(False)).alias("near"), "times"))
    hot = fate.where(F.col("times") > total / HOT_SHARE)  # fewer than HOT_SHARE lines
    goes = F.col("near") | (F.col("pos") != F.col("first"))
    few = hashes.select("h1", "h2", "pos")
    by_hot = few.join(F.broadcast(hot), ["h1", "h2"]).where(goes).select("pos")
    rest = few.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(fate.where(F.col("times") <= total / HOT_SHARE), ["h1", "h2"]).where(goes).select("pos")
    return by_hot.unionByName(rest).groupBy("pos.__lk_id", "pos.__lk_th").agg(F.array_sort(F.collect_set("pos.no")).alias("dropped"))


def _with_dropped(docs: DataFrame, min_chars: int) -> DataFrame:
    """`docs` with keys and the array of dropped line numbers (null: none)."""
    found = dropped_lines(docs, min_chars).withColumnsRenamed({"__lk_id": "__lk_i2", "__lk_th": "__lk_t2", "dropped": "__lk_dropped"})
    keyed = docs.select("*", *row_key())
    return keyed.join(found, F.col("__lk_id").eqNullSafe(F.col("__lk_i2")) & (F.col("__lk_th") == F.col("__lk_t2")), "left")


def _without(lines: Column, dropped: Column) -> Column:
    """The lines but those of the numbers in `dropped` (in order), as the stretches between them."""
    between = lambda x: F.zip_with(F.concat(F.array(F.lit(-1)), dropped), F.concat(dropped, F.array(F.size(x))), lambda a, b: F.slice(x, a + 2, b - a - 1))
    return F.get(F.transform(F.array(lines), lambda x: F.flatten(between(x))), 0)  # the lines as a variable: split once


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the lines that go; documents that lose all their words go too."""
    d = _with_dropped(docs, min_chars)
    new = F.when(F.col("__lk_dropped").isNull(), F.col("text")).otherwise(F.array_join(_without(F.split("text", "\n"), F.col("__lk_dropped")), "\n"))
    d = d.withColumn("__lk_new", new).where(F.col("__lk_dropped").isNull() | F.col("__lk_new").rlike(r"[^\x20\x09-\x0D]"))
    swap = {"text": F.col("__lk_new")}
    if "n_chars" in docs.columns:
        swap["n_chars"] = F.when(F.col("__lk_dropped").isNull(), F.col("n_chars")).otherwise(F.length("__lk_new")).cast(docs.schema["n_chars"].dataType)
    return d.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in docs.columns])


def op5_near_lines(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the numbers of the dropped lines as text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dropped_lines(docs).withColumnsRenamed({"__lk_id": "__lk_i2", "__lk_th": "__lk_t2"})
    keyed = docs.select(*row_key(), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    d = keyed.join(found, F.col("__lk_id").eqNullSafe(F.col("__lk_i2")) & (F.col("__lk_th") == F.col("__lk_t2")), "left")
    return d.select(F.col("__lk_id").alias("doc_id"), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"))


#: Lines, exact repeats and near repeats by brute force over lines that share a half (one edit in characters; levenshtein() counts bytes).
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS no, lower(trim(unnest(l), ' ')) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
written AS (SELECT * FROM lines WHERE length(line) >= 1),
uniq AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS pos, length(line) AS n FROM written GROUP BY line),
keys AS (
  SELECT line, pos, n, m, side, CASE WHEN side = 0 THEN left(line, m // 2) ELSE right(line, m - m // 2) END AS k
  FROM uniq, (SELECT unnest([0, 1]) AS side), LATERAL (SELECT unnest([n, n - 1]) AS m)),
near AS (
  SELECT DISTINCT a.line FROM keys a JOIN keys b ON a.m = b.m AND a.side = b.side AND a.k = b.k AND a.line <> b.line AND b.pos < a.pos
  WHERE CASE WHEN a.n = b.n THEN len(list_filter(generate_series(1, a.n), lambda i: substring(a.line, i, 1) <> substring(b.line, i, 1))) = 1
    WHEN a.n = b.n + 1 THEN len(list_filter(generate_series(1, a.n), lambda i: concat(left(a.line, i - 1), substring(a.line, i + 1)) = b.line)) > 0
    WHEN b.n = a.n + 1 THEN len(list_filter(generate_series(1, b.n), lambda i: concat(left(b.line, i - 1), substring(b.line, i + 1)) = a.line)) > 0 ELSE false END),
gone AS (
  SELECT l.doc_id, l.no FROM written l JOIN uniq u ON l.line = u.line
  WHERE struct_pack(d := l.doc_id, n := l.no) <> u.pos OR l.line IN (SELECT line FROM near))
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, count(g.no)::BIGINT AS n_dropped,
       coalesce(string_agg(g.no::VARCHAR, ',' ORDER BY g.no), '') AS dropped
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id GROUP BY d.doc_id, d.text
"""
