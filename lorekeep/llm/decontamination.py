"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The corpus is written once as documents' words (`forward`), and from these as postings (term, row,
pos) of all terms that the benchmark has, sorted by term within each file, so a list is read by
skipping the others. Items are cut into windows of `WINDOW` words. The lists' lengths tell which
two terms of a window are the rarest in the corpus; a window with a term that the corpus lacks can't
occur. The rarest term's list, each place less the term's offset in the window, gives the places
where the window could begin; they are intersected with the second list, likewise adjusted, within
`SLOP` words: first lists are the shortest there are, second ones are met by row, term and a bin of
eight places, so no list is ever paired with a whole other one. What is left is checked on the words:
an exact match has all the window's words in order; a near match (proximity) has at least `SHARE` of its
different words in the stretch of the window and `SLOP` words around it.

Nothing is limited. Frames are broadcast only when they have been counted and are small
(`BROADCAST_ROWS`), else joined by shuffle.

Defined results: null and blank texts have no words and no hits; items without words have no
windows; an item without an id takes part under the empty name; items equal in all take part once,
equal ids with different texts are one item; rows are judged one by one, so repeated rows have equal
results; an empty table gives an empty result; texts of any length are read whole; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, cut, table, written
from lorekeep.llm.merkle import lowered

WINDOW = 10
#: How far the second rarest term may stand from its place, and the share of words, of a near match.
SLOP, SHARE = 3, 0.8
BIN = 8
BROADCAST_ROWS = 200_000
#: All that is no word character once A-Z are in lower case.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.coalesce(F.array_remove(F.split(lowered(text), _BETWEEN), ""), F.array().cast("array<string>"))


def term(word: Column | str) -> Column:
    return F.xxhash64(word)


def forward(docs: DataFrame) -> DataFrame:
    """(row, doc_id, words), written: a row's number is fixed from here on."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words")), "words")


def postings(corpus: DataFrame, terms: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(term, row, pos) of the given terms in the words of `corpus`, written in order of terms."""
    each = corpus.select("row", F.posexplode("words").alias("pos", "word")).select(term("word").alias("term"), "row", "pos")
    return written(each.join(bounded(terms, 10 * broadcast_rows), "term", "left_semi").sortWithinPartitions("term", "row", "pos"), "postings")


def windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, words): the different windows; (wid, item): which items have them."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    n = F.least(F.size("w"), F.lit(size))
    each = b.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i")).select("item", F.slice("w", F.col("i"), F.col("n")).alias("words"))
    each = cut(each.distinct())
    kinds = cut(each.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words"))
    return kinds, cut(each.join(kinds, "words").select("wid", "item"))


def rarest(kinds: DataFrame, index: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(wid, t0, o0, t1, o1): the two rarest terms of each window that can occur, with their offsets
    (t1 is null in a window of one word over and over). Ties go by the word."""
    counts = index.groupBy("term").agg(F.count("*").alias("n")) if counts is None else counts
    each = kinds.select("wid", F.posexplode("words").alias("o", "word")).groupBy("wid", "word").agg(F.min("o").alias("o"))
    each = each.withColumn("term", term("word")).join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("wid").orderBy("n", "word"))
    each = each.withColumn("place", place).where("place <= 2")
    of = lambda k, c: F.max(F.when(F.col("place") == k + 1, F.col(c))).alias(f"{c[0]}{k}")
    both = each.groupBy("wid").agg(F.min("n").alias("least"), *[of(k, c) for k in (0, 1) for c in ("term", "o")])
    return cut(both.where("least > 0").drop("least"))


def candidates(index: DataFrame, seeds: DataFrame, slop: int = SLOP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, at, wid): places where the lists of a window's rarest terms meet."""
    listed = lambda c: index.join(bounded(cut(seeds.where(f"{c} IS NOT NULL").select(F.col(c).alias("term")).distinct()), 10 * broadcast_rows), "term", "left_semi")
    first = index.join(bounded(seeds.withColumnRenamed("t0", "term"), broadcast_rows), "term")
    first = first.select("row", (F.col("pos") - F.col("o0")).alias("at"), "wid", "t1", "o1")
    due = F.col("at") + F.col("o1")
    bins = F.array_distinct(F.array(F.floor((due - slop) / BIN), F.floor((due + slop) / BIN)))
    pairs = first.where("t1 IS NOT NULL").select("row", "at", "wid", F.col("t1").alias("term"), due.alias("due"), F.explode(bins).alias("bin"))
    second = listed("t1").select(F.col("row").alias("r"), F.col("term").alias("t"), F.floor(F.col("pos") / BIN).alias("b"), "pos")
    met = (F.col("row") == F.col("r")) & (F.col("term") == F.col("t")) & (F.col("bin") == F.col("b")) & (F.abs(F.col("pos") - F.col("due")) <= slop)
    return pairs.join(second, met, "left_semi").select("row", "at", "wid").distinct().unionByName(first.where("t1 IS NULL").select("row", "at", "wid"))


def matches(corpus: DataFrame, kinds: DataFrame, found: DataFrame, slop: int = SLOP, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, exact, near): arrays of (at, n, wid) of each row that has matches, checked on its words."""
    by_row = found.join(bounded(kinds, broadcast_rows), "wid").groupBy("row").agg(F.collect_list(F.struct("at", F.size("words").alias("n"), "wid", "words")).alias("c"))
    by_row = cut(by_row)
    rows = corpus.select("row", "words").join(bounded(by_row, broadcast_rows // 10), "row")
    w = F.col("words")
    exact = lambda c: (c["at"] >= 0) & (F.slice(w, F.greatest(c["at"], F.lit(0)) + 1, c["n"]) == c["words"])
    begin = lambda c: F.greatest(c["at"] - slop, F.lit(0))
    stretch = lambda c: F.slice(w, begin(c) + 1, F.greatest(c["at"] + c["n"] + slop - begin(c), F.lit(0)))
    near = lambda c: (F.size(F.array_distinct(c["words"])) > 1) & (F.size(F.array_intersect(c["words"], stretch(c))) >= share * F.size(F.array_distinct(c["words"])))
    kind = rows.select("row", F.transform("c", lambda c: F.struct(c["at"].alias("at"), c["n"].alias("n"), c["wid"].alias("wid"), F.when(exact(c), 1).when(near(c), 2).alias("kind"))).alias("c"))
    of = lambda k: F.transform(F.filter("c", lambda c: c["kind"] == k), lambda c: F.struct(c["at"].alias("at"), c["n"].alias("n"), c["wid"].alias("wid")))
    return kind.select("row", of(1).alias("exact"), of(2).alias("near")).where("size(exact) + size(near) > 0")


def covered(spans: Column) -> Column:
    """How many places the spans (at, n, ...) cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["n"]).alias("end"), (a["total"] + F.greatest(s["at"] + s["n"] - F.greatest(a["end"], s["at"]), F.lit(0))).alias("total"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near: places of windows that
    match nearly but not exactly."""
    corpus = forward(docs)
    kinds, items = windows(benchmark, size)
    terms = cut(kinds.select(F.explode("words").alias("word")).select(term("word").alias("term")).distinct())
    index = postings(corpus, terms, broadcast_rows)
    seeds = rarest(kinds, index)
    found = cut(matches(corpus, kinds, candidates(index, seeds, slop, broadcast_rows), slop, share, broadcast_rows))
    named = found.select("row", F.explode(F.array_distinct(F.col("exact.wid"))).alias("wid")).join(bounded(items, broadcast_rows), "wid")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = found.select("row", covered(F.col("exact")).alias("n_hit"), F.size("near").cast("long").alias("n_near"))
    known = cut(spans.join(named, "row", "left"))
    rows = corpus.select("row", "doc_id", F.size("words").cast("long").alias("n_words")).join(bounded(known, broadcast_rows), "row", "left")
    zero = F.lit(0).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"),
    )


def op13_positional_index(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Windows at every place of every document by brute force, near ones from the places of the rarest words.
ORACLE = r"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, text, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w, row_number() OVER () AS r FROM documents),
bw AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
each AS MATERIALIZED (
  SELECT DISTINCT item, w[i:i + least(len(w), 10) - 1] AS x FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM bw WHERE len(w) > 0)),
kinds AS MATERIALIZED (SELECT x, array_to_string(x, ' ') AS k, len(x) AS n, len(list_distinct(x)) AS different FROM (SELECT DISTINCT x FROM each)),
sizes AS (SELECT DISTINCT n FROM kinds),
tokens AS MATERIALIZED (SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM dw),
stretches AS MATERIALIZED (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS x FROM tokens),
tried AS MATERIALIZED (SELECT r, p, n, array_to_string(x[:n], ' ') AS k FROM stretches CROSS JOIN sizes),
exact AS MATERIALIZED (
  SELECT t.r, t.p, t.n, t.k FROM tried t JOIN kinds k ON k.n = t.n AND k.k = t.k),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM exact) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM exact JOIN each ON array_to_string(each.x, ' ') = exact.k) GROUP BY r),
counts AS (SELECT word, count(*) AS c FROM tokens GROUP BY word),
terms AS (SELECT k, word, min(o) AS o FROM (SELECT k, generate_subscripts(x, 1) - 1 AS o, unnest(x) AS word FROM kinds) GROUP BY k, word),
placed AS MATERIALIZED (SELECT k, word, o, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY k ORDER BY coalesce(c, 0), word) AS place FROM terms LEFT JOIN counts USING (word)),
seeds AS MATERIALIZED (SELECT a.k, a.word AS w0, a.o AS o0, b.word AS w1, b.o AS o1 FROM placed a JOIN placed b ON a.k = b.k AND a.place = 1 AND b.place = 2 WHERE a.c > 0),
firsts AS MATERIALIZED (SELECT a.r, a.p - s.o0 AS p, s.k, s.w1, s.o1 FROM seeds s JOIN tokens a ON a.word = s.w0),
near AS MATERIALIZED (SELECT DISTINCT f.r, f.p, f.k FROM firsts f JOIN tokens b ON b.r = f.r AND b.word = f.w1 WHERE abs(b.p - f.o1 - f.p) <= 3),
apart AS (
  SELECT n.r, count(*) AS n_near FROM near n JOIN kinds k ON k.k = n.k JOIN dw ON dw.r = n.r LEFT JOIN exact e ON e.r = n.r AND e.p = n.p AND e.k = n.k
  WHERE e.k IS NULL AND len(list_intersect(list_distinct(k.x), dw.w[greatest(n.p - 3, 1):n.p + k.n + 2])) >= 0.8 * k.different GROUP BY n.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN hits USING (r) LEFT JOIN named USING (r) LEFT JOIN apart USING (r)
"""
