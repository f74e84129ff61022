"""Secret scans with multipart credential linking.

Plain patterns report three kinds on their own: assign, access and hex. Weak parts - access
identifiers, random-looking strings and service endpoints - say nothing alone. They become rows
(document, scope, position), and so do base spans: assign and hex act as secrets like random-looking
strings, access as an identifier. An interval join, written as range windows over positions inside a
scope, pairs a secret with an identifier or endpoint when at most `WINDOW` code points lie between
the end of one and the start of the other; a secret inside an endpoint is not paired by that endpoint
alone. Paired random-looking strings and the identifiers and endpoints as near to a paired secret are
reported. A scope is a paragraph.

Defined results: a null or empty text has no spans; repeated rows are scanned one by one; ties in
position are ordered by kind; an empty table gives an empty result; extra columns are ignored.
Rows are dealt by row number, so one source or one group of copies can't gather in a task; a frame of
`WINDOW` holds at most a few times WINDOW / 4 parts, and other frames grow with the row.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lorekeep.llm.common import row_key, slices, table

#: Kinds in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "secret", "identifier", "endpoint"]
ASSIGN, ACCESS, HEX, SECRET, IDENTIFIER, ENDPOINT = range(6)
#: Kinds that act as the secret of a pair.
SECRETS = (SECRET, ASSIGN, HEX)
#: Code points at most between the end of a part and the start of the next that belong together.
WINDOW = 240
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more is one match of [0-9a-f]+
_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_IDENTIFIER = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|account_?id|user_?name|login)["']?\x20?[:=]\x20?["']?([A-Za-z0-9._@-]{4,})""", re.I | re.A)
_ENDPOINT = re.compile(r"""(?:https?|wss?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}""", re.I | re.A)

Span = tuple[int, int, int]


def random_looking(s: str) -> bool:
    """Mixed classes and at least 3.5 bits a character."""
    s = s.rstrip("=")
    if not (re.search("[0-9]", s) and re.search("[A-Z]", s) and re.search("[a-z]", s)):
        return False
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) >= 3.5


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), ASSIGN, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), HEX, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


#: Paragraphs end here.
_GAP = re.compile("\n\n")


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Parts that count only together; strings inside base spans are reported already."""
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    inside = lambda a, b: (k := bisect_left(starts, b)) > 0 and furthest[k - 1] > a
    secrets = [(m.start(), SECRET, m.end()) for m in _SECRET.finditer(text) if random_looking(m[0]) and not inside(m.start(), m.end())]
    secrets += [x for x in base if x[1] in SECRETS]
    if not secrets:
        return []
    others = [x for x in base if x[1] == ACCESS]
    others += [(m.start(), IDENTIFIER, m.end()) for m in _IDENTIFIER.finditer(text) if not inside(m.start(), m.end())]
    others += [(m.start(), ENDPOINT, m.end()) for m in _ENDPOINT.finditer(text)]
    return sorted(secrets + others) if others else []


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    part = pa.struct([("scope", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    for texts in batches:
        base, weak = [], []
        for some in slices(texts):
            for text in some:
                b = base_spans(text)
                base.append(b)
                gaps = [m.end() for m in _GAP.finditer(text)]
                weak.append([(bisect_right(gaps, s), s, k, e) for s, k, e in weak_parts(text, b)])
        as_rows = lambda rows, names: [[dict(zip(names, x)) for x in r] for r in rows]
        yield pa.StructArray.from_arrays([pa.array(as_rows(base, ["start", "kind", "end"]), pa.list_(span)), pa.array(as_rows(weak, ["scope", "start", "kind", "end"]), pa.list_(part))], names=["base", "weak"])


_SCANNED = "struct<base:array<struct<start:bigint,kind:int,end:bigint>>,weak:array<struct<scope:bigint,start:bigint,kind:int,end:bigint>>>"


def find_secrets(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per row of `docs`: the `keys` columns, base spans and all spans, as arrays of
    (start, kind, end) in order."""
    d = docs.select(*keys, arrow_udf(_scan, _SCANNED)(F.col(text)).alias("__lk_s"), F.monotonically_increasing_id().alias("__lk_row"))
    d = d.select(*keys, "__lk_row", F.col("__lk_s.base").alias("__lk_base"), F.posexplode_outer("__lk_s.weak").alias("__lk_at", "__lk_p"))
    # base spans go with a text's first part alone: with each part, a text's parts times its spans would move
    d = d.withColumn("__lk_base", F.when(F.coalesce("__lk_at", F.lit(0)) == 0, F.col("__lk_base")))
    kind, start, end = (F.col(f"__lk_p.{x}") for x in ("kind", "start", "end"))
    secret = kind.isin(*SECRETS)
    scope = Window.partitionBy("__lk_row", "__lk_p.scope")
    # in the first order secrets stand at their start and others at their end, in the second the other way round
    first, second = scope.orderBy(F.when(secret, start).otherwise(end)), scope.orderBy(F.when(secret, end).otherwise(start))
    before, after, so_far = (-WINDOW, 0), (0, WINDOW), (Window.unboundedPreceding, 0)
    last = lambda what, order, frame: F.max(F.when(what, end)).over(order.rangeBetween(*frame))
    follows = last(kind.isin(ACCESS, IDENTIFIER, ENDPOINT), second, after).isNotNull()
    precedes = last(kind.isin(ACCESS, IDENTIFIER), second, so_far) >= start - WINDOW  # or overlaps
    served = last(kind == ENDPOINT, first, before).isNotNull()
    d = d.withColumn("__lk_pair", secret & F.coalesce(follows | precedes | served, F.lit(False)))
    pair = F.col("__lk_pair")
    beside = last(pair, first, after).isNotNull() | (last(pair, first, so_far) >= start - WINDOW)
    linked = ((kind == SECRET) & pair) | (kind.isin(IDENTIFIER, ENDPOINT) & beside)
    d = d.withColumn("__lk_add", F.when(linked, F.struct("__lk_p.start", "__lk_p.kind", "__lk_p.end")))
    d = d.groupBy("__lk_row").agg(*[F.first(k).alias(k) for k in keys], F.first("__lk_base", ignorenulls=True).alias("base"), F.collect_list("__lk_add").alias("__lk_more"))
    return d.select(*keys, "base", F.array_sort(F.concat("base", "__lk_more")).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _mask(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in batches:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            if text is not None and found:
                kept, at = [], 0
                for s in found:
                    if s["end"] > at:
                        kept += [text[at : s["start"]], MASK] if s["start"] >= at else []
                        at = s["end"]
                text = "".join([*kept, text[at:]])
            out.append(text)
        yield pa.array(out, pa.string())


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with each reported span replaced by a mark; all rows and columns stay.

    Rows that are equal in doc_id and text share one scan result."""
    keyed = docs.select("*", *row_key())
    found = find_secrets(keyed, ["__lk_id", "__lk_th"]).where(F.size("spans") > 0).dropDuplicates(["__lk_id", "__lk_th"])
    found = found.select(F.col("__lk_id").alias("__lk_i2"), F.col("__lk_th").alias("__lk_t2"), "spans").withColumnRenamed("spans", "__lk_spans")
    d = keyed.join(found, F.col("__lk_id").eqNullSafe(F.col("__lk_i2")) & (F.col("__lk_th") == F.col("__lk_t2")), "left")
    new = arrow_udf(_mask, "string")(F.col("text"), F.col("__lk_spans"))
    d = d.withColumn("__lk_new", new)
    swap = {"text": F.col("__lk_new")} | ({"n_chars": F.when(F.col("__lk_i2").isNull() & F.col("__lk_t2").isNull(), F.col("n_chars")).otherwise(F.length("__lk_new")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return d.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in docs.columns])


def op2_credential_links(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(ASSIGN).alias("n_assign"), count(ACCESS).alias("n_access"), count(HEX).alias("n_hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
