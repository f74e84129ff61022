"""The few places in which Spark SQL and DuckDB spell the same expression differently.

Operators state their plan once as SQL over named tables. Spark runs it through spark.sql with
DataFrames as arguments; the second spelling is the independent oracle's.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def rrep(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def raw(self, text: str) -> str:
        return f"r'{text}'"

    def quoted(self, text: str) -> str:
        """A pattern as a literal, whatever quotes it has."""
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def fits(self, x: str, pattern: str) -> str:
        """rlike with a column of patterns."""
        return f"({x} RLIKE {pattern})"

    def found(self, x: str, pattern: str) -> str:
        return f"regexp_extract({x}, {pattern}, 0)"

    def half_even(self, x: str) -> str:
        return f"bround({x})"

    def fmt(self, pattern: str, x: str) -> str:
        return f"format_string('{pattern}', {x})"

    def rlike(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    def rext(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def rall(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', {group})"

    def split(self, x: str, mark: str) -> str:
        return f"split({x}, concat('\\\\Q', {mark}, '\\\\E'))"

    def chars(self, x: str) -> str:
        return f"transform(sequence(1, length({x})), i -> substring({x}, i, 1))"

    def explode(self, src: str, cols: str, arr: str, pos: str, v: str) -> str:
        return f"SELECT {cols}, {pos}, {v} FROM {src} LATERAL VIEW posexplode({arr}) lv AS {pos}, {v}"

    def transform(self, arr: str, v: str, e: str) -> str:
        return f"transform({arr}, {v} -> {e})"

    def filter(self, arr: str, v: str, e: str) -> str:
        return f"filter({arr}, {v} -> {e})"

    def join(self, arr: str, sep: str) -> str:
        return f"array_join({arr}, {sep})"

    def size(self, arr: str) -> str:
        return f"CAST(size({arr}) AS BIGINT)"

    def seq(self, a: str, b: str) -> str:
        return f"(CASE WHEN {b} >= {a} THEN sequence({a}, {b}) ELSE array() END)"

    def agg_join(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, {sep}) WITHIN GROUP (ORDER BY {order})"

    def last(self, x: str, over: str) -> str:
        return f"last({x}, true) OVER ({over})"

    def micros(self, ts: str) -> str:
        return f"unix_micros({ts})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def contains(self, arr: str, x: str) -> str:
        return f"array_contains({arr}, {x})"

    def json_list(self, x: str) -> str:
        return f"from_json({x}, 'array<string>')"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, z) -> s + z)"

    def l2sq(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), CAST(0 AS DOUBLE), (s, z) -> s + z)"

    def distinct(self, arr: str) -> str:
        return f"array_distinct({arr})"

    def sort(self, arr: str) -> str:
        return f"array_sort({arr})"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def collect(self, x: str) -> str:
        return f"collect_list({x})"

    def collect_in_order(self, x: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order}, {x}))), s -> s.{x})"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')"

    def find(self, text: str, part: str) -> str:
        return f"instr({text}, {part})"

    def hex32(self, x: str, at: int) -> str:
        """Eight hex digits of a text as a number."""
        return f"CAST(conv(substring({x}, {at}, 8), 16, 10) AS BIGINT)"


class Duck(Spark):
    name = "duck"

    def quoted(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def raw(self, text: str) -> str:
        return f"'{text}'"

    def fits(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {pattern})"

    def half_even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def fmt(self, pattern: str, x: str) -> str:
        return f"printf('{pattern}', {x})"

    def rrep(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def rlike(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def rext(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def rall(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    def split(self, x: str, mark: str) -> str:
        return f"string_split({x}, {mark})"

    def chars(self, x: str) -> str:
        return f"list_transform(generate_series(1, length({x})), lambda i: substring({x}, i, 1))"

    def explode(self, src: str, cols: str, arr: str, pos: str, v: str) -> str:
        return f"SELECT {cols}, generate_subscripts(lv, 1) - 1 AS {pos}, unnest(lv) AS {v} FROM (SELECT *, {arr} AS lv FROM {src})"

    def transform(self, arr: str, v: str, e: str) -> str:
        return f"list_transform({arr}, lambda {v}: {e})"

    def filter(self, arr: str, v: str, e: str) -> str:
        return f"list_filter({arr}, lambda {v}: {e})"

    def join(self, arr: str, sep: str) -> str:
        return f"array_to_string({arr}, {sep})"

    def size(self, arr: str) -> str:
        return f"CAST(len({arr}) AS BIGINT)"

    def seq(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def agg_join(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, {sep} ORDER BY {order})"

    def last(self, x: str, over: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def contains(self, arr: str, x: str) -> str:
        return f"list_contains({arr}, {x})"

    def json_list(self, x: str) -> str:
        return f"CAST(CAST({x} AS JSON) AS VARCHAR[])"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"

    def l2sq(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"

    def distinct(self, arr: str) -> str:
        return f"list_distinct({arr})"

    def sort(self, arr: str) -> str:
        return f"list_sort({arr})"

    def intersect(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def collect(self, x: str) -> str:
        return f"list({x})"

    def collect_in_order(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order})"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '$.{path}')"

    def find(self, text: str, part: str) -> str:
        return f"strpos({text}, {part})"

    def hex32(self, x: str, at: int) -> str:
        return f"CAST(concat('0x', substring({x}, {at}, 8)) AS BIGINT)"


SPARK, DUCK = Spark(), Duck()
