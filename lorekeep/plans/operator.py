"""Operators over named tables.

An operator is called with DataFrames: `tool_summary(tool_audit=df)`. The text of its plan is SQL
that Catalyst optimises as a whole; the operators are lazy and compose.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.plans.dialect import DUCK, SPARK, Spark

Body = str | Callable[[Spark], str]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
VIEWS: dict[str, Body] = {}
OPERATORS: dict[str, "Operator"] = {}


def text_of(body: Body, dialect: Spark) -> str:
    return body if isinstance(body, str) else body(dialect)


def uses(sql: str) -> list[str]:
    """Known tables and views that a text reads."""
    own = set(re.findall(r"\b(\w+)\s+AS\s+\(\s*(?:WITH|SELECT)", sql))
    found = re.findall(r"\b(?:FROM|JOIN|,)\s*(\w+)\b", sql)
    return list(dict.fromkeys(x for x in found if (x in VIEWS or x in TABLES) and x not in own))


def run_sql(sql: str, frames: dict[str, DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """spark.sql over DataFrames that the text names as tables."""
    text = sql.replace("{", "{{").replace("}", "}}")
    own = set(re.findall(r"\b(\w+)\s+AS\s+\(\s*(?:WITH|SELECT)", sql))
    names = [x for x in frames if x not in own and re.search(rf"\b(?:FROM|JOIN|,)\s*{x}\b", sql)]
    for x in names:
        text = re.sub(rf"\b(FROM|JOIN|,)(\s*){x}\b", rf"\1\2{{{x}}}", text)
    spark = spark or next(iter(frames.values())).sparkSession
    if not names:
        return spark.sql(sql)
    return spark.sql(text, **{x: frames[x] for x in names})


class Operator:
    def __init__(self, key: str, doc: str, body: Body, apart: str = "") -> None:
        """apart: DuckDB text of the same rule written apart from `body`."""
        self.key, self.__doc__, self.body, self.apart = key, doc, body, apart

    @property
    def inputs(self) -> list[str]:
        return uses(text_of(self.body, SPARK))

    def __call__(self, **frames: DataFrame) -> DataFrame:
        missing = [x for x in self.inputs if x not in frames]
        if missing:
            raise TypeError(f"{self.key} needs {', '.join(missing)}")
        return run_sql(text_of(self.body, SPARK), frames)

    def over(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        found: dict[str, DataFrame] = {}
        return run_sql(text_of(self.body, SPARK), {x: view(spark, sf_dir, x, found) for x in self.inputs}, spark)

    def oracle(self) -> str:
        return with_views(self.apart or text_of(self.body, DUCK))


def operator(key: str, doc: str, body: Body, apart: str = "") -> Operator:
    if key in OPERATORS:
        raise ValueError(f"{key} is there already")
    OPERATORS[key] = made = Operator(key, doc, body, apart)
    return made


class Coded(Operator):
    """An operator written in DataFrame code: `run(**frames)` over the named tables. The DuckDB text
    is written apart from it."""

    def __init__(self, key: str, doc: str, run: Callable[..., DataFrame], reads: list[str], apart: Body) -> None:
        super().__init__(key, doc, "")
        self.run, self.reads, self.other = run, reads, apart

    @property
    def inputs(self) -> list[str]:
        return self.reads

    def __call__(self, **frames: DataFrame) -> DataFrame:
        missing = [x for x in self.reads if x not in frames]
        if missing:
            raise TypeError(f"{self.key} needs {', '.join(missing)}")
        return self.run(**{x: frames[x] for x in self.reads})

    def over(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        found: dict[str, DataFrame] = {}
        return self(**{x: view(spark, sf_dir, x, found) for x in self.reads})

    def oracle(self) -> str:
        return with_views(text_of(self.other, DUCK))


def coded(key: str, doc: str, reads: list[str], apart: Body) -> Callable[[Callable[..., DataFrame]], Coded]:
    """Registers the decorated function of DataFrames as an operator."""

    def put(run: Callable[..., DataFrame]) -> Coded:
        if key in OPERATORS:
            raise ValueError(f"{key} is there already")
        made = Coded(key, doc, run, reads, apart)
        OPERATORS[key] = made
        return made

    return put


def view(spark: SparkSession, sf_dir: str, name: str, found: dict[str, DataFrame] | None = None) -> DataFrame:
    """A driver table, or a view of them that has the shape of one of the library's tables."""
    found = {} if found is None else found
    if name not in found:
        if name in TABLES:
            found[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sql = text_of(VIEWS[name], SPARK)
            found[name] = run_sql(sql, {x: view(spark, sf_dir, x, found) for x in uses(sql)}, spark)
    return found[name]


def with_views(sql: str) -> str:
    """DuckDB text with the views that it reads in front."""
    order: list[str] = []

    def add(text: str) -> None:
        for x in uses(text):
            if x in VIEWS and x not in order:
                add(text_of(VIEWS[x], DUCK))
                order.append(x)

    add(sql)
    if not order:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(f"{x} AS MATERIALIZED ({text_of(VIEWS[x], DUCK)})" for x in order) + ",\n" + sql.removeprefix("WITH RECURSIVE ")
    return "WITH " + ",\n".join(f"{x} AS MATERIALIZED ({text_of(VIEWS[x], DUCK)})" for x in order) + f"\nSELECT * FROM ({sql})"
