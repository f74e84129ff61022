"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.plans.operator import OPERATORS

for _name in ("lorekeep.sources.views", "lorekeep.operators.logs", "lorekeep.operators.evals", "lorekeep.operators.access", "lorekeep.operators.retrieval", "lorekeep.operators.chunking", "lorekeep.operators.text", "lorekeep.operators.replies", "lorekeep.operators.layout", "lorekeep.operators.pages", "lorekeep.operators.kb", "lorekeep.operators.memory", "lorekeep.operators.signature"):
    importlib.import_module(_name)

from lorekeep.functions import hooks  # noqa: E402
from lorekeep.operators import base, segments, signature  # noqa: E402
from lorekeep.plans.operator import with_views  # noqa: E402
from lorekeep.sources import files  # noqa: E402
from lorekeep.streaming import jobs  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]


#: DataFrame code over the views, with DuckDB texts of its own.
_CODE: dict[str, Query] = base.QUERIES | signature.QUERIES | segments.QUERIES
_TEXTS: dict[str, str] = base.ORACLE | {"mnt_changed_documents": signature.CHANGED, "mnt_index_refresh": segments.REFRESHED}


def queries() -> dict[str, Query]:
    return {k: o.over for k, o in OPERATORS.items()} | _CODE | files.QUERIES | hooks.QUERIES | jobs.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: o.oracle() for k, o in OPERATORS.items()} | {k: with_views(t) for k, t in _TEXTS.items()} | files.ORACLE | hooks.ORACLE | jobs.ORACLE
