"""Lets Python workers import this package when it is not installed on them."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> SparkSession:
    """Put the repository on the workers' path, unless it is there. On a cluster ship the package
    with --py-files or install it; the path then changes nothing."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH"), os.environ.get("PYTHONPATH")) if p]
    if ROOT not in ":".join(paths).split(":"):
        env["PYTHONPATH"] = ":".join([ROOT, *paths[:1]])
    return spark
