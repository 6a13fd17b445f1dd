"""Code and rows for the workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def with_code(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it is run from a checkout."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "")
    if _ROOT not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, paths) if x)
    return spark


def spread(rows: DataFrame, *key: str | Column) -> DataFrame:
    """Rows dealt by ``key`` over several tasks a core, for work that is much heavier than the bytes of a row let expect.

    Scans and shuffles cut tasks by bytes, and a few MB of a column-wise file hold a million rows. A number of partitions
    that is given is not made smaller at run time.
    """
    spark = rows.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *key)
