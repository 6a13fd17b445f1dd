"""All named queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boxes_and_sets, items, logs_and_texts, table_rules, text_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (items, logs_and_texts, boxes_and_sets, text_rules, table_rules):
    for _name, _f in vars(_module).items():
        if callable(_f) and not _name.startswith("_") and getattr(_f, "__module__", "") == _module.__name__:
            QUERIES[_name] = _f
            if sql := getattr(_module, _name.upper(), None):
                ORACLE_SQL[_name] = sql
