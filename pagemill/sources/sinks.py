"""Writers of reports, logs and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_report(report: DataFrame, path: str, keys: tuple[str, ...] = ("project", "chapter")) -> None:
    """K1: a report table partitioned by its keys, replaced only where it has new rows."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*[k for k in keys if k in report.columns]).parquet(path)


def append_json(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """K2: an append-only JSON-lines log of a stream; the checkpoint makes each row appear once."""
    return stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def event_line(ts, kind, msg):
    """K3: the text of one log line."""
    return F.concat_ws(" | ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), kind, msg)


def write_markdown(sections: DataFrame, path: str, key: str, text: str) -> None:
    """K4, K5: one text file per key."""
    sections.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def page_subset(problems: DataFrame) -> DataFrame:
    """Pages that boxes (chapter, problem_id, boxes) touch and problems, per chapter and overall (chapter null)."""
    used = problems.select("chapter", "problem_id", F.explode("boxes").alias("b")).select("chapter", "problem_id", F.col("b.page").alias("page"))
    grouped = used.groupingSets([["chapter"], []], "chapter").agg(F.count_distinct("page").alias("n_pages"), F.count_distinct("chapter", "problem_id").alias("n_problems"), F.array_sort(F.collect_set("page")).alias("pages"))
    return grouped


def set_aside(rows: DataFrame, kept: DataFrame, key: str = "chapter") -> tuple[DataFrame, DataFrame]:
    """K8: rows whose key is among the kept ones, and the rest."""
    return rows.join(kept.select(key).distinct(), key, "left_semi"), rows.join(kept.select(key).distinct(), key, "left_anti")
