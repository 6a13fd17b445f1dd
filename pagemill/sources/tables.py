"""Readers of the tables a folder holds, and of the logs and reports that a document pipeline writes.

Every reader declares its schema, keeps bad rows from failing the job and leaves pruning and pushdown to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "struct<page:int,y0:int,y1:int,x0:int,x1:int>"
PROBLEM = f"project string, chapter int, problem_id string, text string, page int, boxes array<{BOX}>, masks array<{BOX}>, text_source string, has_fig boolean, import_warn string"
EXAM_PROBLEM = "problem_id string, section_idx int, section_name string, page int, rect array<double>, height double, is_stitched boolean, text string"
SLOT = "problem_id string, section_idx int, section_name string, page int, text string, draft string, review string, final string, compact string, score int, status string, review_rounds int, final_mode string, usage struct<`in`:bigint,out:bigint,think:bigint,total:bigint,calls:bigint>, timestamp double, stale_text boolean, stage1 string, stage2 string, stage3 string, stage3_deduction string, compact_breakdown string"
OCR_LINE = "page int, W int, H int, med_h double, deep boolean, x0 double, y0 double, x1 double, y1 double, text string, score double, partial boolean, done boolean"
ANCHOR = "pid string, ch int, k int, pno int, y0 double, x0 double, score double, gap_before array<int>, recovered boolean"
MODEL_REPLY = "problem_id string, round int, stage string, reply string"
USAGE = "`in` bigint, out bigint, think bigint, total bigint, t double, stage string, pid string, model string"
PROFILE = "book struct<id:string,title:string,subtitle:string,author:string,doc_type:string,subject:string,pdf_candidates:array<string>,dpi:int>, chapters map<string,struct<name:string,start_page:int,end_page:int,problem_count:int>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder; times without a zone are read as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with a time that watermarks accept (the session's zone is taken as UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def problems(spark: SparkSession, path: str) -> DataFrame:
    """All problem rows under a root partitioned by project and chapter; only wanted columns and partitions are read."""
    return spark.read.schema(PROBLEM).json(path)


def parse_problems(lines: DataFrame) -> DataFrame:
    """S1 over JSON lines (value) that are a table already; a line that is no JSON object gives a row of nulls."""
    return lines.select(F.from_json("value", PROBLEM).alias("p")).select("p.*")


def slots(spark: SparkSession, path: str) -> DataFrame:
    """Solved rows; files that are not JSON are left out."""
    return parse_slots(spark.read.option("wholetext", True).text(path))


def parse_slots(files: DataFrame) -> DataFrame:
    """S2 over whole files (value)."""
    parsed = files.select(F.from_json("value", SLOT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("s")).select("s.*")
    return parsed.filter("_corrupt is null").drop("_corrupt")


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """S3: an append-only JSON-lines log."""
    return parse_usage(spark.read.text(path))


def parse_usage(lines: DataFrame) -> DataFrame:
    """S3 over lines (value): those that do not parse are skipped, a total of 0 is the sum of its parts."""
    parsed = lines.select(F.from_json("value", USAGE, {"mode": "PERMISSIVE"}).alias("u"), "value").filter(F.col("value").rlike(r"^\s*\{.*\}\s*$")).select("u.*")
    whole = F.coalesce(F.col("in"), F.lit(0)) + F.coalesce("out", F.lit(0)) + F.coalesce("think", F.lit(0))
    return parsed.filter(F.coalesce("in", "out", "think", "total").isNotNull()).withColumn("total", F.when(F.coalesce("total", F.lit(0)) == 0, whole).otherwise(F.col("total")))


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """``time | kind | message`` lines as (ts, kind, msg); short or undated lines are dropped."""
    parts = F.split("value", r" \| ", 3)
    ts = F.try_to_timestamp(F.trim(parts[0]), F.lit("yyyy-MM-dd HH:mm:ss"))
    return lines.select(ts.alias("ts"), F.trim(parts[1]).alias("kind"), parts[2].alias("msg")).filter("ts is not null and msg is not null")


def event_log(spark: SparkSession, path: str, last: int = 6000) -> DataFrame:
    """The last lines of a delimited log (a limit that is the feature of this view)."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    return parse_event_lines(lines.orderBy(F.desc("n")).limit(last).select("value"))


def scaled_lines(spans: DataFrame, dpi: int) -> DataFrame:
    """Text-layer spans (page, line, x0..y1, seq, text) joined to lines, trimmed and scaled from 72 dpi."""
    k = F.lit(dpi / 72.0)
    text = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), ""))
    lines = spans.groupBy("page", "line").agg((F.min("x0") * k).alias("x0"), (F.min("y0") * k).alias("y0"), (F.max("x1") * k).alias("x1"), (F.max("y1") * k).alias("y1"), text.alias("text"))
    return lines.filter("text <> ''")


def lines_to_recognise(lines: DataFrame) -> DataFrame:
    """What a quick scan reads: narrow lines and tall ones."""
    return lines.filter("x1 - x0 <= 0.35 * W or y1 - y0 >= 1.2 * med_h")


CACHED_LINE = "struct<x0:double,y0:double,x1:double,y1:double,text:string,score:double,partial:boolean>"


def cached_lines(files: DataFrame) -> DataFrame:
    """(page, deep, lines) of cached pages (page, value). A cache is an object with its lines and whether they were
    read in full; the old format is a list of lines, all of them read in full. What can't be read is no cache."""
    old = F.col("value").rlike(r"^\s*\[")
    new = F.from_json("value", f"deep boolean, lines array<{CACHED_LINE}>")
    lines = F.when(old, F.from_json("value", f"array<{CACHED_LINE}>")).otherwise(new["lines"])
    return files.select("page", (old | F.coalesce(new["deep"], F.lit(False))).alias("deep"), lines.alias("lines")).filter("lines is not null")


def pages_to_scan(pages: DataFrame, cached: DataFrame, only: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """Wanted pages that no cache has; listing pages prunes the scan."""
    out = pages if only is None else pages.join(only.select("page"), "page", "left_semi")
    out = out if skip is None else out.join(skip.select("page"), "page", "left_anti")
    return out.join(cached.select("page"), "page", "left_anti")


def has_text_layer(page_chars: DataFrame, every: int = 7, most: int = 12, per_page: int = 40) -> DataFrame:
    """Whether sampled pages (pno, n_chars) hold more than ``per_page`` characters each; S9 is every=1, most=4."""
    sample = page_chars.filter(F.col("pno") % every == 0).orderBy("pno").limit(most)
    return sample.agg(F.coalesce(F.sum("n_chars") > per_page * F.count(F.lit(1)), F.lit(False)).alias("has_text"))


def route(documents: DataFrame) -> DataFrame:
    """Which reader a document (doc_type, has_text) goes to."""
    return documents.withColumn("reader", F.when((F.col("doc_type") == "exam") & F.col("has_text"), "exam_text").when(F.col("doc_type") == "exam", "exam_scan").otherwise("book"))


def original_files(files: DataFrame, generated: tuple[str, ...]) -> DataFrame:
    """Per project the first file (project, name) that is no generated one, else any."""
    made = F.lit(False)
    for prefix in generated:
        made = made | F.col("name").startswith(prefix)
    return files.groupBy("project").agg(F.min_by("name", F.struct(made, F.col("name"))).alias("name"))


def project_catalog(projects: DataFrame, problem_rows: DataFrame, slot_rows: DataFrame, usage: DataFrame) -> DataFrame:
    """Projects with their counts, the newest first."""
    total = problem_rows.groupBy("project").agg(F.count(F.lit(1)).alias("total"))
    solved = slot_rows.groupBy("project").agg(F.count_distinct("problem_id").alias("solved"))
    tokens = usage.groupBy("project").agg(F.sum("total").alias("tokens"))
    out = projects.join(total, "project", "left").join(solved, "project", "left").join(tokens, "project", "left")
    return out.fillna(0, ["total", "solved", "tokens"]).orderBy(F.desc("mtime"), "project")


def active_project(projects: DataFrame, asked: str | None, configured: str | None, default: str) -> DataFrame:
    """The asked, else the configured, else the newest project, else a default."""
    newest = projects.agg(F.max_by("project", F.struct("mtime", "project")).alias("newest"))
    return newest.select(F.coalesce(F.lit(asked), F.lit(configured), F.col("newest"), F.lit(default)).alias("project"))


def bookmark_ranges(toc: DataFrame, pattern: str, tail: int = 6) -> DataFrame:
    """Bookmarks (seq, title, page) of one book whose title matches, each up to the next strictly greater page in
    list order, else ``tail`` pages on."""
    from ..operators.sequences import next_greater

    later = next_greater(toc.select(F.lit(0).alias("_book"), "seq", "page"), ["_book"], "seq", "page").select("seq", F.col("next_value").alias("next"))
    return toc.filter(F.col("title").rlike(pattern)).join(later, "seq").select("seq", "title", F.col("page").alias("start"), F.coalesce("next", F.col("page") + tail).alias("end"))


def inbox(spark: SparkSession, path: str, schema: str, archive: str | None = None) -> DataFrame:
    """New files of a folder as a stream; read ones can be moved to an archive."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(path)


def profile(spark: SparkSession, path: str) -> DataFrame:
    """Project settings with defaults for what is missing."""
    return with_defaults(spark.read.schema(PROFILE).option("multiLine", True).json(path))


def with_defaults(raw: DataFrame) -> DataFrame:
    """S16 over settings (book, chapters) that are read already."""
    put = {"id": "", "title": "", "doc_type": "exam", "subject": "", "dpi": 200}
    return raw.select(*[F.coalesce(f"book.{c}", F.lit(v)).alias(c) for c, v in put.items()], "chapters")


def newest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
