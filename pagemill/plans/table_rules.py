"""Queries over page lines, boxes, question banks and logs: tables of the folder stand in for them, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import sequences as W
from ..shipping import spread
from ..sources import sinks, tables
from ..sources.tables import table
from . import views
from .text_rules import _case, _pick


def _cols(df: DataFrame, **exprs: str) -> DataFrame:
    return df.select(*[F.expr(e).alias(c) for c, e in exprs.items()])


_BAND = ["a header", "2.19 题", "习题6-21 x", "42", "- 17 -", "/ 120 /", "xiv", "正文 abc"]


def _band_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = _cols(table(spark, sf, "part"), key="p_partkey", page="p_partkey % 40", y0="p_partkey * 13 % 1000", y1="p_partkey * 13 % 1000 + 10 + p_size % 20", x0="p_size", x1="p_size + p_partkey % 700", H="1000", W="800")
    return p.withColumn("text", _case(F.floor(F.col("key") / 40), _BAND))


def header_footer(spark: SparkSession, sf: str) -> DataFrame:
    """P1, P20, P21."""
    lines = _band_lines(spark, sf)
    rules = _cols(table(spark, sf, "supplier"), page="s_suppkey % 40", y="s_suppkey * 37 % 1000", x0="50", x1="50 + s_suppkey * 11 % 500", H="1000")
    g = J.header_cut(lines, rules).join(J.footer_cut(lines, rules=rules), "page")
    return g.join(J.body_lines(lines, g).groupBy("page").agg(F.count(F.lit(1)).alias("n")), "page", "left")


_BAND_SQL = """
l AS (SELECT p_partkey % 40 AS page, p_partkey * 13 % 1000 AS y0, p_partkey * 13 % 1000 + 10 + p_size % 20 AS y1, p_size AS x0, p_size + p_partkey % 700 AS x1, p_partkey // 40 % 8 AS i, p_partkey AS key FROM part),
r AS (SELECT s_suppkey % 40 AS page, s_suppkey * 37 % 1000 AS y, 50 AS x0, 50 + s_suppkey * 11 % 500 AS x1 FROM supplier)
"""
HEADER_FOOTER = f"""
WITH {_BAND_SQL},
c AS (SELECT page, coalesce((SELECT max(y) + 3 FROM r WHERE r.page = l.page AND y <= 140), max(y1 + 4) FILTER (y1 < 90 AND i NOT IN (1, 2)), 0) AS cut,
  coalesce(min(y0 - 3) FILTER (y0 > 940 AND i IN (3, 4, 6) OR y0 > 850 AND i = 5 AND x1 - x0 < 200), 970) AS foot, max(y0) FILTER (i IN (1, 2)) AS anchor FROM l GROUP BY page),
h AS (SELECT c.*, coalesce((SELECT CASE WHEN min(y0) IS NOT NULL THEN greatest(0, min(y0) - 4) END FROM l WHERE l.page = c.page AND i = 2 AND y0 < cut), cut) AS header_cut FROM c),
f AS (SELECT h.*, least(foot, coalesce((SELECT min(y) - 4 FROM r WHERE r.page = h.page AND y >= 720 AND y < foot AND least(x1, 400) - greatest(x0, 32) >= 96 AND x1 <= 440 AND (anchor IS NULL OR anchor <= y)), foot)) AS footer_cut FROM h)
SELECT page, CAST(header_cut AS DOUBLE) AS header_cut, CAST(footer_cut AS DOUBLE) AS footer_cut, (SELECT nullif(count(*), 0) FROM l WHERE l.page = f.page AND y1 > header_cut AND y0 < footer_cut) AS n FROM f
"""

_KINDS = [None, "heading", None, "stop", "opener", None, None, None, None]
_KIND_TEXT = ["正文 12", "仿真题 7", "思考题", "参考答案", "第2章"]


def _kind_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = _cols(table(spark, sf, "part"), key="p_partkey", page="p_partkey % 50", y0="cast(p_partkey as double)", x0="cast(p_size * 10 as double)", x1="cast(p_size * 16 as double)", W="800")
    return p.withColumn("kind", _case(F.floor(F.col("key") / 50) * 7 + F.col("key"), _KINDS)).withColumn("text", _case(F.col("key"), _KIND_TEXT))


def page_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """P3, P22."""
    lines = _kind_lines(spark, sf)
    ends = J.terminators(lines.withColumn("partial", F.col("key") % 3 == 0), partial="partial")
    return J.page_kind(lines).join(ends.select("page", A.joined(F.transform("rows", lambda r: r.cast("long"))).alias("ends")), "page", "left")


PAGE_KINDS = f"""
WITH l AS (SELECT p_partkey AS key, p_partkey % 50 AS page, p_size * 10 AS x0, p_size * 16 AS x1, {_pick(_KINDS, "(p_partkey // 50 * 7 + p_partkey)")} AS kind, p_partkey % 5 AS i FROM part),
t AS (SELECT page, string_agg(CAST(key AS VARCHAR), ',' ORDER BY key) AS ends FROM l WHERE x0 <= 400 AND (i = 1 OR key % 3 <> 0 AND (i = 2 OR kind IN ('stop', 'opener'))) GROUP BY page)
SELECT p.page, CASE WHEN n >= 5 THEN 'toc' WHEN heading THEN 'heading' ELSE last END AS page_kind, ends
FROM (SELECT page, count(*) FILTER (x1 > 640 AND i IN (0, 1)) AS n, coalesce(bool_or(kind = 'heading'), false) AS heading, arg_max(kind, key) FILTER (kind IS NOT NULL) AS last FROM l GROUP BY page) p LEFT JOIN t ON t.page = p.page
"""

_SOURCES = ["imported", "imported_check", "verified", "text_layer", "ocr", None]


def text_sources(spark: SparkSession, sf: str) -> DataFrame:
    """P6, P7, P10, P11, P12, P17, P18."""
    key = F.col("o_orderkey")
    text = F.concat(F.repeat(F.lit("x"), (key % 12).cast("int")), F.when(key % 7 == 0, F.lit("\t")).otherwise(F.lit("")))
    d = table(spark, sf, "orders").select(key, _case(key, _SOURCES).alias("source"), text.alias("text"), F.when(key % 5 > 1, key % 5 > 2).alias("fig"), F.when(key % 4 > 0, F.repeat(F.lit("b"), (key % 2).cast("int"))).alias("final"), F.lit("old").alias("stage3"))
    section = _case(key, ["选择题", "计算题", "三、填空", "判断", "综合"])
    settings = F.create_map(F.lit("0"), F.lit("zero"), F.lit("1"), F.lit("one"))
    return d.select(
        "o_orderkey", F.coalesce(J.already_verified(F.col("source"), F.col("text")), F.lit(False)).alias("done"), F.coalesce(J.text_only(F.col("source"), F.col("fig")), F.lit(False)).alias("plain"), J.needs_transcription(F.col("source"), F.regexp_replace("text", "\t", " ")).alias("read"),
        J.first_filled("final", "stage3").alias("final"), J.is_easy(section).alias("easy"), J.doc_type(key % 20).alias("doc_type"), J.chapter_setting(settings, (key % 2).cast("string")).alias("setting"),
    )


TEXT_SOURCES = f"""
SELECT o_orderkey, coalesce(source IN ('verified', 'imported') AND o_orderkey % 12 >= 8 AND o_orderkey % 7 <> 0, false) OR coalesce(source IN ('verified', 'imported') AND false, false) AS done,
  coalesce(source LIKE 'imported%' AND o_orderkey % 5 = 2, false) AS plain, coalesce(source, '') NOT IN ('imported', 'imported_check', 'verified', 'text_layer') OR o_orderkey % 12 < 8 AS "read",
  CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 2 = 1 THEN 'b' ELSE 'old' END AS final, o_orderkey % 5 IN (0, 2, 3) AS easy, CASE WHEN o_orderkey % 20 > 12 THEN 'book' ELSE 'exam' END AS doc_type, CASE o_orderkey % 2 WHEN 0 THEN 'zero' ELSE 'one' END AS setting
FROM (SELECT o_orderkey, {_pick(_SOURCES, "o_orderkey")} AS source FROM orders)
"""


def written_back(spark: SparkSession, sf: str) -> DataFrame:
    """J5, J7, P8."""
    p = table(spark, sf, "part")
    problems = p.select(F.col("p_size").alias("chapter"), F.col("p_partkey").alias("problem_id"), F.lit("old").alias("text"), _case(F.col("p_partkey"), _SOURCES).alias("text_source"))
    verdicts = p.filter("p_partkey % 4 > 0").select(F.col("p_size").alias("chapter"), F.col("p_partkey").alias("problem_id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise(F.lit("")).alias("text"), (F.col("p_partkey") % 3 > 0).alias("text_ok"))
    parsed = p.filter("p_partkey % 9 > 4").select(F.col("p_partkey").alias("problem_id"), F.concat(F.lit("new $x"), F.repeat(F.lit("$"), (F.col("p_partkey") % 2).cast("int"))).alias("body"))
    out = J.write_back(problems, verdicts).withColumnRenamed("text", "checked").withColumnRenamed("text_source", "checked_source")
    imported = J.apply_import(problems, parsed, F.coalesce(J.is_damaged(F.col("body")), F.lit(False)))
    return out.join(imported, ["chapter", "problem_id"])


WRITTEN_BACK = f"""
SELECT chapter, problem_id, CASE WHEN use THEN p_name ELSE 'old' END AS checked, CASE WHEN NOT use THEN source WHEN source = 'imported' THEN 'imported' ELSE 'verified' END AS checked_source,
  CASE WHEN new THEN 'new $x$' ELSE 'old' END AS text, CASE WHEN new THEN 'imported' ELSE source END AS text_source
FROM (SELECT p_size AS chapter, p_partkey AS problem_id, p_name, {_pick(_SOURCES)} AS source, p_partkey % 4 > 0 AND p_partkey % 5 > 0 AND p_partkey % 3 > 0 AS use, p_partkey % 9 > 4 AND p_partkey % 2 = 1 AS new FROM part)
"""


def _box_rows(spark: SparkSession, sf: str) -> DataFrame:
    box = F.struct((F.col("l_linenumber") % 3).cast("int").alias("page"), (F.col("l_partkey") % 90).cast("int").alias("y0"), (F.col("l_partkey") % 90 + 10).cast("int").alias("y1"), F.lit(0).alias("x0"), F.col("l_linenumber").cast("int").alias("x1"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", box.alias("box"))
    return spread(rows, "l_orderkey").groupBy(F.col("l_orderkey").alias("problem_id")).agg(F.array_distinct(F.sort_array(F.collect_list("box"))).alias("boxes"))


_BOX_SQL = "SELECT DISTINCT l_orderkey AS problem_id, l_linenumber % 3 AS page, l_partkey % 90 AS y0, l_partkey % 90 + 10 AS y1, 0 AS x0, l_linenumber AS x1 FROM lineitem"


def review_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """J3, J17, O6, O7."""
    boxes = _box_rows(spark, sf)
    flags = boxes.filter("problem_id % 3 = 0").select("problem_id", F.array(F.lit("manual")).alias("flags"))
    checks = boxes.filter("problem_id % 4 = 0").select("problem_id", (F.col("problem_id") % 8 == 0).alias("ok"), F.array().cast("array<string>").alias("problems"))
    pages = spark.createDataFrame([(i, 100 + i) for i in range(3)], "page int, H int")
    expected = table(spark, sf, "orders").filter("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("problem_id"))
    v = views.review(J.expected_only(boxes, expected, ["problem_id"]), flags, checks, F.broadcast(pages))  # three rows
    place = F.row_number().over(Window.partitionBy("problem_id").orderBy(*G.anchor_order(), "x1", "y1"))
    return v.withColumn("place", place).select("problem_id", F.col("box").cast("long").alias("box"), "page", "y0", "H", A.joined("flags").alias("flags"), "ok", F.col("place").cast("long").alias("place"))


REVIEW_BOXES = f"""
WITH b AS ({_BOX_SQL})
SELECT problem_id, row_number() OVER w - 1 AS box, CAST(page AS INTEGER) AS page, CAST(y0 AS INTEGER) AS y0, CAST(100 + page AS INTEGER) AS H, CASE WHEN problem_id % 3 = 0 THEN 'manual' END AS flags,
  CASE WHEN problem_id % 4 = 0 THEN problem_id % 8 = 0 END AS ok, row_number() OVER w AS place FROM b WHERE problem_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0) WINDOW w AS (PARTITION BY problem_id ORDER BY page, y0, y1, x0, x1)
"""


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """S12, S13, A25, O5."""
    projects = _cols(table(spark, sf, "nation"), project="n_nationkey", mtime="n_regionkey * 100 - n_nationkey")
    found = tables.project_catalog(projects, _cols(table(spark, sf, "customer"), project="c_nationkey"), _cols(table(spark, sf, "supplier"), project="s_nationkey", problem_id="s_suppkey % 7"), _cols(table(spark, sf, "customer").filter("c_nationkey > 3"), project="c_nationkey", total="c_custkey"))
    active = tables.active_project(projects.withColumn("project", F.col("project").cast("string")), None, None, "x").select(F.col("project").alias("active"))
    place = F.row_number().over(Window.orderBy(F.desc("mtime"), "project")).cast("long")  # a row per project
    return found.crossJoin(F.broadcast(active)).select("project", "total", "solved", "tokens", (F.col("active") == F.col("project").cast("string")).alias("active"), place.alias("place"))  # one row


CATALOG = """
SELECT n_nationkey AS project, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS total, (SELECT count(DISTINCT s_suppkey % 7) FROM supplier WHERE s_nationkey = n_nationkey) AS solved,
  CAST(coalesce((SELECT sum(c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_nationkey > 3), 0) AS BIGINT) AS tokens, row_number() OVER (ORDER BY n_regionkey * 100 - n_nationkey DESC, CAST(n_nationkey AS VARCHAR) DESC) = 1 AS active,
  row_number() OVER (ORDER BY n_regionkey * 100 - n_nationkey DESC, n_nationkey) AS place FROM nation
"""


def usage_per_problem(spark: SparkSession, sf: str) -> DataFrame:
    """A4, S3."""
    line = F.concat(F.lit('{"in": '), F.col("l_linenumber"), F.lit(', "out": '), F.col("l_suppkey") % 9, F.lit(', "think": 1, "total": '), F.col("l_partkey") % 5, F.lit(', "pid": "'), F.col("l_suppkey"), F.lit('"}'))
    lines = table(spark, sf, "lineitem").select(F.when(F.col("l_partkey") % 11 == 0, F.lit("broken {")).otherwise(line).alias("value"))
    return A.per_problem_usage(tables.parse_usage(lines))


USAGE_PER_PROBLEM = """
SELECT CAST(l_suppkey AS VARCHAR) AS pid, CAST(sum(l_linenumber) AS BIGINT) AS "in", CAST(sum(l_suppkey % 9) AS BIGINT) AS out, count(*) AS think,
  CAST(sum(CASE WHEN l_partkey % 5 = 0 THEN l_linenumber + l_suppkey % 9 + 1 ELSE l_partkey % 5 END) AS BIGINT) AS total, count(*) AS calls FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY l_suppkey
"""


def read_banks(spark: SparkSession, sf: str) -> DataFrame:
    """S1, S2, S16."""
    key = F.col("c_custkey")
    row = F.to_json(F.struct(key.cast("string").alias("problem_id"), F.col("c_nationkey").alias("chapter"), F.col("c_name").alias("text"), F.lit(1).alias("unknown")))
    c = table(spark, sf, "customer")
    problems = tables.parse_problems(c.select(row.alias("value")))
    slots = tables.parse_slots(c.select(F.when(key % 4 == 0, F.lit('{"problem_id": ')).otherwise(F.concat(F.lit('{\n "problem_id": "'), key, F.lit('",\n "score": '), key % 101, F.lit("\n}"))).alias("value")))
    book = c.select(F.from_json(F.when(key % 2 == 0, F.concat(F.lit('{"book": {"id": "'), key, F.lit('", "dpi": 300}}'))).otherwise(F.concat(F.lit('{"book": {"id": "'), key, F.lit('"}}'))), tables.PROFILE).alias("p")).select("p.*")
    settings = tables.with_defaults(book).select(F.col("id").alias("problem_id"), "doc_type", "dpi")
    return problems.select("problem_id", "chapter", "text").join(slots.select("problem_id", "score"), "problem_id", "left").join(settings, "problem_id")


READ_BANKS = """
SELECT CAST(c_custkey AS VARCHAR) AS problem_id, CAST(c_nationkey AS INTEGER) AS chapter, c_name AS text, CAST(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 101 END AS INTEGER) AS score, 'exam' AS doc_type, CASE WHEN c_custkey % 2 = 0 THEN 300 ELSE 200 END AS dpi FROM customer
"""


def verified_problems(spark: SparkSession, sf: str) -> DataFrame:
    """X6, X7, A7."""
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select(key.alias("problem_id"), F.when(key % 6 > 0, F.col("p_size")).alias("height"), (key % 400).alias("width"), F.when(key % 5 > 0, key % 5 > 1).alias("text_ok"), _case(key, ["f", " ", None]).alias("final"), _case(key, ["c", "", None, "d"]).alias("compact"), _case(key, ["passed", "needs_review", "unreviewed"]).alias("status"))
    issues = G.verify_issues(rows).select("problem_id", A.joined("issues").alias("issues"), "issues")
    filled = G.backfill(rows.select("problem_id", _case(F.col("problem_id"), ["t", "", None]).alias("text")), rows.select("problem_id", F.lit("slot").alias("text"), F.lit("x\n### 速查\ny").alias("final"), "compact"))
    return issues.toDF("problem_id", "issues", "_i").drop("_i").join(filled.select("problem_id", "text", "compact"), "problem_id")


VERIFIED_PROBLEMS = """
SELECT p_partkey AS problem_id, concat_ws(',', CASE WHEN p_partkey % 6 = 0 OR p_size < 25 OR p_partkey % 400 < 200 THEN 'slice' END, CASE WHEN p_partkey % 5 = 1 THEN 'text' END, CASE WHEN p_partkey % 3 > 0 THEN 'no_final' END,
  CASE WHEN p_partkey % 4 IN (1, 2) THEN 'no_compact' END, CASE p_partkey % 3 WHEN 1 THEN 'needs_review' WHEN 2 THEN 'unreviewed' END) AS issues,
  CASE WHEN p_partkey % 3 = 0 THEN 't' ELSE 'slot' END AS text, CASE p_partkey % 4 WHEN 0 THEN 'c' WHEN 3 THEN 'd' ELSE 'y' END AS compact FROM part
"""


def verify_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A7, U6."""
    key = F.col("p_partkey")
    old = table(spark, sf, "part").select(key, F.when(key % 3 == 0, F.array(F.lit("题干转写"))).otherwise(F.array().cast("array<string>")).alias("fixed"), F.when(key % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    new = old.filter("p_partkey % 5 = 0").withColumn("fixed", F.array(F.lit("已更正"), F.lit("转写")))
    return A.verify_summary(G.merge_rows(old, new, "p_partkey"))


VERIFY_COUNTS = "SELECT count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 3 = 0) AS auto_fixed, count(*) FILTER (p_partkey % 4 = 0) AS needs_attention, count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 3 = 0) AS transcribed, count(*) FILTER (p_partkey % 5 = 0) AS corrected FROM part"


def recovered_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """W11."""
    a = _cols(table(spark, sf, "lineitem").filter("l_linenumber % 3 <> 2"), chapter="l_orderkey", page="l_linenumber * 10", y="0", k="l_linenumber").distinct()
    again = _cols(table(spark, sf, "lineitem"), chapter="l_orderkey", page="l_linenumber * 10 + l_suppkey % 25 - 12", y="l_suppkey % 7", k="l_linenumber").distinct()
    return W.recover_gaps(a, again, "chapter", ["page", "y"], "k")


RECOVERED_GAPS = """
WITH a AS (SELECT DISTINCT l_orderkey AS chapter, l_linenumber * 10 AS page, 0 AS y, l_linenumber AS k FROM lineitem WHERE l_linenumber % 3 <> 2),
g AS (SELECT chapter, lag(k) OVER w AS a, k AS b, lag(page) OVER w AS p0, page AS p1 FROM a WINDOW w AS (PARTITION BY chapter ORDER BY page)),
n AS (SELECT DISTINCT l_orderkey AS chapter, l_linenumber * 10 + l_suppkey % 25 - 12 AS page, l_suppkey % 7 AS y, l_linenumber AS k FROM lineitem),
f AS (SELECT n.*, row_number() OVER (PARTITION BY n.chapter, g.a, n.k ORDER BY n.page, n.y) AS r FROM n JOIN g ON n.chapter = g.chapter AND n.k > g.a AND n.k < g.b AND (n.page > p0 OR n.page = p0 AND n.y > 0) AND n.page < p1)
SELECT chapter, page, y, k, false AS recovered FROM a UNION ALL SELECT chapter, page, y, k, true FROM f WHERE r = 1
"""


def label_groups(spark: SparkSession, sf: str) -> DataFrame:
    """W13."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.round("value", 2).alias("y"))
    return W.first_group(e, "user_id", "y", ["event_id"], 22.0)


LABEL_GROUPS = """
WITH RECURSIVE o AS (SELECT user_id, round(value, 2) AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE value IS NOT NULL),
f(user_id, r, starts, sizes) AS (SELECT user_id, r, [y], [CAST(1 AS BIGINT)] FROM o WHERE r = 1
  UNION ALL SELECT o.user_id, o.r, CASE WHEN g IS NULL THEN list_append(starts, o.y) ELSE starts END, CASE WHEN g IS NULL THEN list_append(sizes, CAST(1 AS BIGINT)) ELSE list_transform(sizes, lambda n, i: CASE WHEN i = g THEN n + 1 ELSE n END) END
  FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1, LATERAL (SELECT nullif(list_position([abs(s - o.y) <= 22.0 FOR s IN starts], true), 0) AS g) x)
SELECT user_id, unnest(generate_series(1, len(starts))) AS group_id, unnest(starts) AS start, unnest(sizes) AS n FROM f WHERE r = (SELECT count(*) FROM o WHERE o.user_id = f.user_id)
"""


def spaced_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Three characters a row, apart or not, and a longer line."""
    p = _cols(table(spark, sf, "part"), key="p_partkey", page="p_partkey % 30", top="cast(p_partkey * 100 as double)", gap="cast(p_size as double)")
    cell = lambda i, t: F.struct(F.col("top").alias("y0"), (i * (10 + F.col("gap"))).cast("double").alias("x0"), (i * (10 + F.col("gap")) + 10).cast("double").alias("x1"), (F.col("top") + 10).alias("y1"), F.lit(t).alias("text"))
    lines = p.select("page", F.explode(F.array(cell(0, "习"), cell(1, "题"), cell(2, "册"), cell(9, "一段"))).alias("l")).select("page", "l.*")
    return W.merge_spaced(lines).select("page", "y0", "x0", "text")


SPACED_LINES = """
SELECT p_partkey % 30 AS page, CAST(p_partkey * 100 AS DOUBLE) AS y0, CAST(x AS DOUBLE) AS x0, t AS text FROM part,
LATERAL (SELECT unnest(CASE WHEN p_size < 30 THEN [{'x': 0, 't': '习题册'}] ELSE [{'x': 0, 't': '习'}, {'x': 10 + p_size, 't': '题'}, {'x': 20 + 2 * p_size, 't': '册'}] END || [{'x': 9 * (10 + p_size), 't': '一段'}], recursive := true)) u
"""


def ink_rules(spark: SparkSession, sf: str) -> DataFrame:
    """W19, W20, W21, G6, P15."""
    key = F.col("p_partkey")
    ink = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.when((key + i * i) % 5 < 2, (key + i) % 7 + 1).otherwise(0).cast("int"))
    dark = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.when((i >= F.col("p_size") % 10) & (i < F.col("p_size") % 10 + key % 6), 100).otherwise(key % 50).cast("int"))
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", "p_size", ink.alias("ink"), dark.alias("dark"))
    flags = F.transform("ink", lambda v: v > 0)
    return p.select("p_partkey", W.ink_trim(F.col("ink"), 1).cast("long").alias("trimmed"), W.blank_band_above(F.col("ink"), (key % 30).cast("int")).cast("long").alias("band"), W.longest_true_run(flags).cast("long").alias("run"), G.dark_bar_end(F.col("dark"), F.lit(160), (F.col("p_size") % 10).cast("int")).cast("long").alias("bar"), J.touches_edge(F.col("ink"), F.lit(30), key % 4 == 0).alias("touches"))


INK_RULES = """
WITH c AS (SELECT p_partkey, p_size, unnest(generate_series(0, 29)) AS i FROM part),
v AS (SELECT *, CASE WHEN (p_partkey + i * i) % 5 < 2 THEN (p_partkey + i) % 7 + 1 ELSE 0 END AS v FROM c),
g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, v > 0 ORDER BY i) AS g FROM v),
b AS (SELECT p_partkey, v > 0 AS ink, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY p_partkey, v > 0, g),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY a DESC) AS r FROM b WHERE ink),
t AS (SELECT p_partkey, max(CASE WHEN r = 1 THEN a END) AS a1, max(CASE WHEN r = 1 THEN b END) AS b1, max(CASE WHEN r = 2 THEN a END) AS a2, max(CASE WHEN r = 2 THEN b END) AS b2, max(CASE WHEN r = 3 THEN a END) AS a3, max(CASE WHEN r = 3 THEN b END) AS b3 FROM r GROUP BY 1)
SELECT p.p_partkey, CAST(coalesce(CASE WHEN b1 - a1 < 1 AND a1 - b2 >= 3 THEN CASE WHEN b2 - a2 < 1 AND a2 - b3 >= 3 THEN b3 ELSE b2 END ELSE b1 END, 0) AS BIGINT) AS trimmed,
  CAST(coalesce((SELECT (a + least(b, p.p_partkey % 30) - 1) // 2 FROM b WHERE b.p_partkey = p.p_partkey AND NOT ink AND a < p.p_partkey % 30 ORDER BY a DESC LIMIT 1), 0) AS BIGINT) AS band,
  coalesce((SELECT max(b - a) FROM b WHERE b.p_partkey = p.p_partkey AND ink), 0) AS run, CAST(p_size % 10 + p.p_partkey % 6 AS BIGINT) AS bar,
  p.p_partkey % 4 <> 0 AND ((SELECT sum(v) FROM v WHERE v.p_partkey = p.p_partkey AND i < 3) >= 6 OR (SELECT sum(v) FROM v WHERE v.p_partkey = p.p_partkey AND i >= 27) >= 6) AS touches FROM part p LEFT JOIN t ON t.p_partkey = p.p_partkey
"""


def crop_windows(spark: SparkSession, sf: str) -> DataFrame:
    """G1, G2, G13, O11."""
    key, size = F.col("p_partkey"), F.col("p_size")
    x = G.crop_x(size, 500 + size, F.lit(20), 500 + key % 60, 36, F.lit(560))
    margin = G.first_clean_margin(F.array(size % 2 == 1, size % 3 == 0, size % 5 > 0))
    return table(spark, sf, "part").select("p_partkey", x["x0"].cast("long").alias("x0"), x["x1"].cast("long").alias("x1"), margin.cast("long").alias("margin"), G.exam_bottom(key % 300 + 100, key % 170).cast("long").alias("bottom"))


CROP_WINDOWS = """
SELECT p_partkey, CAST(greatest(least(p_size, 20) - 36, 0) AS BIGINT) AS x0, CAST(least(greatest(500 + p_size, 500 + p_partkey % 60) + 36, 560) AS BIGINT) AS x1,
  CAST(CASE WHEN p_size % 2 = 0 THEN 36 WHEN p_size % 3 > 0 THEN 76 ELSE 116 END AS BIGINT) AS margin, CAST(CASE WHEN p_partkey % 300 + 95 - p_partkey % 170 > 70 THEN p_partkey % 170 + 18 ELSE p_partkey % 300 + 95 END AS BIGINT) AS bottom FROM part
"""


def saved_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """G10, O7."""
    boxes = _box_rows(spark, sf)
    edits = boxes.filter("problem_id % 4 = 1").withColumn("boxes", F.reverse(F.transform("boxes", lambda b: b.withField("y0", (b["y0"] + 1).cast("int")))))
    s = G.save_boxes(boxes, edits)
    return s.select("problem_id", A.joined(F.transform("boxes", lambda b: F.concat_ws(":", b["page"], b["y0"]))).alias("boxes"), "stale_text", A.joined("flags").alias("flags"))


SAVED_BOXES = f"""
SELECT problem_id, string_agg(page || ':' || y, ',' ORDER BY page, y0, y1, x0, x1) AS boxes, problem_id % 4 = 1 AS stale_text, CASE WHEN problem_id % 4 = 1 THEN 'manual' ELSE '' END AS flags
FROM (SELECT *, y0 + CASE WHEN problem_id % 4 = 1 THEN 1 ELSE 0 END AS y FROM ({_BOX_SQL})) GROUP BY problem_id
"""

_EDITS = [[("下边到", 300)], [("上边到", 130), ("上边到", 90)], [("续下一页", None), ("下边到", 400)], [("续下一页", None), ("去掉续页", None)], []]


def edited_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """G11."""
    key = F.col("p_partkey")
    ops = F.element_at(F.array(*[F.array(*[F.struct(F.lit(o).alias("op"), F.lit(y).cast("int").alias("y")) for o, y in e]).cast("array<struct<op:string,y:int>>") for e in _EDITS]), (key % 5 + 1).cast("int"))
    box = F.struct(F.lit(1).alias("page"), F.lit(100).alias("y0"), (200 + F.col("p_size")).cast("int").alias("y1"), F.lit(0).alias("x0"), F.lit(50).alias("x1"))
    rows = table(spark, sf, "part").select("p_partkey", F.array(box).cast(f"array<{G.BOX}>").alias("boxes"), ops.alias("ops"), F.when(key % 2 == 0, (key % 200).cast("int")).alias("next_top"), F.lit(1000).alias("page_height"))
    ink = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: ((i + key) % 80 < 61).cast("int"))
    return G.apply_operations(rows).select("p_partkey", A.joined(F.transform("boxes", lambda b: F.concat_ws(":", b["page"], b["y0"], b["y1"]))).alias("boxes"), G.snap_down(ink, F.lit(10)).cast("long").alias("snapped"))


EDITED_BOXES = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1:100:308' WHEN 1 THEN '1:82:' || 200 + p_size WHEN 2 THEN '1:100:408' || more WHEN 3 THEN '1:100:' || 200 + p_size ELSE '1:100:' || 200 + p_size END AS boxes,
  CAST(CASE WHEN (10 + p_partkey) % 80 >= 61 THEN 10 WHEN 61 - (10 + p_partkey) % 80 <= 60 THEN 10 + 61 - (10 + p_partkey) % 80 ELSE 10 END AS BIGINT) AS snapped
FROM (SELECT *, CASE WHEN p_partkey % 2 = 1 THEN ',2:60:940' WHEN p_partkey % 200 - 6 - 60 > 20 THEN ',2:60:' || p_partkey % 200 - 6 ELSE '' END AS more FROM part)
"""


def figure_moves(spark: SparkSession, sf: str) -> DataFrame:
    """G3, G5."""
    seg = _cols(table(spark, sf, "part"), chapter="p_partkey % 5", pid="p_partkey", page="p_partkey % 20", y0="p_size * 10", y1="p_size * 10 + 100", ink_only="p_partkey % 2 = 0")
    caps = _cols(table(spark, sf, "supplier"), chapter="s_suppkey % 5", pid="s_suppkey * 3", page="s_suppkey % 20", y="s_suppkey * 29 % 600")
    own = G.own_figures_after(seg.drop("chapter", "ink_only"), caps.withColumn("pid", F.col("page") + 20 * F.floor(F.col("pid") / 60)).drop("chapter")).groupBy("pid").agg(F.count(F.lit(1)).alias("own"))
    return G.reassign_figures(seg, caps).select("pid", "action", "owner").join(own, "pid", "left")


FIGURE_MOVES = """
WITH s AS (SELECT p_partkey % 5 AS chapter, p_partkey AS pid, p_partkey % 20 AS page, p_size * 10 AS y0, p_size * 10 + 100 AS y1, p_partkey % 2 = 0 AS ink_only FROM part),
c AS (SELECT s_suppkey % 5 AS chapter, s_suppkey * 3 AS pid, s_suppkey % 20 AS page, s_suppkey * 29 % 600 AS y, s_suppkey % 20 + 20 * (s_suppkey * 3 // 60) AS own FROM supplier),
n AS (SELECT s.pid, ink_only, count(DISTINCT c.pid) AS n, min(c.pid) AS named FROM s LEFT JOIN c ON s.chapter = c.chapter AND s.page = c.page AND c.y BETWEEN y0 AND y1 AND c.pid <> s.pid GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN n = 0 THEN 'keep' WHEN n > 1 THEN 'unresolved' WHEN ink_only THEN 'move' ELSE 'copy' END AS action FROM n)
SELECT a.pid, action, unnest(CASE action WHEN 'move' THEN [named] WHEN 'copy' THEN [a.pid, named] ELSE [a.pid] END) AS owner, (SELECT CASE WHEN count(*) > 0 THEN CAST(1 AS BIGINT) END FROM s JOIN c ON c.own = s.pid AND c.page = s.page AND c.y BETWEEN s.y0 AND s.y1 WHERE s.pid = a.pid) AS own FROM a
"""


def free_sides(spark: SparkSession, sf: str) -> DataFrame:
    """G4."""
    lines = _cols(table(spark, sf, "part"), page="p_partkey % 25", y0="p_partkey", y1="p_partkey + p_size % 25", x1="p_size * 16")
    return G.side_figures(lines, F.lit(800)).select("page", "y0", "y1", "x_free", "n")


FREE_SIDES = """
WITH l AS (SELECT p_partkey % 25 AS page, p_partkey AS y0, p_partkey + p_size % 25 AS y1, p_size * 16 AS x1 FROM part WHERE p_size * 16 < 480),
m AS (SELECT *, CASE WHEN y0 - lag(y1) OVER (PARTITION BY page ORDER BY y0) < 30 THEN 0 ELSE 1 END AS new FROM l), r AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y0) AS run FROM m)
SELECT page, min(y0) AS y0, max(y1) AS y1, max(x1) AS x_free, count(*) AS n FROM r GROUP BY page, run HAVING count(*) >= 3
"""


def split_figures(spark: SparkSession, sf: str) -> DataFrame:
    """G4."""
    seg = _cols(table(spark, sf, "part"), pid="p_partkey", page="p_partkey % 30", y0="p_partkey % 7 * 100", y1="p_partkey % 7 * 100 + 60 + p_size")
    fig = _cols(table(spark, sf, "nation"), page="n_nationkey", f0="n_regionkey * 100 + 50", f1="n_regionkey * 100 + 250", xf="400", left="20", right="780", owner="case when n_nationkey % 2 = 0 then n_nationkey + 30 * n_regionkey else -n_nationkey end")
    return G.split_side_figures(seg, fig)


SPLIT_FIGURES = """
WITH s AS (SELECT p_partkey AS pid, p_partkey % 30 AS page, p_partkey % 7 * 100 AS y0, p_partkey % 7 * 100 + 60 + p_size AS y1 FROM part),
f AS (SELECT n_nationkey AS page, n_regionkey * 100 + 50 AS f0, n_regionkey * 100 + 250 AS f1, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 30 * n_regionkey ELSE -n_nationkey END AS owner FROM nation),
m AS (SELECT s.*, f0, f1, owner FROM s JOIN f ON s.page = f.page AND y0 < f1 AND y1 > f0), c AS (SELECT page, count(DISTINCT pid) AS n, bool_or(pid = owner) AS own FROM m GROUP BY page HAVING count(DISTINCT pid) >= 2),
h AS (SELECT m.* FROM m JOIN c ON m.page = c.page), k AS (SELECT *, CASE WHEN pid = owner THEN 'side_figure' ELSE 'side_figure_removed' END AS flag FROM h)
SELECT pid, page, y0, y1, CAST(NULL AS BIGINT) AS x0, CAST(NULL AS BIGINT) AS x1, CAST(NULL AS VARCHAR) AS flag FROM s WHERE pid NOT IN (SELECT pid FROM h)
UNION ALL SELECT pid, page, y0, f0, NULL, NULL, flag FROM k WHERE f0 - y0 > 8 UNION ALL SELECT pid, page, greatest(y0, f0), least(y1, f1), 20, 400, flag FROM k
UNION ALL SELECT pid, page, f0, f1, 400, 780, flag FROM k WHERE pid = owner UNION ALL SELECT pid, page, f1, y1, NULL, NULL, flag FROM k WHERE y1 - f1 > 8
UNION ALL SELECT owner, f.page, f0, f1, 400, 780, 'side_figure' FROM f JOIN c ON c.page = f.page WHERE NOT own
"""


def exam_pages(spark: SparkSession, sf: str) -> DataFrame:
    """G14, G15, X3."""
    chapters = _cols(table(spark, sf, "nation"), chapter="n_nationkey", start_page="n_nationkey * 3", end_page="n_nationkey * 3 + n_regionkey")
    each = G.page_per_problem(chapters).select("problem_id", F.col("page").cast("long").alias("page"))
    exam = G.exam_layout(spark).select(F.concat_ws(".", F.lit("exam"), "section", "number").alias("problem_id"), F.col("page").cast("long").alias("page"))
    stages = G.stage_settings(spark.createDataFrame([("draft",), ("crop_fix",), ("other",)], "stage string")).select(F.concat_ws(".", "stage", "resolution").alias("problem_id"), F.col("budget").cast("long").alias("page"))
    return each.unionByName(exam).unionByName(stages)


EXAM_PAGES = """
SELECT n_nationkey || '.' || i + 1 AS problem_id, CAST(n_nationkey * 3 + i AS BIGINT) AS page FROM nation, LATERAL (SELECT unnest(generate_series(0, n_regionkey)) AS i) x
UNION ALL SELECT 'exam.' || s || '.' || n, p FROM (SELECT unnest([1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4, 4, 4, 4]) AS s, unnest([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 6, 1, 2, 3, 4]) AS n, unnest([1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]) AS p)
UNION ALL VALUES ('draft.MEDIUM', 8000), ('crop_fix.HIGH', 8000), ('other.MEDIUM', 8000)
"""


def located_pages(spark: SparkSession, sf: str) -> DataFrame:
    """X8, J10, U3."""
    samples = _cols(table(spark, sf, "nation"), printed="cast(n_nationkey * 12 as int)", pdf="cast(n_nationkey * 12 + 5 + n_nationkey % 3 as int)")
    ranges = _cols(table(spark, sf, "nation").filter("n_nationkey % 3 = 1"), seq="cast(n_nationkey as int)", start="cast(n_nationkey * 12 + 4 as int)", end="case when n_nationkey % 2 = 0 then cast(n_nationkey * 12 + 7 as int) end")
    return G.page_mapping(samples, ranges, 320)


LOCATED_PAGES = """
WITH s AS (SELECT n_nationkey * 12 AS printed, 5 + n_nationkey % 3 AS off FROM nation WHERE n_nationkey * 12 > 5 AND n_nationkey * 12 + 5 + n_nationkey % 3 BETWEEN 1 AND 320),
r AS (SELECT n_nationkey * 12 + 4 AS a, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 12 + 7 ELSE n_nationkey * 12 + 8 END AS b FROM nation WHERE n_nationkey % 3 = 1),
m AS (SELECT a, b, (SELECT off FROM s ORDER BY abs(printed - a), printed LIMIT 1) AS off FROM r)
SELECT DISTINCT CAST(p AS INTEGER) AS page FROM m, LATERAL (SELECT unnest(generate_series(greatest(1, a + off - 3), least(320, b + off + 3))) AS p) x WHERE a + off BETWEEN 1 AND 320
"""


def picks(spark: SparkSession, sf: str) -> DataFrame:
    """O8, O9, O10, O11, O12."""
    items = _cols(table(spark, sf, "part"), key="p_partkey", page="p_partkey % 100 + 1", y0="p_partkey", parts="p_size % 3", height="p_partkey * 7919 % 100003")
    pick = G.stratified_pick(items).select("key", F.concat(F.lit("sample "), "rank").alias("what"))
    tasks = _cols(table(spark, sf, "nation"), name="n_name", scope="case when n_regionkey = 2 then 'book' else 'chapter' end", weight="n_nationkey % 4")
    last = G.compile_order(tasks).limit(4).select(F.col("weight").alias("key"), F.lit("compiled").alias("what"))
    first = G.keep_first(items, "page", ["y0"]).filter("page <= 20").select("key", F.lit("first").alias("what"))
    events = views.last_events(_cols(table(spark, sf, "events"), key="event_id", ts="ts"), 14).select("key", F.lit("event").alias("what"))
    order = _cols(table(spark, sf, "nation"), chapter="case when n_nationkey % 6 = 5 then n_name else cast(n_nationkey * 7 % 25 as string) end", key="n_nationkey")
    place = F.row_number().over(Window.orderBy(*G.chapter_order())).cast("string")  # a row per chapter
    return pick.unionByName(last).unionByName(first).unionByName(events).unionByName(order.select("key", F.concat(F.lit("place "), place).alias("what")))


PICKS = """
WITH i AS (SELECT p_partkey AS key, p_partkey % 100 + 1 AS page, p_partkey AS y0, p_size % 3 AS parts, p_partkey * 7919 % 100003 AS height FROM part),
s AS (SELECT (SELECT key FROM i WHERE page % 2 = 1 ORDER BY page, y0 LIMIT 1) AS key, 0 AS r UNION ALL SELECT (SELECT key FROM i WHERE page % 2 = 0 ORDER BY page, y0 LIMIT 1), 1
  UNION ALL SELECT (SELECT key FROM i WHERE parts > 1 ORDER BY page, y0 LIMIT 1), 2 UNION ALL SELECT (SELECT key FROM i ORDER BY height DESC, page LIMIT 1), 3)
SELECT key, 'sample ' || min(r) AS what FROM s GROUP BY key
UNION ALL SELECT * FROM (SELECT n_nationkey % 4, 'compiled' FROM nation ORDER BY n_regionkey <> 2, n_nationkey % 4 DESC, n_name LIMIT 4)
UNION ALL SELECT min(key), 'first' FROM i WHERE page <= 20 GROUP BY page
UNION ALL SELECT * FROM (SELECT event_id, 'event' FROM events ORDER BY ts DESC LIMIT 14)
UNION ALL SELECT key, 'place ' || row_number() OVER (ORDER BY TRY_CAST(c AS INTEGER) NULLS LAST, c) FROM (SELECT n_nationkey AS key, CASE WHEN n_nationkey % 6 = 5 THEN n_name ELSE CAST(n_nationkey * 7 % 25 AS VARCHAR) END AS c FROM nation)
"""


def merged_reports(spark: SparkSession, sf: str) -> DataFrame:
    """U5."""
    key = F.col("p_partkey")
    both = G.merge_maps(F.create_map(F.lit("a"), key, F.lit("b"), key + 1), F.when(key % 2 == 0, F.create_map(F.lit("b"), key * 2, F.lit("c"), key * 3)).otherwise(F.create_map(F.lit("d"), key)))
    return table(spark, sf, "part").select("p_partkey", *[both[c].alias(c) for c in "abcd"])


MERGED_REPORTS = "SELECT p_partkey, p_partkey AS a, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 2 ELSE p_partkey + 1 END AS b, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 3 END AS c, CASE WHEN p_partkey % 2 = 1 THEN p_partkey END AS d FROM part"


def scanned_pages(spark: SparkSession, sf: str) -> DataFrame:
    """S5, S6, S7, S10."""
    spans = _cols(table(spark, sf, "lineitem"), page="l_orderkey % 60", line="l_suppkey", seq="struct(l_linenumber * 1000000 + l_partkey, l_returnflag)", x0="cast(l_partkey % 100 as double)", x1="cast(l_partkey % 100 + 30 as double)", y0="cast(l_suppkey as double)", y1="cast(l_suppkey + 9 as double)", text="case when l_linenumber > 2 then concat(l_returnflag, ' ') else ' ' end")
    lines = tables.scaled_lines(spans, 144).withColumn("W", F.lit(300)).withColumn("med_h", F.lit(18.0))
    again = tables.lines_to_recognise(lines).groupBy("page").agg(F.count(F.lit(1)).alias("again"))
    whole = lines.groupBy("page").agg(F.sum("x1").alias("reach"), F.sum(F.length("text")).cast("long").alias("chars"))
    pages = tables.pages_to_scan(whole.select("page"), whole.filter("page % 7 = 0").select("page"), only=whole.filter("page > 5").select("page"), skip=whole.filter("page % 11 = 0").select("page")).withColumn("scan", F.lit(True))
    routed = tables.route(whole.select("page", F.when(F.col("page") % 2 == 0, "exam").otherwise("book").alias("doc_type"), (F.col("page") % 3 == 0).alias("has_text")))
    return whole.join(again, "page", "left").join(pages, "page", "left").join(routed.select("page", "reader"), "page")


SCANNED_PAGES = """
WITH l AS (SELECT l_orderkey % 60 AS page, l_suppkey AS line, min(l_partkey % 100) * 2.0 AS x0, max(l_partkey % 100 + 30) * 2.0 AS x1, string_agg(CASE WHEN l_linenumber > 2 THEN l_returnflag || ' ' ELSE ' ' END, '' ORDER BY l_linenumber * 1000000 + l_partkey, l_returnflag) AS t FROM lineitem GROUP BY 1, 2),
k AS (SELECT page, x0, x1, trim(t, ' ') AS t FROM l WHERE trim(t, ' ') <> '')
SELECT page, CAST(sum(x1) AS DOUBLE) AS reach, CAST(sum(length(t)) AS BIGINT) AS chars, nullif(count(*) FILTER (x1 - x0 <= 105), 0) AS again, CASE WHEN page > 5 AND page % 7 <> 0 AND page % 11 <> 0 THEN true END AS scan,
  CASE WHEN page % 2 = 1 THEN 'book' WHEN page % 3 = 0 THEN 'exam_text' ELSE 'exam_scan' END AS reader FROM k GROUP BY page
"""


_CACHES = ['[{"x0": <k>, "text": "a<k>"}]', '{"deep": true, "lines": [{"x0": 1, "text": "b"}, {"text": "c"}]}', '{"lines": []}', '{"deep": true, "lines": ', "[]", "null"]


def cached_pages(spark: SparkSession, sf: str) -> DataFrame:
    """S6, S7."""
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.replace(_case(F.col("p_partkey"), _CACHES), F.lit("<k>"), F.col("p_size").cast("string")).alias("value"))
    cached = tables.cached_lines(files)
    todo = tables.pages_to_scan(files.select("page"), cached).withColumn("scan", F.lit(True))
    return files.select("page").join(cached, "page", "left").join(todo, "page", "left").select("page", "deep", F.when(F.col("lines").isNotNull(), F.size("lines")).cast("long").alias("n"), F.get("lines", F.lit(0))["text"].alias("first"), "scan")


CACHED_PAGES = f"""
SELECT p_partkey AS page, {_pick([True, True, False, None, True, None])} AS deep, CAST({_pick([1, 2, 0, None, 0, None])} AS BIGINT) AS n, CASE p_partkey % 6 WHEN 0 THEN 'a' || p_size WHEN 1 THEN 'b' END AS first, CASE WHEN p_partkey % 6 IN (3, 5) THEN true END AS scan FROM part
"""


def item_segments(spark: SparkSession, sf: str) -> DataFrame:
    """W9."""
    anchors = _cols(table(spark, sf, "part"), doc="p_partkey % 4", pid="p_partkey", ch="p_partkey * 7 % 60 div 9", page="p_partkey * 7 % 60", y="p_size * 10", ink="case when p_partkey % 3 > 0 then p_size * 10 + p_partkey % 900 end")
    pages = _cols(spark.range(240), doc="id % 4", page="id div 4", header_cut="30", footer_cut="950", H="1000", flag="case when id div 4 % 13 = 5 then 'stop' end").filter("page % 17 > 0")
    return W.item_segments(anchors.filter("page % 17 > 0"), pages)


ITEM_SEGMENTS = """
WITH a AS (SELECT p_partkey % 4 AS doc, p_partkey AS pid, p_partkey * 7 % 60 // 9 AS ch, p_partkey * 7 % 60 AS page, p_size * 10 AS y, CASE WHEN p_partkey % 3 > 0 THEN p_size * 10 + p_partkey % 900 ELSE 950 END AS bottom FROM part WHERE p_partkey * 7 % 60 % 17 > 0),
n AS (SELECT *, lead(page) OVER w AS np, lead(y) OVER w AS ny, lead(ch) OVER w AS nc FROM a WINDOW w AS (PARTITION BY doc ORDER BY page, y, pid)),
o AS (SELECT *, coalesce(nc = ch, false) AS same FROM n WHERE (np IS NULL OR np <> page) AND bottom >= 870 AND page + 1 < 60 AND (page + 1) % 17 > 0),
s AS (SELECT o.*, q FROM o, LATERAL (SELECT unnest(generate_series(page + 1, np)) AS q) x WHERE same AND q % 17 > 0),
c AS (SELECT *, (SELECT min(t.q) FROM s t WHERE t.pid = s.pid AND t.q % 13 = 5 AND t.q < t.np) AS stop FROM s)
SELECT doc, pid, page, CAST(y AS DOUBLE) AS y0, CAST(CASE WHEN np = page THEN ny ELSE bottom END AS DOUBLE) AS y1, CAST(NULL AS VARCHAR) AS flag FROM n
UNION ALL SELECT doc, pid, q, 30.0, 950.0, 'stitch_mid_page' FROM c WHERE q < np AND (stop IS NULL OR q < stop)
UNION ALL SELECT doc, pid, q, 30.0, CAST(ny AS DOUBLE), 'stitched' FROM c WHERE q = np AND stop IS NULL AND ny - 30 > 12
UNION ALL SELECT doc, pid, page + 1, 30.0, 950.0, 'stitched_tail' FROM o WHERE NOT same AND (page + 1) % 13 <> 5 AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc = o.doc AND a.page = o.page + 1)
"""


def text_layers(spark: SparkSession, sf: str) -> DataFrame:
    """S8, S9, S11, S14, K8."""
    pages = _cols(table(spark, sf, "part"), pno="p_partkey", n_chars="p_size * 2")
    layers = tables.has_text_layer(pages).select(F.lit("layer").alias("what"), F.col("has_text").cast("string").alias("value")).unionByName(tables.has_text_layer(pages, 1, 4).select(F.lit("first").alias("what"), F.col("has_text").cast("string").alias("value")))
    files = _cols(table(spark, sf, "nation"), project="n_regionkey", name="case when n_nationkey % 5 < 2 then concat('Print_', n_name) else n_name end")
    originals = tables.original_files(files, ("Print_",)).select(F.concat(F.lit("file "), "project").alias("what"), F.col("name").alias("value"))
    toc = _cols(table(spark, sf, "nation"), seq="n_nationkey", title="n_name", page="n_nationkey * 7 % 25")
    marks = tables.bookmark_ranges(toc, "^[A-K]").select(F.concat(F.lit("toc "), "seq").alias("what"), F.concat_ws("-", "start", "end").alias("value"))
    kept, rest = sinks.set_aside(files.withColumnRenamed("project", "chapter"), spark.createDataFrame([(1,), (2,)], "chapter int"))
    aside = kept.select(F.lit("kept").alias("what"), F.col("name").alias("value")).unionByName(rest.select(F.lit("aside").alias("what"), F.col("name").alias("value")))
    return layers.unionByName(originals).unionByName(marks).unionByName(aside)


TEXT_LAYERS = """
WITH f AS (SELECT n_regionkey AS project, CASE WHEN n_nationkey % 5 < 2 THEN 'Print_' || n_name ELSE n_name END AS name FROM nation), t AS (SELECT n_nationkey AS seq, n_name AS title, n_nationkey * 7 % 25 AS page FROM nation)
SELECT 'layer' AS what, CAST((SELECT sum(n) > 40 * count(*) FROM (SELECT p_size * 2 AS n FROM part WHERE p_partkey % 7 = 0 ORDER BY p_partkey LIMIT 12)) AS VARCHAR) AS value
UNION ALL SELECT 'first', CAST((SELECT sum(n) > 40 * count(*) FROM (SELECT p_size * 2 AS n FROM part ORDER BY p_partkey LIMIT 4)) AS VARCHAR)
UNION ALL SELECT 'file ' || project, arg_min(name, (name LIKE 'Print_%', name)) FROM f GROUP BY project
UNION ALL SELECT 'toc ' || seq, page || '-' || coalesce((SELECT arg_min(b.page, b.seq) FROM t b WHERE b.seq > a.seq AND b.page > a.page), a.page + 6) FROM t a WHERE regexp_matches(title, '^[A-K]')
UNION ALL SELECT CASE WHEN project IN (1, 2) THEN 'kept' ELSE 'aside' END, name FROM f
"""


def document_classes(spark: SparkSession, sf: str) -> DataFrame:
    """P23."""
    pages = _cols(table(spark, sf, "orders"), doc="o_custkey", page="o_orderkey", text="concat(o_orderpriority, o_orderstatus)")
    return J.document_class(pages, {"urgent": ["URGENT", "HIGH"], "calm": ["LOW", "MEDIUM"], "final": ["F"]}).select("doc", "class", F.col("score").cast("long").alias("score"))


DOCUMENT_CLASSES = """
WITH s AS (SELECT o_custkey AS doc, sum(CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 1 ELSE 0 END + CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 1 ELSE 0 END) AS urgent, sum(CASE WHEN o_orderpriority LIKE '%LOW%' THEN 1 ELSE 0 END + CASE WHEN o_orderpriority LIKE '%MEDIUM%' THEN 1 ELSE 0 END) AS calm,
  sum(CASE WHEN o_orderpriority || o_orderstatus LIKE '%F%' THEN 1 ELSE 0 END) AS final FROM orders GROUP BY 1)
SELECT doc, CASE greatest(urgent, calm, final) WHEN calm THEN 'calm' WHEN final THEN 'final' ELSE 'urgent' END AS class, CAST(greatest(urgent, calm, final) AS BIGINT) AS score FROM s
"""


def chapter_files(spark: SparkSession, sf: str) -> DataFrame:
    """A11, J1, K4, F21, F22."""
    pid = F.concat_ws(".", F.col("l_orderkey") % 40, "l_linenumber")
    problems = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 40).alias("chapter"), pid.alias("problem_id")).distinct()
    k = F.split_part("problem_id", F.lit("."), F.lit(2)).cast("int")
    slots = problems.filter(k != 3).select("problem_id", F.concat(F.lit("### 解 "), "problem_id").alias("final"), F.lit(None).cast("string").alias("stage3"), F.when(k % 2 == 0, F.lit("速")).alias("compact"), *[F.lit(None).cast("string").alias(c) for c in ("compact_breakdown", "stage3_deduction", "stage2")], F.when(k == 4, "needs_review").otherwise("passed").alias("status"), F.lit(1).alias("score"))
    md = views.chapter_markdown(problems, slots)
    return md.select("chapter", F.md5("all").alias("all"), F.md5("compact").alias("compact"))


CHAPTER_FILES = """
WITH p AS (SELECT DISTINCT l_orderkey % 40 AS chapter, l_linenumber AS k FROM lineitem WHERE l_linenumber <> 3),
t AS (SELECT *, '## 习题 ' || chapter || '.' || k || chr(10) || chr(10) || CASE WHEN k = 4 THEN '> 待人工复核' || chr(10) || chr(10) ELSE '' END AS head FROM p)
SELECT chapter, md5(string_agg(head || '#### 解 ' || chapter || '.' || k || chr(10) || chr(10), '' ORDER BY k)) AS "all", md5(string_agg(head || '速' || chr(10) || chr(10), '' ORDER BY k) FILTER (k % 2 = 0)) AS compact FROM t GROUP BY chapter
"""


def anchors_found(spark: SparkSession, sf: str) -> DataFrame:
    """Books of four pages' walks with numbers that are next, ahead, behind or of another chapter."""
    key = F.col("l_orderkey")
    row = F.row_number().over(Window.partitionBy("doc").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf, "lineitem").withColumn("doc", key % 97).withColumn("r", row)
    chapter, number = F.floor(F.col("r") / 40) + 1, (F.col("r") % 40) / 2 + F.col("l_suppkey") % 3
    text = F.when(F.col("l_quantity") > 48, "习题").when(F.col("l_quantity") < 2, "参考答案").when(F.col("l_quantity") < 4, "正文").when(F.col("doc") % 2 == 0, F.concat(chapter.cast("int"), F.lit("."), F.floor(number).cast("int"), F.lit("节"))).otherwise(F.concat(F.floor(number).cast("int"), F.lit("、求")))
    lines = rows.select("doc", F.floor(F.col("r") / 8).cast("int").alias("page"), F.col("r").cast("double").alias("y0"), F.lit(50.0).alias("x0"), F.lit(800.0).alias("W"), text.alias("text"), F.lit(False).alias("exam"), F.lit(None).cast("int").alias("page_chapter"))
    lines = lines.withColumn("kind", F.when(F.col("text") == "习题", "heading").when(F.col("text") == "参考答案", "stop"))
    flags = lines.groupBy("doc", "page").agg(F.max(F.when(F.col("kind") == "heading", "heading")).alias("h"), F.max("kind").alias("k")).select("doc", "page", F.coalesce("h", "k").alias("page_kind"))
    return W.find_anchors(lines.join(flags, ["doc", "page"]), chapter_digits=9).select("doc", F.col("y0").cast("long").alias("r"), "ch", "k", A.joined("gap").alias("gap"))


ANCHORS_FOUND = """
WITH RECURSIVE n AS (SELECT l_orderkey % 97 AS doc, l_quantity AS q, l_suppkey % 3 AS s, row_number() OVER (PARTITION BY l_orderkey % 97 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem),
l AS (SELECT doc, r, r // 8 AS page, CASE WHEN q > 48 THEN 'heading' WHEN q < 2 THEN 'stop' END AS kind, CASE WHEN q > 48 OR q < 4 THEN NULL ELSE CAST(floor(r % 40 / 2.0 + s) AS INTEGER) END AS k, CAST(r // 40 + 1 AS INTEGER) AS c FROM n),
m AS (SELECT *, max(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page) = 1 AS heads, max(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page) = 1 AS stops, page <> lag(page, 1, -1) OVER (PARTITION BY doc ORDER BY r) AS turn FROM l),
f(doc, r, walking, start, empty, found, flag, page, inside, hp, last, want, plain, walks, ch, k, gap) AS (
  SELECT doc, CAST(0 AS BIGINT), false, CAST(-1 AS BIGINT), 0, 0, false, CAST(-1 AS BIGINT), false, CAST(-99 AS BIGINT), 0, 1, 1, 0, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), '' FROM (SELECT DISTINCT doc FROM m)
  UNION ALL
  SELECT m.doc, m.r, t.walking, t.start, t.empty, t.found + CASE WHEN y.ch IS NULL THEN 0 ELSE 1 END, m.stops AND NOT m.heads, m.page,
    CASE WHEN NOT t.walking THEN t.inside WHEN m.kind = 'heading' THEN true WHEN m.kind = 'stop' THEN false ELSE t.inside END, CASE WHEN t.walking AND m.kind = 'heading' THEN m.page ELSE f.hp END,
    CASE WHEN y.ch IS NOT NULL AND m.doc % 2 = 0 THEN y.ch ELSE f.last END, CASE WHEN y.ch IS NOT NULL AND m.doc % 2 = 0 THEN y.k + 1 ELSE f.want END,
    CASE WHEN y.ch IS NOT NULL AND m.doc % 2 = 1 THEN y.k + 1 ELSE u.pw END, t.walks, y.ch, y.k, y.gap
  FROM f JOIN m ON m.doc = f.doc AND m.r = f.r + 1,
  LATERAL (SELECT CASE WHEN m.turn AND f.walking THEN CASE WHEN f.found > 0 THEN 0 ELSE f.empty + 1 END ELSE f.empty END AS e) a,
  LATERAL (SELECT m.turn AND f.walking AND (f.page <> f.start AND f.flag OR a.e >= 2) AS over) b,
  LATERAL (SELECT m.turn AND m.heads AND (NOT f.walking OR b.over) AS starts) c,
  LATERAL (SELECT f.walking AND NOT b.over OR c.starts AS walking, CASE WHEN c.starts THEN m.page ELSE f.start END AS start, CASE WHEN c.starts THEN 0 ELSE a.e END AS empty, CASE WHEN m.turn THEN 0 ELSE f.found END AS found,
    f.inside AND NOT b.over AS inside, f.walks + CASE WHEN c.starts THEN 1 ELSE 0 END AS walks) t,
  LATERAL (SELECT t.walking AND t.inside AND m.kind IS NULL AND m.k IS NOT NULL AS live, CASE WHEN c.starts THEN 1 ELSE f.plain END AS pw, CASE WHEN m.k >= 10 THEN [m.k, m.k // 10] ELSE [m.k] END AS cands, m.page - f.hp <= 1 AS near) u,
  LATERAL (SELECT list_filter(u.cands, lambda x: x > f.want AND x <= f.want + 2)[1] AS ahead) v,
  LATERAL (SELECT CASE WHEN NOT u.live THEN NULL WHEN m.doc % 2 = 0 THEN CASE WHEN m.c = f.last AND list_contains(u.cands, f.want) THEN f.want WHEN m.c = f.last AND v.ahead IS NOT NULL THEN v.ahead WHEN list_contains(u.cands, 1) AND u.near THEN 1 END
    WHEN m.k BETWEEN u.pw AND u.pw + 2 OR m.k = 1 AND u.near THEN m.k END AS k) x,
  LATERAL (SELECT CASE WHEN x.k IS NULL THEN NULL WHEN m.doc % 2 = 0 THEN m.c ELSE t.walks END AS ch, x.k AS k,
    CASE WHEN x.k IS NULL THEN '' WHEN m.doc % 2 = 1 THEN CASE WHEN x.k > u.pw THEN array_to_string(generate_series(u.pw, x.k - 1), ',') ELSE '' END
      WHEN m.c = f.last AND NOT list_contains(u.cands, f.want) AND v.ahead IS NOT NULL THEN array_to_string(generate_series(f.want, x.k - 1), ',') ELSE '' END AS gap) y
)
SELECT doc, r, ch, k, gap FROM f WHERE ch IS NOT NULL
"""
