"""Queries over boxes, set operations, order and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import sequences as W
from ..sources import sinks, tables
from ..sources.tables import table


def chapter_notes(spark: SparkSession, sf: str) -> DataFrame:
    """A21 over the chapter report."""
    return A.notes(A.chapter_report(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").withColumn("missing", F.array_sort("missing")))


CHAPTER_NOTES = """
WITH k AS (SELECT l_orderkey AS chapter, l_linenumber AS k, count(*) AS c FROM lineitem GROUP BY 1, 2),
g AS (SELECT chapter, max(k) AS last, list(k ORDER BY k) AS seen, string_agg(CASE WHEN c > 1 THEN CAST(k AS VARCHAR) END, '、' ORDER BY k) AS twice FROM k GROUP BY 1),
m AS (SELECT g.chapter, string_agg(CAST(s.i AS VARCHAR), '、' ORDER BY s.i) AS missing FROM g, LATERAL (SELECT unnest(generate_series(1, g.last)) AS i) s
      WHERE NOT list_contains(g.seen, s.i) GROUP BY 1)
SELECT * FROM (SELECT g.chapter, concat_ws('；', '缺号 ' || missing, '重复 ' || twice) AS note FROM g LEFT JOIN m ON g.chapter = m.chapter) WHERE note <> ''
"""


def coverage_message(spark: SparkSession, sf: str) -> DataFrame:
    return A.coverage_message(A.chapter_report(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber"))


COVERAGE_MESSAGE = """
SELECT '第' || min(c) || '-' || max(c) || '章，' || count(*) || '章共' || CAST(sum(n) AS BIGINT) || '题' AS message FROM (SELECT l_orderkey AS c, count(*) AS n FROM lineitem GROUP BY 1)
"""


def crop_check_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return A.check_estimate(table(spark, sf, "lineitem").select((F.col("l_partkey") % 300).alias("page")))


CROP_CHECK_ESTIMATE = "SELECT pages, slices, pages * 2600 + slices * 1100 AS tokens FROM (SELECT count(DISTINCT l_partkey % 300) AS pages, count(*) AS slices FROM lineitem)"


def fix_summary(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "part").select(F.col("p_partkey").alias("problem_id"), F.lit("old").alias("boxes"))
    after = before.filter("problem_id % 2 = 0").withColumn("boxes", F.lit("new"))
    verdicts = before.filter("problem_id % 3 <> 1").select("problem_id", (F.col("problem_id") % 4 == 0).alias("ok"))
    return A.by_status(G.keep_or_revert(before, after, verdicts))


FIX_SUMMARY = """
SELECT CASE WHEN p_partkey % 2 = 1 THEN 'unchanged' WHEN p_partkey % 3 <> 1 AND p_partkey % 4 = 0 THEN 'fixed' ELSE 'reverted' END AS status, count(*) AS n FROM part GROUP BY 1
"""


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return A.repeated(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATES = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    i = lambda c: c.cast("int")
    box = F.struct(i(F.col("l_partkey") % 200).alias("page"), i(F.col("l_linenumber") * 10).alias("y0"), i(F.col("l_linenumber") * 10 + F.col("l_suppkey") % 9).alias("y1"), F.lit(0).alias("x0"), i(F.col("l_suppkey") % 50).alias("x1"))
    return table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 20).alias("chapter"), F.col("l_orderkey").alias("problem_id")).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def page_subset(spark: SparkSession, sf: str) -> DataFrame:
    p = sinks.page_subset(_boxes(spark, sf))
    return p.select("chapter", "n_pages", "n_problems", A.joined("pages").alias("pages"))


PAGE_SUBSET = """
WITH u AS (SELECT DISTINCT l_orderkey % 20 AS chapter, l_orderkey AS p, l_partkey % 200 AS page FROM lineitem)
SELECT chapter, count(DISTINCT page) AS n_pages, count(DISTINCT p) AS n_problems, (SELECT string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FROM (SELECT DISTINCT page FROM u v WHERE v.chapter = u.chapter)) AS pages FROM u GROUP BY chapter
UNION ALL SELECT NULL, count(DISTINCT page), count(DISTINCT p), (SELECT string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FROM (SELECT DISTINCT page FROM u)) FROM u
"""


def pages_index(spark: SparkSession, sf: str) -> DataFrame:
    return J.pages_index(_boxes(spark, sf)).select("page", A.joined("problem_ids").alias("problem_ids"))


PAGES_INDEX = "SELECT CAST(page AS INTEGER) AS page, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS problem_ids FROM (SELECT DISTINCT l_partkey % 200 AS page, l_orderkey AS p FROM lineitem) GROUP BY page"


def stacked_size(spark: SparkSession, sf: str) -> DataFrame:
    parts = _boxes(spark, sf).select("problem_id", F.explode("boxes").alias("b")).select("problem_id", "b.*")
    return G.stacked_size(parts)


STACKED_SIZE = """
SELECT l_orderkey AS problem_id, CAST(max(l_suppkey % 50) AS INTEGER) AS width, CAST(sum(l_suppkey % 9) AS BIGINT) AS height, count(*) AS parts FROM lineitem
WHERE l_suppkey % 50 >= 4 AND l_suppkey % 9 >= 4 GROUP BY 1
"""


def mask_offsets(spark: SparkSession, sf: str) -> DataFrame:
    parts = _boxes(spark, sf).select("problem_id", F.posexplode("boxes").alias("box", "b")).select("problem_id", "box", "b.y0", "b.y1", "b.page", "b.x1")
    return G.mask_offsets(parts).select("problem_id", "box", F.col("offset").cast("long").alias("offset"))


MASK_OFFSETS = """
WITH b AS (SELECT l_orderkey AS problem_id, l_suppkey % 9 AS h, CAST(row_number() OVER w - 1 AS INTEGER) AS box FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey % 200, l_linenumber * 10, l_linenumber * 10 + l_suppkey % 9, l_suppkey % 50))
SELECT problem_id, box, CAST(coalesce(sum(h) OVER (PARTITION BY problem_id ORDER BY box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM b
"""


def cut_at_terminator(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 400).alias("page"), (F.col("o_custkey") % 500).alias("y0"), (F.col("o_custkey") % 500 + 300).alias("y1"))
    t = table(spark, sf, "supplier").select((F.col("s_suppkey") * 7 % 400).alias("page"), (F.col("s_suppkey") * 13 % 800).alias("ty"))
    return W.cut_at_terminator(s, t).select("key", F.col("y1").alias("end_y"), "was_cut")


CUT_AT_TERMINATOR = """
SELECT key, coalesce(min(ty), any_value(y1)) AS end_y, min(ty) IS NOT NULL AS was_cut FROM (SELECT o_orderkey AS key, o_orderkey % 400 AS page, o_custkey % 500 AS y0, o_custkey % 500 + 300 AS y1 FROM orders) s
LEFT JOIN (SELECT s_suppkey * 7 % 400 AS page, s_suppkey * 13 % 800 AS ty FROM supplier) t ON s.page = t.page AND ty > y0 AND ty < y1 GROUP BY key
"""


def runs_with_heading(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("key"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("day"))
    heads = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("key"), (F.col("s_suppkey") * 97 % 4000).alias("day"))
    return J.runs_with_heading(W.runs(days, ["key"], "day"), heads, "key", "day")


RUNS_WITH_HEADING = """
WITH d AS (SELECT DISTINCT o_custkey % 50 AS key, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS v FROM orders),
g AS (SELECT key, v, v - row_number() OVER (PARTITION BY key ORDER BY v) AS g FROM d), r AS (SELECT key, min(v) AS lo, max(v) AS hi, count(*) AS n FROM g GROUP BY key, g)
SELECT r.*, (SELECT min(s_suppkey * 97 % 4000) FROM supplier WHERE s_suppkey % 50 = r.key AND s_suppkey * 97 % 4000 BETWEEN lo AND hi) AS heading FROM r
"""


def codes_touching_crops(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    code = p.filter("p_size < 10").select(F.col("p_partkey").alias("code"), (F.col("p_partkey") % 60).alias("page"), (F.col("p_partkey") % 41).alias("qx0"), (F.col("p_partkey") % 41 + 5).alias("qx1"), (F.col("p_partkey") % 37).alias("qy0"), (F.col("p_partkey") % 37 + 5).alias("qy1"))
    crop = p.filter("p_size >= 40").select(F.col("p_partkey").alias("crop"), (F.col("p_partkey") % 60).alias("page"), (F.col("p_partkey") % 30).alias("cx0"), (F.col("p_partkey") % 30 + 8).alias("cx1"), (F.col("p_partkey") % 20).alias("cy0"), (F.col("p_partkey") % 20 + 15).alias("cy1"))
    return J.touching(code, crop).select("code", "crop")


CODES_TOUCHING_CROPS = """
SELECT q.k AS code, c.k AS crop FROM (SELECT p_partkey AS k, p_partkey % 60 AS page, p_partkey % 41 AS x, p_partkey % 37 AS y FROM part WHERE p_size < 10) q
JOIN (SELECT p_partkey AS k, p_partkey % 60 AS page, p_partkey % 30 AS x, p_partkey % 20 AS y FROM part WHERE p_size >= 40) c ON q.page = c.page
WHERE q.y < c.y + 15 AND q.y + 5 > c.y AND q.x + 5 > c.x AND q.x < c.x + 8
"""


def manual_overrides(spark: SparkSession, sf: str) -> DataFrame:
    auto = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.array(F.lit("auto")).alias("flags"))
    manual = table(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("key"), F.upper("c_name").alias("value"))
    return J.overridden(auto, manual, "key", "value").select("key", "value", A.joined("flags").alias("flags"))


MANUAL_OVERRIDES = "SELECT c_custkey AS key, CASE WHEN c_nationkey = 3 THEN upper(c_name) ELSE c_mktsegment END AS value, CASE WHEN c_nationkey = 3 THEN 'manual' ELSE 'auto' END AS flags FROM customer"


def captions_to_owners(spark: SparkSession, sf: str) -> DataFrame:
    problems = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("chapter"), F.col("l_linenumber").alias("problem_id")).distinct()
    captions = table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("chapter"), (F.col("o_custkey") % 9).cast("int").alias("pid"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("holder"))
    owned = table(spark, sf, "supplier").select((F.col("s_suppkey") % 100).alias("chapter"), (F.col("s_suppkey") % 5).cast("int").alias("pid"))
    return J.captions_to_owners(captions, problems, owned).groupBy("chapter", "pid", "holder").agg(F.count(F.lit(1)).alias("n"))


CAPTIONS_TO_OWNERS = """
SELECT chapter, CAST(pid AS INTEGER) AS pid, CAST(holder AS INTEGER) AS holder, count(*) AS n FROM (SELECT o_orderkey % 100 AS chapter, o_custkey % 9 AS pid, o_orderkey % 7 + 1 AS holder FROM orders) c
WHERE pid <> holder AND (chapter, pid) IN (SELECT l_orderkey % 100, l_linenumber FROM lineitem) AND (chapter, pid) NOT IN (SELECT s_suppkey % 100, s_suppkey % 5 FROM supplier) GROUP BY 1, 2, 3
"""


def longer_body(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select((F.col("conv_id") % 40).alias("key"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.coalesce("text", F.lit("")).alias("body"))
    return G.longer_of_last_two(rows, ["key"], "pos", "body").select("key", F.md5("body").alias("md5"))


LONGER_BODY = """
WITH r AS (SELECT conv_id % 40 AS key, conv_id * 100 + turn AS pos, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id * 100 + turn DESC) AS r FROM conversations)
SELECT key, md5(body) AS md5 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(body) DESC, pos DESC) AS b FROM r WHERE r <= 2) WHERE b = 1
"""


def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    """O1 beside O2 and O3: where an id stands in each of the orders, within its chapter."""
    pid = F.concat_ws(".", (F.col("l_orderkey") % 30).cast("string"), (F.col("l_linenumber") * (F.col("l_orderkey") % 4 + 1)).cast("string"))
    ids = table(spark, sf, "lineitem").select(pid.alias("problem_id")).distinct()
    chapter = F.split_part("problem_id", F.lit("."), F.lit(1))
    rank = lambda *o: F.row_number().over(Window.partitionBy(chapter).orderBy(*o)).cast("long")
    return ids.select("problem_id", rank(*G.natural_order()).alias("natural"), rank("problem_id").alias("textual"), rank(F.col("problem_id").cast("double"), "problem_id").alias("decimal"))


NATURAL_ORDER = """
WITH i AS (SELECT DISTINCT (l_orderkey % 30) || '.' || (l_linenumber * (l_orderkey % 4 + 1)) AS problem_id FROM lineitem)
SELECT problem_id, row_number() OVER (PARTITION BY split_part(problem_id, '.', 1) ORDER BY CAST(split_part(problem_id, '.', 2) AS INTEGER)) AS "natural",
  row_number() OVER (PARTITION BY split_part(problem_id, '.', 1) ORDER BY problem_id) AS textual,
  row_number() OVER (PARTITION BY split_part(problem_id, '.', 1) ORDER BY CAST(problem_id AS DOUBLE), problem_id) AS decimal FROM i
"""


def exam_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select((F.col("l_partkey") % 150).alias("page"), (F.col("l_orderkey") % 97 * 10 + F.col("l_linenumber")).alias("y"), F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("section")).groupBy("page", "y").agg(F.max("section").alias("section"))
    return W.carry_forward_sections(e, ["y"], "page", "y", "section").select("page", "y", F.col("sec").alias("sec"), "next_y")


EXAM_EVENTS = """
WITH e AS (SELECT l_partkey % 150 AS page, l_orderkey % 97 * 10 + l_linenumber AS y, max(CASE WHEN l_linenumber = 1 THEN l_orderkey END) AS section FROM lineitem GROUP BY 1, 2)
SELECT page, y, last_value(section IGNORE NULLS) OVER (ORDER BY page, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec,
       min(y) OVER (PARTITION BY page ORDER BY y RANGE BETWEEN 11 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_y FROM e
"""


def text_sets(spark: SparkSession, sf: str) -> DataFrame:
    """U1 to U3 as set operations: keys of two sides that differ, agree, or are in either."""
    a = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    mark = lambda d, op: d.select("k", F.lit(op).alias("op"))
    return mark(a.distinct().exceptAll(b), "a_minus_b").unionByName(mark(b.distinct().exceptAll(a.distinct()), "b_minus_a")).unionByName(mark(a.intersect(b), "both")).unionByName(mark(a.union(b).distinct(), "either"))


TEXT_SETS = """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT k, 'a_minus_b' AS op FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'b_minus_a' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
UNION ALL SELECT k, 'both' FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'either' FROM (SELECT k FROM a UNION SELECT k FROM b)
"""


def blank_free_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """F21, F22, F25, F33 in the order in which a solution's text passes through them."""
    head = F.concat(F.lit("## 习题 1.1 解\n\n### 题目重述\n甲\n\n### 解\n"), F.lit("第 3 题 $$x$$。\n"), F.lit("\\tag{2} "))
    t = T.exercise_headings(T.normalize_headings(T.collapse_solution(F.concat(head, F.coalesce("text", F.lit(""))))))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(t).alias("md5"), (F.length(t) > F.length("text")).alias("longer"))


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as log lines and read again."""
    lines = tables.events(spark, sf).select(sinks.event_line(F.col("ts"), F.col("event_type"), F.col("event_id").cast("string")).alias("value"))
    return tables.parse_event_lines(lines).groupBy("kind", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("msg").cast("long")).alias("first"))


EVENT_LINES = "SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2"


def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.logs import latest_state as latest

    return latest(table(spark, sf, "events"), "user_id", "ts", ["event_type", "event_id"]).select("user_id", "event_type", "event_id")


LATEST_STATE = "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1"
