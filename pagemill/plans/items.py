"""Queries over numbered items: reports, reconciliation, sequences (tables lineitem and orders stand in for anchors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import sequences as W
from ..sources.tables import table

#: A total order of lineitem's rows within an order: all columns, rows that agree in them being alike.
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
_ORDER = ", ".join(LINE_ORDER)


def chapter_report(spark: SparkSession, sf: str) -> DataFrame:
    r = A.chapter_report(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
    return r.select("chapter", "n_items", "n_distinct", "last_index", A.joined(F.array_sort("missing")).alias("missing"), A.joined("duplicated").alias("duplicated"))


CHAPTER_REPORT = """
WITH k AS (SELECT l_orderkey AS chapter, CAST(l_linenumber AS BIGINT) AS k, count(*) AS c FROM lineitem GROUP BY 1, 2),
g AS (SELECT chapter, sum(c) AS n_items, count(k) AS n_distinct, max(k) AS last_index,
             coalesce(string_agg(CASE WHEN c > 1 THEN CAST(k AS VARCHAR) END, ',' ORDER BY k), '') AS duplicated FROM k GROUP BY 1),
m AS (SELECT g.chapter, string_agg(CAST(s.i AS VARCHAR), ',' ORDER BY s.i) AS missing
      FROM g, LATERAL (SELECT unnest(generate_series(1, g.last_index)) AS i) s
      WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.chapter = g.chapter AND k.k = s.i) GROUP BY 1)
SELECT g.chapter, CAST(n_items AS BIGINT) AS n_items, n_distinct, last_index, coalesce(missing, '') AS missing, duplicated
FROM g LEFT JOIN m ON g.chapter = m.chapter
"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    text = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    crop = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return text, crop


def import_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return J.reconcile(*_sides(spark, sf), "key")


_RECONCILE = """
WITH t AS (SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT coalesce(t.key, c.key) AS key,
             CASE WHEN t.key IS NOT NULL AND c.key IS NOT NULL THEN 'matched' WHEN c.key IS NOT NULL THEN 'missing_in_text'
                  ELSE 'missing_in_crop' END AS status
      FROM t FULL OUTER JOIN c ON t.key = c.key)
"""
IMPORT_RECONCILE = _RECONCILE + "SELECT * FROM r"


def import_report_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.import_counts(J.reconcile(*_sides(spark, sf), "key"))


IMPORT_REPORT_COUNTS = (
    _RECONCILE
    + """SELECT count(*) FILTER (status IN ('matched', 'missing_in_crop')) AS parsed,
    count(*) FILTER (status IN ('matched', 'missing_in_text')) AS cropped, count(*) FILTER (status = 'matched') AS matched,
    count(*) FILTER (status = 'missing_in_text') AS missing_text, count(*) FILTER (status = 'missing_in_crop') AS missing_crop FROM r"""
)


def rebuild_keep_text(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    new = part.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("page"), F.lit("new").alias("text"))
    old = part.select(F.col("p_partkey").alias("key"), (F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).alias("page"), F.when(F.col("p_partkey") % 5 == 0, "short").otherwise(F.col("p_name")).alias("text"))
    return J.keep_text(new, old, "key", "page", "text").select("key", "text", "kept_source")


REBUILD_KEEP_TEXT = """
SELECT p_partkey AS key, CASE WHEN kept THEN old_text ELSE 'new' END AS text, CASE WHEN kept THEN 'old' ELSE 'new' END AS kept_source
FROM (SELECT n.p_partkey, o.old_text, coalesce(length(trim(o.old_text)) >= 8, false) AS kept FROM part n LEFT JOIN
      (SELECT p_partkey AS k, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS page,
              CASE WHEN p_partkey % 5 = 0 THEN 'short' ELSE p_name END AS old_text FROM part) o
      ON o.k = n.p_partkey AND o.page = n.p_size)
"""


def chapter_coverage(spark: SparkSession, sf: str) -> DataFrame:
    want = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return J.coverage(want, table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k")), "k")


CHAPTER_COVERAGE = """
SELECT want, got, got < 0.6 * want AS fallback FROM (SELECT count(DISTINCT o_orderkey) AS want,
  count(DISTINCT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN o_orderkey END) AS got FROM orders)
"""


def progress_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = A.progress(table(spark, sf, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")
    return p.select(F.coalesce("o_orderpriority", F.lit("all")).alias("chapter"), "total", "done", "is_done", "pct")


PROGRESS_STATS = """
SELECT coalesce(o_orderpriority, 'all') AS chapter, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done,
       count(*) = count(*) FILTER (o_orderstatus = 'F') AS is_done,
       CAST(round_even(100 * count(*) FILTER (o_orderstatus = 'F') / count(*), 0) AS BIGINT) AS pct
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())
"""


def upper_median_by_parity(spark: SparkSession, sf: str) -> DataFrame:
    return A.upper_median_by_parity(table(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice")


UPPER_MEDIAN_BY_PARITY = """
SELECT parity, value FROM (SELECT CAST(l_linenumber % 2 AS BIGINT) AS parity, l_extendedprice AS value,
  row_number() OVER (PARTITION BY l_linenumber % 2 ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_linenumber % 2) AS n FROM lineitem)
WHERE r = n // 2 + 1
"""


def median_height(spark: SparkSession, sf: str) -> DataFrame:
    return A.medians(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), "l_quantity"), ["key"], "l_quantity")


MEDIAN_HEIGHT = "SELECT l_suppkey AS key, median(l_quantity) AS median FROM lineitem GROUP BY 1"


def outlier_groups(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("chapter")).agg(F.count(F.lit(1)).alias("n"))
    shifted = sizes.select((F.col("chapter") + F.when(F.col("n") <= 2, 1_000_000).otherwise(0)).alias("chapter"), "n")
    return A.isolated(shifted, "chapter", "n").select("chapter", "n", F.lit(2).alias("few")).unionByName(A.isolated(shifted, "chapter", "n", few=1).select("chapter", "n", F.lit(1).alias("few")))


OUTLIER_GROUPS = """
WITH s AS (SELECT l_orderkey + CASE WHEN count(*) <= 2 THEN 1000000 ELSE 0 END AS chapter, count(*) AS n FROM lineitem GROUP BY l_orderkey),
t AS (SELECT max(chapter) AS top FROM s WHERE n >= 3), f AS (SELECT unnest([1, 2]) AS few)
SELECT chapter, n, few FROM s, t, f WHERE n <= few AND chapter > top + 3
"""


def best_segment(spark: SparkSession, sf: str) -> DataFrame:
    items = W.number_segments(table(spark, sf, "lineitem"), "l_suppkey", LINE_ORDER, "l_linenumber")
    return A.best_segments(items, "l_suppkey", "seg", ["l_shipdate", "l_partkey", "l_extendedprice"]).select(F.col("l_suppkey").alias("chapter"), F.col("seg").cast("long").alias("seg"), "n")


BEST_SEGMENT = f"""
WITH s AS (SELECT *, CASE WHEN l_linenumber = 1 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM lineitem
           WINDOW w AS (PARTITION BY l_suppkey ORDER BY {_ORDER})),
n AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS seg FROM s),
g AS (SELECT l_suppkey AS chapter, seg, count(*) AS n, min((l_shipdate, l_partkey, l_extendedprice)) AS place FROM n GROUP BY 1, 2),
m AS (SELECT *, max(n) OVER (PARTITION BY chapter) AS most FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY CASE WHEN n >= 0.6 * most AND n >= 3 THEN 0 ELSE 1 END,
        CASE WHEN n >= 0.6 * most AND n >= 3 THEN place END, n DESC, seg DESC) AS r FROM m)
SELECT chapter, CAST(seg AS BIGINT) AS seg, n FROM r WHERE r = 1
"""


def page_runs(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("day"))
    return W.runs(days, ["key"], "day")


PAGE_RUNS = """
WITH d AS (SELECT DISTINCT o_custkey AS key, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS v FROM orders),
g AS (SELECT key, v, v - row_number() OVER (PARTITION BY key ORDER BY v) AS g FROM d)
SELECT key, min(v) AS lo, max(v) AS hi, count(*) AS n FROM g GROUP BY key, g
"""


def segment_bounds(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), F.floor("l_extendedprice").cast("long").alias("y")).distinct()
    s = W.segment_bounds(a, "l_orderkey", "page", "y", 100_000)
    return s.select(F.col("l_orderkey").alias("key"), "page", F.col("y").alias("start_y"), F.col("end_y").cast("long").alias("end_y"), "flag", F.col("mid_pages").cast("long").alias("mid_pages"))


SEGMENT_BOUNDS = """
WITH a AS (SELECT DISTINCT l_orderkey AS key, l_linenumber AS page, CAST(floor(l_extendedprice) AS BIGINT) AS y FROM lineitem),
n AS (SELECT *, lead(page) OVER w AS np, lead(y) OVER w AS ny FROM a WINDOW w AS (PARTITION BY key ORDER BY page, y))
SELECT key, page, y AS start_y, CAST(CASE WHEN np = page THEN ny ELSE 100000 END AS BIGINT) AS end_y,
       CASE WHEN np = page THEN 'whole' WHEN np IS NULL THEN 'last' WHEN np = page + 1 THEN 'stitched' ELSE 'stitch_mid_page' END AS flag,
       CAST(greatest(0, coalesce(np - page - 1, 0)) AS BIGINT) AS mid_pages FROM n
"""


def gap_regions(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").cast("long").alias("k")).distinct()
    return W.gap_regions(a, "chapter", ["k"], "k").select("chapter", "after", "before", A.joined("missing").alias("missing"))


GAP_REGIONS = """
WITH a AS (SELECT DISTINCT l_orderkey AS chapter, CAST(l_linenumber AS BIGINT) AS k FROM lineitem),
p AS (SELECT chapter, k, lag(k) OVER (PARTITION BY chapter ORDER BY k) AS prev FROM a)
SELECT chapter, prev AS after, k AS before, array_to_string(generate_series(prev + 1, k - 1), ',') AS missing FROM p WHERE k > prev + 1
"""


def number_continuity(spark: SparkSession, sf: str) -> DataFrame:
    return W.broken_continuity(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "chapter"), "chapter", LINE_ORDER, "l_linenumber")


NUMBER_CONTINUITY = f"""
SELECT chapter, prev, cur FROM (SELECT l_orderkey AS chapter, l_linenumber AS cur, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS prev
FROM lineitem) WHERE prev IS NOT NULL AND cur <> prev + 1
"""


def sequence_validator(spark: SparkSession, sf: str) -> DataFrame:
    v = W.validate_sequence(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "chapter"), "chapter", LINE_ORDER[:-2], "l_linenumber")
    return v.select("chapter", A.joined("accepted").alias("accepted"), A.joined("gaps").alias("gaps"), A.joined("rejected").alias("rejected"))


SEQUENCE_VALIDATOR = f"""
WITH RECURSIVE o AS (SELECT l_orderkey AS chapter, CAST(l_linenumber AS BIGINT) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS r FROM lineitem),
f(chapter, r, want, accepted, gaps, rejected) AS (
  SELECT chapter, CAST(0 AS BIGINT), CAST(1 AS BIGINT), '', '', '' FROM (SELECT DISTINCT chapter FROM o)
  UNION ALL
  SELECT f.chapter, o.r, CASE WHEN fits THEN k + 1 ELSE want END, CASE WHEN fits THEN accepted || ',' || k ELSE accepted END,
         CASE WHEN k > want AND k <= want + 2 THEN gaps || ',' || array_to_string(generate_series(want, k - 1), ',') ELSE gaps END,
         CASE WHEN fits THEN rejected ELSE rejected || ',' || k END
  FROM f JOIN o ON o.chapter = f.chapter AND o.r = f.r + 1, LATERAL (SELECT (o.k >= f.want AND o.k <= f.want + 2) OR o.k = 1 AS fits) x)
SELECT chapter, substr(accepted, 2) AS accepted, substr(gaps, 2) AS gaps, substr(rejected, 2) AS rejected
FROM f WHERE r = (SELECT count(*) FROM o WHERE o.chapter = f.chapter)
"""


def plain_validator(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "heading").when(F.col("l_linestatus") == "O", "line").otherwise("stop")
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "chapter").withColumn("kind", F.when(F.col("l_quantity") < 10, kind).otherwise("line"))
    return W.validate_plain(rows, "chapter", LINE_ORDER, "l_linenumber", "kind").select("chapter", A.joined("accepted").alias("accepted"))


PLAIN_VALIDATOR = f"""
WITH RECURSIVE o AS (SELECT l_orderkey AS chapter, CAST(l_linenumber AS BIGINT) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS r,
  CASE WHEN l_quantity >= 10 THEN 'line' WHEN l_returnflag = 'R' THEN 'heading' WHEN l_linestatus = 'O' THEN 'line' ELSE 'stop' END AS kind FROM lineitem),
f(chapter, r, inside, opened, want, accepted) AS (
  SELECT chapter, CAST(0 AS BIGINT), false, false, CAST(1 AS BIGINT), '' FROM (SELECT DISTINCT chapter FROM o)
  UNION ALL
  SELECT f.chapter, o.r, CASE kind WHEN 'heading' THEN true WHEN 'stop' THEN false ELSE inside END,
         CASE WHEN kind = 'heading' THEN true WHEN fits OR kind = 'stop' THEN false ELSE opened END,
         CASE WHEN fits THEN k + 1 ELSE want END, CASE WHEN fits THEN accepted || ',' || k ELSE accepted END
  FROM f JOIN o ON o.chapter = f.chapter AND o.r = f.r + 1,
       LATERAL (SELECT kind = 'line' AND inside AND ((k >= want AND k <= want + 2) OR (k = 1 AND opened)) AS fits) x)
SELECT chapter, substr(accepted, 2) AS accepted FROM f WHERE r = (SELECT count(*) FROM o WHERE o.chapter = f.chapter)
"""


def longest_chain(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).alias("line"), F.lit(1).alias("ch"), "l_linenumber")
    return W.longest_chain(rows, "doc", "line", "ch", "l_linenumber").select("doc", "length")


LONGEST_CHAIN = """
WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_shipdate AS DATE) AS line, l_linenumber AS k FROM lineitem),
c(doc, line, k, n) AS (SELECT doc, line, k, CAST(1 AS BIGINT) FROM d
  UNION SELECT d.doc, d.line, d.k, c.n + 1 FROM c JOIN d ON d.doc = c.doc AND d.line > c.line AND d.k > c.k)
SELECT doc, max(n) AS length FROM c GROUP BY doc
"""


def best_round_gate(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.col("l_quantity") > 48, F.lit(None)).otherwise(F.floor(F.col("l_tax") * 100) * 8 + F.floor(F.col("l_quantity")))
    reviews = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("round")).agg(F.max(score.cast("int")).alias("score"))
    return G.gate(W.best_round(reviews, ["key"], "round", "score")).select("key", "best_round", "score", F.col("rounds").alias("rounds"), "status", "final_mode")


BEST_ROUND_GATE = """
WITH v AS (SELECT l_orderkey AS key, l_linenumber AS round, max(CASE WHEN l_quantity > 48 THEN NULL ELSE CAST(floor(l_tax * 100) * 8 + floor(l_quantity) AS INTEGER) END) AS score
           FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, coalesce(max(CASE WHEN score >= 95 THEN 1 END) OVER (PARTITION BY key ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(nullif(score, 0), -1) DESC, round) AS r, count(*) OVER (PARTITION BY key) AS rounds FROM s WHERE over_ = 0)
SELECT key, round AS best_round, score, rounds, CASE WHEN score >= 95 THEN 'passed' WHEN score IS NOT NULL THEN 'needs_review' ELSE 'unreviewed' END AS status,
       CASE WHEN score >= 95 THEN 'draft_passed' ELSE 'rewritten' END AS final_mode FROM r WHERE r = 1
"""


def expand_ranges(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "orders").select((F.col("o_custkey") % 5000 + 1).alias("a"), (F.col("o_custkey") % 5000 + 1 + F.col("o_orderkey") % 7 - 3).alias("b"))
    return G.page_set(spans, "a", "b", pad=1, last=5000)


EXPAND_RANGES = """
SELECT DISTINCT page FROM (SELECT unnest(generate_series(greatest(least(a, b) - 1, 1), least(greatest(a, b) + 1, 5000))) AS page
FROM (SELECT o_custkey % 5000 + 1 AS a, o_custkey % 5000 + 1 + o_orderkey % 7 - 3 AS b FROM orders))
"""


def nearest_offset(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 3).alias("at"))
    samples = table(spark, sf, "supplier").select((F.col("s_suppkey") * 37).alias("sample"), (F.col("s_suppkey") % 11).alias("off"))
    return J.nearest(points, samples, "key", "at", "sample", "off").select("key", "sample", "off")


NEAREST_OFFSET = """
SELECT key, sample, off FROM (SELECT c_custkey AS key, s.sample, s.off, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s.sample - c_custkey * 3), s.sample) AS r
FROM customer, (SELECT s_suppkey * 37 AS sample, s_suppkey % 11 AS off FROM supplier) s) WHERE r = 1
"""


def mask_owner(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    page = (F.col("p_partkey") % 97).alias("page")
    box = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("box"), page, (F.col("p_partkey") % 50).alias("bx0"), (F.col("p_partkey") % 50 + F.col("p_size")).alias("bx1"), (F.col("p_partkey") % 40).alias("by0"), (F.col("p_partkey") % 40 + 20).alias("by1"))
    mask = part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("mask"), page, (F.col("p_partkey") % 45).alias("mx0"), (F.col("p_partkey") % 45 + 6).alias("mx1"), (F.col("p_partkey") % 38).alias("my0"), (F.col("p_partkey") % 38 + F.col("p_size") % 9).alias("my1"))
    return J.mask_owner(mask, box)


MASK_OWNER = """
WITH b AS (SELECT p_partkey AS box, p_partkey % 97 AS page, p_partkey % 50 AS x0, p_partkey % 50 + p_size AS x1, p_partkey % 40 AS y0, p_partkey % 40 + 20 AS y1 FROM part WHERE p_partkey % 2 = 0),
m AS (SELECT p_partkey AS mask, p_partkey % 97 AS page, p_partkey % 45 AS x0, p_partkey % 45 + 6 AS x1, p_partkey % 38 AS y0, p_partkey % 38 + p_size % 9 AS y1 FROM part WHERE p_partkey % 2 = 1),
a AS (SELECT m.mask, b.box, coalesce(greatest(0, least(m.x1, b.x1) - greatest(m.x0, b.x0)) * greatest(0, least(m.y1, b.y1) - greatest(m.y0, b.y0)), 0) AS area
      FROM m LEFT JOIN b ON m.page = b.page),
r AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY area DESC, box) AS r FROM a)
SELECT mask, CAST(CASE WHEN area > 0 THEN box ELSE -1 END AS BIGINT) AS owner, CAST(area AS BIGINT) AS area FROM r WHERE r = 1
"""


def signature(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import signature as sig

    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), sig(F.col("p_name")).alias("sig"))


SIGNATURE = r"SELECT p_partkey AS key, array_to_string(list_sort(string_split(regexp_replace(p_name, '&emsp;|\s', '', 'g'), '')), '') AS sig FROM part"


def neighbour_pages(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "orders").select((F.col("o_orderkey") % 20_000).alias("page")).filter("page % 3 <> 1").distinct()
    return J.neighbour_pages(used, "page", 20_000)


NEIGHBOUR_PAGES = """
WITH u AS (SELECT DISTINCT o_orderkey % 20000 AS page FROM orders WHERE o_orderkey % 20000 % 3 <> 1),
n AS (SELECT page - 1 AS page FROM u UNION SELECT page + 1 FROM u)
SELECT page FROM n WHERE page BETWEEN 1 AND 20000 AND page NOT IN (SELECT page FROM u)
"""
