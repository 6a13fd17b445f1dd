"""Crowded pages and small files: what a query makes on the way grows with its input, and its work is spread."""

import compare
import duckdb
from pyspark.sql import functions as F

from pagemill.functions import mathtext as M
from pagemill.operators import geometry as G
from pagemill.operators import joins as J
from pagemill.operators import sequences as W
from pagemill.plans import registry
from pagemill.streaming import logs


def joined_rows(df):
    """The most rows that a join of this DataFrame has given out, and the rows of the result."""
    rows, found = df.collect(), [0]

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        n = p.metrics().get("numOutputRows")
        if "Join" in name and n.isDefined():
            found.append(n.get().value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found), rows


def test_figures_on_a_crowded_page(spark):
    """captions of one page are not compared one by one with its segments."""
    seg = spark.range(400).selectExpr("1 AS chapter", "id AS pid", "1 AS page", "id % 5 * 100 AS y0", "id % 5 * 100 + 150 AS y1", "id % 2 = 0 AS ink_only")
    caps = spark.range(400).selectExpr("1 AS chapter", "CASE WHEN id % 97 < 90 THEN 1000 ELSE 1000 + id END AS pid", "1 AS page", "id AS y").filter("y < 240 OR pid = 1000")
    made, rows = joined_rows(G.reassign_figures(seg, caps))
    want = {}
    named = [(r.pid, r.y) for r in caps.collect()]
    for s in seg.collect():
        names = {p for p, y in named if s.y0 <= y <= s.y1 and p != s.pid}
        action = "keep" if not names else "unresolved" if len(names) > 1 else "move" if s.ink_only else "copy"
        want[s.pid] = (action, sorted(([] if action == "move" else [s.pid]) + (list(names) if action in ("move", "copy") else [])))
    got = {}
    for r in rows:
        got.setdefault(r.pid, (r.action, []))[1].append(r.owner)
    assert {k: (a, sorted(o)) for k, (a, o) in got.items()} == want and {a for a, _ in want.values()} == {"keep", "unresolved", "move", "copy"}
    assert made < 5_000


def test_figures_between_pixels(spark):
    """ends and captions with fractions, below 0 and far apart, and a segment's own name among three."""
    seg = spark.createDataFrame([(1, 7, 1, -3.5, 2.25, True), (1, 8, 1, 2.3, 2.4, True), (1, 9, 1, 0.0, 3e5, False), (1, 10, 1, 5.0, 1.0, True), (1, 11, 1, None, 1.0, True)], "chapter int, pid int, page int, y0 double, y1 double, ink_only boolean")
    caps = spark.createDataFrame([(1, 7, 1, -3.5), (1, 8, 1, -2.0), (1, 9, 1, 2.26), (1, 7, 1, 299999.5), (1, None, 1, 2.35)], "chapter int, pid int, page int, y double")
    got = sorted((r.pid, r.action, r.owner) for r in G.reassign_figures(seg, caps).collect())
    assert got == [(7, "move", 8), (8, "keep", 8), (9, "copy", 7), (9, "copy", 9), (10, "keep", 10), (11, "keep", 11)]


def test_masks_and_boxes_of_a_crowded_page(spark):
    """equal rectangles are compared once, and boxes within one of a smaller number not at all; owners stay the first of the largest areas."""
    boxes = spark.range(300).selectExpr("id AS box", "1 AS page", "id % 4 * 5 AS bx0", "id % 4 * 5 + 10 + id * 7 % 11 AS bx1", "id % 3 * 90 AS by0", "id % 3 * 90 + 80 AS by1")
    masks = spark.range(300).selectExpr("id AS mask", "1 AS page", "id % 7 * 5 AS mx0", "id % 7 * 5 + 6 AS mx1", "id % 5 * 80 AS my0", "id % 5 * 80 + 30 AS my1")
    made, rows = joined_rows(J.mask_owner(masks, boxes))
    b = boxes.collect()
    side = lambda a0, a1, b0, b1: max(0, min(a1, b1) - max(a0, b0))
    want = {}
    for m in masks.collect():
        area, first = max((side(m.mx0, m.mx1, x.bx0, x.bx1) * side(m.my0, m.my1, x.by0, x.by1), -x.box) for x in b)
        want[m.mask] = (-first if area else -1, area)
    assert {r.mask: (r.owner, r.area) for r in rows} == want and len(rows) == 300 and {a > 0 for _, a in want.values()} == {True, False}
    assert made < 5_000


def test_codes_and_crops_of_a_crowded_page(spark):
    """all pairs come out, other columns and repeated rows as well, and no join makes them."""
    codes = spark.range(200).selectExpr("id AS code", "1 AS page", "id % 3 * 100 AS qx0", "id % 3 * 100 + 5 AS qx1", "id % 2 * 200 AS qy0", "id % 2 * 200 + 150 AS qy1").unionAll(spark.sql("SELECT 0L, 1, 0L, 5L, 0L, 150L"))
    crops = spark.range(200).selectExpr("concat('c', id % 150) AS crop", "1 AS page", "id % 2 * 100 AS cx0", "id % 2 * 100 + 50 AS cx1", "-70 AS cy0", "CASE WHEN id % 4 < 3 THEN 260 ELSE 0 END AS cy1")
    touching = J.touching(codes, crops, block=16)
    assert touching.columns == ["page", "code", "qx0", "qx1", "qy0", "qy1", "crop", "cx0", "cx1", "cy0", "cy1"]
    made, rows = joined_rows(touching)
    want = sorted((q.code, c.crop) for q in codes.collect() for c in crops.collect() if q.qy0 < c.cy1 and q.qy1 > c.cy0 and q.qx1 > c.cx0 and q.qx0 < c.cx1)
    assert sorted((r.code, r.crop) for r in rows) == want and len(want) > 8_000
    assert made < 4_000


def folder(tmp_path, sf, name, sql):
    """The smallest tables with one of them replaced."""
    for t in compare.TABLES:
        if t != name:
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    duckdb.connect().execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet'")
    return str(tmp_path)


def test_anchors_of_a_hundred_chapters(spark, sf, tmp_path):
    """chapters with three digits."""
    at = folder(tmp_path, sf, "lineitem", f"select * replace (194 * (i // 7) as l_orderkey, cast(i % 7 as int) as l_linenumber, i as l_partkey, cast(1 + i * 7 % 50 as double) as l_quantity) exclude (i) from (from '{sf}/lineitem.parquet' limit 1), range(4200) r(i)".replace("select * replace", "select * exclude (i) replace").replace(" exclude (i) from", " from"))
    got = registry.QUERIES["anchors_found"](spark, at).toPandas()
    compare.assert_same(got, registry.ORACLE_SQL["anchors_found"], at)
    assert got["ch"].max() > 100


def test_scanned_pages_with_equal_places(spark, sf, tmp_path):
    """pieces of a line at one place come in the order of their flags."""
    rows = "(values (3, 0, 'N'), (2, 1100000, 'R'), (3, 100000, 'A'), (3, 200000, 'N')) r(a, b, c)"
    at = folder(tmp_path, sf, "lineitem", f"select * exclude (a, b, c) replace (61 as l_orderkey, 1 as l_suppkey, cast(a as int) as l_linenumber, cast(b as bigint) as l_partkey, c as l_returnflag) from (from '{sf}/lineitem.parquet' limit 1), {rows}")
    compare.assert_same(registry.QUERIES["scanned_pages"](spark, at).toPandas(), registry.ORACLE_SQL["scanned_pages"], at)


def test_formulas_are_cleaned_everywhere(spark, sf):
    """a small file is not one task, and equal texts of a batch are cleaned once."""
    assert registry.QUERIES["cleaned_formulas"](spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_ink_is_walked_once(spark, sf):
    """F8: a small file is not one task, and blocks of ink are found in one walk, however many of them are dropped."""
    assert registry.QUERIES["ink_rules"](spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    ink = spark.sql("SELECT array(1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1) AS ink UNION ALL SELECT array(0, 0) UNION ALL SELECT array(0, 1, 1) UNION ALL SELECT array()")
    for most, want in enumerate((17, 10, 3, 3)):
        out = ink.select(W.ink_trim(F.col("ink"), 2, most).alias("end"))
        assert [r.end for r in out.collect()] == [want, 0, 3, 0]
        assert out._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_trailing_rates_of_a_dense_log(spark):
    """running sums instead of a window's rows again for each row; ties, nulls and both ends of the windows."""
    log = spark.range(300).selectExpr("id", "timestamp_micros(1000000000000000 + id DIV 2 * 20000000 + id % 3 * 10) AS ts", "CASE WHEN id % 60 > 25 THEN id END AS total", "id % 7 = 0 AS bad")
    out = logs.trailing(log, "ts", "total", F.col("bad"), ["id"])
    rows, want = [(r.id, r.ts.timestamp(), r.total, r.bad) for r in log.collect()], {}
    for i, t, _, _ in rows:
        last = lambda s: [r for r in rows if -1e-7 <= t - r[1] <= s + 1e-7]  # noqa: B023, E731
        known = [r[2] for r in last(300) if r[2] is not None]
        want[i] = (len(last(300)), sum(known) if known else None, sum(r[3] for r in last(600)))
    assert {r.id: (r.n5, r.sum5, r.fail10) for r in out.collect()} == want and None in {x[1] for x in want.values()}
    assert "RangeFrame, -" not in out._jdf.queryExecution().analyzed().toString()
    inexact = logs.trailing(log.withColumn("total", F.col("total").cast("double")), "ts", "total", F.col("bad"), ["id"])
    assert {r.id: (r.n5, r.sum5, r.fail10) for r in inexact.collect()} == want


def test_boxes_stay_in_small_parts(spark, sf):
    """rows of a problem or a document are dealt over parts that are not put together again for their few bytes."""
    for name in ("review_boxes", "saved_boxes", "page_spans"):
        assert registry.QUERIES[name](spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism, name


def test_tokens_slice_by_slice(spark):
    """counts are the same however texts are sliced, and no tokens come back from the workers."""
    texts = [None, "", "a $x$ \\frac", "\\fraction $$y$$", "\\alpha中 $z", "甲" * 300 + "\\sqrt2 \\sqrt ", "$a$\\int$b$"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    want = [(0, 0, ""), (0, 0, ""), (1, 0, "bare_command"), (0, 1, ""), (0, 0, "unclosed"), (0, 0, "bare_command"), (2, 0, "bare_command")]
    for size in (1, 40, 1 << 20):
        out = M.token_counts(rows, "k", "t", size)
        assert [(r.n_inline, r.n_disp, r.problems) for r in out.orderBy("k").collect()] == want
    assert "kind" not in out._jdf.queryExecution().analyzed().toString()
