from pyspark.sql import functions as F

from pagemill.operators import sequences as W
from pagemill.streaming import logs as S


def validated(spark, ks):
    d = spark.createDataFrame([(1, i, k) for i, k in enumerate(ks)], "doc int, pos int, k int")
    r = W.validate_sequence(d, "doc", ["pos"], "k").first()
    return r.accepted, r.gaps, r.rejected


def test_validator(spark):
    assert validated(spark, [1, 2, 5]) == ([1, 2, 5], [3, 4], [])
    assert validated(spark, [1, 2, 6, 3]) == ([1, 2, 3], [], [6])
    assert validated(spark, [1, 2, 3, 2]) == ([1, 2, 3], [], [2])


def anchors(spark, rows, exam=False):
    """rows: (page, y0, text, kind); a page with a heading is a heading page, with a stop or an opener one of these."""
    d = spark.createDataFrame([(1, p, float(y), 50.0, 800.0, t, k) for p, y, t, k in rows], "doc int, page int, y0 double, x0 double, W double, text string, kind string")
    flags = d.groupBy("page").agg(F.coalesce(F.max(F.when(F.col("kind") == "heading", "heading")), F.max("kind")).alias("page_kind"))
    d = d.join(flags, "page").withColumn("page_chapter", F.lit(None).cast("int")).withColumn("exam", F.lit(exam))
    return [(r.page, r.ch, r.k, r.gap) for r in W.find_anchors(d).orderBy("page", "y0").collect()]


def test_anchors_with_chapters(spark):
    rows = [(0, 1, "1.1 before any heading", None), (1, 1, "习题", "heading"), (1, 2, "1.1 a", None), (1, 3, "1.2 b", None), (1, 4, "1.7 too far", None), (1, 5, "1.5 c", None), (2, 1, "2.1 next chapter", None), (2, 2, "1.6 the old one", None), (2, 3, "2.9 a", None), (3, 1, "3.1 far from the heading", None), (4, 1, "x", None), (5, 1, "2.2 the walk is over", None)]
    assert anchors(spark, rows) == [(1, 1, 1, []), (1, 1, 2, []), (1, 1, 5, [3, 4]), (2, 2, 1, [])]


def test_anchors_every_candidate_and_prefix(spark):
    rows = [(1, 1, "习题", "heading"), (1, 2, "习题2.1 a", None), (1, 3, "习题2.25节", None), (1, 4, "2.3 kΩ", None), (1, 5, "习题2.3 b", None), (2, 1, "答案", "stop"), (2, 2, "习题2.4", None)]
    assert anchors(spark, rows) == [(1, 2, 1, []), (1, 2, 2, []), (1, 2, 3, [])]


def test_anchors_without_chapters(spark):
    rows = [(1, 1, "习题", "heading"), (1, 2, "1. a", None), (1, 3, "2、 b", None), (1, 4, "第5题 c", None), (2, 1, "9. d", None), (4, 1, "6. after a page without lines", None), (7, 1, "7. over", None), (8, 1, "习题", "heading"), (8, 2, "1. e", None)]
    assert anchors(spark, rows) == [(1, 1, 1, []), (1, 1, 2, []), (1, 1, 5, [3, 4]), (8, 2, 1, [])]


def test_anchors_of_an_exam(spark):
    rows = [(1, 1, "一、选择题（每题3分）", None), (1, 2, "1. a", None), (1, 3, "2. b", None), (1, 4, "二、填空题", None), (1, 5, "3. c", None), (5, 1, "4. d", None), (5, 2, "三、计算题", None), (5, 3, "1. e", None)]
    assert anchors(spark, rows, exam=True) == [(1, 1, 1, []), (1, 1, 2, []), (1, 2, 3, [1, 2]), (5, 2, 4, []), (5, 3, 1, [])]


def test_longest_chain_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(d, rng.randrange(12), rng.randrange(3), rng.randrange(6)) for d in range(30) for _ in range(rng.randrange(1, 25))]

    def chain(items):
        best, back = [1] * len(items), [-1] * len(items)
        for x, (at, *c) in enumerate(items):
            for y in range(x):
                if items[y][0] < at and items[y][1:] < tuple(c) and best[y] + 1 >= best[x]:
                    best[x], back[x] = best[y] + 1, y
        x = max(range(len(items)), key=lambda i: (best[i], i))
        out = []
        while x >= 0:
            out.append(f"{items[x][1]}.{items[x][2]}")
            x = back[x]
        return len(out), " ".join(reversed(out))

    got = {r.doc: (r.length, r.chain) for r in W.longest_chain(spark.createDataFrame(rows, "doc int, line int, ch int, k int"), "doc", "line", "ch", "k").collect()}
    assert got == {d: chain(sorted({r[1:] for r in rows if r[0] == d})) for d in got} and len(got) == len({r[0] for r in rows})


def test_runs_over_stretches(spark):
    d = spark.createDataFrame([(k, x) for k in (1, 2) for x in (*range(3, 30 + k), 40, 41, 63, 64, 65)], "k int, p int")
    for stretch in (4, 16, 1 << 16):
        got = sorted((r.k, r.lo, r.hi, r.n) for r in W.runs(d, ["k"], "p", stretch).collect())
        assert got == [(1, 3, 30, 28), (1, 40, 41, 2), (1, 63, 65, 3), (2, 3, 31, 29), (2, 40, 41, 2), (2, 63, 65, 3)]


def test_nearest_over_stretches(spark):
    from pagemill.operators import joins as J

    p = spark.createDataFrame([(i, i) for i in range(-5, 120)], "key int, at int")
    samples = [0, 3, 4, 50, 51, 52, 90]
    s = spark.createDataFrame([(x, x * 10) for x in samples], "sample int, off int")
    for stretches in (1, 4, 64):
        got = {r["key"]: (r["sample"], r["off"]) for r in J.nearest(p, s, "key", "at", "sample", "off", stretches).collect()}
        want = {i: min(samples, key=lambda x: (abs(x - i), x)) for i in range(-5, 120)}
        assert got == {i: (x, 10 * x) for i, x in want.items()}


def test_runs(spark):
    d = spark.createDataFrame([(x,) for x in (3, 4, 5, 9, 10, 10)], "p int")
    assert sorted((r.lo, r.hi) for r in W.runs(d, [], "p").collect()) == [(3, 5), (9, 10)]


def test_rows_do_not_chain(spark):
    d = spark.createDataFrame([(1, float(y)) for y in (0, 10, 20)], "key int, y double")
    assert sorted((r.start, r.n) for r in W.cluster_rows(d, "key", "y", ["y"], 12).collect()) == [(0.0, 2), (20.0, 1)]


def test_throttle_is_greedy(spark):
    d = spark.createDataFrame([("k", i, s * 1_000_000) for i, s in enumerate((0, 6, 10, 15, 20))], "key string, i int, us long")
    assert sorted(r.us // 1_000_000 for r in S.throttle(d, "key", "i", "us", 10_000_000).filter("emitted").collect()) == [0, 10, 20]


def test_longest_chain_ties(spark):
    d = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 1, 1), (1, 3, 1, 2), (1, 4, 1, 9), (1, 5, 1, 3)], "doc int, line int, ch int, k int")
    r = W.longest_chain(d, "doc", "line", "ch", "k").first()
    assert (r.length, r.chain) == (3, "1.1 1.2 1.3")


def test_next_greater(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate((5, 3, 4, 9, 9))], "k int, o int, v int")
    assert [r.next_value for r in W.next_greater(d, ["k"], "o", "v").orderBy("o").collect()] == [9, 4, 9, None, None]


def test_ink(spark):
    d = spark.createDataFrame([([0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0],)], "ink array<int>")
    assert d.select(W.ink_trim(F.col("ink"), 2)).first()[0] == 3
    assert d.select(W.longest_true_run(F.transform("ink", lambda x: x == 0))).first()[0] == 7
    assert d.select(W.blank_band_above(F.col("ink"), F.lit(10))).first()[0] == 6


def test_spaced_characters(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, "习"), (1, 1.0, 25.0, 35.0, 11.0, "题"), (1, 0.0, 100.0, 200.0, 10.0, "一")], "page int, y0 double, x0 double, x1 double, y1 double, text string")
    assert sorted(r.text for r in W.merge_spaced(d.filter("x0 < 50")).collect()) == ["习题"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", f"2024-01-01 00:00:{s:02d}", "m", s) for s in (0, 6, 10, 15, 20)]
    spark.createDataFrame(rows, "key string, ts string, msg string, v int").withColumn("ts", F.to_timestamp("ts")).write.json(src)
    stream = lambda: spark.readStream.schema("key string, ts timestamp, msg string, v int").json(src)

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{mode}")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table("out").collect()

    assert sorted(r.us // 1_000_000 % 60 for r in run(S.throttled_stream(stream(), "key", "ts", "msg", 10), "append")) == [0, 10, 20]
    assert {r.n for r in run(S.windowed_rates(stream(), "ts", "v"), "complete")} == {5}
    q = S.upsert_latest(stream(), "key", "ts", str(tmp_path / "t"), str(tmp_path / "cu"))
    q.awaitTermination()
    assert [(r.key, r.v) for r in spark.read.parquet(str(tmp_path / "t" / "v0")).collect()] == [("a", 20)]


def test_log_readers(spark, tmp_path):
    from pagemill.sources import tables as R

    lines = spark.createDataFrame([("2024-01-01 00:00:00 | 请求 | a | b",), ("broken",), ("x | y | z",)], "value string")
    assert [(r.kind, r.msg) for r in R.parse_event_lines(lines).collect()] == [("请求", "a | b")]
    p = tmp_path / "u.jsonl"
    p.write_text('{"in": 1, "out": 2, "think": 3, "total": 0, "stage": "draft"}\nnot json\n{"in": 1, "total": 9}\n')
    assert sorted(r.total for r in R.usage_log(spark, str(p)).collect()) == [6, 9]


def test_segments_that_do_not_reach_the_bottom(spark):
    d = spark.createDataFrame([(1, 1, 10, 500), (1, 4, 20, 950), (1, 6, 30, 990), (1, 6, 70, 80)], "ch int, page int, y int, ink int")
    got = W.segment_bounds(d, "ch", "page", "y", 1000, bottom="ink").orderBy("page", "y").collect()
    assert [(r.end_y, r.flag, r.mid_pages) for r in got] == [(500, "whole", 0), (950, "stitch_mid_page", 1), (70, "whole", 0), (80, "last", 0)]
