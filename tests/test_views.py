from pyspark.sql import functions as F

from pagemill.operators import geometry as G
from pagemill.plans import views as V
from pagemill.sources import tables


def bank(spark):
    p = spark.createDataFrame([(1, "1.1", "old text one", "ocr"), (1, "1.2", "old text two", "ocr"), (1, "1.10", None, "ocr"), (2, "2.1", "x", "ocr")], "chapter int, problem_id string, text string, text_source string")
    return p.withColumn("boxes", F.array().cast(f"array<{tables.BOX}>"))


def test_import(spark):
    text = spark.createDataFrame([(1, "### 1.1\nnew $x$\n### 1.2\nbad $y\n### 1.10\nlast\n### 1.10\nlast one\n### 3.1\nextra")], "doc int, text string")
    problems, status = V.import_text(bank(spark), text)
    assert {r.problem_id: (r.text, r.text_source) for r in problems.collect()} == {"1.1": ("new $x$", "imported"), "1.2": ("old text two", "ocr"), "1.10": ("last one", "imported"), "2.1": ("x", "ocr")}
    r = V.import_report(status).first()
    assert (r.parsed, r.cropped, r.matched) == (4, 4, 2)
    assert (r.missing_in_text, r.missing_in_crop, r.duplicated_in_text, r.damaged_in_text) == (["2.1"], ["3.1"], ["1.10"], ["1.2"])


def test_solving_and_markdown(spark):
    replies = [("1.1", 1, "draft", "## 习题 1.1 解\n### 详尽分步\na"), ("1.1", 1, "review", "评分：97"), ("1.2", 1, "draft", "d1"), ("1.2", 1, "review", "评分：50"), ("1.2", 2, "draft_retry", "d2"), ("1.2", 2, "review", "评分：60"), ("1.2", 2, "final", "whole\n### 速查\nshort")]
    slots = G.solve(bank(spark).select("problem_id"), spark.createDataFrame(replies, tables.MODEL_REPLY))
    got = {r.problem_id: (r.best_round, r.status, r.final, r.compact) for r in slots.collect()}
    assert got["1.1"][1] == "passed" and got["1.1"][3] == "### 详尽分步\na" and got["1.2"] == (2, "needs_review", "whole", "short")
    full = slots.select("problem_id", "final", "compact", "status", "score", *[F.lit(None).cast("string").alias(c) for c in ("stage2", "stage3", "stage3_deduction", "compact_breakdown")])
    md = {r.chapter: r for r in V.chapter_markdown(bank(spark), full).collect()}
    assert set(md) == {1} and md[1]["all"].index("习题 1.1") < md[1]["all"].index("习题 1.2") and "待人工复核" in md[1]["all"] and "#### 详尽分步" in md[1]["compact"]


def test_problem_view_order(spark):
    slots = spark.createDataFrame([("1.2", "passed", 97, True)], "problem_id string, status string, score int, stale_text boolean")
    issues = spark.createDataFrame([("1.10", ["a"])], "problem_id string, issues array<string>")
    jobs = spark.createDataFrame([("2.1", "queued")], "problem_id string, state string")
    rows = V.chapter_problems(bank(spark), slots, issues, issues.limit(0), jobs).collect()
    assert [r.problem_id for r in rows] == ["1.1", "1.2", "1.10", "2.1"]
    assert [r.needs_review for r in rows] == [False, True, True, False] and rows[3].state == "queued"


def test_writers(spark, tmp_path):
    from pagemill.sources import sinks

    report = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "project string, chapter int, note string")
    path = str(tmp_path / "report")
    sinks.write_report(report, path)
    sinks.write_report(report.filter("project = 'a'").withColumn("note", F.lit("new")), path)  # b's part stays
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("project", "chapter", "note").collect()) == [("a", 1, "new"), ("b", 1, "y")]
    sinks.write_markdown(report.select("project", "note"), str(tmp_path / "md"), "project", "note")
    assert sorted(tuple(r) for r in spark.read.text(str(tmp_path / "md")).select("project", "value").collect()) == [("a", "x"), ("b", "y")]
    src = str(tmp_path / "in")
    report.write.json(src)
    for _ in range(2):  # a second run finds nothing new
        sinks.append_json(spark.readStream.schema(report.schema).json(src), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    stream = tables.inbox(spark, src, "project string, chapter int, note string")
    q = stream.writeStream.format("memory").queryName("inbox").option("checkpointLocation", str(tmp_path / "inbox")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("inbox").count() == 2
