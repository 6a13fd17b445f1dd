"""Boxes on pages, page spans, gates and order of items (G, X, O and U rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = "struct<page:int,y0:int,y1:int,x0:int,x1:int>"


def crop_x(ink_l: Column, ink_r: Column, prof_l: Column, prof_r: Column, margin: int, width: Column) -> Column:
    """G1: the page's ink and the book's profile together, with a margin, within the page."""
    return F.struct(F.greatest(F.least(ink_l, prof_l) - margin, F.lit(0)).alias("x0"), F.least(F.greatest(ink_r, prof_r) + margin, width).alias("x1"))


def first_clean_margin(touching: Column, margin: int = 36, step: int = 40) -> Column:
    """The first margin whose render has no ink at its edge; the last one tried if none has. ``touching``: one boolean per try."""
    tries = F.transform(touching, lambda t, i: F.struct(t.alias("t"), (F.lit(margin) + i * step).alias("m")))
    clean = F.filter(tries, lambda x: ~x["t"])
    return F.coalesce(F.try_element_at(clean, F.lit(1))["m"], F.try_element_at(tries, F.lit(-1))["m"])


def reassign_figures(segments: DataFrame, captions: DataFrame) -> DataFrame:
    """Segments (chapter, pid, page, y0, y1, ink_only) and captions (chapter, pid, page, y). A figure-only segment
    moves to the problem its caption names; one that holds text too is copied; captions of two problems leave it where
    it is, marked. One row per segment and owner."""
    hit = captions.select("chapter", F.col("pid").alias("named"), "page", "y").filter("named is not null")
    span = ["chapter", "page", "y0", "y1"]
    named = _few_names(segments.select(*span).distinct().filter("y0 <= y1"), hit)
    found = segments.distinct().join(named, span, "left").withColumn("names", F.filter(F.coalesce("_names", F.array().cast(dict(named.dtypes)["_names"])), lambda n: n != F.col("pid")))
    g = found.select(*segments.columns, "names")
    action = F.when(F.size("names") == 0, "keep").when(F.size("names") > 1, "unresolved").when(F.col("ink_only"), "move").otherwise("copy")
    g = g.withColumn("action", action)
    owners = F.when(F.col("action") == "move", F.col("names")).when(F.col("action") == "copy", F.concat(F.array("pid"), "names")).otherwise(F.array("pid"))
    return g.withColumn("owner", F.explode(owners)).drop("names")


def _few_names(spans: DataFrame, hit: DataFrame, top: int = 16) -> DataFrame:
    """(chapter, page, y0, y1, _names): the names that captions inside of a span give, all of them up to three and three of
    more, which tells none, one and several apart whichever name is the span's own.

    Rows of pixels are put together in pairs, pairs of these and so on, and each stretch keeps three names. A span asks
    for the few stretches that make up the rows between its ends, and compares captions one by one in the end rows only.
    """
    place = ["chapter", "page"]

    def three(rows: DataFrame, *key: str) -> DataFrame:
        return rows.distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("named"))).filter("_r <= 3").drop("_r")

    at = hit.withColumn("_cell", F.floor("y"))
    cells = three(at.select(*place, "_cell", "named"), *place, "_cell")
    level = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_level")
    tree = cells.select("*", level).withColumn("_node", F.expr("shiftright(_cell, _level)"))
    tree = three(tree.select(*place, "_level", "_node", "named"), *place, "_level", "_node")
    lo, hi = F.floor("y0") + 1, F.floor("y1")  # rows from lo, below hi
    first, end = lambda n: -F.floor(-lo / F.pow(F.lit(2), n)), lambda n: F.floor(hi / F.pow(F.lit(2), n))
    node = lambda n, at: F.struct(n.alias("_level"), at.alias("_node"))
    inner = F.transform(F.sequence(F.lit(0), F.lit(top - 1)), lambda n: F.when(first(n) < end(n), F.array_compact(F.array(F.when(first(n) % 2 != 0, node(n, first(n))), F.when(end(n) % 2 != 0, node(n, end(n) - 1))))))
    n = F.lit(top)
    outer = F.when(first(n) < end(n), F.transform(F.sequence(first(n), end(n) - 1), lambda at: node(n, at)))
    asked = spans.select("*", F.explode(F.flatten(F.array_compact(F.concat(inner, F.array(outer))))).alias("_n")).select(*spans.columns, "_n.*")
    whole = asked.join(tree, [*place, "_level", "_node"]).select(*spans.columns, "named")
    ends = spans.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor("y0"), F.floor("y1")))))
    edge = ends.join(three(at.select(*place, "_cell", "y", "named"), *place, "y"), [*place, "_cell"]).filter("y >= y0 and y <= y1").select(*spans.columns, "named")
    return three(whole.unionByName(edge), *spans.columns).groupBy(*spans.columns).agg(F.array_sort(F.collect_list("named")).alias("_names"))


def side_figures(lines: DataFrame, width: Column) -> DataFrame:
    """Pages where text leaves a side free: lines that end left of 60 % of the width while others reach the edge, as (page, y0, y1, x_free)."""
    short = lines.filter(F.col("x1") < 0.6 * width)
    w = Window.partitionBy("page").orderBy("y0")
    runs = short.withColumn("_new", F.when(F.col("y0") - F.lag("y1").over(w) < 30, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy("page", "run").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max("x1").alias("x_free"), F.count(F.lit(1)).alias("n")).filter("n >= 3").drop("run")


def split_side_figures(segments: DataFrame, figures: DataFrame, least: int = 8) -> DataFrame:
    """Segments (pid, page, y0, y1) of full width, split where a figure (page, f0, f1, xf, left, right, owner) stands
    beside the text of two problems or more: (pid, page, y0, y1, x0, x1, flag).

    Beside the figure only what is left of it remains; above and below the whole width does, if more than ``least`` high.
    The figure goes to its owner, whether or not that has a segment there. x0 and x1 are null for the whole width. Of
    several figures beside a segment the first counts.
    """
    fig = figures.select("page", "f0", "f1", "xf", "left", "right", "owner")
    met = segments.join(fig, "page").filter("y0 < f1 and y1 > f0")
    crossing = met.groupBy("page", "f0").agg(F.count_distinct("pid").alias("n"), F.bool_or(F.col("pid") == F.col("owner")).alias("own")).filter("n >= 2")
    key = ["pid", "page", "y0", "y1"]
    first = met.join(crossing, ["page", "f0"]).groupBy(*key).agg(F.min_by(F.struct("f0", "f1", "xf", "left", "right", "owner"), "f0").alias("f"))
    part = lambda y0, y1, x0, x1: F.struct(y0.alias("a"), y1.alias("b"), x0.cast("long").alias("x0"), x1.cast("long").alias("x1"))
    none, f0, f1 = F.lit(None), F.col("f.f0"), F.col("f.f1")
    mine = F.col("pid") == F.col("f.owner")
    parts = F.array_compact(F.array(
        F.when(f0 - F.col("y0") > least, part(F.col("y0"), f0, none, none)),
        part(F.greatest("y0", f0), F.least("y1", f1), F.col("f.left"), F.col("f.xf")),
        F.when(mine, part(f0, f1, F.col("f.xf"), F.col("f.right"))),
        F.when(F.col("y1") - f1 > least, part(f1, F.col("y1"), none, none)),
    ))
    split = first.select("pid", "page", F.explode(parts).alias("p"), F.when(mine, "side_figure").otherwise("side_figure_removed").alias("flag"))
    split = split.select("pid", "page", F.col("p.a").alias("y0"), F.col("p.b").alias("y1"), "p.x0", "p.x1", "flag")
    lost = fig.join(crossing.filter("not own"), ["page", "f0"]).select(F.col("owner").alias("pid"), "page", F.col("f0").alias("y0"), F.col("f1").alias("y1"), F.col("xf").cast("long").alias("x0"), F.col("right").cast("long").alias("x1"), F.lit("side_figure").alias("flag"))
    kept = segments.select(*key).join(first.select(*key), key, "left_anti").select(*key, none.cast("long").alias("x0"), none.cast("long").alias("x1"), none.cast("string").alias("flag"))
    return kept.unionByName(split).unionByName(lost)


def own_figures_after(rest: DataFrame, captions: DataFrame) -> DataFrame:
    """Parts cut off an item (pid, page, y0, y1) that hold a caption of that item."""
    inside = captions.select(F.col("pid"), F.col("page"), F.col("y"))
    return rest.join(inside, ["pid", "page"]).filter("y >= y0 and y <= y1").drop("y").distinct()


def dark_bar_end(row_ink: Column, width: Column, cut: Column) -> Column:
    """The first row below ``cut`` after a bar whose rows are at least 60 % dark; ``cut`` when there is none."""
    start = F.struct(cut.cast("int").alias("end"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        dark = x["v"] >= 0.6 * width
        go = s["open"] & (x["i"] >= cut)
        return F.struct(F.when(go & dark, x["i"] + 1).otherwise(s["end"]).alias("end"), F.when(x["i"] < cut, True).otherwise(go & dark).alias("open"))

    return F.aggregate(F.transform(row_ink, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), start, step)["end"]


def stacked_size(parts: DataFrame) -> DataFrame:
    """The size of an item whose parts stand one below the other; parts with a side under 4 are left out."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return parts.filter((w >= 4) & (h >= 4)).groupBy("problem_id").agg(F.max(w).alias("width"), F.sum(h).alias("height"), F.count(F.lit(1)).alias("parts"))


def mask_offsets(boxes: DataFrame) -> DataFrame:
    """Where each box (problem_id, box, y0, y1) begins in the stacked image."""
    h = F.col("y1") - F.col("y0")
    return boxes.withColumn("offset", F.coalesce(F.sum(h).over(Window.partitionBy("problem_id").orderBy("box").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def save_boxes(problems: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual boxes (problem_id, boxes) in order of page and top replace those of a problem, whose text and verdicts become stale."""
    e = edits.select("problem_id", F.array_sort("boxes").alias("_b"))
    joined = problems.join(e, "problem_id", "left")
    edited = F.col("_b").isNotNull()
    return joined.withColumn("boxes", F.coalesce("_b", "boxes")).withColumn("stale_text", edited).withColumn("flags", F.when(edited, F.array(F.lit("manual"))).otherwise(F.array().cast("array<string>"))).drop("_b")


def apply_operations(items: DataFrame) -> DataFrame:
    """Items (problem_id, boxes, ops, next_top, page_height) with their planned edits applied in order.

    ops: array of (op, y, limit). "下边到" sets the last original box's bottom to y + 8, "上边到" the first one's top to
    y - 8 unless that moves it down by more than 15, "续下一页" adds a box on the next page if it is taller than 20,
    "去掉续页" keeps the first page's boxes only.
    """
    first, last = F.element_at("boxes", 1), F.size("boxes")
    put = lambda bs, i, **k: F.transform(bs, lambda b, j: F.when(j + 1 == i, F.struct(b["page"].alias("page"), k.get("y0", b["y0"]).cast("int").alias("y0"), k.get("y1", b["y1"]).cast("int").alias("y1"), b["x0"].alias("x0"), b["x1"].alias("x1"))).otherwise(b))

    def step(bs: Column, o: Column) -> Column:
        top = F.greatest(F.lit(0), o["y"] - 8)
        end = F.element_at(bs, -1)
        y0 = (0.06 * F.col("page_height")).cast("int")
        y1 = F.coalesce(F.col("next_top") - 6, (0.94 * F.col("page_height")).cast("int")).cast("int")
        more = F.struct((end["page"] + 1).alias("page"), y0.alias("y0"), y1.alias("y1"), end["x0"].alias("x0"), end["x1"].alias("x1"))
        return (
            F.when(o["op"] == "下边到", put(bs, last, y1=o["y"] + 8))
            .when((o["op"] == "上边到") & (top - first["y0"] <= 15), put(bs, F.lit(1), y0=top))
            .when((o["op"] == "续下一页") & (y1 - y0 > 20), F.concat(bs, F.array(more)))
            .when(o["op"] == "去掉续页", F.filter(bs, lambda b: b["page"] == first["page"]))
            .otherwise(bs)
        )

    return items.withColumn("boxes", F.aggregate("ops", F.col("boxes").cast(f"array<{BOX}>"), step))


def snap_down(ink: Column, y: Column, most: int = 60) -> Column:
    """The first blank row at or below ``y``, at most ``most`` rows on; else ``y``."""
    found = F.filter(F.transform(F.slice(ink, y + 1, most + 1), lambda v, i: F.when(v == 0, y + i)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), y)


def keep_or_revert(before: DataFrame, after: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New boxes stay only where the second check (problem_id, ok) is content."""
    a = after.select("problem_id", F.col("boxes").alias("_new"))
    out = before.join(a, "problem_id", "left").join(verdicts, "problem_id", "left")
    good = F.col("_new").isNotNull() & F.coalesce("ok", F.lit(False))
    return out.withColumn("status", F.when(F.col("_new").isNull(), "unchanged").when(good, "fixed").otherwise("reverted")).withColumn("boxes", F.when(good, F.col("_new")).otherwise(F.col("boxes"))).drop("_new", "ok")


def exam_bottom(limit: Column, text_bottom: Column) -> Column:
    """5 above the next item, but 18 below the text when more than 70 would be blank."""
    end = limit - 5
    return F.when(end - text_bottom > 70, text_bottom + 18).otherwise(end)


def page_per_problem(chapters: DataFrame) -> DataFrame:
    """Without any item found, each page of a chapter (chapter, start_page, end_page) is one."""
    pages = chapters.select("chapter", F.posexplode(F.sequence("start_page", "end_page")).alias("i", "page"))
    return pages.select("chapter", F.concat_ws(".", "chapter", (F.col("i") + 1).cast("string")).alias("problem_id"), "page")


# Fixed values (G15): the literal exam layout, as section, number, page, top and bottom in points.
EXAM_LAYOUT = (
    (1, 1, 1, 289.0, 370.0), (1, 2, 1, 370.0, 448.0), (1, 3, 1, 456.0, 526.0), (1, 4, 1, 526.0, 582.0), (1, 5, 1, 584.0, 638.0),
    (2, 1, 2, 126.0, 156.0), (2, 2, 2, 156.0, 193.0), (2, 3, 2, 193.0, 227.0), (2, 4, 2, 227.0, 248.0), (2, 5, 2, 252.0, 272.0),
    (3, 1, 2, 298.0, 335.0), (3, 2, 2, 502.0, 530.0), (3, 3, 3, 105.0, 144.0), (3, 4, 3, 366.0, 425.0), (3, 5, 4, 98.0, 140.0), (3, 6, 4, 353.0, 395.0),
    (4, 1, 5, 126.0, 186.0), (4, 2, 5, 446.0, 470.0), (4, 3, 6, 97.0, 140.0), (4, 4, 6, 387.0, 448.0),
)


def exam_layout(spark) -> DataFrame:
    """The fixed twenty questions as (section, number, page, y0, y1)."""
    return spark.createDataFrame(EXAM_LAYOUT, "section int, number int, page int, y0 double, y1 double")


def gate(best: DataFrame, score: str = "score", passing: int = 95) -> DataFrame:
    """Passed, needs_review or unreviewed, and whether the draft is final."""
    passed = F.coalesce(F.col(score) >= passing, F.lit(False))
    return best.withColumn("status", F.when(passed, "passed").when(F.col(score).isNotNull(), "needs_review").otherwise("unreviewed")).withColumn("final_mode", F.when(passed, "draft_passed").otherwise("rewritten"))


# Fixed values (X3): thinking budgets per stage, and stages that get images in high resolution.
BUDGETS = {"transcribe": 2048, "verify": 4096, "crop_check": 4096, "compact": 1024, "review": 6000, "draft": 8000, "draft_easy": 4000, "draft_retry": 12000, "final": 12000, "locate": 4096}
HIGH_RESOLUTION = ("transcribe", "verify", "crop_check", "crop_fix", "locate")


def stage_settings(stages: DataFrame, stage: str = "stage", budget: int = 8000, resolution: str = "MEDIUM") -> DataFrame:
    """Each stage's thinking budget and the resolution of its images; others get the defaults."""
    budgets = F.create_map(*[F.lit(x) for kv in BUDGETS.items() for x in kv])
    return stages.withColumn("budget", F.coalesce(F.try_element_at(budgets, F.col(stage)), F.lit(budget))).withColumn("resolution", F.when(F.col(stage).isin(*HIGH_RESOLUTION), "HIGH").otherwise(resolution))


def solve(problems: DataFrame, replies: DataFrame, passing: int = 95, rounds: int = 3) -> DataFrame:
    """The solving path from a table of replies (problem_id, round, stage, reply): score, best round, gate, slot row."""
    from ..functions.text import last_score, split_compact
    from .sequences import best_round

    reviews = replies.filter((F.col("stage") == "review") & (F.col("round") <= rounds)).select("problem_id", "round", last_score(F.col("reply")).alias("score"))
    best = gate(best_round(reviews, ["problem_id"], "round", "score", passing), passing=passing)
    text = replies.select("problem_id", F.col("round").alias("best_round"), "stage", "reply")
    drafts = text.filter("stage like 'draft%'").select("problem_id", "best_round", F.col("reply").alias("draft"))
    finals = text.filter("stage = 'final'").select("problem_id", F.col("reply").alias("rewritten")).dropDuplicates(["problem_id"])
    out = problems.join(best, "problem_id").join(drafts, ["problem_id", "best_round"], "left").join(finals, "problem_id", "left")
    whole = F.when(F.col("final_mode") == "draft_passed", F.col("draft")).otherwise(F.coalesce("rewritten", "draft"))
    parts = split_compact(whole)
    return out.withColumn("final", parts["final"]).withColumn("compact", parts["compact"]).drop("rewritten")


def verify_issues(rows: DataFrame) -> DataFrame:
    """Issues of a problem from its slice, text verdict and solution, as an array."""
    return rows.withColumn(
        "issues",
        F.array_compact(
            F.array(
                F.when(F.coalesce(F.col("height") < 25, F.lit(True)) | (F.col("width") < 200), "slice"),
                F.when(~F.coalesce("text_ok", F.lit(True)), "text"),
                F.when(F.coalesce(F.trim("final"), F.lit("")) == "", "no_final"),
                F.when(F.coalesce(F.trim("compact"), F.lit("")) == "", "no_compact"),
                F.when(F.col("status").isin("needs_review", "unreviewed"), F.col("status")),
            )
        ),
    )


def backfill(problems: DataFrame, slots: DataFrame) -> DataFrame:
    """Missing problem texts from the slot, missing compacts from the final."""
    from ..functions.text import split_compact

    s = slots.select("problem_id", F.col("text").alias("_t"), "final", "compact")
    out = problems.join(s, "problem_id", "left").withColumn("text", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "_t")).drop("_t")
    return out.withColumn("compact", F.coalesce(F.nullif("compact", F.lit("")), split_compact(F.col("final"))["compact"]))


def page_mapping(samples: DataFrame, ranges: DataFrame, n_pages: int) -> DataFrame:
    """Printed page ranges (seq, start, end) as file pages by sampled offsets (printed, pdf). Empty when there are
    fewer than two samples, they differ by more than 12, or more than 60 % of the pages would be taken."""
    from .joins import nearest

    good = samples.filter((F.col("printed") > 5) & F.col("pdf").between(1, n_pages)).select("printed", (F.col("pdf") - F.col("printed")).alias("off"))
    spread = good.agg(F.count(F.lit(1)).alias("n"), (F.max("off") - F.min("off")).alias("spread"))
    end = F.coalesce("end", F.col("start") + 4)
    end = F.when((end < F.col("start")) | (end - F.col("start") > 40), F.col("start") + 4).otherwise(end)
    near = nearest(ranges.withColumn("end", end), good, "seq", "start", "printed", "off").select("seq", "off")
    pad = F.when(F.col("spread") == 0, 1).otherwise(F.least(F.lit(4), F.col("spread") + 1))
    spans = ranges.withColumn("end", end).join(near, "seq").join(F.broadcast(spread)).filter("n >= 2 and spread <= 12")  # one row
    spans = spans.withColumn("a", F.col("start") + F.col("off")).withColumn("b", F.col("end") + F.col("off")).filter(F.col("a").between(1, n_pages))
    pages = spans.select(F.explode(F.sequence(F.greatest(F.lit(1), F.col("a") - pad), F.least(F.lit(n_pages), F.col("b") + pad))).alias("page")).distinct()
    return pages.join(F.broadcast(pages.agg(F.count(F.lit(1)).alias("taken")))).filter(F.col("taken") <= 0.6 * n_pages).select("page")  # one row


def page_set(spans: DataFrame, a: str, b: str, pad: int, last: int) -> DataFrame:
    """Distinct pages of spans with swapped ends put right, widened and clipped."""
    lo, hi = F.greatest(F.least(a, b) - pad, F.lit(1)), F.least(F.greatest(a, b) + pad, F.lit(last))
    return spans.filter(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias("page")).distinct()


# Order


def natural_order(pid: str = "problem_id") -> list[Column]:
    """O1: by chapter and number."""
    part = lambda i: F.split_part(F.col(pid), F.lit("."), F.lit(i)).cast("int")
    return [part(1), part(2)]


def line_order() -> list[Column]:
    """Lines of a page from the top, then from the left."""
    return [F.col("y0"), F.col("x0")]


def anchor_order() -> list[Column]:
    """Anchors by page, then from the top."""
    return [F.col("page"), F.col("y0")]


def chapter_order(chapter: str = "chapter") -> list[Column]:
    """Chapters by their number, those without one last."""
    return [F.col(chapter).try_cast("int").asc_nulls_last(), F.col(chapter)]


def float_order(pid: str = "problem_id", pos: str = "pos") -> list[Column]:
    """O2: as a decimal number, in which 1.10 equals 1.1; for exams of old only."""
    return [F.col(pid).cast("double"), F.col(pos)]


def stratified_pick(items: DataFrame, most: int = 4) -> DataFrame:
    """The first item on an odd page, on an even page, of several parts, and the tallest; each once, at most four."""
    tops = [("odd", "page % 2 = 1", ["page", "y0"]), ("even", "page % 2 = 0", ["page", "y0"]), ("stitched", "parts > 1", ["page", "y0"])]
    picks = [items.filter(c).agg(F.min_by(F.struct(*items.columns), F.struct(*o)).alias("i")).withColumn("rank", F.lit(n)) for n, (_, c, o) in enumerate(tops)]
    picks.append(items.agg(F.max_by(F.struct(*items.columns), F.struct("height", -F.col("page"))).alias("i")).withColumn("rank", F.lit(3)))
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    first = out.filter("i is not null").groupBy("i").agg(F.min("rank").alias("rank"))
    return first.orderBy("rank").limit(most).select("i.*", "rank")


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def longer_of_last_two(rows: DataFrame, key: list[str], pos: str, body: str) -> DataFrame:
    """Of a key's last two bodies the longer, the later of equals."""
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(pos)))
    return rows.withColumn("_r", r).filter("_r <= 2").groupBy(*key).agg(F.max_by(body, F.struct(F.length(body), F.col(pos))).alias(body))


def compile_order(tasks: DataFrame) -> DataFrame:
    """Whole books first, then the heaviest."""
    return tasks.orderBy(F.when(F.col("scope") == "book", 0).otherwise(1), F.desc("weight"), "name")


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps, the new value where both have a key."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(old), lambda e: ~F.array_contains(F.map_keys(new), e["key"])), F.map_entries(new)))


def merge_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows that were not checked again, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
