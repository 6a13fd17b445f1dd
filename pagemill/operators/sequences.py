"""Order-dependent operators (W rows of the inventory).

Where a row's fate depends only on its neighbours, windows are used. Where a rejected row must not become anybody's
predecessor, the rows of one document pass by a state in order (`folds`); documents are the unit of parallel work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import Anchors, Chain, Expected, FirstGroup, Greater, Plain, Rows, Spaced, fold

MAX_SKIP = 2


def validate_sequence(rows: DataFrame, doc: str, order: list[str], index: str, skip: int = MAX_SKIP) -> DataFrame:
    """W1 for one chapter per document: accept the expected number, or one at most ``skip`` above it (the numbers left
    out are gaps), or 1 as a restart; reject the rest, which changes nothing. (doc, accepted, gaps, rejected), arrays in order."""
    numbered = rows.filter(F.col(index).isNotNull()).select(doc, *order, F.col(index).cast("long").alias("_k"))
    return fold(numbered, [doc], [*order, "_k"], ["_k"], lambda: Expected(skip), "accepted array<bigint>, gaps array<bigint>, rejected array<bigint>")


def validate_plain(rows: DataFrame, doc: str, order: list[str], index: str, kind: str, skip: int = MAX_SKIP) -> DataFrame:
    """W2, W3 for one chapter per document: a heading row opens a section, a stop row closes it; inside one the next number
    is accepted, one at most ``skip`` above, or 1 right after a heading. (doc, accepted) in order."""
    numbered = rows.select(doc, *order, F.col(kind).alias("_kind"), F.col(index).cast("long").alias("_k"))
    return fold(numbered, [doc], [*order, "_kind", "_k"], ["_kind", "_k"], lambda: Plain(skip), "accepted array<bigint>")


def find_anchors(lines: DataFrame, doc: str = "doc", skip: int = MAX_SKIP, chapter_digits: int = 2) -> DataFrame:
    """W1, W2, W3 in full: numbers of exercises in documents, as (doc, page, y0, x0, ch, k, gap).

    lines (doc, page, y0, x0, W, text, kind, page_kind, page_chapter, exam) are body lines with their kinds (P2, P3) and
    the chapter of their page (W7; null if unknown). Per line all candidates (F1) are tried by one rule before the next:
    the expected number of the chapter; one at most ``skip`` above, which leaves a gap; 1 of any chapter within a page of
    a heading. Once a number with the word for exercise in front was accepted, others do not count in that section. Lines
    without candidates may hold plain numbers, which count by chapter, in exams also on from the section before. Null
    texts, pages or tops are no lines; a null ``exam`` is no exam. Chapters have ``chapter_digits`` digits at most.
    """
    text = F.trim("text")
    section = F.regexp_extract(text, T.EXAM_SECTION, 1)
    heads = (section != "") & (F.col("x0") < 0.4 * F.col("W")) & F.regexp_extract(text, T.EXAM_SECTION, 2).rlike("[题分]")
    opener = F.regexp_extract(T.without_space(F.col("text")), "^第([0-9]+)章", 1)
    number = T.repair_digits(F.regexp_extract(text, T.PLAIN, 1))
    seen = lines.filter("text is not null and page is not null and y0 is not null").select(
        doc, "page", F.col("y0").cast("double").alias("y0"), F.col("x0").cast("double").alias("x0"), F.coalesce("exam", F.lit(False)).alias("_exam"), "page_kind", "page_chapter", "kind",
        F.when(opener != "", opener.cast("int")).alias("_opener"), F.when(heads, F.coalesce(T.chinese_numeral(F.left(section, F.lit(1))), F.lit(0))).alias("_section"),
        ((F.col("x0") <= 0.5 * F.col("W")) & (text != "")).alias("_left"), T.anchor_candidates(text, chapter_digits).alias("_candidates"), F.col("text").rlike(T.PREFIX).alias("_prefixed"), F.when(number.rlike(r"^\d+$"), number.cast("int")).alias("_number"),
    )
    values = ["page", "y0", "x0", "_exam", "page_kind", "page_chapter", "kind", "_opener", "_section", "_left", "_candidates", "_prefixed", "_number"]
    return fold(seen, [doc], ["page", "y0", "x0"], values, lambda: Anchors(skip), "page int, y0 double, x0 double, ch int, k int, gap array<int>")


def carry_section(rows: DataFrame, doc: str, order: list[str], kind: str) -> DataFrame:
    """W3 in its simple form: whether a row stands in a section, by the last heading or stop above it."""
    above = F.last(F.when(F.col(kind).isin("heading", "stop"), F.col(kind)), ignorenulls=True).over(Window.partitionBy(doc).orderBy(*order))
    return rows.withColumn("in_section", F.coalesce(above == "heading", F.lit(False)))


def number_segments(rows: DataFrame, chapter: str, order: list[str], index: str) -> DataFrame:
    """A new segment at every 1 and at a chapter's first row."""
    w = Window.partitionBy(chapter).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumn("_new", ((F.col(index) == 1) | first).cast("int")).withColumn("seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(rows: DataFrame, key: list[str], value: str, stretch: int = 1 << 16) -> DataFrame:
    """Runs of consecutive numbers as (key, lo, hi, n).

    Runs are found within stretches of the numbers first, so that one key's are spread; only those that touch an end of
    their stretch are then joined with their neighbours, two rows a stretch at most.
    """
    distinct = rows.select(*key, F.col(value).cast("long").alias("_v")).filter("_v is not null").distinct().withColumn("_s", F.floor(F.col("_v") / stretch))
    found = distinct.withColumn("_g", F.col("_v") - F.row_number().over(Window.partitionBy(*key, "_s").orderBy("_v")))
    found = found.groupBy(*key, "_s", "_g").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).drop("_g", "_s")
    touches = (F.pmod("lo", F.lit(stretch)) == 0) | (F.pmod(F.col("hi") + 1, F.lit(stretch)) == 0)
    w = Window.partitionBy(*key).orderBy("lo") if key else Window.orderBy("lo")
    first = F.coalesce(F.col("lo") != F.lag("hi").over(w) + 1, F.lit(True)).cast("int")
    joined = found.filter(touches).withColumn("_new", first).withColumn("_run", F.sum("_new").over(w)).groupBy(*key, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")
    return found.filter(~touches).unionByName(joined).withColumn("n", F.col("hi") - F.col("lo") + 1)


def forward_fill(rows: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last known value at or before each row."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def next_greater(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The value of the first later row that is strictly greater, else null.

    A range self-join would compare every pair of a key. Instead a key's rows pass by from the last to the first, over a
    stack from which a row removes all that are not greater, for they are hidden behind it from then on.
    """
    kind = dict(rows.dtypes)
    return fold(rows, key, [F.desc(order), F.desc(value)], [order, value], Greater, f"`{order}` {kind[order]}, `{value}` {kind[value]}, next_value {kind[value]}")


def segment_bounds(anchors: DataFrame, key: str, page: str, y: str, height: int, overflow: float = 0.08, bottom: str | None = None) -> DataFrame:
    """Where each item ends: at the next anchor of its key on the same page, else at the page's end; further pages up
    to the next anchor are stitched when the item reaches the lowest ``overflow`` of its page. ``bottom`` is where the
    content below an anchor ends on its page; without it all content is taken to reach the page's end."""
    w = Window.partitionBy(key).orderBy(page, y)
    nxt_p, nxt_y = F.lead(page).over(w), F.lead(y).over(w)
    out = anchors.withColumn("next_page", nxt_p).withColumn("next_y", nxt_y)
    same = F.col("next_page") == F.col(page)
    content = F.coalesce(F.col(bottom), F.lit(height)) if bottom else F.lit(height)
    short = F.col("next_page").isNotNull() & (content < (1 - overflow) * height)
    end = F.when(same, F.col("next_y")).otherwise(content)
    flag = F.when(same | short, "whole").when(F.col("next_page").isNull(), "last").when(F.col("next_page") == F.col(page) + 1, "stitched").otherwise("stitch_mid_page")
    return out.withColumn("end_y", end).withColumn("flag", flag).withColumn("mid_pages", F.when(short, 0).otherwise(F.greatest(F.lit(0), F.coalesce(F.col("next_page") - F.col(page) - 1, F.lit(0)))))


def item_segments(anchors: DataFrame, pages: DataFrame, doc: str = "doc", overflow: float = 0.08, least: int = 12) -> DataFrame:
    """W9 in full: the parts of pages that each item covers, as (doc, pid, page, y0, y1, flag).

    anchors (doc, pid, ch, page, y, ink): where an item begins and where the content below it ends on its page (null: at
    the footer). pages (doc, page, header_cut, footer_cut, H, flag). An item ends at the next anchor of its page, else
    with its content. If that reaches the lowest ``overflow`` of the page and there is a next page, it goes on: within its
    chapter over whole pages up to the next anchor's, of which it gets the head if that is taller than ``least``, but not
    past an opener, a stop or a table of contents; as the last of its chapter over the next page, if that is none of
    these and holds no anchor.
    """
    w = Window.partitionBy(doc).orderBy("page", "y", "pid")
    page = pages.select(doc, F.col("page").alias("_q"), "header_cut", "footer_cut", "H", F.coalesce(F.col("flag").isin("opener", "stop", "toc"), F.lit(False)).alias("_flagged"))
    a = anchors.withColumn("_np", F.lead("page").over(w)).withColumn("_ny", F.lead("y").over(w)).withColumn("_nc", F.lead("ch").over(w))
    a = a.join(page.select(doc, F.col("_q").alias("page"), "footer_cut", "H"), [doc, "page"])
    same = F.coalesce(F.col("_np") == F.col("page"), F.lit(False))
    bottom = F.coalesce("ink", "footer_cut")
    first = a.select(doc, "pid", "page", F.col("y").cast("double").alias("y0"), F.when(same, F.col("_ny")).otherwise(bottom).cast("double").alias("y1"), F.lit(None).cast("string").alias("flag"))
    on = a.filter(~same & (bottom >= F.col("footer_cut") - overflow * F.col("H"))).select(doc, "pid", "page", F.coalesce(F.col("_nc") == F.col("ch"), F.lit(False)).alias("_same"), "_np", "_ny")
    on = on.join(page.select(doc, (F.col("_q") - 1).alias("page")), [doc, "page"], "left_semi")
    whole = lambda flag: [doc, "pid", F.col("_q").alias("page"), F.col("header_cut").cast("double").alias("y0"), F.col("footer_cut").cast("double").alias("y1"), F.lit(flag).alias("flag")]
    steps = on.filter("_same").withColumn("_q", F.explode(F.sequence(F.col("page") + 1, F.col("_np")))).join(page, [doc, "_q"])
    mid = F.col("_q") < F.col("_np")
    over = F.max((mid & F.col("_flagged")).cast("int")).over(Window.partitionBy(doc, "pid").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("_over", over).filter("_over = 0")
    head = steps.filter(~mid & (F.col("_ny") - F.col("header_cut") > least))
    head = head.select(doc, "pid", F.col("_q").alias("page"), F.col("header_cut").cast("double").alias("y0"), F.col("_ny").cast("double").alias("y1"), F.lit("stitched").alias("flag"))
    tail = on.filter("not _same").withColumn("_q", F.col("page") + 1).join(page.filter("not _flagged"), [doc, "_q"]).join(anchors.select(doc, F.col("page").alias("_q")), [doc, "_q"], "left_anti")
    return first.unionByName(steps.filter(mid).select(*whole("stitch_mid_page"))).unionByName(head).unionByName(tail.select(*whole("stitched_tail")))


def stitched_pages(segments: DataFrame, page: str) -> DataFrame:
    """One row per whole page between an item's first page and the next anchor's."""
    return segments.filter("mid_pages > 0").withColumn("mid_page", F.explode(F.sequence(F.col(page) + 1, F.col("next_page") - 1)))


def cut_at_terminator(segments: DataFrame, terminators: DataFrame, page: str = "page", top: str = "y0", bottom: str = "y1", pad: int = 0) -> DataFrame:
    """A segment ends at the first terminator (page, ty) inside it."""
    inside = segments.join(terminators.select(F.col(page).alias("_p"), F.col("ty")), (F.col(page) == F.col("_p")) & (F.col("ty") > F.col(top) + pad) & (F.col("ty") < F.col(bottom)), "left")
    return inside.groupBy(*segments.columns).agg(F.min("ty").alias("cut")).withColumn(bottom, F.coalesce(F.col("cut"), F.col(bottom))).withColumn("was_cut", F.col("cut").isNotNull()).drop("cut")


def gap_regions(anchors: DataFrame, chapter: str, order: list[str], index: str) -> DataFrame:
    """Numbers missing between neighbours of one chapter, with the neighbour they follow."""
    w = Window.partitionBy(chapter).orderBy(*order)
    found = anchors.withColumn("prev", F.lag(index).over(w)).filter(F.col(index) > F.col("prev") + 1)
    return found.select(chapter, F.col("prev").alias("after"), F.col(index).alias("before"), F.sequence(F.col("prev") + 1, F.col(index) - 1).alias("missing"))


def recover_gaps(anchors: DataFrame, reread: DataFrame, chapter: str, order: list[str], index: str) -> DataFrame:
    """Anchors with those numbers that reading again has found (``reread``, columns alike) where they were missing:
    between the neighbours of one chapter and among the numbers left out there. Of a number found twice the first stays."""
    w = Window.partitionBy(chapter).orderBy(*order)
    at = F.struct(*order)
    gaps = anchors.select(chapter, F.lag(index).over(w).alias("_a"), F.col(index).alias("_b"), F.lag(at).over(w).alias("_from"), at.alias("_to")).filter("_b > _a + 1")
    found = reread.join(gaps, chapter).filter((F.col(index) > F.col("_a")) & (F.col(index) < F.col("_b")) & (at > F.col("_from")) & (at < F.col("_to")))
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy(chapter, "_from", index).orderBy(*order))).filter("_r = 1")
    return anchors.withColumn("recovered", F.lit(False)).unionByName(first.select(*anchors.columns).withColumn("recovered", F.lit(True)))


def cluster_rows(items: DataFrame, key: str, position: str, order: list[str], tolerance: float) -> DataFrame:
    """Items of a key in rows; an item joins the current row while it is within ``tolerance`` of the row's first
    item, so rows do not chain. (key, row_id, start, n)"""
    placed = items.filter(F.col(position).isNotNull()).select(key, *[c for c in order if c != position], F.col(position).cast("double").alias("_p"))
    return fold(placed, [key], ["_p", *[c for c in order if c != position]], ["_p"], lambda: Rows(tolerance), "row_id long, start double, n long")


def first_group(items: DataFrame, key: str, position: str, order: list[str], tolerance: float) -> DataFrame:
    """The older variant; an item joins the first earlier group within ``tolerance``, whichever it is."""
    placed = items.filter(F.col(position).isNotNull()).select(key, *order, F.col(position).cast("double").alias("_p"))
    return fold(placed, [key], [*order, "_p"], ["_p"], lambda: FirstGroup(tolerance), "group_id long, start double, n long")


def merge_neighbours(items: DataFrame, key: str, order: str, row: str, text: str, sep: str = "&emsp;&emsp;") -> DataFrame:
    """Consecutive sub-items of one row as one line; items of several lines or with display formulas stay alone."""
    w = Window.partitionBy(key).orderBy(order)
    alone = F.col(text).contains("\n") | F.col(text).contains("$$")
    joins = (F.lag(row).over(w) == F.col(row)) & ~alone & ~F.lag(alone).over(w)
    marked = items.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("line", F.sum("_new").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("_t")))), lambda x: x["_t"])
    return marked.groupBy(key, "line").agg(F.array_join(parts, sep).alias(text))


def merge_spaced(lines: DataFrame, page: str = "page") -> DataFrame:
    """Single characters set apart become one line again: same row (tops within half a height), gaps under three heights."""
    box = ["y0", "x0", "x1", "y1"]
    rows = lines.select(page, *[F.col(c).cast("double").alias(c) for c in box], "text").filter("text is not null")
    return fold(rows, [page], [*box, "text"], [*box, "text"], Spaced, "y0 double, x0 double, x1 double, y1 double, text string")


def best_round(reviews: DataFrame, key: list[str], round_: str, score: str, passing: int = 95) -> DataFrame:
    """Rounds count up to the first that passes; of those the greatest score, the earlier of equals. Null and 0 rank alike, below all."""
    w = Window.partitionBy(*key).orderBy(round_).rowsBetween(Window.unboundedPreceding, -1)
    seen = reviews.withColumn("_over", F.coalesce(F.max(F.when(F.col(score) >= passing, 1)).over(w), F.lit(0))).filter("_over = 0")
    rank = F.struct(F.coalesce(F.nullif(F.col(score), F.lit(0)), F.lit(-1)).alias("s"), (-F.col(round_)).alias("r"))
    return seen.groupBy(*key).agg(F.max_by(F.struct(F.col(round_).alias("round"), F.col(score).alias("score")), rank).alias("b"), F.count(F.lit(1)).alias("rounds")).select(*key, F.col("b.round").alias("best_round"), F.col("b.score").alias("score"), "rounds")


def stage_durations(rows: DataFrame, key: list[str], ts: str, now: Column | None = None) -> DataFrame:
    """Seconds until the next row of the key; the last row lasts until ``now``, or is open."""
    following = F.lead(ts).over(Window.partitionBy(*key).orderBy(ts))
    end = F.coalesce(following, now) if now is not None else following
    return rows.withColumn("seconds", (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6)


def last_stages(durations: DataFrame, ts: str, n: int = 8) -> DataFrame:
    """The newest rows of a timeline."""
    return durations.orderBy(F.desc(ts)).limit(n)


def broken_continuity(rows: DataFrame, key: str, order: list[str], index: str) -> DataFrame:
    """Places where a number is not its predecessor plus one."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("prev", F.lag(index).over(w)).filter(F.col("prev").isNotNull() & (F.col(index) != F.col("prev") + 1)).select(key, "prev", F.col(index).alias("cur"))


def ink_trim(profile: Column, height: int, most: int = 2) -> Column:
    """The end of the last ink block of a column of row counts, after dropping up to ``most`` small trailing blocks
    that stand ``3 * height`` or more below the block before."""
    block = "struct<a:int,b:int>"
    none = F.array_repeat(F.lit(None).cast(block), most + 1)  # the last blocks, the latest first

    def grow(s: Column, x: Column) -> Column:
        new = lambda a: F.struct(a.alias("a"), (x["i"] + 1).alias("b"))
        touches = F.coalesce(s[0]["b"] == x["i"], F.lit(False))
        return F.when(~x["ink"], s).when(touches, F.concat(F.array(new(s[0]["a"])), F.slice(s, 2, most))).otherwise(F.concat(F.array(new(x["i"])), F.slice(s, 1, most)))

    def end(s: Column) -> Column:
        out = s[most]["b"]
        for i in reversed(range(most)):
            drop = (s[i]["a"] - s[i + 1]["b"] >= 3 * height) & (s[i]["b"] - s[i]["a"] < height)
            out = F.when(F.coalesce(drop, F.lit(False)), out).otherwise(s[i]["b"])
        return F.coalesce(out, F.lit(0))

    return F.aggregate(F.transform(profile, lambda v, i: F.struct(i.alias("i"), (v > 0).alias("ink"))), none, grow, end)


def longest_true_run(flags: Column) -> Column:
    """The length of the longest run of true."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x, s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(flags, start, step)["best"]


def blank_band_above(ink: Column, y: Column) -> Column:
    """The middle of the nearest band of blank rows above ``y``; 0 when there is none."""
    start = F.struct(F.lit(-1).alias("top"), F.lit(-1).alias("bottom"), F.lit(False).alias("open"))

    def step(s: Column, x: Column) -> Column:
        blank = x["v"] == 0
        fresh = blank & ~s["open"]
        return F.when(x["i"] >= y, s).otherwise(F.struct(F.when(fresh, x["i"]).otherwise(s["top"]).alias("top"), F.when(blank, x["i"]).otherwise(s["bottom"]).alias("bottom"), blank.alias("open")))

    end = lambda band: F.when(band["bottom"] < 0, 0).otherwise(F.floor((band["top"] + band["bottom"]) / 2)).cast("int")
    return F.aggregate(F.transform(ink, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), start, step, end)


def carry_forward_sections(events: DataFrame, order: list[str], page: str, y: str, section: str) -> DataFrame:
    """The current section of each sub-question, and the next event more than 10 below it on the same page.

    Pages are the unit of parallel work; sections are carried over pages by their last one.
    """
    filled = events.withColumn("sec", F.last(section, ignorenulls=True).over(Window.partitionBy(page).orderBy(*order)))
    last = events.filter(F.col(section).isNotNull()).groupBy(page).agg(F.max_by(section, F.struct(*order)).alias("at_end"))
    pages = events.select(page).distinct().join(last, page, "left")
    carried = pages.withColumn("carried", F.last("at_end", ignorenulls=True).over(Window.orderBy(page).rowsBetween(Window.unboundedPreceding, -1))).select(page, "carried")  # a row per page
    below = F.min(y).over(Window.partitionBy(page).orderBy(F.col(y)).rangeBetween(11, Window.unboundedFollowing))
    return filled.join(carried, page, "left").withColumn("sec", F.coalesce("sec", "carried")).withColumn("next_y", below).drop("carried")


def longest_chain(rows: DataFrame, doc: str, line: str, chapter: str, index: str) -> DataFrame:
    """Per document the longest chain with growing line and growing (chapter, index). Of equal lengths the later end
    wins and, before it, the greater predecessor. (doc, length, chain)"""
    distinct = rows.select(doc, line, F.col(chapter).cast("long").alias("_ch"), F.col(index).cast("long").alias("_k")).distinct()
    return fold(distinct, [doc], [line, "_ch", "_k"], [line, "_ch", "_k"], Chain, "length long, chain string")
