"""Joins between items, replies, boxes and pages (J rows), and what filters them (P rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import spread

# Where a text can come from.
IMPORTED = ("imported", "imported_check")
TRUSTED = ("text_layer", "verified", *IMPORTED)
VERIFIED = ("verified", "imported")  # imported_check is still to be checked


def first_filled(*cols: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def with_solutions(problems: DataFrame, slots: DataFrame) -> DataFrame:
    """Problems with their final and compact text, whatever field an old row keeps them in."""
    s = slots.select("problem_id", first_filled("final", "stage3").alias("final"), first_filled("compact", "compact_breakdown", "stage3_deduction", "stage2").alias("compact"), "status", "score")
    return problems.join(s, "problem_id", "left")


def status_view(items: DataFrame, reviews: DataFrame, key: str, status: Column, flagged: Column) -> DataFrame:
    """Items with their review; without one they are unsolved; flagged ones need review."""
    joined = items.join(reviews, key, "left")
    return joined.withColumn("status", F.coalesce(status, F.lit("unsolved"))).withColumn("needs_review", F.coalesce(flagged, F.lit(False)))


def problem_view(problems: DataFrame, slots: DataFrame, attention: DataFrame, crop_issues: DataFrame, jobs: DataFrame) -> DataFrame:
    """Five sides on the problem's id; issue lists of both checks as one."""
    out = problems.join(slots.select("problem_id", F.coalesce("status", F.lit("passed")).alias("status"), "score", "stale_text"), "problem_id", "left")
    out = out.join(attention.select("problem_id", F.col("issues").alias("_a")), "problem_id", "left").join(crop_issues.select("problem_id", F.col("issues").alias("_c")), "problem_id", "left").join(jobs.select("problem_id", "state"), "problem_id", "left")
    none = F.array().cast("array<string>")
    issues = F.concat(F.coalesce("_a", none), F.coalesce("_c", none))
    needs = F.col("status").isin("needs_review", "unreviewed") | F.coalesce("stale_text", F.lit(False)) | (F.size(issues) > 0)
    return out.withColumn("issues", issues).withColumn("status", F.coalesce("status", F.lit("unsolved"))).withColumn("needs_review", needs).drop("_a", "_c")


def reconcile(text: DataFrame, crop: DataFrame, key: str) -> DataFrame:
    """Each distinct key of either side as matched, missing_in_text or missing_in_crop."""
    t, c = text.select(key).distinct().withColumn("_t", F.lit(True)), crop.select(key).distinct().withColumn("_c", F.lit(True))
    status = F.when(F.col("_t") & F.col("_c"), "matched").when(F.col("_c"), "missing_in_text").otherwise("missing_in_crop")
    return t.join(c, key, "full_outer").select(key, status.alias("status"))


def apply_import(problems: DataFrame, parsed: DataFrame, damaged: Column) -> DataFrame:
    """Problems take the imported text (problem_id, body) unless it is damaged."""
    joined = problems.join(parsed, "problem_id", "left")
    use = F.col("body").isNotNull() & ~damaged
    return joined.withColumn("text", F.when(use, F.col("body")).otherwise(F.col("text"))).withColumn("text_source", F.when(use, "imported").otherwise(F.col("text_source"))).drop("body")


def keep_text(new: DataFrame, old: DataFrame, key: str, page: str, text: str, least: int = 8) -> DataFrame:
    """A rebuilt item keeps its old text when key and page agree and the old text has ``least`` characters or more."""
    o = old.select(F.col(key).alias("_k"), F.col(page).alias("_p"), F.col(text).alias("_t"))
    joined = new.join(o, (F.col(key) == F.col("_k")) & (F.col(page) == F.col("_p")), "left")
    kept = F.coalesce(F.length(F.trim("_t")) >= least, F.lit(False))
    return joined.withColumn(text, F.when(kept, F.col("_t")).otherwise(F.col(text))).withColumn("kept_source", F.when(kept, "old").otherwise("new")).drop("_k", "_p", "_t")


def write_back(problems: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Texts found right go back to (chapter, problem_id), as verified or, if they were imported without a check, as
    imported; a verdict without text or against it changes nothing."""
    v = verdicts.select("chapter", "problem_id", F.col("text").alias("_t"), "text_ok")
    joined = problems.join(v, ["chapter", "problem_id"], "left")
    use = F.coalesce(F.col("text_ok") & (F.col("_t") != ""), F.lit(False))
    source = F.when(F.col("text_source") == "imported", "imported").otherwise("verified")
    return joined.withColumn("text", F.when(use, F.col("_t")).otherwise(F.col("text"))).withColumn("text_source", F.when(use, source).otherwise(F.col("text_source"))).drop("_t", "text_ok")


def pages_index(problems: DataFrame) -> DataFrame:
    """Which problems stand on a page."""
    boxes = problems.select("problem_id", F.explode("boxes").alias("b")).select(F.col("b.page").alias("page"), "problem_id").distinct()
    return boxes.groupBy("page").agg(F.array_sort(F.collect_list("problem_id")).alias("problem_ids"))


def overlap(a: str, b: str) -> Column:
    """Area that two rectangles (x0, y0, x1, y1 under each prefix) share."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")))
    return side("x0", "x1") * side("y0", "y1")


def _stripes(lo: str, hi: str, stripe: int = 64) -> Column:
    """The stripes of a page that a side reaches into, a row each."""
    return F.explode(F.sequence(F.floor(F.least(lo, hi) / stripe), F.floor(F.greatest(lo, hi) / stripe)))


def mask_owner(masks: DataFrame, boxes: DataFrame) -> DataFrame:
    """The box on a mask's page that it overlaps most, -1 if none; of equals the first. masks (mask, page, m...),
    boxes (box, page, b...) with the prefixes m and b on x0, y0, x1, y1.

    Equal rectangles are compared once, and only where they share a stripe of their page. Of boxes that differ in one
    side, one that lies within a box of a smaller number is never an owner and is left out. First the greatest area of a
    mask is found and then the first box that has it, so pairs are never kept.
    """
    m, b = [f"m{c}" for c in ("x0", "y0", "x1", "y1")], [f"b{c}" for c in ("x0", "y0", "x1", "y1")]
    spots = masks.select("page", *m).distinct().filter("mx0 < mx1 and my0 < my1").withColumn("_s", _stripes("my0", "my1"))
    kept = boxes.filter("bx0 < bx1 and by0 < by1").groupBy("page", *b).agg(F.min("box").alias("box"))
    for side, outer in (("bx1", 1), ("bx0", -1), ("by1", 1), ("by0", -1)):
        before = Window.partitionBy("page", *[c for c in b if c != side]).orderBy(F.col("box").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        kept = kept.withColumn("_far", F.max(outer * F.col(side)).over(before)).filter(F.col("_far").isNull() | (outer * F.col(side) > F.col("_far"))).drop("_far")
    kept = kept.withColumn("_s", _stripes("by0", "by1"))
    area = overlap("m", "b")
    most = spots.join(kept, ["page", "_s"]).groupBy("page", *m).agg(F.max(area).alias("area")).filter("area > 0")
    owners = spots.join(most, ["page", *m]).join(kept, ["page", "_s"]).filter(area == F.col("area")).groupBy("page", *m).agg(F.min("box").alias("box"), F.max("area").alias("area"))
    joined = masks.join(owners, ["page", *m], "left").withColumn("area", F.coalesce("area", F.lit(0)))
    best = joined.groupBy("mask").agg(F.max_by(F.struct("box", "area"), F.struct(F.col("area"), -F.col("box"))).alias("b"))
    return best.select("mask", F.when(F.col("b.area") > 0, F.col("b.box")).otherwise(F.lit(-1)).cast("long").alias("owner"), F.coalesce(F.when(F.col("b.area") > 0, F.col("b.area")), F.lit(0)).cast("long").alias("area"))


def nearest(points: DataFrame, samples: DataFrame, key: str, at: str, sample: str, value: str, stretches: int = 64) -> DataFrame:
    """For each point the value of the nearest sample on either side; of equals the smaller sample.

    Both kinds of rows are sorted together and each point looks at the last sample before and the first after it, so no
    pair of them is made. They are sorted in stretches between quantiles of the samples; what a stretch does not hold
    itself it gets from the nearest one that does, over a table of one row a stretch.
    """
    kinds, kind_of = dict(samples.dtypes), dict(points.dtypes)
    bounds = samples.agg(F.percentile_approx(sample, [i / stretches for i in range(1, stretches)], 10_000).alias("b")).first()["b"] or []
    stretch = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b <= F.col("x"))) if bounds else F.lit(0)
    p = points.select(F.col(key).alias("k"), F.col(at).alias("x"), F.lit(None).cast(kinds[sample]).alias("s"), F.lit(None).cast(kinds[value]).alias("v"), F.lit(1).alias("kind"))
    s = samples.filter(F.col(sample).isNotNull()).groupBy(F.col(sample).alias("x")).agg(F.min(value).alias("v")).select(F.lit(None).cast(kind_of[key]).alias("k"), "x", F.col("x").alias("s"), "v", F.lit(0).alias("kind"))
    both = p.unionByName(s).withColumn("_part", stretch)
    own = F.when(F.col("kind") == 0, F.struct("s", "v"))
    before = lambda *order: F.last(own, ignorenulls=True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("lo", before("x", "kind")).withColumn("hi", before(F.desc("x"), "kind")).filter("kind = 1")
    ends = both.groupBy("_part").agg(F.max_by(own, F.when(F.col("kind") == 0, F.col("x"))).alias("last"), F.min_by(own, F.when(F.col("kind") == 0, F.col("x"))).alias("first"))
    over = Window.orderBy("_part")  # a row a stretch
    ends = ends.select("_part", F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.first("first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    found = found.join(F.broadcast(ends), "_part").withColumn("lo", F.coalesce("lo", "below")).withColumn("hi", F.coalesce("hi", "above"))  # at most ``stretches`` rows
    use_lo = F.col("hi").isNull() | (F.col("lo").isNotNull() & ((F.col("x") - F.col("lo.s")) <= (F.col("hi.s") - F.col("x"))))
    return found.select(F.col("k").alias(key), F.col("x").alias(at), F.when(use_lo, F.col("lo.s")).otherwise(F.col("hi.s")).alias(sample), F.when(use_lo, F.col("lo.v")).otherwise(F.col("hi.v")).alias(value))


def lines_in_segments(lines: DataFrame, segments: DataFrame, page: str, centre: str, top: str, bottom: str, slack: float = 4, stripe: int = 64) -> DataFrame:
    """Lines whose centre lies inside a segment of their page, give or take ``slack``.

    Pages are cut into stripes, and a segment meets the lines of its own stripes only; a line is in one stripe, so it
    meets a segment once.
    """
    at = lambda y: F.floor(y / stripe)
    s = segments.withColumnRenamed(page, "_p").withColumn("_s", F.explode(F.sequence(at(F.col(top) - slack), at(F.col(bottom) + slack))))
    inside = (F.col(centre) >= F.col(top) - slack) & (F.col(centre) <= F.col(bottom) + slack)
    return lines.withColumn("_l", at(F.col(centre))).join(s, (F.col(page) == F.col("_p")) & (F.col("_l") == F.col("_s")) & inside).drop("_p", "_s", "_l")


def runs_with_heading(runs: DataFrame, headings: DataFrame, key: str, page: str) -> DataFrame:
    """Runs (lo, hi) of a key with the first heading page inside, null if there is none."""
    h = headings.select(F.col(key).alias("_k"), F.col(page).alias("_h"))
    joined = runs.join(h, (F.col(key) == F.col("_k")) & F.col("_h").between(F.col("lo"), F.col("hi")), "left")
    return joined.groupBy(*runs.columns).agg(F.min("_h").alias("heading"))


def touching(codes: DataFrame, crops: DataFrame, block: int = 1024) -> DataFrame:
    """Codes (page, q...) that overlap a crop (page, c...) with more than an edge.

    The result has a row for each pair, so on crowded pages it grows with the square of the input; what is done besides
    does not. Equal rectangles are compared once, where both begin or go on in a stripe of their page, and crops of one
    rectangle stand in blocks, each of which meets its codes in a place of its own.
    """
    q, c = [f"q{x}" for x in ("x0", "y0", "x1", "y1")], [f"c{x}" for x in ("x0", "y0", "x1", "y1")]
    inside = (F.col("qy0") < F.col("cy1")) & (F.col("qy1") > F.col("cy0")) & (F.col("qx1") > F.col("cx0")) & (F.col("qx0") < F.col("cx1"))
    first = F.floor(F.greatest(F.least("qy0", "qy1"), F.least("cy0", "cy1")) / 64)  # the first stripe that both reach
    spots, areas = codes.select("page", *q).distinct().withColumn("_s", _stripes("qy0", "qy1")), crops.groupBy("page", *c).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    met = spots.join(areas.withColumn("_s", _stripes("cy0", "cy1")), ["page", "_s"]).filter(inside & (F.col("_s") == first)).drop("_s")
    rest = [x for x in crops.columns if x != "page"]
    packed = crops.join(areas, ["page", *c]).withColumn("_b", F.pmod(F.xxhash64(*crops.columns), "_blocks")).groupBy("page", *c, "_b").agg(F.collect_list(F.struct(*rest)).alias("_crops"))
    pairs = codes.join(met, ["page", *q]).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    pairs = spread(pairs, "page", *c, "_b").join(packed, ["page", *c, "_b"])
    return pairs.select("page", *[x for x in codes.columns if x != "page"], F.explode("_crops").alias("_c")).select("*", "_c.*").drop("_c")


def captions_to_owners(captions: DataFrame, problems: DataFrame, owned: DataFrame) -> DataFrame:
    """Captions (chapter, pid, holder) to the problem they name, in the same chapter, not the one that holds them nor one that has them."""
    found = captions.join(problems.select("chapter", F.col("problem_id").alias("pid")), ["chapter", "pid"]).filter("pid <> holder")
    return found.join(owned.select("chapter", "pid"), ["chapter", "pid"], "left_anti")


def overridden(computed: DataFrame, manual: DataFrame, key: str, value: str) -> DataFrame:
    """Manual values replace computed ones and say so in the flags."""
    m = manual.select(key, F.col(value).alias("_m"))
    return computed.join(m, key, "left").withColumn("flags", F.when(F.col("_m").isNotNull(), F.array(F.lit("manual"))).otherwise(F.col("flags"))).withColumn(value, F.coalesce("_m", value)).drop("_m")


def expected_only(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are expected."""
    return rows.join(expected.select(*keys), keys, "left_semi")


def coverage(want: DataFrame, got: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """Distinct wanted keys, those that were got, and whether too few to go on (fallback)."""
    w, g = want.select(key).distinct(), got.select(key).distinct().withColumn("_g", F.lit(1))
    row = w.join(g, key, "left").agg(F.count(F.lit(1)).alias("want"), F.count("_g").alias("got"))
    return row.withColumn("fallback", F.col("got") < share * F.col("want"))


def open_requests(log: DataFrame, key: str, ts: str, kind: str, request: str, closing: list[str], within: str | None = None, now: Column | None = None) -> DataFrame:
    """J20, ST5: keys whose last request or closing event is a request, and since when; optionally not older than ``within``."""
    last = log.filter(F.col(kind).isin(request, *closing)).groupBy(key).agg(F.max_by(F.struct(F.col(ts).alias("ts"), F.col(kind).alias("kind")), ts).alias("l"))
    out = last.filter(F.col("l.kind") == request).select(key, F.col("l.ts").alias("opened_at"))
    return out if within is None else out.filter(F.col("opened_at") >= (F.current_timestamp() if now is None else now) - F.expr(f"interval {within}"))


def neighbour_pages(used: DataFrame, page: str, n_pages: int) -> DataFrame:
    """Pages next to used ones that are not used themselves."""
    near = used.select(F.explode(F.array(F.col(page) - 1, F.col(page) + 1)).alias(page)).distinct().filter(F.col(page).between(1, n_pages))
    return near.join(used.select(page), page, "left_anti")


def unsolved(items: DataFrame, solved: DataFrame, key: str) -> DataFrame:
    """P16, J18, ST8: items without a solution."""
    return items.join(solved.select(key), key, "left_anti")


# Predicates


def body_lines(lines: DataFrame, geometry: DataFrame) -> DataFrame:
    """Lines outside the header and footer bands of their page."""
    return lines.join(geometry.select("page", "header_cut", "footer_cut"), "page").filter("y1 > header_cut and y0 < footer_cut").drop("header_cut", "footer_cut")


# Words that mark headings, chapter openers and the end of exercises, in text without white space.
HEADING_WORDS = "(?i)(习题|思考题|练习题|复习题|基本题|深入题|扩充题|Problems|Exercises)"
NUMBERED_HEADING = r"(?iU)^(?:§)?\d{1,2}(?:[.．]\d{1,2})*(?:习题|练习题|思考题|Exercises|Problems)$"
OPENER = r"^第[0-9一二三四五六七八九十百]+章"
STOP_WORDS = "^(附录|参考文献|索引|部分?习题(参考)?答案|习题解答|参考答案|答案|习题提示)"
ANSWER_WORDS, NO_ANSWER_WORDS = "答案|解答|题解", "[附带含]答案"
SENTENCE_MARKS = "[，。；！？,;!?]"
CAPTION = T.CAPTION
CONFUSABLE = "一丨丁二十"


def line_kind(text: Column, height: Column, median: Column, y0: Column, page_height: Column) -> Column:
    """Stop, opener or heading, tried in that order on the text without white space; else null."""
    bare = T.without_space(text)
    title = (F.length(bare) <= 16) & ~bare.rlike(SENTENCE_MARKS)
    stop = title & (bare.rlike(STOP_WORDS) | bare.rlike(ANSWER_WORDS) & ~bare.rlike(NO_ANSWER_WORDS))
    opener = bare.rlike(OPENER) & (height >= 1.35 * median) & (y0 > 0.12 * page_height)
    heading = (F.length(bare) <= 14) & bare.rlike(HEADING_WORDS) & ~_anchored(text) | (F.length(bare) <= 24) & bare.rlike(NUMBERED_HEADING)
    return F.when(stop, "stop").when(opener, "opener").when(heading, "heading")


def page_kind(lines: DataFrame, page: str = "page", kind: str = "kind", right_edge: Column | None = None, least: int = 5) -> DataFrame:
    """Toc when many lines end in a number at the right edge; a heading sticks, else the last stop or opener."""
    edge = right_edge if right_edge is not None else (F.col("x1") > 0.8 * F.col("W")) & F.col("text").rlike(r"\d+$")
    g = lines.groupBy(page).agg(F.count_if(edge).alias("n"), F.bool_or(F.coalesce(F.col(kind) == "heading", F.lit(False))).alias("heading"), F.max_by(kind, F.when(F.col(kind).isNotNull(), F.struct("y0", "x0"))).alias("last"))
    return g.select(page, F.when(F.col("n") >= least, "toc").when(F.col("heading"), "heading").otherwise(F.col("last")).alias("page_kind"))


def is_prose(text: Column) -> Column:
    """At least two Han characters other than confusable ones, and no caption."""
    han = F.regexp_replace(text, "[^一-鿿]", "")
    return (F.length(F.regexp_replace(han, f"[{CONFUSABLE}]", "")) >= 2) & ~text.rlike(CAPTION)


def already_verified(source: Column, text: Column, sources: tuple[str, ...] = VERIFIED, least: int = 8) -> Column:
    """Verified, or imported without a check; enough text and no control character."""
    return source.isin(*sources) & (F.length(text) >= least) & ~text.rlike(r"[\t\x08\x0b\x0c\r]")


def is_damaged(text: Column) -> Column:
    """An odd number of dollars once escaped and doubled ones are gone."""
    bare = F.replace(F.replace(text, F.lit("\\$"), F.lit("")), F.lit("$$"), F.lit(""))
    return (F.length(bare) - F.length(F.replace(bare, F.lit("$"), F.lit("")))) % 2 == 1


def has_figure(pid: Column, text: Column, listed: Column, line_given: Column) -> Column:
    """True when the list or the text names a figure; unknown when no list was given."""
    return F.when(line_given, F.array_contains(listed, pid) | text.contains("见图") | text.rlike(r"图\s*[PT]?\d"))


def text_only(source: Column, has_fig: Column) -> Column:
    """P10: imported and known to have no figure."""
    return source.isin(*IMPORTED) & has_fig.eqNullSafe(False)


def needs_transcription(source: Column, text: Column, least: int = 8) -> Column:
    """Not from a trusted source, or too short."""
    return ~F.coalesce(source, F.lit("")).isin(*TRUSTED) | (F.length(F.trim(F.coalesce(text, F.lit("")))) < least)


def is_easy(section: Column) -> Column:
    """P12."""
    return section.rlike("选择|填空|判断")


def crop_issues(height: Column, width: Column) -> Column:
    """Issues of a slice as an array."""
    return F.array_compact(F.array(F.when(height < 25, "too_low"), F.when(width < 200, "too_narrow")))


def quality_flags(height: Column, page_height: Column, n_boxes: Column, score: Column) -> Column:
    """Too short, too tall, empty and low confidence, as an array."""
    return F.array_compact(F.array(F.when(height < 30, "too_short"), F.when(height > 1.8 * page_height, "too_tall"), F.when(n_boxes == 0, "empty"), F.when(score < 0.8, "low_confidence")))


def touches_edge(columns: Column, width: Column, full: Column, depth: int = 3, least: int = 6) -> Column:
    """Ink in the outer columns of a crop that is not as wide as its page."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x.cast("int"))
    return ~full & ((total(F.slice(columns, 1, depth)) >= least) | (total(F.slice(columns, F.greatest(width - depth + 1, F.lit(1)), F.lit(depth))) >= least))


def chapter_setting(settings: Column, chapter: Column) -> Column:
    """A chapter's settings, an error if there are none."""
    return F.coalesce(F.try_element_at(settings, chapter), F.raise_error(F.concat(F.lit("no settings for chapter "), chapter)))


def doc_type(n_pages: Column) -> Column:
    """P18."""
    return F.when(n_pages > 12, "book").otherwise("exam")


def in_column(x0: Column, x1: Column, left: Column, right: Column, slack: int = 8) -> Column:
    """Within the text column, give or take."""
    return (x0 >= left - slack) & (x1 <= right + slack)


def header_cut(lines: DataFrame, rules: DataFrame, has_headers: bool | Column = True) -> DataFrame:
    """P20: the bottom of a page's header: 3 below its rule in the top 14 %, else 4 below the lowest text in the top 9 %
    that does not begin as a problem does, if the book has headers at all (A15), else 0; but 4 above a line that begins
    with the word for exercise and a number, which is never part of a header."""
    rule = rules.filter("y <= 0.14 * H").groupBy("page").agg((F.floor(F.max("y")) + 3).alias("rule"))
    text = lines.filter((F.col("y1") < 0.09 * F.col("H")) & ~_anchored(F.col("text")) & F.lit(has_headers)).groupBy("page").agg((F.floor(F.max("y1")) + 4).alias("text"))
    cuts = lines.select("page").distinct().join(rule, "page", "left").join(text, "page", "left").select("page", F.coalesce("rule", "text", F.lit(0)).cast("double").alias("header_cut"))
    first = lines.join(cuts, "page").filter((F.col("y0") < F.col("header_cut")) & F.col("text").rlike(T.PREFIX)).groupBy("page").agg(F.greatest(F.lit(0), F.floor(F.min("y0")) - 4).cast("double").alias("first"))
    return cuts.join(first, "page", "left").select("page", F.coalesce("first", "header_cut").alias("header_cut"))


def _anchored(text: Column) -> Column:
    return F.coalesce(F.size(T.anchor_candidates(F.trim(text))) > 0, F.lit(False))


def footer_cut(
    lines: DataFrame,
    number: str = r"^[\s·\-—–]*(\d{1,4}|[ivxlcIVXLC]{1,6})[\s·\-—–]*$",
    rules: DataFrame | None = None,
    slashed: str = r"^[\s/|\\Il1·\-—–]*\d{1,4}[\s/|\\Il1·\-—–]*$",
) -> DataFrame:
    """The top of a page's footer: 3 above a page number (or a roman one) in the bottom 6 %, or a narrow one between
    slashes in the bottom 15 %, else 97 % of the page; or above that, by 4, a footnote rule (page, y, x0, x1 in ``rules``)
    in the lowest 28 %, which is in the left half, 12 % of the page long, and has no problem below it. The white around
    a rule is up to its finder."""
    text, low = F.col("text"), F.col("y0") / F.col("H")
    narrow = (F.col("x1") - F.col("x0") < 0.25 * F.col("W")) & text.contains("/") & text.rlike(slashed)
    at = F.when(text.rlike(number) & (low > 0.94) | narrow & (low > 0.85), F.col("y0"))
    cuts = lines.groupBy("page").agg(F.coalesce(F.floor(F.min(at)) - 3, F.floor(0.97 * F.max("H"))).cast("double").alias("footer_cut"), F.max("H").alias("_h"), F.max("W").alias("_w"), F.max(F.when(_anchored(text), F.col("y0"))).alias("_anchor"))
    if rules is None:
        return cuts.select("page", "footer_cut")
    length = F.least("x1", 0.5 * F.col("_w")) - F.greatest("x0", 0.04 * F.col("_w"))
    fits = (F.col("y") >= 0.72 * F.col("_h")) & (F.col("y") < F.col("footer_cut")) & (length >= 0.12 * F.col("_w")) & (F.col("x1") <= 0.55 * F.col("_w"))
    notes = rules.select("page", "y", "x0", "x1").join(cuts, "page").filter(fits & (F.col("_anchor").isNull() | (F.col("_anchor") <= F.col("y")))).groupBy("page").agg((F.min("y") - 4).alias("_note"))
    return cuts.join(notes, "page", "left").select("page", F.least("footer_cut", "_note").alias("footer_cut"))


def terminators(lines: DataFrame, kind: str = "kind", partial: str | None = None) -> DataFrame:
    """Rows of a page at which an exercise ends: simulation exercises, titles standing alone, stops and openers, in
    the left half. Of a line that was read in part only (``partial``) nothing but the first counts."""
    text = F.trim("text")
    whole = ~F.coalesce(F.col(partial), F.lit(False)) if partial else F.lit(True)
    ends = text.rlike(T.SIMULATION) | whole & (T.without_space(text).rlike(T.TITLE) | F.coalesce(F.col(kind).isin("stop", "opener"), F.lit(False)))
    found = lines.filter((text != "") & (F.col("x0") <= 0.5 * F.col("W")) & ends)
    return found.groupBy("page").agg(F.array_sort(F.collect_list("y0")).alias("rows"))


def document_class(pages: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """The class whose keywords occur on most pages (doc, page, text); of equals the first by name."""
    scores = [F.sum(sum((F.col("text").contains(w).cast("int") for w in ws), F.lit(0))).alias(c) for c, ws in sorted(words.items())]
    g = pages.groupBy("doc").agg(*scores)
    best = F.greatest(*[F.col(c) for c in words]) if len(words) > 1 else F.col(next(iter(words)))
    return g.select("doc", F.coalesce(*[F.when(F.col(c) == best, c) for c in sorted(words)]).alias("class"), best.alias("score"))
