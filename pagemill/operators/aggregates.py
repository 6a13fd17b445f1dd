"""Roll-ups over items, logs and verdicts (A rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(values: Column, sep: str = ",") -> Column:
    """An array as one string, in its order."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def usage_by_stage(log: DataFrame, stage: str = "stage", measures: tuple[str, ...] = ("total",)) -> DataFrame:
    """A1: calls and sums per stage and overall (stage null, is_total); a null or empty stage is 'other'."""
    named = log.withColumn("_stage", F.coalesce(F.nullif(F.col(stage), F.lit("")), F.lit("other")))
    grouped = named.groupingSets([["_stage"], []], "_stage").agg(F.grouping("_stage").alias("g"), F.count(F.lit(1)).alias("calls"), *[F.sum(m).alias(m) for m in measures])
    return grouped.select(F.col("_stage").alias("stage"), (F.col("g") == 1).alias("is_total"), "calls", *measures)


def usage_summary(log: DataFrame, solving: tuple[str, ...] = ("draft", "final")) -> DataFrame:
    """A2, A3: the total, distinct solved problems and the average per problem, rounded half to even (0 without any)."""
    row = log.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count_distinct(F.when(F.col("stage").isin(*solving), F.col("pid"))).alias("solved"))
    return row.withColumn("per_problem", F.when(F.col("solved") == 0, F.lit(0)).otherwise(F.bround(F.col("total") / F.col("solved"))).cast("long"))


def per_problem_usage(log: DataFrame) -> DataFrame:
    """A4: running totals of each problem."""
    return log.filter("pid is not null").groupBy("pid").agg(F.sum("in").alias("in"), F.sum("out").alias("out"), F.sum("think").alias("think"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("calls"))


def chapter_report(items: DataFrame, chapter: str, index: str) -> DataFrame:
    """Per chapter the count, last index, missing numbers of 1..last and those that repeat.

    Two aggregations on keys that begin alike: one row per (chapter, index) first, so a chapter's arrays hold distinct
    numbers only.
    """
    once = items.groupBy(F.col(chapter).alias("chapter"), F.col(index).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    grouped = once.groupBy("chapter").agg(F.sum("c").alias("n_items"), F.count("k").alias("n_distinct"), F.max("k").alias("last_index"), F.collect_set("k").alias("seen"), F.sort_array(F.collect_list(F.when(F.col("c") > 1, F.col("k")))).alias("twice"))
    wanted = F.when(F.col("last_index") >= 1, F.sequence(F.lit(1).cast("long"), F.col("last_index"))).otherwise(F.array().cast("array<bigint>"))
    return grouped.select("chapter", "n_items", "n_distinct", "last_index", F.array_except(wanted, "seen").alias("missing"), F.col("twice").alias("duplicated"))


def progress(items: DataFrame, chapter: str, done: Column) -> DataFrame:
    """Total and done per chapter and overall (chapter null), with a percentage rounded half to even."""
    counted = items.groupingSets([[chapter], []], chapter).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"))
    pct = F.when(F.col("total") == 0, 0).otherwise(F.bround(100 * F.col("done") / F.col("total")))
    return counted.withColumn("is_done", F.col("done") == F.col("total")).withColumn("pct", pct.cast("long"))


def verify_summary(details: DataFrame) -> DataFrame:
    """How many problems were fixed, need attention, were transcribed or corrected."""
    has = lambda word: F.exists("fixed", lambda x: x.contains(word))
    return details.agg(F.count_if(F.size("fixed") > 0).alias("auto_fixed"), F.count_if(F.size("issues") > 0).alias("needs_attention"), F.count_if(has("转写")).alias("transcribed"), F.count_if(has("更正")).alias("corrected"))


def merge_checks(checks: DataFrame) -> DataFrame:
    """Verdicts of several pages (problem_id, page, ok, problems) as one per problem."""
    return checks.groupBy("problem_id").agg(
        F.bool_and("ok").alias("ok"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "problems"))), lambda x: F.transform(x["problems"], lambda p: F.struct(p["type"].alias("type"), p["detail"].alias("detail"), x["page"].alias("page"))))).alias("problems"),
        F.array_sort(F.collect_set("page")).alias("pages"),
    )


def check_estimate(boxes: DataFrame, per_page: int = 2600, per_slice: int = 1100) -> DataFrame:
    """Pages, slices and the tokens their check takes."""
    return boxes.agg(F.count_distinct("page").alias("pages"), F.count(F.lit(1)).alias("slices")).withColumn("tokens", F.col("pages") * per_page + F.col("slices") * per_slice)


def modal(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A10: the most common value per key; of equals the one seen first."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value), F.max("n").alias("n"))


def ordered_text(rows: DataFrame, key: list[str], order: list[str], text: str, sep: str = "") -> DataFrame:
    """Texts of a key in order as one; rows with an empty text are skipped."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.filter(F.coalesce(F.col(text), F.lit("")) != "").groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), sep).alias("text"))


def book_text(chapters: DataFrame, order: str, text: str, separator: str) -> DataFrame:
    """Chapter texts in order with a separator before every one but the first."""
    return ordered_text(chapters.withColumn("_all", F.lit(1)), ["_all"], [order], text, separator).drop("_all")


def medians(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The interpolated median."""
    return rows.groupBy(*key).agg(F.median(value).alias("median"))


def upper_median_by_parity(rows: DataFrame, page: str, value: str) -> DataFrame:
    """Per page parity the upper median; a parity without rows takes that of all.

    Ranks by counting instead of sorting one array: values are counted first, so a window sees distinct values only.
    """
    both = rows.select(F.pmod(F.col(page), F.lit(2)).alias("parity"), F.col(value).alias("value")).filter("value is not null")
    counted = both.groupBy("parity", "value").agg(F.count(F.lit(1)).alias("n"))

    def upper(c: DataFrame, keys: list[str]) -> DataFrame:
        to = F.sum("n").over(Window.partitionBy(*keys).orderBy("value"))
        total = F.sum("n").over(Window.partitionBy(*keys))
        at = F.floor(total / 2) + 1
        return c.withColumn("to", to).withColumn("at", at).filter((F.col("to") >= F.col("at")) & (F.col("to") - F.col("n") < F.col("at"))).select(*keys, "value")

    each = upper(counted, ["parity"])
    overall = upper(counted.groupBy("value").agg(F.sum("n").alias("n")).withColumn("all", F.lit(1)), ["all"]).select(F.col("value").alias("overall"))
    parities = rows.sparkSession.range(2).select(F.col("id").alias("parity"))
    return parities.join(each, "parity", "left").join(F.broadcast(overall)).select("parity", F.coalesce("value", "overall").alias("value"))  # one row


def header_vote(rows: DataFrame, key: list[str], vote: str, least: int = 4) -> DataFrame:
    """Whether at least half of the votes are for; true when there are fewer than ``least``."""
    grouped = rows.groupBy(*key).agg(F.count(vote).alias("votes"), F.sum(F.col(vote).cast("int")).alias("ayes"))
    return grouped.withColumn("has_header", (F.col("votes") < least) | (F.coalesce("ayes", F.lit(0)) >= 0.5 * F.col("votes"))).drop("ayes")


def isolated(groups: DataFrame, chapter: str, n: str, few: int = 2, solid: int = 3, gap: int = 3) -> DataFrame:
    """A16 (few=2) and A17 (few=1): chapters with few items whose number lies far above every solid one."""
    top = groups.filter(F.col(n) >= solid).agg(F.max(chapter).alias("top"))
    return groups.join(F.broadcast(top)).filter((F.col(n) <= few) & (F.col(chapter) > F.col("top") + gap)).drop("top")  # one row


def best_segments(items: DataFrame, chapter: str, seg: str, order: list[str], share: float = 0.6, least: int = 3) -> DataFrame:
    """Per chapter the longest segment (tie: the later), unless an earlier one has at least ``share`` of it and ``least`` items."""
    sizes = items.groupBy(chapter, seg).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("at"))
    w = Window.partitionBy(chapter)
    marked = sizes.withColumn("most", F.max("n").over(w)).withColumn("longest", F.max(F.struct("n", seg)).over(w)[seg])
    near = (F.col("n") >= share * F.col("most")) & (F.col("n") >= least)
    picked = marked.groupBy(chapter).agg(F.min_by(F.struct(seg, "n"), F.when(near, F.col("at"))).alias("near"), F.max_by(F.struct(seg, "n"), F.struct("n", seg)).alias("top"))
    return picked.select(chapter, F.coalesce("near", "top").alias("p")).select(chapter, F.col(f"p.{seg}").alias(seg), F.col("p.n").alias("n"))


def import_counts(status: DataFrame) -> DataFrame:
    """Counts of a reconciliation (key, status)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return status.agg(n("matched", "missing_in_crop").alias("parsed"), n("matched", "missing_in_text").alias("cropped"), n("matched").alias("matched"), n("missing_in_text").alias("missing_text"), n("missing_in_crop").alias("missing_crop"))


def short_list(values: Column, most: int = 12, sep: str = "、", more: str = "等") -> Column:
    """The first values as one string, with a mark when some are left out."""
    return F.concat(joined(F.slice(values, 1, most), sep), F.when(F.size(values) > most, more).otherwise(""))


def notes(report: DataFrame) -> DataFrame:
    """One line per chapter of a chapter report that has gaps or repeats."""
    gaps = F.when(F.size("missing") > 0, F.concat(F.lit("缺号 "), short_list(F.col("missing"))))
    twice = F.when(F.size("duplicated") > 0, F.concat(F.lit("重复 "), short_list(F.col("duplicated"))))
    return report.select("chapter", F.concat_ws("；", gaps, twice).alias("note")).filter("note <> ''")


def coverage_message(report: DataFrame) -> DataFrame:
    """The span of chapters and how many items they hold, as one sentence."""
    row = report.agg(F.min("chapter").alias("lo"), F.max("chapter").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_items").alias("items"))
    return row.select(F.format_string("第%d-%d章，%d章共%d题", F.col("lo").cast("long"), F.col("hi").cast("long"), "n", "items").alias("message"))


def by_status(results: DataFrame) -> DataFrame:
    """Results per status."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
