"""Read views of a question bank, over its tables (schemas in sources.tables).

Each takes DataFrames and returns one; they are what a service would show. Orchestration (uploads, starting and
stopping jobs, calls to a model, typesetting) is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import geometry as G
from ..operators import joins as J
from ..streaming import logs


def import_text(problems: DataFrame, text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(problems with the imported bodies, one row per id with its status).

    Damaged bodies are not applied and count as damaged; ids of either side alone are missing on the other.
    """
    parsed = T.parse_import(text).select("problem_id", T.normalize_blanks(F.col("body")).alias("body"), "duplicated")
    damaged = F.coalesce(J.is_damaged(F.col("body")), F.lit(False))
    updated = J.apply_import(problems, parsed.select("problem_id", "body"), damaged)
    status = J.reconcile(parsed, problems, "problem_id").join(parsed.select("problem_id", "duplicated", J.is_damaged(F.col("body")).alias("damaged")), "problem_id", "left")
    status = status.withColumn("status", F.when((F.col("status") == "matched") & F.col("damaged"), "damaged").otherwise(F.col("status")))
    return updated, status.fillna(False, ["duplicated", "damaged"])


def import_report(status: DataFrame) -> DataFrame:
    """The report of an import: counts and lists of ids in natural order."""
    key = F.struct(F.split_part("problem_id", F.lit("."), F.lit(1)).cast("int").alias("c"), F.split_part("problem_id", F.lit("."), F.lit(2)).cast("int").alias("k"), F.col("problem_id"))
    ids = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, key))), lambda x: x["problem_id"])
    s = F.col("status")
    n = lambda *v: F.count_if(s.isin(*v))
    return status.agg(n("matched", "damaged", "missing_in_crop").alias("parsed"), n("matched", "damaged", "missing_in_text").alias("cropped"), n("matched").alias("matched"), ids(s == "missing_in_text").alias("missing_in_text"), ids(s == "missing_in_crop").alias("missing_in_crop"), ids(F.col("duplicated")).alias("duplicated_in_text"), ids(s == "damaged").alias("damaged_in_text"))


def chapter_problems(problems: DataFrame, slots: DataFrame, attention: DataFrame, crop_issues: DataFrame, jobs: DataFrame) -> DataFrame:
    """A chapter's problems with what is known of them, in natural order."""
    return J.problem_view(problems, slots, attention, crop_issues, jobs).orderBy("chapter", *G.natural_order())


def one_problem(problems: DataFrame, slots: DataFrame, pid: str, image: Column | None = None) -> DataFrame:
    """One problem's texts as they are shown."""
    v = J.with_solutions(problems.filter(F.col("problem_id") == pid), slots)
    final = T.embed_image(F.col("final"), image) if image is not None else T.collapse_solution(F.col("final"))
    return v.withColumn("final", final).withColumn("compact", T.with_problem_text(F.col("compact"), F.col("text")))


def review(problems: DataFrame, flags: DataFrame, checks: DataFrame, pages: DataFrame) -> DataFrame:
    """Every box with its problem's flags, its check and the size of its page."""
    boxes = problems.select("problem_id", F.posexplode("boxes").alias("box", "b")).select("problem_id", "box", "b.*")
    return boxes.join(flags.select("problem_id", "flags"), "problem_id", "left").join(checks.select("problem_id", "ok", "problems"), "problem_id", "left").join(pages, "page", "left")


def needs_review(view: DataFrame) -> DataFrame:
    return view.filter("needs_review")


def usage(log: DataFrame) -> DataFrame:
    """Stages by total, the grand total last."""
    return A.usage_by_stage(log.withColumn("total", F.col("total").cast("long"))).orderBy("is_total", F.desc("total"), "stage")


def solve_status(problems: DataFrame, slots: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """A6, ST1: per chapter and overall how much is solved, with the rate of the last five minutes."""
    done = problems.join(slots.select("problem_id", F.lit(True).alias("_d")), "problem_id", "left")
    left = done.filter("_d is null").count()
    return A.progress(done, "chapter", F.coalesce("_d", F.lit(False))).crossJoin(F.broadcast(logs.rate_and_eta(log, "ts", now, left)))  # one row


def last_events(log: DataFrame, n: int = 14) -> DataFrame:
    """The newest lines of a log."""
    return log.orderBy(F.desc("ts")).limit(n)


def chapter_markdown(problems: DataFrame, slots: DataFrame, banner: str = "> 待人工复核\n\n") -> DataFrame:
    """(chapter, all, compact): solved problems of a chapter in order; unsolved ones are left out."""
    v = J.with_solutions(problems, slots).withColumn("ch", F.split_part("problem_id", F.lit("."), F.lit(1)).cast("int")).withColumn("k", F.split_part("problem_id", F.lit("."), F.lit(2)).cast("int"))
    head = F.concat(F.lit("## 习题 "), "problem_id", F.lit("\n\n"), F.when(F.col("status").isin("needs_review", "unreviewed"), banner).otherwise(""))
    v = v.withColumn("_all", F.when(F.col("final").isNotNull(), F.concat(head, T.normalize_headings(F.col("final")), F.lit("\n\n")))).withColumn("_compact", F.when(F.col("final").isNotNull() & F.col("compact").isNotNull(), F.concat(head, T.normalize_headings(F.col("compact")), F.lit("\n\n"))))
    whole = A.ordered_text(v, ["chapter"], ["ch", "k"], "_all").withColumnRenamed("text", "all")
    return whole.join(A.ordered_text(v, ["chapter"], ["ch", "k"], "_compact").withColumnRenamed("text", "compact"), "chapter", "left")
