"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be taken ``target / source_size`` times. The whole part is certain; the fractions
are rounded in pairs: mass moves from one document to the other, in a randomly chosen direction whose odds keep both
expectations, until one of them is 0 or 1. What moves is words, so a pair's words stay the same and at the end a
source misses its target by less than one document. Longer documents are settled first, so that one is short. Pairs are formed within blocks of about ``BLOCK`` documents; each
block hands its one open document on to the next level, a reduction tree whose depth is the logarithm of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 64
EPS = 1e-12


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``rank`` (0, 1, ..) by code point with null last, without gathering the sources in one task."""
    n = max(1, min(200, math.ceil(sources.count() / 50_000)))
    key = [F.col("source").isNull(), F.col("source")]
    dealt = scratch.save(sources.repartitionByRange(n, *key).withColumn("part", F.spark_partition_id()), "ranked")
    inside = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*key)))
    before = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(before.select("part", F.coalesce("before", F.lit(0)).alias("before")), "part").withColumn("rank", F.col("before") + F.col("at") - 1).drop("part", "at", "before")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) with ``target``: weights share the total; what is above ``most`` times a source's size goes to the rest by weight, until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    known = scratch.save(_ranked(sources, scratch).withColumn("weight", weight).withColumn("most", F.col("source_size") * most), "weighted")
    total = float(known.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("most") < F.col("weight") * level
        row = known.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (total - row["held"]) / row["open"]
    return known.withColumn("target", F.least("most", F.col("weight") * level)).select("source", "source_size", "target", "n_rows")


def _uniform(*what) -> Column:
    """A number in [0, 1) that depends on nothing but ``what``."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(float(1 << 53))


def _unit(item: Column, x: Column) -> Column:
    return F.struct(item["order"].alias("order"), item["h"].alias("h"), item["id"].alias("id"), item["size"].alias("size"), item["m"].alias("m"), item["base"].alias("base"), item["sure"].alias("sure"), x.cast("double").alias("x"))


def _pair(state: Column, item: Column, seed: int) -> Column:
    """One step of the fold: ``state`` is (open unit or null, settled units)."""
    held = state["open"]
    a, x, b, y = held["size"], held["x"], item["size"], item["x"]
    up, down = F.least(a * (1 - x), b * y), F.least(a * x, b * (1 - y))  # words into the held unit, or out of it
    rise = _uniform(F.lit(seed), held["h"], item["h"], a, b) * (up + down) < down
    moved = F.when(rise, up).otherwise(-down)
    near = lambda v: F.when(v < EPS, 0.0).when(v > 1 - EPS, 1.0).otherwise(v)
    x2, y2 = near(x + moved / a), near(y - moved / b)
    done_x, done_y = x2.isin(0.0, 1.0), y2.isin(0.0, 1.0)
    h2, i2 = _unit(held, x2), _unit(item, y2)
    nothing = F.slice(F.array(i2), 1, 0)
    settled = F.concat(state["done"], F.when(done_x, F.array(h2)).otherwise(nothing), F.when(done_y, F.array(i2)).otherwise(nothing))
    still = F.when(~done_x, h2).when(~done_y, i2)
    return F.when(held.isNull(), F.struct(_unit(item, y).alias("open"), state["done"].alias("done"))).otherwise(F.struct(still.alias("open"), settled.alias("done")))


UNIT = "struct<order:bigint,h:bigint,id:{id},size:bigint,m:bigint,base:bigint,sure:bigint,x:double>"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: id, size, source, source_size, target, copies, taken.

    Null text has size 0; a null source is a source of its own, the last. Documents without words are never taken.
    Rows that repeat id, source and size are rounded together and their copies dealt out in turn. Equal input gives
    equal output. Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"))
    units = scratch.save(rows.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("m")), "units")
    sources = scratch.save(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "sources")
    aims = scratch.save(targets(sources, scratch, weights, most), "targets")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    aims = aims.withColumn("whole", F.floor(ratio).cast("long")).withColumn("part", ratio - F.floor(ratio)).withColumn("blocks", F.ceil(F.col("n_rows") / BLOCK).cast("long"))
    extra = F.col("part") * F.col("m")
    given = units.join(aims, units["source"].eqNullSafe(aims["source"])).select(
        units["source"], "source_size", "target", "blocks",
        F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(seed), "id", "size").alias("h"), F.col("id"), F.col("size"), F.col("m"), F.when(F.col("size") > 0, F.col("whole")).otherwise(0).cast("long").alias("base"), F.when(F.col("size") > 0, F.floor(extra)).otherwise(0).cast("long").alias("sure"), F.when(F.col("size") > 0, extra - F.floor(extra)).otherwise(0.0).cast("double").alias("x")).alias("u"),
    )
    keys = ["source", "source_size", "target"]
    settled_now = (F.col("u.x") < EPS) | (F.col("u.x") > 1 - EPS)
    finished = [given.filter(settled_now).select(*keys, "u")]
    cur = given.filter(~settled_now).select(*keys, "blocks", "u")
    n_blocks, level = aims.agg(F.max("blocks")).first()[0] or 0, 0
    unit = UNIT.format(id=dict(rows.dtypes)["id"])
    while n_blocks:
        level += 1
        block = F.pmod(F.xxhash64(F.lit(level), F.col("u.h"), F.col("u.id")), F.col("blocks"))
        start = F.struct(F.lit(None).cast(unit).alias("open"), F.array().cast(f"array<{unit}>").alias("done"))
        folded = (
            cur.groupBy(*keys, "blocks", block.alias("block"))
            .agg(F.sort_array(F.collect_list("u")).alias("us"))
            .select(*keys, "blocks", F.aggregate("us", start, lambda s, i: _pair(s, i, seed)).alias("s"))
        )
        folded = scratch.save(folded, f"level{level}")
        finished.append(folded.select(*keys, F.explode("s.done").alias("u")))
        last = n_blocks == 1
        cur = folded.filter("s.open IS NOT NULL").select(*keys, F.ceil(F.col("blocks") / BLOCK).cast("long").alias("blocks"), F.col("s.open").alias("u"))
        n_blocks = 0 if last else math.ceil(n_blocks / BLOCK)
    drawn = F.when(_uniform(F.lit(seed), F.lit("last"), F.col("u.h")) < F.col("u.x"), 1.0).otherwise(0.0)
    finished.append(cur.select(*keys, F.struct(*[F.col(f"u.{c}").alias(c) for c in ("order", "h", "id", "size", "m", "base", "sure")], drawn.alias("x")).alias("u")))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    each = out.select(*keys, "u", F.explode(F.sequence(F.lit(1).cast("long"), F.col("u.m"))).alias("j"))
    copies = F.col("u.base") + F.when(F.col("j") <= F.col("u.sure"), 1).when((F.col("j") == F.col("u.sure") + 1) & (F.col("u.x") > 0.5), 1).otherwise(0)
    return each.select(F.col("u.id").alias(id_col), F.col("u.size").alias("size"), F.col("source"), "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("u.size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns unchanged, whatever their names.

    Rows that share id, source and size are told apart by counting only, so the k-th of them gets the k-th number of
    copies. Null ids and sources are values like others; rows without words, null texts among them, are not taken. An
    empty table gives an empty result.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).filter("copies > 0")
    key, source, size, copies, words, at, copy = unused(docs, "_id", "_source", "_size", "_copies", "_words", "_at", "_copy")
    per_key = taken.groupBy(F.col(id_col).alias(key), F.col("source").alias(source), F.col("size").alias(size)).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(copies))
    rows = docs.withColumn(words, count_words(F.col(text_col)))
    hit = rows.join(per_key, F.col(id_col).eqNullSafe(F.col(key)) & F.col(source_col).eqNullSafe(F.col(source)) & (F.col(words) == F.col(size)))
    counted = hit.withColumn(at, F.row_number().over(Window.partitionBy(id_col, source_col, words).orderBy(F.xxhash64(text_col))))
    counted = counted.filter(F.col(at) <= F.size(copies))
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.element_at(copies, F.col(at)).cast("long")))).select(*docs.columns)
