"""Near-duplicates by min-max hashing of word shingles.

Each permutation of the hash space gives two values of a signature, the least and the greatest image of a set, so
half as many hash evaluations are needed. Bands of ``ROWS`` values put documents into buckets; documents of a bucket
are compared on their full sets.

Documents with equal sets are one class from the start. A bucket's classes are first compared with its smallest class
only, which joins nearly all of a large group by as many comparisons as it has members. Buckets that still hold
classes of different components then compare these with all of theirs, block by block, and each pair of blocks passes
on fewer links than there are components in it. So no link between classes that share a bucket is lost, and no table
ever holds the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from ._common import Scratch, runs, small, tidied, unused, with_code
from .graph import components
from .shingles import WORDS, jaccard_at_least, shingle_sets

#: 120 permutations give 240 values, 48 bands of 5. A pair of similarity 0.75 shares no bucket with odds of 3e-6.
PERMUTATIONS, ROWS = 120, 5
PERCENT = 75
#: Comparisons with one document that stay together; more are dealt to parts.
TOGETHER = 64
#: Sets on one side of a pair of blocks, and elements of them.
SIDE, ELEMENTS = 2048, 1 << 20
#: Sets hashed at a time; bounds the arrays.
SLAB = 1 << 20

_SEEDS = wordhash.mix(np.arange(2 * PERMUTATIONS, dtype=np.uint64) + np.uint64(1 << 50))
_A, _B = (_SEEDS[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)


def signatures(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """len(sizes) x 2 PERMUTATIONS: least and greatest images by turns. Sets must not be empty."""
    out = np.empty((len(sizes), 2 * PERMUTATIONS), np.uint32)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + SLAB, side="right")))
        x = (elements[base : ends[to - 1]] >> np.uint64(32)).astype(np.uint32)
        starts = (ends[at:to] - sizes[at:to]) - base
        for p in range(PERMUTATIONS):
            image = x * _A[p] + _B[p]
            out[at:to, 2 * p] = np.minimum.reduceat(image, starts)
            out[at:to, 2 * p + 1] = np.maximum.reduceat(image, starts)
        at = to
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    n_bands = signature.shape[1] // ROWS
    values = signature[:, : n_bands * ROWS].reshape(-1, n_bands, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(n_bands, dtype=np.uint64), values.shape[:2])
    for r in range(ROWS):
        key = wordhash.mix(key ^ values[:, :, r]) + np.uint64(r)
    return key


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, two 64-bit sums that name the set, and the band keys (rows of empty sets are meaningless)."""
    elements, sizes = shingle_sets(texts)
    full = sizes > 0
    f1, f2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    keys = np.zeros((len(sizes), 2 * PERMUTATIONS // ROWS), np.uint64)
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        f1[full] = np.add.reduceat(wordhash.mix(elements), starts)
        f2[full] = np.add.reduceat(wordhash.mix(elements ^ np.uint64(0x5851F42D4C957F2D)), starts)
        keys[full] = band_keys(signatures(elements, sizes[full]))
    return sizes, f1, f2, keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _described(rows: DataFrame) -> DataFrame:
    """(id, n, f1, f2, bands) for rows (id, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, f1, f2, keys = describe(part.column(1).to_pylist())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1]), _signed(keys.ravel()))
                yield pa.record_batch([part.column(0), pa.array(n), _signed(f1), _signed(f2), bands], names=["id", "n", "f1", "f2", "bands"])

    return rows.mapInArrow(tidied(run), f"id {rows.schema['id'].dataType.simpleString()}, n long, f1 long, f2 long, bands array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough; ``texts`` is (cid, t).

    Comparisons with a are dealt to parts; each part gets a's text once and the others' one after the other.
    """
    pairs = scratch.save(pairs, f"{name}_asked")
    often = scratch.save(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TOGETHER).select("a", F.ceil(F.col("n") / TOGETHER).alias("parts")), f"{name}_often")
    if small(24 * often.count()):
        often = F.broadcast(often)  # size just checked
    salt = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    pairs = scratch.save(pairs.join(often, "a", "left").select("a", "b", salt.alias("salt")), f"{name}_pairs")
    if small(24 * pairs.count()):
        pairs = F.broadcast(pairs)  # size just checked
    right = pairs.join(texts, pairs["b"] == texts["cid"]).select("a", "salt", "b", "t")
    heads = pairs.select("a", "salt").distinct()
    left = heads.join(texts, heads["a"] == texts["cid"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "t")
    dealt = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = head_set = None
        for batch in batches:
            hit_a, hit_b = [], []
            elements, sizes = shingle_sets(batch.column(3).to_pylist())
            ends = np.cumsum(sizes)
            for a, b, s, e in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                if b is None:
                    head, head_set = a, elements[s:e].copy()
                elif head != a:
                    raise ValueError("a comparison came without its first text")
                elif jaccard_at_least(head_set, elements[s:e], PERCENT):
                    hit_a.append(a)
                    hit_b.append(b)
            yield pa.record_batch([pa.array(hit_a, pa.int64()), pa.array(hit_b, pa.int64())], names=["a", "b"])

    return scratch.save(dealt.mapInArrow(tidied(run), "a long, b long"), f"{name}_links")


def _across(members: DataFrame, labels: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the components of every bucket that holds more than one.

    Members outside of a bucket's largest component are compared with all members, as blocks of the former against
    blocks of the latter, each pair of blocks in a place of its own. Full sets are compared there, and of the links found
    those are passed on that join two components which the ones before did not.
    """
    marked = members.select("key", "cid", "n").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("key", "cid", "n", F.coalesce("label", "cid").alias("label"))
    mixed = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    marked = scratch.save(marked.join(mixed, "key"), "mixed")
    held = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements"))
    largest = F.max(F.struct("sets", "elements", "label"))
    blocks = lambda sets, elements: F.greatest(F.lit(1), F.ceil(sets / SIDE), F.ceil(elements / ELEMENTS)).cast("int")
    sizes = held.groupBy("key").agg(largest.alias("top"), F.sum("sets").alias("sets"), F.sum("elements").alias("elements"))
    sizes = sizes.select("key", F.col("top.label").alias("main"), blocks(F.col("sets") - F.col("top.sets"), F.col("elements") - F.col("top.elements")).alias("rows"), blocks(F.col("sets"), F.col("elements")).alias("cols"))
    placed = marked.join(scratch.save(sizes, "mixed_sizes"), "key")
    outer = F.col("label") != F.col("main")
    mine = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    # side 0 is a row, 1 a column, 2 both
    cells = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_col = F.transform(cells("rows"), lambda r: F.struct(r.alias("row"), mine("cols").alias("col"), F.when(outer & (r == mine("rows")), 2).otherwise(1).alias("side")))
    as_row = F.transform(F.filter(cells("cols"), lambda c: outer & (c != mine("cols"))), lambda c: F.struct(mine("rows").alias("row"), c.alias("col"), F.lit(0).alias("side")))
    dealt = placed.select("key", "cid", "label", F.explode(F.concat(as_col, as_row)).alias("at")).select("key", "at.*", "cid", "label")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                elements, sizes = shingle_sets(part.column(1).to_pylist())
                ends = np.cumsum(sizes)
                yield pa.record_batch([part.column(0), pa.array([elements[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())], names=["cid", "s"])

    needed = texts.join(marked.select("cid").distinct(), "cid", "left_semi").select("cid", "t")
    sets = scratch.save(needed.mapInArrow(tidied(full), "cid long, s binary"), "mixed_sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["key", "row", "col"]):
            a, b = joining(cell["cid"].to_numpy(), cell["label"].to_numpy(), cell["side"].to_numpy(), [np.frombuffer(x, np.uint64) for x in cell["s"].to_pylist()])
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    work = dealt.join(sets, "cid").select("key", "row", "col", "side", "cid", "label", "s").repartition("key", "row", "col").sortWithinPartitions("key", "row", "col")
    return scratch.save(work.mapInArrow(tidied(compare), "a long, b long").distinct(), "across")


#: Cells of an incidence matrix that are held at a time.
CELLS = 4 << 20


def joining(ids: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Pairs of a row and a column whose sets are similar enough and that join two components, the smaller id first.

    side: 0 row, 1 column, 2 both; sets are sorted and distinct."""
    rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    n = np.array([len(x) for x in sets])
    if not len(rows) or not len(cols):
        return [], []
    distinct, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), n)
    shared = often > 1  # what only one member has is in no intersection
    number = np.cumsum(shared) - 1
    of, at = of[shared[at]], number[at[shared[at]]]
    n_shared = int(shared.sum())
    width = max(1, min(n_shared, CELLS // len(sets)))
    both = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    for lo in range(0, n_shared, width):
        s, e = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[of[s:e], at[s:e] - lo] = 1
        both += m[rows] @ m[cols].T
    hit = (100 * both.astype(np.int64) >= PERCENT * (n[rows, None] + n[None, cols] - both.astype(np.int64))) & (label[rows, None] != label[None, cols])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    a, b = [], []
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = root(int(label[rows[i]])), root(int(label[cols[j]]))
        if x != y:
            parent[x] = y
            p, q = int(ids[rows[i]]), int(ids[cols[j]])
            a.append(min(p, q))
            b.append(max(p, q))
    return a, b


def _similar_size(x: str, y: str):
    return (100 * F.least(x, y) >= PERCENT * F.greatest(x, y))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable, itself included), kept.

    Words are lower-cased (A-Z) runs of non-space; a set is the distinct shingles of five words, or the whole
    sequence as one when there are fewer. Null, empty or blank text has the empty set and links with nothing. Links
    are pairs with 100 * intersection >= 75 * union, checked on the full sets. Rows that repeat an id share a
    component; a null id joins a component without naming it. Other columns are not read.
    """
    spark = with_code(docs.sparkSession)
    scratch = Scratch(spark, "near_dedup")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    seen = scratch.save(_described(rows), "described")
    classes = seen.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    banded = classes.select("cid", "n", F.explode("bands").alias("key"))
    buckets = scratch.save(banded.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("head"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("key", F.col("head.cid").alias("head"), F.col("head.n").alias("head_n")), "buckets")
    members = scratch.save(banded.join(buckets, "key"), "members")

    wanted = members.select("cid").distinct().join(classes.select("cid", "rep", "n", "f1", "f2"), "cid")
    wanted = scratch.save(wanted, "wanted")
    if small(48 * wanted.count()):
        wanted = F.broadcast(wanted)  # size just checked
    found = rows.join(wanted, rows["id"].eqNullSafe(F.col("rep")))
    texts = scratch.save(_own_text(found.select("cid", "n", "f1", "f2", "t")), "texts")

    stars = members.filter("cid <> head").filter(_similar_size("n", "head_n")).groupBy(F.col("head").alias("a"), F.col("cid").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    stars = scratch.save(stars, "stars")
    first = stars.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("minus"))).alias("top")).select((-F.col("top.minus")).alias("a"), "b")
    links = _linked(first, texts, scratch, "first")
    labels = components(links, scratch, "first_labels")
    of = lambda c, x: labels.select(F.col("node").alias(c), F.col("label").alias(x))
    apart = stars.select("a", "b").join(of("a", "la"), "a", "left").join(of("b", "lb"), "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    links = links.unionByName(_linked(apart.select("a", "b").join(first, ["a", "b"], "left_anti"), texts, scratch, "second"))
    links = links.unionByName(_across(members, components(links, scratch, "second_labels"), texts, scratch))
    labels = components(links, scratch, "labels")
    linked = classes.select("cid", "n", "f1", "f2", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    linked = scratch.save(linked, "linked")
    names = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    per_class = scratch.save(linked.join(scratch.save(names, "names"), "label").select("n", "f1", "f2", "component_id"), "per_class")
    scratch.keep("described", "per_class")
    out = seen.select("id", "n", "f1", "f2").join(per_class, ["n", "f1", "f2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _own_text(found: DataFrame) -> DataFrame:
    """(cid, t): of rows that share an id, those whose text has the class's set, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, sizes = shingle_sets(batch.column(4).to_pylist())
            filled = sizes > 0
            f1 = np.zeros(len(sizes), np.int64)
            if filled.any():
                f1[filled] = np.add.reduceat(wordhash.mix(elements), (np.cumsum(sizes) - sizes)[filled]).view(np.int64)
            same = filled & (sizes == batch.column(1).to_numpy()) & (f1 == batch.column(2).to_numpy())
            yield pa.record_batch([batch.column(0), batch.column(4)], names=["cid", "t"]).filter(pa.array(same))

    return found.mapInArrow(tidied(run), "cid long, t string").dropDuplicates(["cid"])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a near-duplicate group keeps, columns unchanged, whatever their names: all those with the
    smallest id of each group. Rows without words are a group of their own each. A null id is never the smallest, but
    stays where no other is there. An empty table gives an empty result."""
    (own,) = unused(docs, "_kept_id")
    kept = near_dedup(docs, id_col, text_col).filter(F.coalesce("kept", F.col("component_id").isNull())).select(F.col(id_col).alias(own)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
