"""Near-duplicate embeddings by NN-descent.

Equal vectors are one class from the start. Every class keeps a list of its nearest neighbours. Lists begin with the
leaves of a few random-hyperplane trees and are then refined: each class in turn introduces the classes around it to
one another, and whoever finds someone nearer than its list's last keeps it. At the end edges of the wanted similarity
are checked in double precision and kept. A list that is full of such edges is saturated and may hide more of them, so
it is enlarged to its whole component, which is compared block by block. Links that leave the component are hidden only
between two saturated classes, so saturated members of different components are compared as well, unless the balls that
hold them are too far apart; a link found there makes one component of two. An audit compares a sample of queries with
all vectors; while recall is too low, other trees are added and more classes are introduced to one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, runs, tidied, with_code
from .graph import components

K = 10
TREES, LEAF, LARGEST_LEAF = 10, 40, 128
#: Members that a class introduces to one another in a round, the newest first, and what it tells each of them.
CIRCLE, TOLD = 16, 5
ROUNDS = 3
#: Classes that the audit samples: at first, and at most while fewer than LINKED of them have links.
AUDITED, MOST_AUDITED, LINKED, RECALL = 4096, 16384, 100, 0.99
#: Vectors in a block of a saturated component: more in components of more than BLOCKS blocks, up to the second number.
#: Balls in a block of the comparison of components.
SIDE, LARGEST_SIDE, BLOCKS, BALLS = 256, 2048, 256, 2048
#: Added to angles, against rounding.
SLACK = 1e-6
ROUGH = 0.01


def _unit(raw: list[bytes], dims: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; all of one dimension."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if len(raw) else np.zeros((0, 1))
    # the largest part is brought to 1 first, so that no square over- or underflows
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cleaned(rows: DataFrame) -> DataFrame:
    """(id, raw, dim): the vector's doubles as bytes; null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dim = [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v, float) + 0.0 if v and None not in v else np.zeros(0)  # + 0.0: -0 becomes 0
                fine = x.size > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                raw.append(x.tobytes() if fine else None)
                dim.append(x.size if fine else 0)
            yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary()), pa.array(dim, pa.int32())], names=["id", "raw", "dim"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, raw binary, dim int")


def _planted(classes: DataFrame, n: int, first: int = 0) -> DataFrame:
    """Edges (a, b, sim): the K nearest of each class within its leaf of each of TREES trees, from number ``first`` on."""
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = _unit(part.column(1).to_pylist(), dims)
                small = unit.astype(np.float32)
                blobs = pa.array([r.tobytes() for r in small], pa.binary())
                for tree in range(first, first + TREES):
                    planes = np.random.default_rng([tree, int(dim)]).standard_normal((int(dim), depth + 1))
                    side = unit @ planes
                    code = (side[:, :depth] > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(unit), np.int64)
                    yield pa.record_batch([pa.array(np.full(len(unit), tree * (1 << 20) + int(dim))), pa.array(code.astype(np.int64)), pa.array(side[:, depth]), part.column(0), blobs], names=["tree", "code", "at", "cid", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in runs(batches, ["tree", "code"], LARGEST_LEAF):
            ids = leaf["cid"].to_numpy()
            if len(ids) < 2:
                continue
            x = np.frombuffer(b"".join(leaf["v"].to_pylist()), np.float32).reshape(len(ids), -1)
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            k = min(K, len(ids) - 1)
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            yield pa.record_batch([pa.array(np.repeat(ids, k)), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(sim, near, 1).ravel())], names=["a", "b", "sim"])

    placed = classes.select("cid", "raw", "dim").mapInArrow(place, "tree long, code long, at double, cid long, v binary")
    parts = max(2, math.ceil(n * TREES / 40_000))
    return placed.repartitionByRange(parts, "tree", "code", "at").sortWithinPartitions("tree", "code", "at").mapInArrow(meet, "a long, b long, sim float")


def _best(edges: DataFrame) -> DataFrame:
    """The K nearest of each a; fresh unless the edge was there before."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return once.withColumn("r", rank).filter(F.col("r") <= K).drop("r")


def _introduced(graph: DataFrame, classes: DataFrame, turn: int, n: int, circle: int, told: int) -> DataFrame:
    """Edges found by one round of the local join."""
    around = graph.select(F.col("a").alias("c"), F.col("b").alias("m"), "fresh").unionByName(graph.select(F.col("b").alias("c"), F.col("a").alias("m"), "fresh"))
    around = around.groupBy("c", "m").agg(F.max("fresh").alias("fresh"))
    # a popular class is asked by many: it introduces a part of them, another one each round
    order = Window.partitionBy("c").orderBy(F.desc("fresh"), F.xxhash64(F.lit(turn), "m"))
    around = around.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= circle).drop("r")
    last = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= K, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("last"))
    who = classes.select(F.col("cid").alias("m"), "raw", "dim").join(last.withColumnRenamed("a", "m"), "m")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(b, np.float64) for b in batch.column(1).to_pylist()]
            v = [(a / np.abs(a).max()) for a in x]
            v = [(a / np.sqrt(a @ a)).astype(np.float16).tobytes() for a in v]
            yield pa.record_batch([batch.column(0), pa.array(v, pa.binary()), batch.column(2), batch.column(3)], names=["m", "v", "dim", "last"])

    who = who.select("m", "raw", "dim", "last").mapInArrow(shrink, "m long, v binary, dim int, last float")
    sent = around.join(who, "m").select("c", "m", "fresh", "last", "v")
    parts = max(2, math.ceil(n * circle / 60_000))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for group in runs(batches, ["c"]):
            ids = group["m"].to_numpy()
            if len(ids) < 2:
                continue
            x = np.frombuffer(b"".join(group["v"].to_pylist()), np.float16).reshape(len(ids), -1).astype(np.float32)
            fresh, last = group["fresh"].to_numpy(), group["last"].to_numpy()
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            if len(ids) > told + 1:
                floor = -np.partition(-sim, told - 1, axis=1)[:, told - 1]
            else:
                floor = np.full(len(ids), -2, np.float32)
            i, j = np.nonzero((sim > last[:, None]) & (sim >= floor[:, None]) & (fresh[:, None] | fresh[None, :]) & (sim > -2))
            out.append((ids[i], ids[j], sim[i, j]))
            held += len(i)
            if held > 100_000:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "sim"])
                out, held = [], 0
        if held:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "sim"])

    return sent.repartition(parts, "c").sortWithinPartitions("c").mapInArrow(meet, "a long, b long, sim float")


def _checked(graph: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Undirected links (a < b) of the graph whose cosine in double precision is large enough."""
    near = graph.filter(F.col("sim") >= least - ROUGH).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("raw").alias(f"raw_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size, other = (np.fromiter(map(len, z), np.int64, len(z)) for z in (x, y))
            keep = np.zeros(len(x), bool)
            for n in np.unique(size[size == other]).tolist():
                at = np.flatnonzero((size == n) & (other == n))
                keep[at] = (_unit([x[i] for i in at], None) * _unit([y[i] for i in at], None)).sum(1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "raw_a", "raw_b").mapInArrow(tidied(run), "a long, b long")


def _enlarged(full: DataFrame, least: float) -> DataFrame:
    """(cid, n): linked vectors of each class in ``full`` (label, cid, raw, dim, m), compared with its whole component.

    Members are dealt to blocks; each pair of blocks is one piece of work, which returns counts and no pairs.
    """
    side = F.greatest(F.lit(SIDE), F.least(F.lit(LARGEST_SIDE), F.ceil(F.col("count") / BLOCKS)))
    sizes = full.groupBy("label").count().select("label", F.ceil(F.col("count") / side).cast("int").alias("blocks"))
    dealt = full.join(sizes, "label").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    work = dealt.select("label", lo.alias("lo"), hi.alias("hi"), F.when(F.col("mine") == hi, 1).otherwise(0).alias("side"), "cid", "raw", "dim", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in runs(batches, ["label", "lo", "hi"]):
            ids, m, side = piece["cid"].to_numpy(), piece["m"].to_numpy(), piece["side"].to_numpy()
            x = _unit(piece["raw"].to_pylist(), None)
            same = piece["lo"][0].as_py() == piece["hi"][0].as_py()
            rows, cols = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            hit = x[rows] @ x[cols].T >= least
            if same:
                np.fill_diagonal(hit, False)
                n, who = hit @ m[cols], ids[rows]
            else:
                n, who = np.concatenate([hit @ m[cols], hit.T @ m[rows]]), np.concatenate([ids[rows], ids[cols]])
            yield pa.record_batch([pa.array(who), pa.array(n.astype(np.int64))], names=["cid", "n"])

    return work.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi").mapInArrow(run, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))


def _balls(full: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(label, dim, v, r): for each component in ``full`` (label, cid, raw, dim) a unit vector, and the largest angle to it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                found, at = np.unique(part.column(0).to_numpy(), return_inverse=True)
                sums = np.zeros((len(found), int(dim)))
                np.add.at(sums, at, _unit(part.column(1).to_pylist(), None))
                yield pa.record_batch([pa.array(found), pa.array(np.full(len(found), dim, np.int32)), pa.array([x.tobytes() for x in sums], pa.binary())], names=["label", "dim", "v"])

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["label"]):
            x = np.frombuffer(b"".join(part["v"].to_pylist()), np.float64).reshape(len(part), -1).sum(0)
            size = np.linalg.norm(x)
            x = x / size if size > 0 else np.eye(1, len(x))[0]
            yield pa.record_batch([part["label"][:1].combine_chunks(), part["dim"][:1].combine_chunks(), pa.array([x.tobytes()], pa.binary())], names=["label", "dim", "v"])

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_angles(batch.column(1), batch.column(2)))], names=["label", "r"])

    sums = full.select("label", "raw", "dim").mapInArrow(add, "label long, dim int, v binary")
    centres = scratch.save(sums.repartition("label").sortWithinPartitions("label").mapInArrow(centre, "label long, dim int, v binary"), f"{name}_centres")
    radii = full.join(centres.select("label", "v"), "label").select("label", "raw", "v").mapInArrow(widest, "label long, r double").groupBy("label").agg(F.max("r").alias("r"))
    return scratch.save(centres.join(radii, "label"), name)


def _angles(raw: pa.Array, v: pa.Array) -> np.ndarray:
    """Angle between each vector and the unit vector beside it."""
    x = [np.frombuffer(b, np.float64) for b in raw.to_pylist()]
    y = [np.frombuffer(b, np.float64) for b in v.to_pylist()]
    return np.arccos(np.clip([a @ b / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()) for a, b in zip(x, y, strict=True)], -1, 1)).astype(float)


def _bridges(full: DataFrame, scratch: Scratch, name: str, least: float) -> DataFrame:
    """Labels (a, b) of components in ``full`` (label, cid, raw, dim), which holds their saturated classes, that a link joins.

    Every pair of components is decided: by their balls, then by single members and the other's ball, then by members.
    """
    reach = math.acos(least) + SLACK
    balls = _balls(full, scratch, f"{name}_balls")
    blocks = balls.groupBy("dim").count().select("dim", F.ceil(F.col("count") / BALLS).cast("int").alias("blocks"))
    dealt = balls.join(blocks, "dim").withColumn("mine", F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    work = dealt.select("dim", lo.alias("lo"), hi.alias("hi"), F.when(F.col("mine") == hi, 1).otherwise(0).alias("side"), "label", "v", "r")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in runs(batches, ["dim", "lo", "hi"]):
            ids, r, side = piece["label"].to_numpy(), piece["r"].to_numpy(), piece["side"].to_numpy()
            x = np.frombuffer(b"".join(piece["v"].to_pylist()), np.float64).reshape(len(ids), -1)
            same = piece["lo"][0].as_py() == piece["hi"][0].as_py()
            rows, cols = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            for at in range(0, len(rows), SIDE):
                some = rows[at : at + SIDE]
                i, j = np.nonzero(np.arccos(np.clip(x[some] @ x[cols].T, -1, 1)) <= reach + r[some][:, None] + r[cols][None, :])
                a, b = ids[some[i]], ids[cols[j]]
                keep = a < b if same else a != b
                yield pa.record_batch([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])

    pairs = scratch.save(work.repartition("dim", "lo", "hi").sortWithinPartitions("dim", "lo", "hi").mapInArrow(near, "a long, b long"), f"{name}_pairs")
    facing = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("label"), F.col("b").alias("facing"))
    facing = facing.unionByName(pairs.select("a", "b", F.lit(1).alias("side"), F.col("b").alias("label"), F.col("a").alias("facing")))
    asked = full.join(facing.join(balls.select(F.col("label").alias("facing"), "v", "r"), "facing"), "label")

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _angles(batch.column(3), batch.column(4)) <= reach + batch.column(5).to_numpy()
            yield batch.select(["a", "b", "side", "raw"]).filter(pa.array(keep, pa.bool_()))

    members = asked.select("a", "b", "side", "raw", "v", "r").mapInArrow(reaching, "a long, b long, side int, raw binary")
    members = scratch.save(members, f"{name}_members")
    count = lambda side: F.ceil(F.count(F.when(F.col("side") == side, 1)) / SIDE).cast("int")
    sizes = members.groupBy("a", "b").agg(count(0).alias("rows"), count(1).alias("cols")).filter("rows > 0 and cols > 0")
    dealt = members.join(sizes, ["a", "b"])
    mine, first = F.xxhash64("raw"), F.col("side") == 0
    dealt = dealt.withColumn("mine", F.pmod(mine, F.when(first, F.col("rows")).otherwise(F.col("cols"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(first, F.col("cols")).otherwise(F.col("rows")) - 1)))
    work = dealt.select("a", "b", F.when(first, F.col("mine")).otherwise(F.col("other")).alias("row"), F.when(first, F.col("other")).otherwise(F.col("mine")).alias("col"), "side", "raw")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in runs(batches, ["a", "b", "row", "col"]):
            x, side = _unit(piece["raw"].to_pylist(), None), piece["side"].to_numpy()
            if (x[side == 0] @ x[side == 1].T >= least).any():
                yield pa.record_batch([piece["a"][:1].combine_chunks(), piece["b"][:1].combine_chunks()], names=["a", "b"])

    keys = ["a", "b", "row", "col"]
    return scratch.save(work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(meet, "a long, b long").distinct(), name)


def _truth(classes: DataFrame, n: int, scratch: Scratch, least: float) -> DataFrame:
    """(cid, near, true) of sampled classes that have links: how many other classes link with each, and rows of these."""
    size = AUDITED
    while True:
        asked = classes.orderBy(F.xxhash64(F.lit(5), "cid"), "cid").limit(size).select("cid", "raw", "dim").collect()
        asked.sort(key=lambda r: r["cid"])
        by_dim = {d: (np.array([r["cid"] for r in asked if r["dim"] == d]), _unit([r["raw"] for r in asked if r["dim"] == d], None)) for d in {r["dim"] for r in asked}}

        def run(batches: Iterator[pa.RecordBatch], by_dim=by_dim) -> Iterator[pa.RecordBatch]:
            sums = {dim: np.zeros((2, len(ids)), np.int64) for dim, (ids, _) in by_dim.items()}
            for batch in batches:
                dims = batch.column(2).to_numpy()
                for dim, (ids, q) in by_dim.items():
                    part = batch.filter(pa.array(dims == dim))
                    for at in range(0, part.num_rows, 1024):
                        some = part.slice(at, 1024)
                        cid, m = some.column(0).to_numpy(), some.column(3).to_numpy()
                        # what is so close to the limit that rounding decides is not asked for
                        hit = _unit(some.column(1).to_pylist(), None) @ q.T >= least + 1e-9
                        own = np.minimum(np.searchsorted(ids, cid), len(ids) - 1)
                        hit[np.arange(len(cid)), own] &= ids[own] != cid
                        sums[dim] += np.stack([hit.sum(0), m @ hit])
            for dim, (ids, _) in by_dim.items():
                yield pa.record_batch([pa.array(ids), pa.array(sums[dim][0]), pa.array(sums[dim][1])], names=["cid", "near", "true"])

        found = classes.select("cid", "raw", "dim", "m").mapInArrow(run, "cid long, near long, true long").groupBy("cid").agg(F.sum("near").alias("near"), F.sum("true").alias("true"))
        found = scratch.save(found.filter("near > 0"), f"truth{size}")
        if size >= min(n, MOST_AUDITED) or found.count() >= LINKED:
            return found
        size *= 4


def _audit(truth: DataFrame, counted: DataFrame) -> float:
    """Mean share of a sampled class's links with other classes that ``counted`` (cid, m, n_links) has: the mean over
    those with at most K such classes or that over those with more, whichever is lower, so that no crowd hides a pair."""
    share = F.least(F.lit(1.0), (F.col("n_links") - F.col("m") + 1) / F.col("true"))
    got = truth.join(counted, "cid").groupBy((F.col("near") > K).alias("many")).agg(F.avg(share).alias("share")).collect()
    return min((r["share"] for r in got), default=1.0)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """Per row: id, n_links (other rows with cosine >= ``least``), component_id (smallest id reachable), kept.

    Null, empty and zero vectors and those with a null or non-finite part link with nothing; so do vectors of
    different lengths with one another. Rows with equal vectors link. A null id names no component. Other columns are
    not read.
    """
    spark = with_code(vectors.sparkSession)
    scratch = Scratch(spark, "embedding_dedup")
    rows = scratch.save(_cleaned(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))), "rows")
    grouped = rows.filter("raw is not null").groupBy("raw").agg(F.first("dim").alias("dim"), F.count(F.lit(1)).alias("m"), F.min("id").alias("rep"))
    classes = scratch.save(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    graph = scratch.save(_best(_planted(classes, n).withColumn("fresh", F.lit(True))), "graph0")
    truth = _truth(classes, n, scratch, least)
    turn, wanted, last = 0, ROUNDS, "graph0"
    trees, circle, told = TREES, CIRCLE, TOLD
    whole = False
    while True:
        while turn < wanted:
            turn += 1
            old = graph.withColumn("fresh", F.lit(False))
            graph = scratch.save(_best(old.unionByName(_introduced(graph, classes, turn, n, circle, told).withColumn("fresh", F.lit(True)))), f"graph{turn}")
            scratch.drop(last)
            last = f"graph{turn}"
        links = scratch.save(_checked(graph, classes, least), f"links{turn}")
        labels = components(links, scratch, f"labels{turn}")
        full = classes.select(F.col("cid").alias("node")) if whole else graph.filter(F.col("sim") >= least - ROUGH).groupBy("a").count().filter(F.col("count") >= K).select(F.col("a").alias("node"))
        # a full list may also hide a class's only link, where what it holds is just below the limit
        full = scratch.save(full.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), F.col("node").alias("cid"), F.col("label").isNull().alias("alone")), f"full{turn}")
        labels = scratch.save(labels.unionByName(full.filter("alone").select(F.col("cid").alias("node"), "label")), f"all{turn}")
        bridges = _bridges(full.join(classes, "cid").select("label", "cid", "raw", "dim"), scratch, f"bridges{turn}", least)
        if bridges.limit(1).count():
            merged = components(bridges, scratch, f"merged{turn}").select(F.col("node").alias("label"), F.col("label").alias("over"))
            labels = scratch.save(labels.join(merged, "label", "left").select("node", F.coalesce("over", "label").alias("label")), f"joined{turn}")
            full = full.select("cid").join(labels.withColumnRenamed("node", "cid"), "cid")
        crowded = scratch.save(full.select("label").distinct(), f"crowded{turn}")
        members = labels.join(crowded, "label").select("label", F.col("node").alias("cid"))
        enlarged = scratch.save(_enlarged(members.join(classes, "cid").select("label", "cid", "raw", "dim", "m"), least), f"enlarged{turn}")
        weight = classes.select(F.col("cid").alias("y"), "m")
        both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        sparse = both.join(weight, "y").groupBy(F.col("x").alias("cid")).agg(F.sum("m").alias("s"))
        counted = classes.select("cid", "m", "rep").join(sparse, "cid", "left").join(enlarged, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        counted = scratch.save(counted.select("cid", "m", "rep", (F.coalesce("n", "s", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "cid").alias("label")), f"counted{turn}")
        if whole or _audit(truth, counted) >= RECALL:
            break
        whole = 2 * trees * LARGEST_LEAF >= n  # then comparing all costs no more than further leaves
        for first in range(trees, 2 * trees, TREES) if not whole else ():
            old = graph.withColumn("fresh", F.lit(False))
            graph = scratch.save(_best(old.unionByName(_planted(classes, n, first).withColumn("fresh", F.lit(True)))), f"graph{turn}_{first}")
            scratch.drop(last)
            last = f"graph{turn}_{first}"
        trees, circle, told = 2 * trees, circle + CIRCLE, told + TOLD
        wanted = turn + 1
    names = scratch.save(counted.groupBy("label").agg(F.min("rep").alias("component_id")), "names")
    per_class = counted.join(names, "label").join(classes.select("cid", "raw"), "cid").select("raw", "n_links", "component_id")
    out = rows.join(scratch.save(per_class, "per_class"), "raw", "left")
    scratch.keep("rows", "per_class")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
