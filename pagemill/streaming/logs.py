"""Rates, throttling and open requests over event logs, as batch and as Structured Streaming (ST rows)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trailing(log: DataFrame, ts: str, total: str, failed: Column, keep: list[str], minutes: int = 5, fail_minutes: int = 10) -> DataFrame:
    """ST1 to ST3 per row: rows and sum of the last ``minutes`` and failures of the last ``fail_minutes``, both ends included.

    The log is cut into stretches as long as the longer window; a row goes to its own stretch and, as history, to the
    next one, so every window is whole within one stretch and stretches run in parallel. A row is added when it comes and
    taken off again once a window has passed it, so running sums do and a row costs the same however dense the log is;
    only totals that are no exact numbers are summed up window by window.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    size = max(minutes, fail_minutes) * 60_000_000
    own = F.floor(us / size)
    if dict(log.dtypes)[total] not in ("float", "double"):
        v, f, none = F.coalesce(total, F.lit(0)), F.coalesce(failed.cast("int"), F.lit(0)), F.lit(0)
        known = F.col(total).isNotNull().cast("int")
        step = lambda at, late, n, v, known, f: F.struct(at.alias("_at"), F.lit(late).alias("_late"), n.alias("_n"), v.alias("_v"), known.alias("_k"), f.alias("_f"))
        steps = F.array(step(us, 0, F.lit(1), v, known, f), step(us + minutes * 60_000_000, 1, F.lit(-1), -v, -known, none), step(us + fail_minutes * 60_000_000, 1, none, none.cast(dict(log.dtypes)[total]), none, -f))
        steps = log.select(*keep, own.alias("_own"), F.explode(steps).alias("_x")).select(*keep, "_own", "_x.*", F.explode(F.array(F.col("_own"), F.col("_own") + 1)).alias("_s"))
        steps = steps.filter((F.col("_at") < (F.col("_s") + 1) * size) & ((F.col("_n") != 0) | (F.col("_f") != 0)))
        w = Window.partitionBy("_s").orderBy("_at", "_late")
        out = steps.select(*keep, "_s", "_own", "_late", *[F.sum(c).over(w).alias(c) for c in ("_n", "_v", "_k", "_f")]).filter("_s = _own and _late = 0")
        return out.select(*keep, F.col("_n").alias("n5"), F.when(F.col("_k") > 0, F.col("_v")).alias("sum5"), F.col("_f").alias("fail10"))
    rows = log.select(*keep, us.alias("_us"), F.col(total).alias("_v"), failed.cast("int").alias("_f"), F.explode(F.array(own, own + 1)).alias("_s"), own.alias("_own"))
    w = Window.partitionBy("_s").orderBy("_us")
    short, long = w.rangeBetween(-minutes * 60_000_000, 0), w.rangeBetween(-fail_minutes * 60_000_000, 0)
    out = rows.withColumn("n5", F.count(F.lit(1)).over(short)).withColumn("sum5", F.sum("_v").over(short)).withColumn("fail10", F.count(F.when(F.col("_f") == 1, 1)).over(long))
    return out.filter("_s = _own").select(*keep, "n5", "sum5", "fail10")


def rate_and_eta(log: DataFrame, ts: str, now: Column, left: int, minutes: int = 5) -> DataFrame:
    """ST1: completions of the last minutes as a rate per minute, and the minutes that are left at it (null at rate 0)."""
    rate = log.filter((F.col(ts) >= now - F.expr(f"interval {minutes} minutes")) & (F.col(ts) <= now)).agg((F.count(F.lit(1)) / minutes).alias("per_minute"))
    return rate.withColumn("eta_minutes", F.when(F.col("per_minute") > 0, left / F.col("per_minute")))


def throttle(log: DataFrame, key: str, row: str, us: str, least: int) -> DataFrame:
    """ST4: rows of a key in order of time; one is emitted if at least ``least`` microseconds have passed since the last
    emitted one. A greedy scan: neither tumbling nor session windows give the same. (key, row, us, emitted)

    Each key's rows pass by once in order; nothing of them is held but the last emitted time.
    """
    kinds = dict(log.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, last = object(), None
        for pdf in batches:
            emitted = []
            for k, t in zip(pdf[key], pdf[us], strict=True):
                if k != key_now:
                    key_now, last = k, None
                go = last is None or t - last >= least
                last = t if go else last
                emitted.append(go)
            yield pdf.assign(emitted=emitted)

    rows = log.select(key, row, us).repartition(key).sortWithinPartitions(key, us, row)
    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, `{row}` {kinds[row]}, `{us}` {kinds[us]}, emitted boolean")


def throttled_stream(stream: DataFrame, key: str, ts: str, msg: str, least_seconds: float) -> DataFrame:
    """ST4 on a stream: keyed state holds the time of the last emitted row."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in batches:
            keep = []
            for t in pdf.sort_values("us", kind="stable")["us"]:
                go = last is None or t - last >= least_seconds * 1e6
                last = int(t) if go else last
                keep.append(go)
            out = pdf.sort_values("us", kind="stable")[keep]
            yield pd.DataFrame({key: k[0], "us": out["us"], msg: out[msg]})
        if last is not None:
            state.update((last,))

    rows = stream.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), msg)
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` string, us long, `{msg}` string", "last long", "append", GroupStateTimeout.NoTimeout)


def open_request_stream(stream: DataFrame, key: str, ts: str, kind: str, request: str, closing: tuple[str, ...]) -> DataFrame:
    """ST5 on a stream: per key whether its last event is a request, whenever that changes."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, was = state.get if state.exists else (None, None)
        before = was
        for pdf in batches:
            for t, x in zip(pdf["us"], pdf["kind"], strict=True):
                if at is None or t >= at:
                    at, was = int(t), x == request
        if at is not None:
            state.update((at, was))
            if was != before:
                yield pd.DataFrame({key: [k[0]], "us": [at], "is_open": [bool(was)]})

    rows = stream.filter(F.col(kind).isin(request, *closing)).select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(kind).alias("kind"))
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` long, us long, is_open boolean", "at long, was boolean", "update", GroupStateTimeout.NoTimeout)


def windowed_rates(stream: DataFrame, ts: str, total: str, late: str = "10 minutes", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """ST1, ST2 on a stream: rows and sums of sliding windows; rows later than ``late`` are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def latest_state(log: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """ST6: the last known row of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(ts, *fields), ts).alias("l")).select(key, "l.*")


def upsert_latest(stream: DataFrame, key: str, ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """ST6, ST9: each micro-batch is merged once into a table with a row per key; a burst of a key costs one write."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_state(batch, key, ts, [c for c in batch.columns if c not in (key, ts)])
        try:
            old = spark.read.parquet(f"{path}/v{number - 1}") if number else new.limit(0)
        except Exception as e:  # the first version has no one before it
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = new.limit(0)
        both = old.select(*new.columns).unionByName(new)
        latest_state(both, key, ts, [c for c in new.columns if c not in (key, ts)]).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """ST8: what a restart still has to do."""
    return work.join(done.select(key), key, "left_anti")
