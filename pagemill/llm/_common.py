"""Shared plumbing: scratch tables in the cluster's shared folder, and code for the workers."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])
_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where it is unset, one of our own if everything runs in this process (local tests), and an error on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="pagemill-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def with_code(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it is run from a checkout."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "")
    if _ROOT not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, paths) if x)
    return spark


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has a column of that name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Folders of scratch tables that this process has made and not cleared.
_made: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this process. Results that were not written or collected yet can't be read after."""
    while _made:
        _delete(spark, _made.pop())


class Scratch:
    """Tables that cut the lineage of one operator's run; each is written once and read again.

    They live in the shared folder, so an executor that is lost takes nothing with it. An operator drops those that its
    result does not read; the others stay until ``clear_scratch``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/pagemill/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _made.append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        return self.read(name, df.schema)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        _delete(self.spark, self.path(name))
        self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        for name in sorted(self.names.difference(names)):
            self.drop(name)


def tidied(run):
    """``run``, a function over Arrow batches, giving memory that it no longer needs back to the system when it ends.

    Workers are kept for later tasks, and their allocators hold on to what these may never need.
    """

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not glibc
            pass

    return wrapped


def small(n_bytes: int, limit: int = 32 << 20) -> bool:
    """Whether a side of that measured size may be broadcast; what is built of it takes about twice as much."""
    return n_bytes <= limit


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Consecutive rows that agree in ``keys``; runs longer than ``most`` come in parts of that length."""
    held: list[pa.Table] = []
    n, last = 0, None

    def whole() -> Iterator[pa.Table]:
        if held:
            run = pa.concat_tables(held)
            for at in range(0, n, most or n):
                yield run.slice(at, most or n)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        change = np.zeros(len(t) - 1, bool)
        for k in keys:
            x = t[k].to_numpy()
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(t)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s or [t[k][0].as_py() for k in keys] != last:
                yield from whole()
                held, n = [], 0
            held.append(t.slice(s, e - s))
            n += e - s
            if most and n >= most:
                run = pa.concat_tables(held)
                for at in range(0, n - n % most, most):
                    yield run.slice(at, most)
                held, n = [run.slice(n - n % most)] if n % most else [], n % most
        last = [t[k][len(t) - 1].as_py() for k in keys]
    yield from whole()
