"""Token counts with a whole-token shortcut.

Offline, each string of the vocabulary that the library encodes alone as one token is found (`bpe.prove_whole_tokens`).
Pre-tokens of a text that are among them count one at once; only the rest are merged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._common import tidied, with_code


@functools.lru_cache(maxsize=1)
def _counts(vocabulary: str, whole: frozenset[str]) -> bpe.Counts:
    return bpe.Counts(bpe.encoder(vocabulary), whole)


def count_tokens(text: str, counts: bpe.Counts) -> int:
    return sum(sum(counts.of(bpe.PIECE.findall(part))) for part in bpe.slices(text))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty and has no token. A special string inside a text is its one token, as is the library's
    default. Whole texts, any length; no shuffle. Rows that repeat are counted each. Other columns are not read.
    """
    spark = with_code(docs.sparkSession)
    proven = spark.sparkContext.broadcast(bpe.prove_whole_tokens(vocabulary))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(vocabulary, proven.value)
        for batch in batches:
            n = [count_tokens(t, counts) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("b"))
    out = rows.mapInArrow(tidied(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
