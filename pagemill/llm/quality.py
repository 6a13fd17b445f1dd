"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Trees are grown on binned statistics with the logistic loss and flattened into arrays (feature, threshold, leaf), so
that a batch walks all trees by array lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import wordhash
from ._common import tidied, unused, with_code

#: Labelled rows that the model is fitted on at most: those whose ids have the smallest hashes.
SAMPLE = 20_000
ACCEPT = 0.3
#: Rows whose statistics are held at a time.
SLICE = 1000

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".?",
    "shout": b"!",
    "comma": b",;:",
    "symbol": b"#$%&*+/<=>@\\^_`{|}~[]",
    "bar": b"|",
    "quote": b"\"'()-",
    "space": b" \t",
    "line": b"\n\r",
    "high": bytes(range(128, 256)),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _i] = 1
NAMES = [*_CLASSES, "log_bytes", "log_words", "word_bytes", "distinct", "commonest", "repeated_next", "repeated_pair", "line_repeats", "line_bytes", "byte_entropy"]


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row per text. A null or empty text, or one without words, has zeros where nothing can be counted."""
    data = [(t or "").encode() for t in texts]
    out = np.zeros((len(data), len(NAMES)))
    hashes, counts = wordhash.words(data)
    ends = np.cumsum(counts)
    k = len(_CLASSES)
    for i, (b, e, n) in enumerate(zip(data, ends.tolist(), counts.tolist(), strict=True)):
        size = len(b)
        if not size:
            continue
        seen = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        out[i, :k] = seen @ _TABLE / size
        share = seen[seen > 0] / size
        lines = b.split(b"\n")
        w = hashes[e - n : e]
        out[i, k : k + 2] = np.log1p(size), np.log1p(n)
        if n:
            _, each = np.unique(w, return_counts=True)
            out[i, k + 2 : k + 5] = size / n, len(each) / n, each.max() / n
            out[i, k + 5] = (w[1:] == w[:-1]).mean() if n > 1 else 0
            out[i, k + 6] = (w[2:] == w[:-2]).mean() if n > 2 else 0
        out[i, k + 7 :] = 1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)), -(share * np.log2(share)).sum()
    return out


@dataclass
class Model:
    """Flattened trees: node j of a tree has children 2j+1 (value <= threshold) and 2j+2."""

    prior: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least: int = 20, ridge: float = 1.0) -> Model:
    """Without rows the model says 0.5; with one class only, that class's smoothed share."""
    n = len(y)
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    inner, leaves = 2**depth - 1, 2**depth
    if not 0 < y.sum() < n:
        return Model(prior, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(n_features) * bins
    margin = np.full(n, prior)
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            for j in range(2**level - 1, 2 ** (level + 1) - 1):
                here = np.flatnonzero(node == j)
                if len(here) < 2 * least:
                    continue
                cells = flat[here].ravel()
                g, h, c = (np.bincount(cells, np.repeat(v, n_features) if v is not None else None, n_features * bins).reshape(n_features, bins) for v in (grad[here], hess[here], None))
                gl, hl, cl = g.cumsum(1), h.cumsum(1), c.cumsum(1)
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (ct - cl < least)] = -1
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] > 1e-6 and b < len(edges[f]):
                    feature[j], threshold[j] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        where = node - inner
        leaf = -rate * np.bincount(where, grad, leaves) / (np.bincount(where, hess, leaves) + ridge)
        margin = margin + leaf[where]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_leaves.append(leaf)
    return Model(prior, np.stack(all_features), np.stack(all_thresholds), np.stack(all_leaves))


def remainder(id_col: str, by: int):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows, none of them held out (crc32 of the id mod 5 is 0): those whose ids' hashes
    come first and, where ids repeat, those whose hashes with their statistics do. Labels without a document, null ids and null labels count for
    nothing."""
    with_code(docs.sparkSession)
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).filter("y is not null").filter(F.col(id_col).isNotNull() & (remainder(id_col, 5) != 0))
    chosen = known.orderBy(F.xxhash64(id_col), id_col, "y").limit(sample)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), id_col).select("t", "y", F.xxhash64(id_col).alias("h"))  # bounded by sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (w.slice(i, SLICE) for w in batches for i in range(0, w.num_rows, SLICE)):
            x = statistics(batch.column(0).to_pylist())
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "h"])

    got = rows.mapInArrow(tidied(run), "x array<double>, y int, h long").orderBy(F.xxhash64("h", "x"), "x", "y").limit(sample).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(NAMES))
    return fit(x, (got["y"].to_numpy() == 1).astype(float))


def with_scores(docs: DataFrame, model: Model, text_col: str, score: str) -> DataFrame:
    """``docs`` with all its columns and one more."""
    spark = with_code(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # some kilobytes, by the number of trees
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                scores = shared.value.score(statistics(batch.column(at).to_pylist()))
                yield pa.record_batch([*batch.columns, pa.array(scores)], names=[*batch.schema.names, score])

    return docs.mapInArrow(tidied(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, held_out, score (0 to 1), predicted (1 from 0.3 on).

    Null text counts as empty; every text has a score. Only the text makes the score. A null id hashes as the empty
    string. Without labels every score is 0.5. Rows that repeat are scored each.
    """
    model = train(docs, labels, id_col, text_col)
    scored = with_scores(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), model, "text", "score")
    return scored.select(id_col, (remainder(id_col, 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged, whatever their names. Null texts count as
    empty; without any label all rows stay; an empty table gives an empty result."""
    (name,) = unused(docs, "_score")
    return with_scores(docs, train(docs, labels, id_col, text_col), text_col, name).filter(F.col(name) >= ACCEPT).drop(name)
