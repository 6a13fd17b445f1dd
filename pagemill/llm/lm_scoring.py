"""Language-model scores by deleted interpolation of a bigram model.

P(w | v) = l2[b] c(v, w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1), where b buckets contexts by how often they occur.
The weights of each bucket come from expectation-maximisation on held-out counts: one fold of the training documents
is set aside, the ratios are taken from the rest and the fold's bigrams weigh them. Scores then use all training counts.

How counts travel: documents are dealt to blocks of so many bytes, which are written once. A block asks for each of its
distinct words and word pairs once, at the place its hash names, and brings its own counts along; the place adds them
up and answers every block in the order of its questions. So no row per token is ever made. A place hears at most
``FAN`` blocks: where there are more, the places of each group of blocks add up first and ask on for the group, so a
word that every block has is one question per block, and again one per group, and nowhere one task's whole input.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from ._common import Scratch, tidied, with_code

HELD_OUT, TUNING, FOLDS = 2, 3, 7
#: Bytes of text in a block and in a part of a long document, and bytes of the corpus for each place that counts.
BLOCK_BYTES, PART_BYTES, PLACE_BYTES = 16 << 20, 4 << 20, 8 << 20
#: Blocks, or groups of blocks, that a place hears.
FAN = 4096
BUCKETS = 32
_U = np.uint64
START, END = wordhash.mix(np.array([1 << 60, 1 << 61], _U))
_LEFT, _RIGHT = wordhash.mix(np.array([1 << 58, 1 << 59], _U)) | _U(1)


def _packed(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, bytes of equal weight side by side: small ones become runs of zeros."""
    return pa.compress(np.ascontiguousarray(x.astype(_U).view(np.uint8).reshape(len(x), 8).T).tobytes(), "zstd", asbytes=True)


def _unpacked(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(_U).ravel()


def _packed_keys(ascending: np.ndarray) -> bytes:
    return _packed(np.diff(ascending, prepend=_U(0)))


def _unpacked_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(b, n), dtype=_U)


def _cut(keys: np.ndarray, places: int) -> Iterator[tuple[int, int, int]]:
    """Runs of ascending keys by place: the range of hashes is shared out evenly."""
    top = (keys >> _U(32)) * _U(places) >> _U(32)
    at = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(top[s]), s, e


class Block:
    """Distinct words and pairs of a run of texts, and which of them each token is.

    A text that does not begin its document has the word before it in front, which is its context and no token; one
    that does not close its document has no end.
    """

    def __init__(self, texts: list[bytes], begins: np.ndarray, closes: np.ndarray):
        h, n_words = wordhash.words(texts)
        begins, closes = begins.astype(np.int64), closes.astype(np.int64)
        self.n_tokens = n_words - (1 - begins) + closes
        ends = np.cumsum(n_words + begins + closes)
        firsts = ends - n_words - begins - closes  # places of the contexts that texts begin with
        self.starts = np.cumsum(self.n_tokens) - self.n_tokens
        stream = np.full(len(h) + int(begins.sum() + closes.sum()), END, _U)
        inside = np.ones(len(stream), bool)
        inside[firsts[begins > 0]] = False
        inside[ends[closes > 0] - 1] = False
        stream[firsts[begins > 0]] = START
        stream[inside] = h
        del h, inside
        self.words, at = np.unique(stream, return_inverse=True)
        at = at.astype(np.int32)
        self.second = np.ones(len(stream), bool)
        self.second[firsts] = False
        self.counted = self.second.copy()  # START is counted once for each document, a context in front not again
        self.counted[firsts[begins > 0]] = True
        second = np.flatnonzero(self.second)
        self.token_word = at[second]
        pairs = wordhash.mix(stream[second - 1] * _LEFT + stream[second] * _RIGHT)
        del stream
        self.stream_word = at
        self.pairs, first, which = np.unique(pairs, return_index=True, return_inverse=True)
        del pairs
        self.token_pair = which.astype(np.int32)
        del which
        self.pair_word = at[second[first]]
        self.pair_context = at[second[first] - 1]
        self._lengths = ends - firsts

    def counts(self, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words and of pairs: counts in all training texts, and ``held`` as questions have it."""
        fold = np.repeat(folds, self._lengths)
        out = []
        for at, f, n in ((self.stream_word[self.counted], fold[self.counted], len(self.words)), (self.token_pair, fold[self.second], len(self.pairs))):
            out += [np.bincount(at[f != HELD_OUT], minlength=n), 2 * np.bincount(at[f == TUNING], minlength=n)]
        out[1][self.stream_word[fold == TUNING]] |= 1
        out[3] |= out[3] > 0
        return tuple(out)


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _parted(text: bytes, most: int) -> list[tuple[bytes, bool, bool]]:
    """(text, whether it begins its document, whether it closes it): parts of about ``most`` bytes of a longer text, cut before a white space."""
    out: list[list] = []
    at, context = 0, b""
    while len(text) > most and at < len(text):
        m = _SPACE.search(text, at + most)
        part, at = (text[at : m.start()], m.start()) if m else (text[at:], len(text))
        last = part.rsplit(None, 1)  # of bytes: the same six white spaces
        if last:
            out.append([context + part, not context, False])
            context = last[-1]
    if not out:
        return [(text, True, True)]
    out[-1][2] = True
    return [tuple(x) for x in out]


_DEALT = "block long, n_bytes long, row array<long>, fold array<int>, begins array<boolean>, closes array<boolean>, lengths array<int>, t binary, tuning_begins array<boolean>, tuning_closes array<boolean>, tuning_lengths array<int>, tuning binary"


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (id, fold, t) as blocks, one row each; texts of the tuning fold stand in columns of their own as well."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = block = TaskContext.get().partitionId() << 33
        held, size, id_type = [], 0, None

        def flush() -> pa.RecordBatch:
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            cols = [pa.array([block], pa.int64()), pa.array([size], pa.int64()), one([h[0] for h in held], pa.int64()), one([h[2] for h in held], pa.int32())]
            for some in (held, [h for h in held if h[2] == TUNING]):
                texts = pa.array([pa.compress(b"".join(h[3] for h in some), "zstd", asbytes=True)], pa.binary())
                cols += [one([h[4] for h in some], pa.bool_()), one([h[5] for h in some], pa.bool_()), one([len(h[3]) for h in some], pa.int32()), texts]
            cols.append(one([h[1] for h in held], id_type))
            return pa.record_batch(cols, names=[*(c.split()[0] for c in _DEALT.split(", ")), "id"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 256):
                for key, fold, text in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    for part, begins, closes in _parted((text or "").encode(), PART_BYTES):
                        if held and size + len(part) > BLOCK_BYTES:
                            yield flush()
                            held, size, block = [], 0, block + 1
                        held.append((row, key, fold, part, begins, closes))
                        size += len(part) + 16
                    row += 1
        if held:
            yield flush()

    return rows.mapInArrow(tidied(run), f"{_DEALT}, id array<{kind}>")


def _block(row: dict, prefix: str = "") -> Block:
    lengths = row[f"{prefix}lengths"]
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    text = pa.decompress(row["tuning" if prefix else "t"], ends[-1], "zstd", asbytes=True)
    return Block([text[e - n : e] for n, e in zip(lengths, ends, strict=True)], np.asarray(row[f"{prefix}begins"]), np.asarray(row[f"{prefix}closes"]))


#: unit: a block, or a group of blocks; via: the place that asks for the group (0 for blocks). kind 1 is words, 2 pairs.
#: held: twice the count in the tuning fold, and one more where texts of that fold have the key (a context in front of
#: a part of a long text is there without being counted).
_ASK = "unit long, via long, kind int, place long, n int, keys binary, total binary, held binary"
_SAY = "unit long, via long, kind int, place long, n int, n_held int, total binary, fit binary, sum_n long, sum_held long, sum_v long, sum_fit long"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[name for name, _ in fields])


def _questions(unit: int, via: int, kind: int, places: int, keys: np.ndarray, total: np.ndarray, held: np.ndarray) -> Iterator[tuple]:
    for place, s, e in _cut(keys, places):
        yield unit, via, kind, place, e - s, _packed_keys(keys[s:e]), _packed(total[s:e]), _packed(held[s:e])


def _asked(blocks: DataFrame, places: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = _block(row)
                words, words_held, pairs, pairs_held = b.counts(np.asarray(row["fold"], np.int64))
                found = [*_questions(row["block"], 0, 1, places, b.words, words, words_held), *_questions(row["block"], 0, 2, places, b.pairs, pairs, pairs_held)]
                del b, row, words, words_held, pairs, pairs_held
                yield from _table(found, _ASK).to_batches()

    return blocks.select("block", "fold", "begins", "closes", "lengths", "t").mapInArrow(tidied(run), _ASK)


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of questions of one kind: distinct keys, their two counts, and which of them each question's keys are."""
    distinct, at = np.unique(np.concatenate([_unpacked_keys(r["keys"], r["n"]) for r in rows]), return_inverse=True)
    total = np.bincount(at, np.concatenate([_unpacked(r["total"], r["n"]) for r in rows])).astype(np.int64)
    held = np.concatenate([_unpacked(r["held"], r["n"]) for r in rows])
    there = np.bincount(at, held & _U(1)) > 0
    return distinct, total, 2 * np.bincount(at, held >> _U(1)).astype(np.int64) + there, at


def _answers(rows: list[dict], at: np.ndarray, total: np.ndarray, fit: np.ndarray, sums: tuple[int, ...]) -> pa.Table:
    """To each question its keys' counts in all training texts, and outside of the tuning fold for those the unit has there."""
    out, e = [], 0
    for i, r in enumerate(rows):
        part, e = at[e : e + r["n"]], e + r["n"]
        own = part[_unpacked(r["held"], r["n"]) > 0]
        out.append((r["unit"], r["via"], r["kind"], r["place"], len(part), len(own), _packed(total[part]), _packed(fit[own]), *(sums if i == 0 else (0, 0, 0, 0))))
    return _table(out, _SAY)


def _answer(table: pa.Table) -> pa.Table:
    """One place that hears everyone: adds up and answers; sizes of the corpus come along once."""
    rows = table.to_pylist()
    distinct, total, held, at = _summed(rows)
    held >>= 1
    word = distinct != START
    sums = (int(total[word].sum()), int(held[word].sum()), int((total[word] > 0).sum()), int((total[word] > held[word]).sum())) if rows[0]["kind"] == 1 else (0, 0, 0, 0)
    return _answers(rows, at, total, total - held, sums)


def _settled(asked: DataFrame, n_units: int, n_bytes: int, scratch: Scratch, level: int = 0) -> DataFrame:
    """The answers (as ``_SAY``) to ``asked``, saved."""
    if n_units <= FAN:
        return scratch.save(asked.groupBy("kind", "place").applyInArrow(_answer, _SAY), f"said{level}")
    groups, finer = math.ceil(n_units / FAN), max(1, math.ceil(n_bytes / PLACE_BYTES))
    asked = scratch.save(asked.withColumn("group", F.pmod(F.xxhash64("unit"), F.lit(groups))), f"asked{level}")

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        distinct, total, held, _ = _summed(rows)
        return _table(list(_questions(rows[0]["group"], rows[0]["place"], rows[0]["kind"], finer, distinct, total, held)), _ASK)

    mine = asked.groupBy("group", "kind", "place")
    said = _settled(mine.applyInArrow(gather, _ASK), groups, n_bytes, scratch, level + 1)

    def hand_down(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        distinct, _, held, at = _summed(rows)
        total, fit, own = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), np.flatnonzero(held > 0)
        e = f = 0
        sums = np.zeros(4, np.int64)
        for r in sorted(right.to_pylist(), key=lambda r: r["place"]):  # finer places in the order of the keys
            total[e : e + r["n"]] = _unpacked(r["total"], r["n"])
            fit[own[f : f + r["n_held"]]] = _unpacked(r["fit"], r["n_held"])
            e, f = e + r["n"], f + r["n_held"]
            sums += [r["sum_n"], r["sum_held"], r["sum_v"], r["sum_fit"]]
        return _answers(rows, at, total, fit, tuple(sums.tolist()))

    theirs = said.withColumnsRenamed({"unit": "_group", "via": "_via", "kind": "_kind"}).groupBy("_group", "_kind", "_via")
    out = scratch.save(mine.cogroup(theirs).applyInArrow(hand_down, _SAY), f"said{level}")
    scratch.drop(f"asked{level}")
    scratch.drop(f"said{level + 1}")
    return out


def _answered(keys: np.ndarray, kind: int, said: list[dict], places: int, column: str, n: str) -> np.ndarray:
    by = {r["place"]: r for r in said if r["kind"] == kind}
    out = np.zeros(len(keys))
    for place, s, e in _cut(keys, places):
        out[s:e] = _unpacked(by[place][column], by[place][n])
    return out


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket for each doubling."""
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(count + 1))).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _grid(x: np.ndarray) -> np.ndarray:
    """Cells of a fifth of a doubling; 0 is zero itself."""
    return np.where(x > 0, np.clip(400 + np.round(5 * np.log2(np.maximum(x, 1e-300))), 1, 400), 0).astype(np.int64)


def em(bucket: np.ndarray, weight: np.ndarray, f2: np.ndarray, f1: np.ndarray, f0: float, turns: int = 40) -> np.ndarray:
    """Weights (BUCKETS x 3) for pairs, words and the uniform part. Buckets with little to learn from lean on the whole."""
    f = np.stack([f2, f1, np.full(len(f1), f0)], axis=1)
    start = np.array([0.4, 0.4, 0.2])
    if not weight.sum():
        return np.tile(start, (BUCKETS, 1))

    def learn(at: np.ndarray, n: int, prior: np.ndarray, strength: float) -> np.ndarray:
        lam = np.tile(prior, (n, 1))
        for _ in range(turns):
            post = lam[at] * f
            post *= (weight / np.maximum(post.sum(1), 1e-300))[:, None]
            got = np.stack([np.bincount(at, post[:, k], n) for k in range(3)], axis=1) + strength * prior
            lam = got / got.sum(1, keepdims=True)
        return lam

    whole = np.maximum(learn(np.zeros(len(f), np.int64), 1, start, 0.0)[0], 1e-6)
    return learn(bucket, BUCKETS, whole / whole.sum(), 5.0)


def _tuned(blocks: DataFrame, said: DataFrame, places: int, n_fit: int, v_fit: int, scratch: Scratch) -> np.ndarray:
    """The weights, from the counts of the tuning fold against those of the other training texts."""
    names, kinds = ["cell", "weight", "f2", "f1"], (pa.int64(), pa.float64(), pa.float64(), pa.float64())

    def tune(left: pa.Table, right: pa.Table) -> pa.Table:
        # the keys of these texts are those that the block has in the tuning fold, in the same order
        b, answers = _block(left.to_pylist()[0], "tuning_"), right.to_pylist()
        word, pair = (_answered(keys, kind, answers, places, "fit", "n_held") for kind, keys in ((1, b.words), (2, b.pairs)))
        weight, context = np.bincount(b.token_pair, minlength=len(b.pairs)), word[b.pair_context]
        f2, f1 = _ratio(pair, context), word[b.pair_word] / max(1, n_fit)
        cells, at = np.unique((bucket_of(context) * 401 + _grid(f2)) * 401 + _grid(f1), return_inverse=True)
        data = [cells, *(np.bincount(at, weight * x, len(cells)) for x in (1.0, f2, f1))]
        return pa.table([pa.array(c, k) for c, k in zip(data, kinds, strict=True)], names=names)

    left = blocks.filter(F.size("tuning_lengths") > 0).select("block", "tuning", "tuning_begins", "tuning_closes", "tuning_lengths").groupBy("block")
    right = said.filter("n_held > 0").select(F.col("unit").alias("_unit"), "kind", "place", "n_held", "fit").groupBy("_unit")
    cells = left.cogroup(right).applyInArrow(tune, "cell long, weight double, f2 double, f1 double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in names[1:]])
    got = scratch.save(cells, "cells").toPandas().sort_values("cell")  # at most BUCKETS x 401 x 401 cells whatever the corpus, in fact some thousands
    w = got["weight"].to_numpy()
    return em(got["cell"].to_numpy() // 401**2, w, got["f2"].to_numpy() / w, got["f1"].to_numpy() / w, 1 / (v_fit + 1))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are lower-cased (A-Z) runs of non-space, then one end that is a token too; null text is the end alone.
    Documents whose crc32 of the id as text is 2 modulo 7 are not learnt from (a null id hashes as the empty string).
    base_score uses add-one unigrams; score is the log10 probability by the interpolated model. Without any training
    document both are those of the uniform model. Rows that repeat count and are scored each; a long text is scored
    in parts, each with the word before it as context, whose scores are added up. Other columns are not read.
    """
    spark = with_code(docs.sparkSession)
    scratch = Scratch(spark, "lm_scoring")
    fold = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).select("id", fold.alias("fold"), "t")
    id_kind = rows.schema["id"].dataType.simpleString()
    blocks = scratch.save(_dealt(rows), "blocks")
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    places = max(4, math.ceil(min(size["bytes"], FAN * BLOCK_BYTES) / PLACE_BYTES))
    said = _settled(_asked(blocks, places), size["n"], size["bytes"], scratch)
    sums = said.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sum_n", "sum_held", "sum_v", "sum_fit")]).first()
    n, v = sums["sum_n"], sums["sum_v"]
    lam = _tuned(blocks, said, places, n - sums["sum_held"], sums["sum_fit"], scratch) if n else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row, answers = left.to_pylist()[0], right.to_pylist()
        b = _block(row)
        word, pair = (_answered(keys, kind, answers, places, "total", "n") for kind, keys in ((1, b.words), (2, b.pairs)))
        context = word[b.pair_context]
        mix = lam[bucket_of(context)]
        p = mix[:, 0] * _ratio(pair, context) + mix[:, 1] * word[b.pair_word] / max(1, n) + mix[:, 2] / (v + 1)
        base = np.log10((word + 1) / (n + v + 1))
        per_text = lambda x: np.add.reduceat(x, b.starts)
        data = [pa.array(row["row"], pa.int64()), pa.array(row["id"], left.schema.field("id").type.value_type), pa.array(np.asarray(row["fold"]) == HELD_OUT), pa.array(b.n_tokens)]
        data += [pa.array(per_text((word > 0)[b.token_word].astype(np.int64))), pa.array(per_text(base[b.token_word])), pa.array(per_text(np.log10(p)[b.token_pair])), pa.array(~np.asarray(row["begins"]) | ~np.asarray(row["closes"]))]
        return pa.table(data, names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "part"])

    left = blocks.select("block", "row", "id", "fold", "begins", "closes", "lengths", "t").groupBy("block")
    right = said.select(F.col("unit").alias("_unit"), "kind", "place", "n", "total").groupBy("_unit")
    scored = scratch.save(left.cogroup(right).applyInArrow(score, f"row long, id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, part boolean"), "scored")
    scratch.keep("scored")
    values = ["n_tokens", "n_known", "base_score", "score"]
    parts = scored.filter("part").groupBy("row").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in values])
    out = scored.filter("not part").select("id", "held_out", *values).unionByName(parts.select("id", "held_out", *values))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
