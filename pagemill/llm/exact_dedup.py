"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Each text is cut into blocks of a fixed number of bytes. A sort gives every distinct block one integer name (the
smallest number of a row that holds it); adjacent names are paired and the pairs named in the same way until each
document has one name. Names stand for contents, not for hashes of them, so two documents share a name exactly when
they are equal.

Hot blocks: hashes are counted first, and a block whose hash occurs more often than ``hot`` is named within ``SALTS``
parts, whose few representatives then agree on one name. Hashes only choose where rows go; they never decide equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 256
#: Hot hashes that are broadcast at most (16 bytes each); above it the bar for "hot" is doubled.
MAX_HOT = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; where all is ASCII the faster lower() does the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def name_rows(scratch: Scratch, rows: DataFrame, key: list[str], level: int, hot: int) -> DataFrame:
    """Adds ``name``: one integer for all rows with equal ``key`` (null equals null), which no other key gets.

    ``rows`` has a unique long ``uid``; the name is the smallest uid among the equals. Key columns are dropped.
    """
    fp = F.xxhash64(*key)
    counts = scratch.save(rows.groupBy(fp.alias("fp")).count().filter(F.col("count") > hot), f"hot{level}")
    bar, n_hot = hot, counts.count()
    while n_hot > MAX_HOT:
        bar *= 2
        counts = counts.filter(F.col("count") > bar)
        n_hot = counts.count()
    carried = [c for c in rows.columns if c not in key]
    if not n_hot:
        return rows.withColumn("name", F.min("uid").over(Window.partitionBy(*key))).drop(*key)

    marked = rows.withColumn("fp", fp).join(F.broadcast(counts.select("fp", F.lit(True).alias("hot"))), "fp", "left")
    marked = marked.withColumn("salt", F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("uid"), F.lit(SALTS))).otherwise(F.lit(0)))
    part = marked.withColumn("name1", F.min("uid").over(Window.partitionBy(*key, "salt")))
    spoken = F.col("hot") & (F.col("uid") == F.col("name1"))  # one row for each key and part
    first = scratch.save(part.select(*carried, "name1", "hot", spoken.alias("rep"), *[F.when(spoken, F.col(k)).alias(k) for k in key]), f"part{level}")
    agreed = first.filter("rep").select("name1", F.min("name1").over(Window.partitionBy(*key)).alias("name2"))
    return first.join(agreed, "name1", "left").select(*carried, F.coalesce("name2", "name1").alias("name"))


def identities(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, hot: int = 256) -> DataFrame:
    """Per row of ``docs``: rid, id, text_sha256 and the pair (n_blocks, name) that equal texts share."""
    body = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), F.encode(body, "UTF-8").alias("body"))
    base = base.select(F.monotonically_increasing_id().alias("rid"), "id", F.sha2("body", 256).alias("sha"), "body", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int").alias("n"))
    cut = base.select("rid", "id", "sha", "n", F.posexplode(F.expr(f"transform(sequence(0, n - 1), i -> substring(body, i * {block_bytes} + 1, {block_bytes}))")).alias("pos", "block"))
    rows = cut.select("rid", "id", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), F.col("n").alias("n_blocks"), "n", "pos", "block", F.monotonically_increasing_id().alias("uid"))
    named = scratch.save(name_rows(scratch, rows, ["block"], 0, hot), "names0")
    longest, level, done = named.agg(F.max("n")).first()[0] or 1, 0, [named.filter("n = 1")]
    while longest > 1:
        level += 1
        left, right = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = (
            named.filter("n > 1")
            .groupBy("rid", F.expr("pos div 2").cast("int").alias("half"))
            .agg(F.max("id").alias("id"), F.max("sha").alias("sha"), F.max("n_blocks").alias("n_blocks"), F.max("n").alias("n"), F.max(left).alias("a"), F.max(right).alias("b"), F.max(F.when(F.col("pos") % 2 == 0, F.col("uid"))).alias("uid"))
            .select("rid", "id", "sha", "n_blocks", F.expr("(n + 1) div 2").cast("int").alias("n"), F.col("half").alias("pos"), "a", "b", "uid")
        )
        named = scratch.save(name_rows(scratch, pairs, ["a", "b"], level, hot), f"names{level}")
        done.append(named.filter("n = 1"))
        longest = (longest + 1) // 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("rid", "id", "sha", "n_blocks", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, hot: int = 256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equals the largest id
    stays, a null id counting as the smallest; of rows that repeat an id too, one stays. Columns other than the two
    named are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    rows = scratch.save(identities(docs, scratch, id_col, text_col, block_bytes, hot), "rows")
    scratch.keep("rows")
    groups = rows.groupBy("n_blocks", "name").agg(F.max(F.struct("id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = scratch.save(groups, "groups")
    joined = rows.join(groups, ["n_blocks", "name"])
    return joined.select(F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged, whatever their names; null texts count as empty.

    Of rows that repeat an id and a text, one stays: the one whose other columns come first as JSON, so reruns agree. An
    empty table gives an empty result.
    """
    own, own_sha, sha, rest, place = unused(docs, "_kept_id", "_kept_sha", "_sha", "_rest", "_place")
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(own), F.col("text_sha256").alias(own_sha))
    body = F.sha2(F.encode(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8"), 256)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.withColumn(sha, body).withColumn(rest, F.to_json(F.struct(*others)) if others else F.lit(""))
    hit = rows.join(kept, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(sha) == F.col(own_sha)), "left_semi")
    first = F.row_number().over(Window.partitionBy(id_col, sha).orderBy(rest))
    return hit.withColumn(place, first).filter(F.col(place) == 1).select(*docs.columns)


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
           FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
