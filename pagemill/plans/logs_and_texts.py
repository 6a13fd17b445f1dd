"""Queries over logs (events), labelled documents, conversations and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mathtext as M
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sequences as W
from ..sources.tables import events, table
from ..streaming import logs as S


def problem_status_view(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("quality").isNotNull(), F.when(F.col("quality") == 1, "passed").otherwise("needs_review"))
    v = J.status_view(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", status, (F.col("quality") == 0) | (F.col("toxic") == 1))
    return v.select("doc_id", "status", "needs_review")


PROBLEM_STATUS_VIEW = """
SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'unsolved' WHEN quality = 1 THEN 'passed' ELSE 'needs_review' END AS status,
       coalesce(quality = 0 OR toxic = 1, false) AS needs_review FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def attention_list(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    issues = F.array_compact(F.concat(J.crop_issues(n % 97, n), J.quality_flags(n % 97, F.lit(40), n % 5, (n % 100) / 100)))
    return table(spark, sf, "documents").select("doc_id", F.array_join(issues, ",").alias("issues")).filter("issues <> ''")


ATTENTION_LIST = """
SELECT doc_id, issues FROM (SELECT doc_id, concat_ws(',', CASE WHEN n % 97 < 25 THEN 'too_low' END, CASE WHEN n < 200 THEN 'too_narrow' END,
  CASE WHEN n % 97 < 30 THEN 'too_short' END, CASE WHEN n % 97 > 72 THEN 'too_tall' END, CASE WHEN n % 5 = 0 THEN 'empty' END,
  CASE WHEN n % 100 < 80 THEN 'low_confidence' END) AS issues FROM (SELECT doc_id, length(text) AS n FROM documents)) WHERE issues <> ''
"""


def unsolved_rows(spark: SparkSession, sf: str) -> DataFrame:
    return J.unsolved(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


UNSOLVED_ROWS = "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("pid"), F.round(F.col("value") * 100).cast("long").alias("total"), "ts", "event_id")


def usage_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    return A.usage_by_stage(_usage(spark, sf))


USAGE_BY_STAGE = """
SELECT CASE WHEN g = 1 THEN NULL ELSE stage END AS stage, g = 1 AS is_total, calls, total FROM (
SELECT s AS stage, grouping(s) AS g, count(*) AS calls, CAST(sum(v) AS BIGINT) AS total
FROM (SELECT coalesce(nullif(event_type, ''), 'other') AS s, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY GROUPING SETS ((s), ()))
"""


def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.usage_summary(_usage(spark, sf), ("purchase", "signup"))


USAGE_SUMMARY = """
SELECT total, solved, CASE WHEN solved = 0 THEN 0 ELSE CAST(round_even(total / solved, 0) AS BIGINT) END AS per_problem
FROM (SELECT CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(DISTINCT CASE WHEN event_type IN ('purchase', 'signup') THEN user_id END) AS solved FROM events)
"""


def stage_order(spark: SparkSession, sf: str) -> DataFrame:
    g = _usage(spark, sf).groupBy("stage").agg(F.sum("total").alias("total"), F.min("event_id").alias("first"))
    return g.select("stage", F.row_number().over(Window.orderBy(F.desc("total"), "first")).cast("long").alias("pos"))  # a row per stage


STAGE_ORDER = """
SELECT stage, row_number() OVER (ORDER BY total DESC, first) AS pos FROM (SELECT event_type AS stage, sum(CAST(round(value * 100) AS BIGINT)) AS total, min(event_id) AS first FROM events GROUP BY 1)
"""


def modal_title(spark: SparkSession, sf: str) -> DataFrame:
    return A.modal(table(spark, sf, "documents"), "source", "lang", "doc_id").withColumnRenamed("lang", "title")


MODAL_TITLE = """
SELECT source, title, n FROM (SELECT source, lang AS title, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r
FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1
"""


def header_vote(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", (F.length("text") % 2 == 0).alias("vote"))
    return A.header_vote(d, ["source"], "vote")


HEADER_VOTE = """
SELECT source, count(vote) AS votes, count(vote) < 4 OR count(*) FILTER (vote) >= 0.5 * count(vote) AS has_header
FROM (SELECT source, length(text) % 2 = 0 AS vote FROM documents) GROUP BY source
"""


def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return W.forward_fill(e, ["user_id"], ["ts", "event_id"], "mark", "carried").select("event_id", "carried")


FORWARD_FILL = """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events
"""


def next_greater(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return W.next_greater(e, ["user_id"], "event_id", "v").select("event_id", F.col("next_value").alias("next_key"))


NEXT_GREATER = """
WITH e AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events)
SELECT a.event_id, (SELECT arg_min(b.v, b.event_id) FROM e b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.v > a.v) AS next_key FROM e a
"""


def stage_durations(spark: SparkSession, sf: str) -> DataFrame:
    return W.stage_durations(events(spark, sf), ["user_id"], "ts").select("event_id", "seconds")


STAGE_DURATIONS = "SELECT event_id, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS seconds FROM events"


def row_cluster(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.round("value", 2).alias("y"))
    return W.cluster_rows(e, "user_id", "y", ["event_id"], 12.0).select("user_id", "row_id", "start", "n")


ROW_CLUSTER = """
WITH RECURSIVE o AS (SELECT user_id, round(value, 2) AS y, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 2), event_id) AS r FROM events),
f AS (SELECT user_id, r, y AS start, CAST(1 AS BIGINT) AS row_id FROM o WHERE r = 1
  UNION ALL SELECT o.user_id, o.r, CASE WHEN abs(o.y - f.start) <= 12.0 THEN f.start ELSE o.y END, CASE WHEN abs(o.y - f.start) <= 12.0 THEN f.row_id ELSE f.row_id + 1 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id, row_id, start, count(*) AS n FROM f GROUP BY 1, 2, 3
"""


def throttle(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_type", "event_id", F.unix_micros("ts").alias("us"))
    return S.throttle(e, "event_type", "event_id", "us", 3_600_000_000).select("event_id", "emitted")


THROTTLE = """
WITH RECURSIVE o AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS r FROM events),
f AS (SELECT event_type, event_id, us, r, us AS last, true AS emitted FROM o WHERE r = 1
  UNION ALL SELECT o.event_type, o.event_id, o.us, o.r, CASE WHEN o.us - f.last >= 3600000000 THEN o.us ELSE f.last END, o.us - f.last >= 3600000000
  FROM f JOIN o ON o.event_type = f.event_type AND o.r = f.r + 1)
SELECT event_id, emitted FROM f
"""


def trailing_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("total"), "event_type")
    return S.trailing(e, "ts", "total", F.col("event_type") == "error", keep=["event_id"])


TRAILING_RATE = """
SELECT event_id, count(*) OVER w5 AS n5, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w5 AS BIGINT) AS sum5, count(CASE WHEN event_type = 'error' THEN 1 END) OVER w10 AS fail10 FROM events
WINDOW w5 AS (ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW), w10 AS (ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW)
"""


def open_requests(spark: SparkSession, sf: str) -> DataFrame:
    return J.open_requests(table(spark, sf, "events"), "user_id", "ts", "event_type", "click", ["purchase", "error"])


OPEN_REQUESTS = """
SELECT user_id, ts AS opened_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events WHERE event_type IN ('click', 'purchase', 'error')) WHERE r = 1 AND event_type = 'click'
"""


def lines_in_segment(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("yc", F.col("pos") * 10)
    last = F.floor((F.size(F.split("text", "\n")) - 1) * 10 / 45).cast("int")
    segments = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("seg")).withColumn("top", F.col("seg") * 45).withColumn("bottom", F.col("seg") * 45 + 30)
    found = J.lines_in_segments(lines, segments, "doc_id", "yc", "top", "bottom")
    return A.ordered_text(found, ["doc_id", "seg"], ["pos"], "text", "\n").select("doc_id", "seg", F.md5("text").alias("text"))


LINES_IN_SEGMENT = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
s AS (SELECT doc_id AS d, unnest(generate_series(0, (len(string_split(text, chr(10))) - 1) * 10 // 45)) AS seg FROM documents)
SELECT doc_id, CAST(seg AS INTEGER) AS seg, md5(string_agg(t, chr(10) ORDER BY pos)) AS text FROM l JOIN s ON d = doc_id AND pos * 10 BETWEEN seg * 45 - 4 AND seg * 45 + 34 WHERE t <> '' GROUP BY 1, 2
"""


def chapter_markdown(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("part", F.concat(F.lit("### "), "role", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n")))
    return A.ordered_text(c, ["conv_id"], ["turn"], "part").select("conv_id", F.md5("text").alias("md5"), F.length("text").cast("long").alias("n_chars"))


_CHAPTERS = "SELECT conv_id, string_agg('### ' || role || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1"
CHAPTER_MARKDOWN = f"SELECT conv_id, md5(t) AS md5, CAST(length(t) AS BIGINT) AS n_chars FROM ({_CHAPTERS})"


def book_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """One book per hundred conversations: a book, unlike a corpus, fits in a row."""
    c = table(spark, sf, "conversations").withColumn("part", F.concat(F.lit("### "), "role", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n")))
    chapters = A.ordered_text(c, ["conv_id"], ["turn"], "part").withColumn("book", F.floor(F.col("conv_id") / 100))
    return A.ordered_text(chapters, ["book"], ["conv_id"], "text", "\n\\newpage\n").select("book", F.md5("text").alias("md5"))


BOOK_MARKDOWN = f"SELECT CAST(conv_id // 100 AS BIGINT) AS book, md5(string_agg(t, chr(10) || '\\newpage' || chr(10) ORDER BY conv_id)) AS md5 FROM ({_CHAPTERS}) GROUP BY 1"


def normalize_blanks(spark: SparkSession, sf: str) -> DataFrame:
    blanked = F.concat("text", F.lit(" ________ \\_\\_\\_\\_\\_ &emsp;&emsp;&emsp;&emsp; x          y"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_blanks(blanked)).alias("md5"))


NORMALIZE_BLANKS = r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text || ' ________ \_\_\_\_\_ &emsp;&emsp;&emsp;&emsp; x          y',
  '\\underline\{(?:\s|\\[ ,;:!]|\\quad|\\qquad|~)*\}', '\\underline{\\qquad\\qquad}', 'g'), '(?:\\[ ,;:!]\s*){6,}', '\\qquad\\qquad ', 'g'),
  '(?:\\_){4,}', '\\_\\_\\_\\_\\_\\_', 'g'), '_{6,}', '\\_\\_\\_\\_\\_\\_', 'g'), '[ \t]{8,}', '  ', 'g'), '(?:&emsp;\s*){3,}', '&emsp;&emsp; ', 'g')) AS md5
FROM documents
"""


def score_extract(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("初评 评分：80\n"), "text", F.lit("\n【评分】： **"), (F.col("doc_id") % 130).cast("string"), F.lit("**"))
    return table(spark, sf, "documents").select("doc_id", T.last_score(reply).alias("score"))


SCORE_EXTRACT = "SELECT doc_id, CAST(CASE WHEN doc_id % 130 <= 100 THEN doc_id % 130 END AS INTEGER) AS score FROM documents"


def parse_headings(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.lit("### "), (F.col("conv_id") % 9 + 1).cast("string"), F.lit(".0"), (F.col("turn") % 3).cast("string"), F.lit("\n"))
    texts = A.ordered_text(table(spark, sf, "conversations").withColumn("part", F.concat(head, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\n"))), ["conv_id"], ["turn"], "part")
    return T.parse_import(texts, "conv_id", "text").select("conv_id", "problem_id", F.md5("body").alias("body_md5"), "duplicated")


PARSE_HEADINGS = r"""
WITH c AS (SELECT conv_id, turn, (conv_id % 9 + 1) || '.' || (turn % 3) AS problem_id, regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^[\s　]+|[\s　]+$', '', 'g') AS body FROM conversations),
r AS (SELECT *, count(*) OVER (PARTITION BY conv_id, problem_id) AS n, row_number() OVER (PARTITION BY conv_id, problem_id ORDER BY turn DESC) AS r FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, problem_id ORDER BY length(body) DESC, turn DESC) AS best FROM r WHERE r <= 2 AND body <> '')
SELECT conv_id, problem_id, md5(body) AS body_md5, n > 1 AS duplicated FROM f WHERE best = 1
"""


def damaged_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" $x")).when(F.col("doc_id") % 3 == 1, F.lit(" \\$5 $$y$$")).otherwise(F.lit("")))
    return table(spark, sf, "documents").select("doc_id", J.is_damaged(t).alias("damaged"))


DAMAGED_TEXT = r"""
SELECT doc_id, (length(b) - length(replace(b, '$', ''))) % 2 = 1 AS damaged FROM (SELECT doc_id, replace(replace(text ||
  CASE doc_id % 3 WHEN 0 THEN ' $x' WHEN 1 THEN ' \$5 $$y$$' ELSE '' END, '\$', ''), '$$', '') AS b FROM documents)
"""


def fence_balance(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("text", F.repeat(F.lit("\n```\ncode"), (F.col("doc_id") % 4).cast("int")))
    return table(spark, sf, "documents").select("doc_id", T.fence_count(t).cast("long").alias("n"), T.fence_count(T.balance_fences(t)).cast("long").alias("fixed"))


FENCE_BALANCE = "SELECT doc_id, doc_id % 4 AS n, (doc_id % 4 + 1) // 2 * 2 AS fixed FROM documents"


def similarity_top1(spark: SparkSession, sf: str) -> DataFrame:
    """For each part the best of the type names that share its first letter, by matching blocks."""
    part = table(spark, sf, "part")
    quotes = part.select(F.col("p_partkey").alias("key"), F.upper("p_name").alias("quote"), F.lit(0).alias("lo"), F.lit(1).alias("hi"), F.upper(F.left("p_name", F.lit(1))).alias("page"))
    lines = part.select(F.upper("p_type").alias("text"), F.upper(F.left("p_type", F.lit(1))).alias("page")).distinct().withColumn("yc", F.lit(0.5)).withColumn("line", F.xxhash64("text"))
    return M.best_line(quotes, lines, "page").select("key", F.col("text").alias("best"), F.round("score", 6).alias("score"))


def math_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """formulas of each text and what is wrong with them."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" $a+b$ and $$c$$ \\$5")).otherwise(F.lit(" $x"))).alias("t"))
    return M.token_counts(d, "doc_id", "t")


def check_replies(spark: SparkSession, sf: str) -> DataFrame:
    pid = F.concat((F.col("l_orderkey") % 90 + 1).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    line = F.concat(pid, F.when(F.col("l_returnflag") == "R", F.lit(" | 截断 | x")).otherwise(F.lit(" | OK")))
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("page"), line.alias("line"), pid.alias("pid")).distinct()
    replies = rows.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("reply"))
    merged = T.check_reply(replies, rows.select(F.col("pid").alias("problem_id")).distinct())
    checks = A.merge_checks(merged)
    return checks.select("problem_id", "ok", F.size("problems").cast("long").alias("n_problems"), A.joined("pages").alias("pages"))


CHECK_REPLIES = """
WITH r AS (SELECT DISTINCT l_orderkey % 500 AS page, (l_orderkey % 90 + 1) || '.' || l_linenumber AS problem_id, l_returnflag = 'R' AS bad FROM lineitem)
SELECT problem_id, NOT bool_or(bad) AS ok, count(*) FILTER (bad) AS n_problems,
       (SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FROM (SELECT DISTINCT page AS p FROM r q WHERE q.problem_id = r.problem_id)) AS pages
FROM r GROUP BY problem_id
"""
