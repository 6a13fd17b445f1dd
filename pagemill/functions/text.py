"""String and Markdown functions as column expressions (F rows of the inventory).

Python's \\s and \\d cover Unicode, Java's do not: patterns that depend on it begin with (?U).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of the texts that are read.
DASH = r"[-－—–﹣一_.．·]"
ANCHOR = r"(?U)^\s*[△▲Δ*＊☆★]?\s*(?:习\s*题\s*)?([0-9lIO|]{1,2})\s*[-－—–﹣一_.．·]\s*([0-9lIO|]{1,4})"
PREFIX = r"(?U)^\s*[△▲Δ*＊☆★]?\s*习\s*题\s*[0-9lIO|]"
TITLE = r"(?iU)^[\W\d_]*(?:Mul[a-zA-Z]*)?\s*(?:仿真)?(?:习题与思考题|思考题与习题|思考题和习题|习题|思考题|练习题|复习题|基本题|深入题|扩充题|Problems|Exercises)[\W\d_]*$"
SIMULATION = r"(?iU)^\s*(?:Mul[a-zA-Z]*\s*仿真|Multisim|仿真\s*题|仿真练习)"
CAPTION = r"(?U)^图\s*[PpＰ]?\s*(\d{1,2})\s*[.\-－—–·．]\s*(\d{1,3})\s*(?:\([a-z]\)|（[a-z]）)?\s*$"
PLAIN = r"(?U)^\s*(?:第\s*)?([0-9lIO|]{1,3})\s*(?:[.．、]|题)(?![0-9])"
EXAM_SECTION = r"(?U)^\s*([一二三四五六七八九十]+)\s*[、.．]\s*(\S.*)$"
HEAD = r"(?:\*\*)?\s*(?:习题|题目|题|第)?\s*(\d{1,2})\s*[.\-－—–·．]\s*(\d{1,3})(?!\d)\s*(?:题)?\s*(?:\*\*)?\s*[.。:：、]?\s*(.*)$"
IMPORT_HEAD = r"(?U)^\s*#{1,6}\s*" + HEAD
BARE_HEAD = r"(?U)^\s*(?:#{1,6}\s*)?" + HEAD
FIGURE_LINE = r"(?U)^\s*[*>\-\s]*有图题号\s*[*]*\s*[:：]\s*[*]*\s*(.*)$"
PAGE_LINE = r"(?U)^\s*[*>\-\s]*习题页\s*[*]*\s*[:：]\s*[*]*\s*(.*)$"
PAGE_RANGE = r"(\d{1,4})\s*[-－—–~～至到]\s*(\d{1,4})"
SCORE = r"(?:综合)?评分[】\]]?\s*[：:]\s*\**\s*(\d{1,3})"
STEP = r"^(?:\*\*(?:步骤|第一|第二|第三|第四|第五|第六|第七|第八|第九|第十|方法|解法|情况|阶段|分析|视角|小题|算子|特性).*?\*\*|\*\*[（(][0-9a-zA-Z一二三四五六七八九十]+[）)].*?\*\*|[（(][0-9a-zA-Z一二三四五六七八九十]+[）)]\s*|[①②③④⑤⑥⑦⑧⑨⑩]\s*|\d+\.\s+|\*\*【(?:最终结论|考研精要|波形标注|规范答案)】\*\*|[-*]\s+)"
COMPACT_HEAD = r"(?i)\n#{1,4}[^\n]*(?:速查|Compact)[^\n]*\n"
RESTATED = r"(?s)###\s*(?:[📌📝]\s*)?题目重述[^\n]*\n+(.*?)(?=\n+---|\n+###|\z)"
CHINESE_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"


def repair_digits(text: Column) -> Column:
    """letters that are read for digits."""
    return F.translate(text, "lI|Oo", "11100")


def anchor_candidates(text: Column, chapter_digits: int = 2) -> Column:
    """(chapter, number) for every prefix of the digits after the chapter, longest first; empty when there is none.
    Chapters have up to two digits in print; tables of books with more chapters ask for up to nine."""
    anchor = ANCHOR.replace("{1,2}", f"{{1,{chapter_digits}}}")
    ch = repair_digits(F.regexp_extract(text, anchor, 1))
    digits = repair_digits(F.regexp_extract(text, anchor, 2))
    n = F.length(digits)
    none = F.array().cast("array<struct<ch:int,k:int>>")
    each = F.transform(F.sequence(F.greatest(F.least(n, F.lit(3)), F.lit(1)), F.lit(1), F.lit(-1)), lambda d: F.struct(ch.cast("int").alias("ch"), F.left(digits, d).cast("int").alias("k")))
    return F.when((n > 0) & digits.rlike(r"^\d+$") & ch.rlike(r"^\d+$"), each).otherwise(none)


def chinese_numeral(text: Column) -> Column:
    """one of the numerals up to ten, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CHINESE_DIGITS.items() for x in kv]), text)


def without_space(text: Column) -> Column:
    """F5."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def import_heading(line: Column) -> Column:
    """the id of an import heading as "ch.k" without leading zeros, else null."""
    ch, k = F.regexp_extract(line, IMPORT_HEAD, 1), F.regexp_extract(line, IMPORT_HEAD, 2)
    return F.when(ch != "", F.concat_ws(".", ch.cast("int").cast("string"), k.cast("int").cast("string")))


def parse_import(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, problem_id, body, duplicated) of a text with headings.

    Hash headings win where there are any, else bare line numbers count. Lines of hints are dropped, text before the
    first heading too; three and more line ends become two and a closing rule goes. Of an id's last two bodies the
    longer stays (the later of equals); ids without any body are not parsed.
    """
    lines = texts.select(doc, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "line")).filter(~(F.col("line").rlike(FIGURE_LINE) | F.col("line").rlike(PAGE_LINE) | F.ltrim("line").startswith("👉") | F.col("line").contains("file:///")))
    hashed = F.max(F.when(F.col("line").rlike(IMPORT_HEAD), 1).otherwise(0)).over(Window.partitionBy(doc))
    lines = lines.withColumn("_hashed", hashed)
    part = lambda i: F.when(F.col("_hashed") == 1, F.regexp_extract("line", IMPORT_HEAD, i)).otherwise(F.regexp_extract("line", BARE_HEAD, i))
    marked = lines.withColumn("ch", part(1)).withColumn("k", part(2)).withColumn("is_head", F.col("ch") != "")
    marked = marked.withColumn("block", F.sum(F.col("is_head").cast("int")).over(Window.partitionBy(doc).orderBy("pos"))).filter("block > 0")
    body_line = F.when(F.col("is_head"), part(3)).otherwise(F.col("line"))
    whole = marked.groupBy(doc, "block").agg(
        F.max(F.when(F.col("is_head"), F.concat_ws(".", F.col("ch").cast("int").cast("string"), F.col("k").cast("int").cast("string")))).alias("problem_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", body_line.alias("t")))), lambda x: x["t"]), "\n").alias("body"),
    )
    clean = F.regexp_replace(F.col("body"), r"\n{3,}", "\n\n")
    clean = F.regexp_replace(F.regexp_replace(clean, r"(?U)\n-{3,}\s*$", ""), r"(?U)^\s+|\s+$", "")
    w = Window.partitionBy(doc, "problem_id")
    ranked = whole.withColumn("body", clean).withColumn("_n", F.count(F.lit(1)).over(w))
    filled = ranked.filter("body <> ''").withColumn("_r", F.row_number().over(w.orderBy(F.desc("block")))).filter("_r <= 2")
    return filled.groupBy(doc, "problem_id").agg(F.max_by("body", F.struct(F.length("body"), F.col("block"))).alias("body"), (F.max("_n") > 1).alias("duplicated"))


def figure_list(text: Column) -> Column:
    """Ids named in lines of figures, without leading zeros, in order, each once."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(FIGURE_LINE)), lambda x: F.regexp_extract(x, FIGURE_LINE, 1))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"\d{1,2}\s*[.\-－—–·．]\s*\d{1,3}"), F.lit(0))))
    tidy = lambda x: F.concat_ws(".", F.regexp_extract(x, r"^(\d+)", 1).cast("int").cast("string"), F.regexp_extract(x, r"(\d+)$", 1).cast("int").cast("string"))
    return F.array_distinct(F.transform(found, tidy))


def page_ranges(texts: DataFrame, doc: str, text: str, total_pages: int, pad: int = 1, only_chapters: list[int] | None = None) -> DataFrame:
    """Pages (doc, page) that a line of page ranges names, widened by ``pad`` and clipped.

    Swapped bounds are put right; a text with 全部 or with a page beyond the last gives none.
    """
    lines = texts.select(doc, F.explode(F.split(text, "\n")).alias("l")).withColumn("l", F.regexp_extract("l", PAGE_LINE, 1)).filter("l <> ''")
    everything = lines.filter("l like '%全部%' or l like '%全书%'").select(doc).distinct()
    parts = lines.join(everything, doc, "left_anti").select(doc, F.explode(F.split("l", "[；;。]")).alias("p"))
    chapter = F.regexp_extract("p", r"第\s*(\d+)\s*章", 1)
    parts = parts.withColumn("ch", F.when(chapter != "", chapter.cast("int"))).withColumn("p", F.regexp_replace("p", r"第\s*\d+\s*章", " "))
    if only_chapters:
        parts = parts.filter(F.col("ch").isNull() | F.col("ch").isin(only_chapters))
    single = F.regexp_replace("p", PAGE_RANGE, " ")
    found = parts.select(doc, F.explode(F.concat(F.regexp_extract_all("p", F.lit(PAGE_RANGE), F.lit(0)), F.regexp_extract_all(single, F.lit(r"\d{1,4}"), F.lit(0)))).alias("r"))
    a, b = F.regexp_extract("r", r"^(\d+)", 1).cast("int"), F.regexp_extract("r", r"(\d+)$", 1).cast("int")
    spans = found.select(doc, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    beyond = spans.filter(F.col("hi") > total_pages).select(doc).distinct()
    spans = spans.join(beyond, doc, "left_anti")
    pages = spans.select(doc, F.explode(F.sequence(F.greatest(F.col("lo") - pad, F.lit(1)), F.least(F.col("hi") + pad, F.lit(total_pages)))).alias("page"))
    return pages.distinct()


def chapters_in(ids: DataFrame, pid: str) -> DataFrame:
    """F10."""
    return ids.select(F.split_part(F.col(pid), F.lit("."), F.lit(1)).cast("int").alias("chapter")).distinct()


def normalize_blanks(text: Column) -> Column:
    """runs of blanks in the forms that readers produce, each as a short one; in this order."""
    out = F.regexp_replace(text, r"\\underline\{(?:\s|\\[ ,;:!]|\\quad|\\qquad|~)*\}", r"\\underline{\\qquad\\qquad}")
    out = F.regexp_replace(out, r"(?:\\[ ,;:!]\s*){6,}", r"\\qquad\\qquad ")
    out = F.regexp_replace(out, r"(?:\\_){4,}", r"\\_\\_\\_\\_\\_\\_")
    out = F.regexp_replace(out, r"_{6,}", r"\\_\\_\\_\\_\\_\\_")
    out = F.regexp_replace(out, r"[ \t]{8,}", "  ")
    return F.regexp_replace(out, r"(?:&emsp;\s*){3,}", "&emsp;&emsp; ")


def strip_leading_id(text: Column, pid: Column) -> Column:
    """an id at the start of its own text, taken off up to twice; blanks normalised."""
    part = lambda i: F.split_part(pid, F.lit("."), F.lit(i))
    pattern = F.concat(F.lit(r"(?U)^\s*(?:\*\*)?(?:习题|第)?\s*"), part(1), F.lit(r"\s*[-－—–﹣.．·]\s*"), part(2), F.lit(r"(?!\d)\s*(?:题)?(?:\*\*)?\s*[.。:：、]?\s*"))
    once = F.regexp_replace(F.regexp_replace(text, pattern, F.lit("")), pattern, F.lit(""))
    return F.when(pid.contains("."), normalize_blanks(F.regexp_replace(once, r"(?U)^\s+|\s+$", ""))).otherwise(text)


def last_score(text: Column) -> Column:
    """the last score of a reply if it is 0 to 100, else null."""
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(SCORE), F.lit(1)), F.lit(-1)).cast("int")
    return F.when(found.between(0, 100), found)


def split_compact(text: Column) -> Column:
    """(final, compact), parted at the last compact heading; without one, compact is derived."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(COMPACT_HEAD), F.lit(0)), F.lit(-1))
    # the last heading is where its text stands for the last time
    at = F.length(text) - F.length(F.call_function("substring_index", text, last, F.lit(-1))) - F.length(last)
    parted = F.struct(strip(F.left(text, at)).alias("final"), strip(F.call_function("substring_index", text, last, F.lit(-1))).alias("compact"))
    return F.when(last.isNotNull(), parted).otherwise(F.struct(strip(text).alias("final"), derive_compact(text).alias("compact")))


def derive_compact(text: Column) -> Column:
    """from the heading of the detailed steps on, else the whole text."""
    found = F.regexp_extract(text, r"(?m)(^#{2,4}[^\n]*(?:详尽分步|分步演算|分步推导)(?s:.*))", 1)
    return F.regexp_replace(F.when(found != "", found).otherwise(text), r"(?U)^\s+|\s+$", "")


def verdict(reply: Column) -> Column:
    """F16: (complete, issues, text) of a reply without its code fence; null when it does not say whether it is complete.
    无, 没有 and none mean that there is no issue."""
    bare = F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*|\s*```$", "")
    yes = F.lower(F.regexp_extract(bare, r"(?i)COMPLETE\"?\s*[:：]\s*\"?(yes|no|是|否|true|false)", 1))
    issues = F.trim(F.regexp_extract(bare, r"(?si)ISSUES\s*[:：]\s*(.*?)(?=\n\s*TEXT\s*[:：]|\z)", 1))
    text = F.trim(F.regexp_extract(bare, r"(?si)\n\s*TEXT\s*[:：]\s*(.*)\z", 1))
    out = F.struct(yes.isin("yes", "是", "true").alias("complete"), F.when(issues.isin("无", "没有", "none", "None"), "").otherwise(issues).alias("issues"), text.alias("text"))
    return F.when(yes != "", out)


CHECK_LINE = r"(?U)^\s*(?:[-*]\s*)?(\d{1,2}\.\d{1,3})\s*[|｜]\s*([^|｜]+?)\s*(?:[|｜]\s*(.*))?$"
MISSING_LINE = r"(?U)^\s*(?:[-*]\s*)?漏题\s*[|｜]\s*([^|｜]+?)\s*(?:[|｜]\s*(.*))?$"


def check_reply(replies: DataFrame, allowed: DataFrame) -> DataFrame:
    """lines ``pid | OK`` and ``pid | type | detail`` of replies (page, reply) as (page, problem_id, ok, problems).
    Ids that are not allowed are ignored; OK never undoes an error, whichever comes first."""
    lines = replies.select("page", F.posexplode(F.split("reply", "\n")).alias("pos", "line")).filter(~F.col("line").rlike(MISSING_LINE))
    part = lambda i: F.trim(F.regexp_extract("line", CHECK_LINE, i))
    rows = lines.select("page", "pos", part(1).alias("problem_id"), part(2).alias("type"), part(3).alias("detail")).filter("problem_id <> ''")
    rows = rows.join(allowed.select("problem_id"), "problem_id", "left_semi")
    bad = F.upper("type") != "OK"
    problems = F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("pos", "type", "detail")))), lambda x: F.struct(x["type"].alias("type"), x["detail"].alias("detail")))
    return rows.groupBy("page", "problem_id").agg(F.bool_and(~bad).alias("ok"), problems.alias("problems"))


def missing_reports(replies: DataFrame) -> DataFrame:
    """lines ``漏题 | pid | detail`` as (page, pid, detail)."""
    lines = replies.select("page", F.explode(F.split("reply", "\n")).alias("line")).filter(F.col("line").rlike(MISSING_LINE))
    return lines.select("page", F.trim(F.regexp_extract("line", MISSING_LINE, 1)).alias("pid"), F.trim(F.regexp_extract("line", MISSING_LINE, 2)).alias("detail"))


FIX_VERBS = ("下边到", "上边到", "续下一页", "去掉续页", "需要手动", "没问题")


def fix_operations(reply: Column, pid: Column) -> Column:
    """(op, arg) of an item's lines ``verb | pid | argument`` with one of the six verbs, in order."""
    rows = F.transform(F.split(reply, "\n"), lambda x: F.transform(F.split(x, "[|｜]"), lambda y: F.trim(y)))
    mine = F.filter(rows, lambda r: (F.size(r) >= 2) & (F.get(r, F.lit(1)) == pid) & r[0].isin(*FIX_VERBS))
    return F.transform(mine, lambda r: F.struct(r[0].alias("op"), F.coalesce(F.get(r, F.lit(2)), F.lit("")).alias("arg")))


def match_form(text: Column) -> Column:
    """what is compared when a quote is looked for: no white space, TeX marks or punctuation."""
    return F.regexp_replace(text, r"(?U)[\s$\\{}^_、，。,.:：；;（）()\[\]【】]", "")


def latex_safe(text: Column) -> Column:
    """punctuation apart from display formulas, tags as text."""
    out = F.regexp_replace(text, r"(?s)\$\$(.+?)\$\$([，。、；,.;!?])", "\\$\\$\n$1\n\\$\\$\n$2\n")
    return F.regexp_replace(out, r"\\tag\{([^}]+)\}", r"\\quad \\text{($1)}")


def normalize_headings(text: Column) -> Column:
    """a leading second-level heading of the problem goes, third-level ones become fourth-level."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"^##\s+(?:习题|题目)\s*[\d.]+\s*[^\n]*\n+", "")
    return latex_safe(F.regexp_replace(out, r"(?m)^###\s+", "#### "))


def is_step(line: Column) -> Column:
    """F24."""
    return line.rlike(STEP)


def exercise_headings(text: Column) -> Column:
    """F25."""
    return F.regexp_replace(text, r"(?mU)^#{2,4}\s*第\s*([\d.]+(?:\([a-zA-Z0-9]+\))?)\s*题\s*$", "## 习题 $1")


def fence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("```"))


def balance_fences(text: Column) -> Column:
    """each item (from one second-level heading of an exercise to the next) with an odd number of fences gets one more."""
    items = F.split(text, r"(?m)(?<=\n)(?=## 习题 )")
    fixed = F.transform(items, lambda s: F.when(fence_count(s) % 2 == 1, F.concat(_rstrip(s), F.lit("\n```\n\n"))).otherwise(s))
    return F.array_join(fixed, "")


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def light_clean(text: Column) -> Column:
    """what an item gets when it can't be reflowed: no emoji, at most one empty line."""
    out = F.regexp_replace(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", ""), r"\n{3,}", "\n\n")
    return F.concat(_rstrip(out), F.lit("\n\n"))


def too_long(text: Column, most: int = 5000) -> Column:
    """whether any line is longer than ``most``."""
    return F.exists(F.split(text, "\n"), lambda x: F.length(x) > most)


# Negations that a TeX engine has signs for, and font commands that need braces as a script.
NEGATED = {
    "\\not\\implies": "\\nRightarrow", "\\not\\Rightarrow": "\\nRightarrow", "\\not\\Longrightarrow": "\\nRightarrow", "\\not\\impliedby": "\\nLeftarrow",
    "\\not\\Leftarrow": "\\nLeftarrow", "\\not\\iff": "\\nLeftrightarrow", "\\not\\Leftrightarrow": "\\nLeftrightarrow", "\\not\\rightarrow": "\\nrightarrow",
    "\\not\\to": "\\nrightarrow", "\\not\\mid": "\\nmid", "\\not\\in": "\\notin",
}
SCRIPT_FONTS = "bb|cal|bf|rm|it|frak|sf|tt|scr|bfit"
PAGE_BREAK = '<div style="page-break-after: always;"></div>'


def _even_dollars(line: Column) -> Column:
    """A display formula's missing dollar put at its end, or one too many there taken off."""
    bare = F.regexp_replace(line, r"(?U)\s+$", "")
    odd = (F.length(bare) - F.length(F.replace(bare, F.lit("$"), F.lit("")))) % 2 == 1
    two = lambda f: f(bare, F.lit("$$"))
    missing = two(F.startswith) & F.endswith(bare, F.lit("$")) & ~two(F.endswith) & odd
    surplus = F.startswith(bare, F.lit("$")) & ~two(F.startswith) & two(F.endswith) & odd
    return F.when(missing, F.concat(bare, F.lit("$"))).when(surplus, F.left(bare, F.length(bare) - 1)).otherwise(line)


def sanitize_tex(text: Column) -> Column:
    """what a TeX engine can't take: emoji, tags, punctuation after display formulas, blanks inside dollars, bare
    fonts as scripts, negated arrows, uneven dollars, texts and sizes of images, page breaks; in this order."""
    out = F.regexp_replace(F.regexp_replace(text, EMOJI, ""), r"\\tag\{([^}]+)\}", r"\\quad \\text{($1)}")
    out = F.regexp_replace(out, r"\$\$([^$]+?)\$\$([，。、；,.;!?])", "\\$\\$\n$1\n\\$\\$\n$2\n")
    out = F.regexp_replace(out, r"(?<![$\\])\$(?!\$)([^$\n]+?)(?<!\\)\$(?!\$)", "\\$\x01$1\x02\\$")  # what stands within is marked, then trimmed
    out = F.regexp_replace(out, "(?U)\x01\\s*|\\s*\x02", "")
    out = F.regexp_replace(out, r"([\^_])\\(math(?:" + SCRIPT_FONTS + r"))\{([^{}]*)\}", r"$1{\\$2{$3}}")
    out = F.replace(out, F.lit("\\centernot"), F.lit("\\not"))
    for negated, sign in NEGATED.items():
        out = F.replace(out, F.lit(negated), F.lit(sign))
    out = F.array_join(F.transform(F.split(out, "\n"), _even_dollars), "\n")
    out = F.regexp_replace(out, r"!\[.*?\]\((.*?)\)", "![]($1){width=95%}")
    return F.replace(out, F.lit(PAGE_BREAK), F.lit("\n\\newpage\n"))


def degrade(section: Column) -> Column:
    """a section as a code block."""
    return F.concat(F.lit("```\n"), F.replace(section, F.lit("```"), F.lit("'''")), F.lit("\n```\n"))


def sections(text: Column) -> Column:
    """parts that begin with a second- or third-level heading, what comes before them first."""
    return F.filter(F.split(text, r"(?m)(?<=\n)(?=#{2,3} )"), lambda x: x != "")


def probe_once(rows: DataFrame, section: str) -> DataFrame:
    """F32: each distinct section once, under its hash."""
    return rows.select(F.md5(section).alias("h"), section).dropDuplicates(["h"])


def _one_rule(text: Column) -> Column:
    return F.regexp_replace(text, r"---\s*\n+(\s*---\s*\n+)+", "---\n\n")


def collapse_solution(text: Column) -> Column:
    """without the restatement of the problem, and without doubled or hanging rules."""
    out = _one_rule(F.regexp_replace(text, RESTATED, ""))
    return F.regexp_replace(F.regexp_replace(out, r"^(##\s*[^\n]+\n+)\s*---\s*\n+", "$1"), r"(?U)^\s+|\s+$", "")


def embed_image(text: Column, block: Column) -> Column:
    """an image block in place of the first restatement, else after the problem's heading, else in front."""
    first, head = F.regexp_substr(text, F.lit(RESTATED)), F.regexp_substr(text, F.lit(r"^##\s*习题\s*[^\n]+\n+"))
    at = F.instr(text, first)
    swapped = F.concat(F.left(text, at - 1), block, F.lit("\n\n"), F.substr(text, at + F.length(first)))
    ruled = F.concat(block, F.lit("\n\n---\n\n"))
    out = F.when(first.isNotNull(), swapped).when(head.isNotNull(), F.concat(head, ruled, F.substr(text, F.length(head) + 1))).otherwise(F.concat(ruled, text))
    return F.regexp_replace(_one_rule(out), r"(?U)^\s+|\s+$", "")


def with_problem_text(compact: Column, problem: Column) -> Column:
    """the problem's text after the heading or in front, unless its first 30 characters are there already."""
    bare = F.regexp_replace(problem, r"(?U)^\s+|\s+$", "")
    block = F.concat(F.lit("### 📝 题目文本\n\n"), bare, F.lit("\n\n---\n\n"))
    head = F.regexp_substr(compact, F.lit(r"^###?\s*习题\s*[^\n]+\n+"))
    put = F.when(head.isNotNull(), F.concat(head, block, F.substr(compact, F.length(head) + 1))).otherwise(F.concat(block, compact))
    return _one_rule(F.when((F.coalesce(bare, F.lit("")) == "") | F.contains(compact, F.left(bare, F.lit(30))), compact).otherwise(put))


def file_name(name: Column) -> Column:
    """a name without what file systems refuse; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(name, r"[\\/:*?\"<>|\s]+", "_"), r"^[._]+|[._]+$", ""), F.lit(""))


def sub_items(rows: DataFrame, key: str, text: str) -> DataFrame:
    """the stem (item 0) and the sub-items of a text, one row each."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = F.col("line").rlike(r"^\s*[（(](?:[a-z]|\d{1,2})[)）]").cast("int")
    numbered = lines.withColumn("item", F.sum(head).over(Window.partitionBy(key).orderBy("pos")))
    return numbered.groupBy(key, "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def signature(text: Column) -> Column:
    """the sorted characters of a text without white space, equal for all orders of them."""
    bare = F.regexp_replace(text, r"(?U)&emsp;|\s", "")
    return F.array_join(F.array_sort(F.filter(F.split(bare, ""), lambda x: x != "")), "")


def bracket_delimiters(text: Column) -> Column:
    """\\[ \\] as dollars on lines of their own, and \\( \\), unless escaped, as dollars; blanks inside go."""
    out = F.regexp_replace(text, r"(?sU)\\\[\s*(.*?)\s*\\\]", "\n\\$\\$\n$1\n\\$\\$\n")
    return F.regexp_replace(out, r"(?sU)(?<!\\)\\\(\s*(.*?)\s*\\\)", "\\$$1\\$")


def plain_labels(text: Column) -> Column:
    """bold sub-item labels as plain ones."""
    return F.regexp_replace(text, r"\*\*([（(](?:[a-z]|\d{1,2})[)）])\*\*", "$1")


def json_in(text: Column, schema: str) -> Column:
    """what stands from the first { to the last } as JSON."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def duration(seconds: Column) -> Column:
    """75 as 1:15 and 3700 as 1:01:40."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def bar(done: Column, total: Column, width: int = 20) -> Column:
    """a bar of # and -."""
    n = F.floor(F.least(done / F.greatest(total, F.lit(1)), F.lit(1)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n))


def backoff_seconds(attempt: Column, limited: Column) -> Column:
    """The wait before the n-th retry: 30 n up to 180 when limited, else 5 n^1.5 up to 45."""
    return F.when(limited, F.least(F.lit(180.0), 30.0 * attempt)).otherwise(F.least(F.lit(45.0), 5 * F.pow(attempt, F.lit(1.5))))


def percent_between(lo: int, width: int, done: Column, total: Column) -> Column:
    """lo + the whole part of width * done / total."""
    return (F.lit(lo) + F.floor(width * done / F.greatest(total, F.lit(1)))).cast("int")
