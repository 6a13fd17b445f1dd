"""Queries over the text rules: each row gets one of a few written cases by its key, filled with the row's values; the SQL
says what the rule makes of each case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mathtext as M
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..shipping import spread
from ..sources.tables import table


def _case(key: Column, cases: list) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cases]), (key % len(cases) + 1).cast("int"))


def _list(cases: list) -> str:
    """The same cases as a list of the SQL."""
    return "[" + ", ".join("NULL" if c is None else str(c).lower() if isinstance(c, bool) else str(c) if isinstance(c, int) else "'" + c.replace("'", "''") + "'" for c in cases) + "]"


def _pick(cases: list, key: str = "p_partkey") -> str:
    return f"({_list(cases)})[CAST({key} % {len(cases)} + 1 AS INTEGER)]"


def _filled(key: Column, cases: list[str], **values: Column) -> Column:
    out = _case(key, cases)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string"))
    return out


def _fill(cases: list[str], key: str = "p_partkey", **values: str) -> str:
    out = _pick(cases, key)
    for name, value in values.items():
        out = f"replace({out}, '<{name}>', CAST({value} AS VARCHAR))"
    return out


_PART, _N_SQL = "part", "(p_partkey % 90 + 1)"


def _key() -> Column:
    return F.col("p_partkey")


def _n() -> Column:
    return _key() % 90 + 1



_LINES = ["习题 参考 答案", "本题附答案", "题解", "第 3 章 信号", "习 题", "习题1-1 求解", "4.7 Exercises", "§2.3 习题", "直接计算，并验证你的答案。", "正文", "图 3.4", "一丨丁"]


def line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """P2, P4, P19, F3, F5."""
    p, text = table(spark, sf, _PART), _case(_key(), _LINES)
    kind = J.line_kind(text, F.col("p_size"), F.lit(20), _key() % 1000, F.lit(1000))
    return p.select("p_partkey", kind.alias("kind"), J.is_prose(text).alias("prose"), J.in_column(F.col("p_size"), F.col("p_size") + 700, F.lit(20), F.lit(720)).alias("inside"))


LINE_KINDS = f"""
SELECT p_partkey, CASE WHEN p_partkey % 12 = 3 AND (p_size < 27 OR p_partkey % 1000 <= 120) THEN NULL ELSE {_pick(["stop", None, "stop", "opener", "heading", None, "heading", "heading", None, None, None, None])} END AS kind,
  {_pick([True, True, True, True, True, True, False, True, True, True, False, False])} AS prose, p_size >= 12 AND p_size <= 28 AS inside FROM part
"""


def anchor_texts(spark: SparkSession, sf: str) -> DataFrame:
    """F1, F2, F3, F4."""
    letters = lambda c: F.when(_key() % 3 == 0, F.translate(c, "10", "lO")).otherwise(c)
    ch, digits = letters(F.col("p_size").cast("string")), letters((_key() % 1999 + 1).cast("string"))
    text = F.concat(_case(_key(), ["习题 ", "△", "", " * "]), ch, _case(_key(), [".", "-", "—", "一", "·"]), digits, F.lit("节"))
    found = F.transform(T.anchor_candidates(text), lambda x: F.concat_ws(".", x["ch"], x["k"]))
    numeral = T.chinese_numeral(_case(_key(), ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "百"]))
    return table(spark, sf, _PART).select("p_partkey", F.array_join(found, ",").alias("candidates"), text.rlike(T.PREFIX).alias("prefixed"), numeral.alias("numeral"))


ANCHOR_TEXTS = """
SELECT p_partkey, array_to_string([p_size || '.' || CAST(left(d, n) AS INTEGER) FOR n IN generate_series(least(3, length(d)), 1, -1)], ',') AS candidates,
  p_partkey % 4 = 0 AS prefixed, CAST(CASE WHEN p_partkey % 11 < 10 THEN p_partkey % 11 + 1 END AS INTEGER) AS numeral
FROM (SELECT p_partkey, p_size, CAST(p_partkey % 1999 + 1 AS VARCHAR) AS d FROM part)
"""

_HEADS = ["### <c>.<k> x", "# 习题 0<c>．0<k>", "###### **第<c>-<k>题** y", "<c>.<k> no hash", "## 题目<c>—<k>：z", "正文 <c>.<k>", "## 3.14159 and 2"]


def import_ids(spark: SparkSession, sf: str) -> DataFrame:
    """F6, F12."""
    c, k = F.col("p_size"), _n()
    heading = T.import_heading(_filled(_key(), _HEADS, c=c, k=k))
    own = _filled(_key(), ["习题<c>.<k> <c>-<k>题. 求 x", "**<c>.<k>** 求 x", "<c>.<k>1 求 x", "求 x", " 第<c>·<k>题：求 x________"], c=c, k=k)
    return table(spark, sf, _PART).select("p_partkey", heading.alias("id"), T.strip_leading_id(own, F.concat_ws(".", c, k)).alias("bare"), T.without_space(own).alias("dense"))


_OWN = ["习题<c>.<k> <c>-<k>题. 求 x", "**<c>.<k>** 求 x", "<c>.<k>1 求 x", "求 x", " 第<c>·<k>题：求 x________"]
IMPORT_IDS = rf"""
SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 2, 4) OR p_partkey % 7 = 1 AND p_size < 10 THEN p_size || '.' || {_N_SQL} END AS id,
  {_fill(["求 x", "求 x", "<c>.<k>1 求 x", "求 x", "求 x" + chr(92) + "_" + (chr(92) + "_") * 5], c="p_size", k=_N_SQL)} AS bare, replace({_fill(_OWN, c="p_size", k=_N_SQL)}, ' ', '') AS dense FROM part
"""


def chapters_present(spark: SparkSession, sf: str) -> DataFrame:
    """F10."""
    return T.chapters_in(table(spark, sf, "lineitem").select(F.concat_ws(".", F.col("l_orderkey") % 500, "l_linenumber").alias("pid")), "pid")


CHAPTERS_PRESENT = "SELECT DISTINCT CAST(l_orderkey % 500 AS INTEGER) AS chapter FROM lineitem"


def figure_lists(spark: SparkSession, sf: str) -> DataFrame:
    """F8, U7, P9."""
    c, k = F.col("p_size"), _n()
    text = _filled(_key(), ["a\n有图题号：<c>.<k>、<c>.0<k>\n**有图题号**: 51.1\nb", "> 有图题号： 51．1，<c>-<k>", "没有", "有图题号：无"], c=c, k=k)
    listed, body = T.figure_list(text), _case(_key(), ["无", "见图", "如图P3", "图 2", "无"])
    return table(spark, sf, _PART).select("p_partkey", F.array_join(listed, ",").alias("listed"), J.has_figure(F.concat_ws(".", c, k), body, listed, text.contains("有图题号")).alias("has_fig"))


FIGURE_LISTS = f"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || k || ',51.1' WHEN 1 THEN '51.1,' || p_size || '.' || k ELSE '' END AS listed,
  CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE p_partkey % 4 < 2 OR p_partkey % 5 IN (1, 2, 3) END AS has_fig FROM (SELECT p_partkey, p_size, {_N_SQL} AS k FROM part)
"""


def page_spans(spark: SparkSession, sf: str) -> DataFrame:
    """F9, U3."""
    key = F.col("c_custkey")
    a, b, one = key % 250 + 1, key % 250 + F.col("c_nationkey") - 11, key * 7 % 310 + 1
    text = F.when(key % 10 == 0, F.lit("习题页：全部")).when(key % 10 == 1, F.lit("前言")).otherwise(F.concat(F.lit("x\n- **习题页**： 第1章 "), a, F.lit("~"), F.greatest(b, F.lit(1)), F.lit("；第 2 章 "), one, F.lit("。\ny")))
    rows = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return T.page_ranges(rows.select(key.alias("doc"), text.alias("t")), "doc", "t", 300)


PAGE_SPANS = """
WITH c AS (SELECT c_custkey AS doc, c_custkey % 250 + 1 AS a, greatest(c_custkey % 250 + c_nationkey - 11, 1) AS b, c_custkey * 7 % 310 + 1 AS one FROM customer WHERE c_custkey % 10 > 1),
s AS (SELECT doc, least(a, b) AS lo, greatest(a, b) AS hi FROM c WHERE one <= 300 UNION ALL SELECT doc, one, one FROM c WHERE one <= 300)
SELECT DISTINCT doc, CAST(unnest(generate_series(greatest(lo - 1, 1), least(hi + 1, 300))) AS INTEGER) AS page FROM s
"""

_REPLIES = ["开头 <k>\n### 速查\n甲\n## Compact <k>\n 乙 <k> ", "题 <k>\n### 详尽分步推导\n丙 <k>\n", " 只有 <k>", "#### 【速查】\n丁"]
_VERDICTS = ["COMPLETE: yes\nISSUES: 无\nTEXT: 题 <k>\n甲", "```text\nCOMPLETE：否\nISSUES: 缺 <k>\n图\nTEXT：\n```", '"complete": "True"\nISSUES: None', "不知道 <k>"]
_PLANS = ["下边到 | 1.<k> | 末行\n上边到 | 1.9999 | x\n续下一页｜1.<k>", "没问题|1.<k>", "说明 | 1.<k>\n需要手动 | 1.<k> | a | b", "去掉续页"]


def reply_parts(spark: SparkSession, sf: str) -> DataFrame:
    """F14, F15, F16, F18."""
    parts, verdict = T.split_compact(_filled(_key(), _REPLIES, k=_n())), T.verdict(_filled(_key(), _VERDICTS, k=_n()))
    ops = F.transform(T.fix_operations(_filled(_key(), _PLANS, k=_n()), F.concat(F.lit("1."), _n())), lambda o: F.concat_ws(":", o["op"], o["arg"]))
    return table(spark, sf, _PART).select("p_partkey", parts["final"].alias("final"), parts["compact"].alias("compact"), verdict["complete"].alias("complete"), verdict["issues"].alias("issues"), verdict["text"].alias("text"), F.array_join(ops, ";").alias("ops"))


REPLY_PARTS = f"""
SELECT p_partkey, {_fill(["开头 <k>" + chr(10) + "### 速查" + chr(10) + "甲", "题 <k>" + chr(10) + "### 详尽分步推导" + chr(10) + "丙 <k>", "只有 <k>", "#### 【速查】" + chr(10) + "丁"], k=_N_SQL)} AS final,
  {_fill(["乙 <k>", "### 详尽分步推导" + chr(10) + "丙 <k>", "只有 <k>", "#### 【速查】" + chr(10) + "丁"], k=_N_SQL)} AS compact,
  {_pick([True, False, True, None])} AS complete, {_fill(["", "缺 <k>" + chr(10) + "图", "", None], k=_N_SQL)} AS issues, {_fill(["题 <k>" + chr(10) + "甲", "", "", None], k=_N_SQL)} AS text,
  {_fill(["下边到:末行;续下一页:", "没问题:", "需要手动:a", ""], k=_N_SQL)} AS ops FROM part
"""

_SOLUTIONS = ["## 习题 1.<k> 解\n\n### 题目重述\n甲 <k>\n\n### 解\n乙", "## 习题 1.<k>\n\n乙 <k>", "乙\n\n---\n\n---\n\n丙 <k>", "### 📝 题目重述：\n甲\n---\n乙"]


def shown_solutions(spark: SparkSession, sf: str) -> DataFrame:
    """F33, F34, F35, F22, F21, F25."""
    t = _filled(_key(), _SOLUTIONS, k=_n())
    problem = _filled(_key(), ["题 <k> 的文字", " 乙 <k> ", "", "新题 <k>"], k=_n())
    heads = T.exercise_headings(_filled(_key(), ["### 第 3.<k> 题\n甲", "# 第 3 题", "第 3 题", "## 第 <k>(a)  题  \n乙"], k=_n()))
    return table(spark, sf, _PART).select("p_partkey", T.collapse_solution(t).alias("bare"), T.embed_image(t, F.lit("![](p.png)")).alias("framed"), T.with_problem_text(t, problem).alias("compact"), T.normalize_headings(F.concat(t, F.lit("\n$$x$$。\\tag{2}"))).alias("chapter"), heads.alias("heads"))


def _lines(*parts: str) -> str:
    return "\n".join(parts)


SHOWN_SOLUTIONS = f"""
SELECT p_partkey, {_fill([_lines("## 习题 1.<k> 解", "", "", "", "### 解", "乙"), _lines("## 习题 1.<k>", "", "乙 <k>"), _lines("乙", "", "---", "", "丙 <k>"), _lines("---", "乙")], k=_N_SQL)} AS bare,
  {_fill([_lines("## 习题 1.<k> 解", "", "![](p.png)", "", "", "", "### 解", "乙"), _lines("## 习题 1.<k>", "", "![](p.png)", "", "---", "", "乙 <k>"), _lines("![](p.png)", "", "---", "", "乙", "", "---", "", "丙 <k>"), _lines("![](p.png)", "", "", "---", "乙")], k=_N_SQL)} AS framed,
  {_fill([_lines("## 习题 1.<k> 解", "", "### 📝 题目文本", "", "题 <k> 的文字", "", "---", "", "### 题目重述", "甲 <k>", "", "### 解", "乙"), _lines("## 习题 1.<k>", "", "乙 <k>"), _lines("乙", "", "---", "", "丙 <k>"), _lines("### 📝 题目文本", "", "新题 <k>", "", "---", "", "### 📝 题目重述：", "甲", "---", "乙")], k=_N_SQL)} AS compact,
  {_fill([_lines("#### 题目重述", "甲 <k>", "", "#### 解", "乙", ""), "", _lines("乙", "", "---", "", "---", "", "丙 <k>", ""), _lines("#### 📝 题目重述：", "甲", "---", "乙", "")], k=_N_SQL)} || '$$' || chr(10) || 'x' || chr(10) || '$$' || chr(10) || '。' || chr(10) || '\\quad \\text{{(2)}}' AS chapter,
  {_fill([_lines("## 习题 3.<k>", "甲"), "# 第 3 题", "第 3 题", _lines("## 习题 <k>(a)", "乙")], k=_N_SQL)} AS heads FROM part
"""

_TEX = ["a \\tag{<k>}", "$$x_<k>$$，y", "a $ x_<k> $ b", "x^\\mathbb{R} <k>", "a \\centernot\\implies <k> \\not\\in c", "$$x <k>$", "$x <k>$$", "![alt <k>](p.png)", '<k><div style="page-break-after: always;"></div>', "⚡<k>"]
_BRACKETS = ["a \\[ x <k> \\] b", "\\( y \\) <k>", "\\\\( z <k>", "plain <k>"]


def tex_forms(spark: SparkSession, sf: str) -> DataFrame:
    """F29, F43, F47, F30, F36, F41."""
    label = _filled(_key(), ["**(a)** x<k>", "**（b）**", "(c) **x**"], k=_n())
    name = _filled(_key(), [' a/b:<k>?"x" ', "..", "卷<k>.", "__"], k=_n())
    return table(spark, sf, _PART).select(
        "p_partkey", T.sanitize_tex(_filled(_key(), _TEX, k=_n())).alias("tex"), T.bracket_delimiters(_filled(_key(), _BRACKETS, k=_n())).alias("dollars"), T.plain_labels(label).alias("label"),
        T.degrade(_filled(_key(), ["a```b <k>"], k=_n())).alias("code"), T.file_name(name).alias("name"),
    )


TEX_FORMS = f"""
SELECT p_partkey, {_fill([chr(97) + " " + chr(92) + "quad " + chr(92) + "text{(<k>)}", _lines("$$", "x_<k>", "$$", "，", "y"), "a $x_<k>$ b", "x^{" + chr(92) + "mathbb{R}} <k>", "a " + chr(92) + "nRightarrow <k> " + chr(92) + "notin c", "$$x <k>$$", "$x <k>$", "![](p.png){width=95%}", _lines("<k>", chr(92) + "newpage", ""), "<k>"], k=_N_SQL)} AS tex,
  {_fill([_lines("a ", "$$", "x <k>", "$$", " b"), "$y$ <k>", chr(92) * 2 + "( z <k>", "plain <k>"], k=_N_SQL)} AS dollars, {_fill(["(a) x<k>", "（b）", "(c) **x**"], k=_N_SQL)} AS label,
  {_fill([_lines("```", "a'''b <k>", "```", "")], k=_N_SQL)} AS code, {_fill(["a_b_<k>_x", None, "卷<k>", None], k=_N_SQL)} AS name FROM part
"""

_FORMULAS = ["设 $，x_<k>，$ 是", "$a，b_<k>$", "$a$$b_<k>$", "有 $$a，b_<k>。$$ 所以", "$x_<k> \\tag{(1)}$", "$a　b_<k>$", "见 $速度_<k>$", "$a_<k>"]
_BARES = ["设 \\alpha_<k> 为", "x_<k> + \\beta", "(a) 求 \\frac{1}{<k>}，即 x^2.", "有 \\text{力} F_<k>", "\\$5 $x_<k>$"]
_NOISES = ["题 <k>\n![a](image_placeholder_1)\nNote: see\nthe figure <k>\n### 2\nok", "Sure <k>\nLet me see\n$$\nx\n$$", "**Note:** <k>\n\nkept", "甲 <k>"]
_ORDERS = ["### <k>\n题\n(b) 乙\n(a) 甲 $x$", "### <k>\n(a) 甲\n(c) 丙", "### <k>\n(b) 乙&emsp;&emsp;(a) 甲", "(b) <k>\n(a) 甲"]


def cleaned_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """F39, F42, F44, F45, F46, F48, F50."""
    rows = spread(table(spark, sf, _PART).select("p_partkey"), "p_partkey")
    fixed = M.applied("math", _filled(_key(), _FORMULAS, k=_n()))
    whole = M.cleaned(_filled(_key(), ["Let me see\n### 1.<k>\n设 $x，$ 且 \\alpha", "### 1.<k>\r\n(b) 乙\r\n(a) 甲\r\n", "### 1.<k>\n\n\n\nx"], k=_n()))
    return rows.select(
        "p_partkey", fixed.alias("math"), M.applied("bare", _filled(_key(), _BARES, k=_n())).alias("bare"), M.applied("noise", _filled(_key(), _NOISES, k=_n())).alias("noise"), M.applied("reorder", _filled(_key(), _ORDERS, k=_n())).alias("ordered"),
        whole["text"].alias("clean"), whole["fixes"]["math"].cast("long").alias("math_fixes"), whole["fixes"]["reorder"].cast("long").alias("reorder_fixes"),
    )


CLEANED_FORMULAS = f"""
SELECT p_partkey, {_fill(["设 ，$x_<k>$， 是", "$a$，$b_<k>$", "$a$ $b_<k>$", _lines("有", "", "$$", "a," + chr(92) + " b_<k>", "$$", "", "所以"), "$x_<k> " + chr(92) + "qquad " + chr(92) + "text{(1)}$", "$a " + chr(92) + "quad b_<k>$", "见 $" + chr(92) + "text{速度}_<k>$", "$a_<k>"], k=_N_SQL)} AS math,
  {_fill(["设 $" + chr(92) + "alpha_<k>$ 为", _lines("$$", "x_<k> + " + chr(92) + "beta", "$$"), "(a) 求 $" + chr(92) + "frac{1}{<k>}$，即 $x^2$.", "有 $" + chr(92) + "text{力} F_<k>$", chr(92) + "$5 $x_<k>$"], k=_N_SQL)} AS bare,
  {_fill([_lines("题 <k>", "### 2", "ok"), _lines("Sure <k>", "$$", "x", "$$"), _lines("", "kept"), "甲 <k>"], k=_N_SQL)} AS noise,
  {_fill([_lines("### <k>", "题", "(a) 甲 $x$", "(b) 乙", "", ""), _lines("### <k>", "(a) 甲", "(c) 丙"), _lines("### <k>", "(a) 甲", "(b) 乙", "", ""), _lines("(b) <k>", "(a) 甲")], k=_N_SQL)} AS ordered,
  {_fill([_lines("### 1.<k>", "设 $x$， 且 $" + chr(92) + "alpha$"), "### 1.<k>" + chr(13) + chr(10) + "(a) 甲" + chr(13) + chr(10) + "(b) 乙" + chr(13) + chr(10), _lines("### 1.<k>", "", "x")], k=_N_SQL)} AS clean,
  CAST({_pick([1, 0, 0])} AS BIGINT) AS math_fixes, CAST({_pick([0, 1, 0])} AS BIGINT) AS reorder_fixes FROM part
"""

_TOKENS = ["a $x$ \\$5 $$y$$ $z", "$a\n\nb$", "$$a$$ \\frac x", "\\$ plain", "$a$ $b$ $$c$$$$d$$", "x $$ y $z$"]


def formula_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """F39, F40, F49."""
    rows = table(spark, sf, _PART).select("p_partkey", _case(_key(), _TOKENS).alias("t"), F.size(T.sections(F.concat(F.lit("head\n"), F.repeat(F.lit("### 1\nx\n## 2\n"), F.col("p_size").cast("int"))))).cast("long").alias("n_sections"))
    return M.token_counts(rows.drop("n_sections"), "p_partkey", "t").join(rows.drop("t"), "p_partkey")


FORMULA_TOKENS = f"""
SELECT p_partkey, CAST({_pick([1, 0, 0, 0, 2, 0])} AS BIGINT) AS n_inline, CAST({_pick([1, 0, 1, 0, 2, 0])} AS BIGINT) AS n_disp, {_pick(["unclosed", "unclosed", "bare_command", "", "", "unclosed"])} AS problems, CAST(2 * p_size + 1 AS BIGINT) AS n_sections FROM part
"""

_PRINTS = ["### 第 1.<k> 题\n#### 详尽分步推导\n##### 小结\n甲\n---\n#### 结论 x\n乙 <k>", "## 习题 2.<k> 解\n$$\na\n+b_<k>\n$$\n已知 c", "## 习题 3.<k>\n```\n  a\n  b <k>\n\n\n\n  c\n```", "正文 <k>：\nx = 1\n(1) 甲\n(2) 乙"]


def print_forms(spark: SparkSession, sf: str) -> DataFrame:
    """F23 to F28, F31, F32."""
    line = _filled(_key(), ["**步骤 1** x", "(a) y", "正文 <k>", "- z", "① w", "<k>. v"], k=_n())
    return table(spark, sf, _PART).select("p_partkey", M.reflowed(_filled(_key(), _PRINTS, k=_n())).alias("printed"), T.is_step(line).alias("step"), T.light_clean(_filled(_key(), ["a📝<k>\n\n\n\nb \n", "<k>"], k=_n())).alias("light"), T.too_long(F.repeat(F.lit("甲"), (F.col("p_size") * 200).cast("int"))).alias("long"))


PRINT_FORMS = f"""
SELECT p_partkey, {_fill([_lines("## 习题 1.<k>", "", "**小结**", "甲", "", "**【最终结论】**", "乙 <k>", ""), _lines("## 习题 2.<k>", "", "$a +b_<k>$； 已知 c", ""), _lines("## 习题 3.<k>", "", "```text", "a", "  b <k>", "", "  c", "```", ""), _lines("正文 <k>： x = 1", "", "(1) 甲", "", "(2) 乙", "")], k=_N_SQL)} AS printed,
  {_pick([True, True, False, True, True, True])} AS step, {_fill([_lines("a<k>", "", "b", "", ""), _lines("<k>", "", "")], k=_N_SQL)} AS light, p_size > 25 AS long FROM part
"""


def probed_sections(spark: SparkSession, sf: str) -> DataFrame:
    """F32."""
    return T.probe_once(table(spark, sf, "conversations").select(F.coalesce("text", F.lit("")).alias("section")), "section").select("h")


PROBED_SECTIONS = "SELECT DISTINCT md5(coalesce(text, '')) AS h FROM conversations"


def sub_items(spark: SparkSession, sf: str) -> DataFrame:
    """F37, W14."""
    from ..operators import sequences as W

    text = _filled(_key(), ["题干 <k>\n(a) 甲\n续\n(b) 乙", "(1) <k>", "无 <k>"], k=_n())
    items = T.sub_items(table(spark, sf, _PART).select("p_partkey", text.alias("t")), "p_partkey", "t")
    merged = W.merge_neighbours(items.withColumn("row", F.floor(F.col("item") / 2)), "p_partkey", "item", "row", "text")
    return merged.select("p_partkey", F.col("line").cast("long").alias("line"), "text")


SUB_ITEMS = f"""
WITH p AS (SELECT p_partkey, {_N_SQL} AS k FROM part)
SELECT p_partkey, CAST(1 AS BIGINT) AS line, CASE p_partkey % 3 WHEN 0 THEN '题干 ' || k WHEN 1 THEN '(1) ' || k ELSE '无 ' || k END AS text FROM p
UNION ALL SELECT p_partkey, 2, '(a) 甲' || chr(10) || '续' FROM p WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 3, '(b) 乙' FROM p WHERE p_partkey % 3 = 0
"""


_QUOTED = ["甲乙丙丁戊己庚辛壬癸子丑寅卯", "0123456789012345", "ZYXWVUTSRQPONMLK", "aabbccddeeffgghh"]
_QUOTES = ["甲 乙，丙$丁$（戊）己庚辛壬癸子丑寅", "01234", "ZYX WVU。", "a", "qqqqqqqq", "aabbcc{dd}eeffgg"]


def quoted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of twenty pages, of which a quote is looked for in a part of its page."""
    p = table(spark, sf, _PART).filter("p_partkey >= 0")
    lines = spark.range(20).select(F.col("id").alias("page"), F.explode(F.array(*[F.struct(F.lit(i).alias("line"), F.lit(t).alias("text"), F.lit(10.0 * i).alias("yc")) for i, t in enumerate(_QUOTED)])).alias("l")).select("page", "l.*")
    quotes = p.select(F.col("p_partkey").alias("key"), (_key() % 20).alias("page"), _case(F.floor(_key() / 20), _QUOTES).alias("quote"), F.lit(0.0).alias("lo"), F.when(_key() % 3 == 0, 5.0).otherwise(40.0).alias("hi"))
    return M.best_line(quotes, lines, "page").select("key", "line", "text", F.round("score", 6).alias("score"))


QUOTED_LINES = f"""
SELECT key, CAST(line AS INTEGER) AS line, ({_list(_QUOTED)})[line + 1] AS text, round(2.0 * m / (m + least(m + 2, length(({_list(_QUOTED)})[line + 1]))) + 0.3, 6) AS score
FROM (SELECT p_partkey AS key, p_partkey % 3 = 0 AS first, {_pick([0, 1, 2, None, None, 3], "p_partkey // 20")} AS line, {_pick([12, 5, 6, 0, 0, 12], "p_partkey // 20")} AS m FROM part) WHERE line = 0 OR line IS NOT NULL AND NOT first
"""


def formats(spark: SparkSession, sf: str) -> DataFrame:
    """F51, F52, X2."""
    key, n = F.col("o_orderkey"), F.col("o_orderkey") % 9 + 1
    answer = T.json_in(F.concat(F.lit("说明 {\"a\": "), key, F.lit(", \"b\": [1, 2]} 完")), "a long, b array<int>")
    return table(spark, sf, "orders").select(
        "o_orderkey", T.duration(key % 7300).alias("span"), T.bar(n, F.lit(10), 10).alias("bar"), F.round(T.backoff_seconds(n, key % 2 == 0), 6).alias("wait"), T.percent_between(30, 55, n, F.lit(9)).cast("long").alias("percent"), answer["a"].alias("a"), F.size(answer["b"]).cast("long").alias("n_b"),
    )


FORMATS = """
SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS span, repeat('#', CAST(n AS INTEGER)) || repeat('-', CAST(10 - n AS INTEGER)) AS bar,
  round(CASE WHEN o_orderkey % 2 = 0 THEN least(180.0, 30.0 * n) ELSE least(45.0, 5 * pow(n, 1.5)) END, 6) AS wait, CAST(30 + floor(55 * n / 9) AS BIGINT) AS percent, o_orderkey AS a, CAST(2 AS BIGINT) AS n_b
FROM (SELECT o_orderkey, CAST(o_orderkey % 7300 AS BIGINT) AS s, CAST(o_orderkey % 9 + 1 AS BIGINT) AS n FROM orders)
"""


def book_of_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    chapters = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ch"), F.concat(F.lit("# "), "n_name").alias("text"))
    return A.book_text(chapters, "ch", "text", "\n\\newpage\n")


BOOK_OF_CHAPTERS = r"SELECT string_agg('# ' || n_name, chr(10) || '\newpage' || chr(10) ORDER BY n_nationkey) AS text FROM nation"
