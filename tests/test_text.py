"""Hand-traced cases of the text functions and parsers."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import mathtext as M
from pagemill.functions import text as T
from pagemill.operators import aggregates as A
from pagemill.operators import geometry as G
from pagemill.operators import joins as J


def value(spark, expr, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(expr(F.col("t"))).collect()]


def test_anchor_candidates(spark):
    a, b, c = value(spark, T.anchor_candidates, "2.692.5节曾", "l.O3", "仿真题1-3")
    assert [tuple(x) for x in a] == [(2, 692), (2, 69), (2, 6)]
    assert [tuple(x) for x in b] == [(1, 3), (1, 0)]
    assert c == []


def test_scores(spark):
    got = value(spark, T.last_score, "【评分】：96分", "评分：80 … 评分：95", "评分：101", "没有")
    assert got == [96, 95, None, None]


def test_blanks(spark):
    a, b = value(spark, T.normalize_blanks, "________", "_____")
    assert a == r"\_" * 6 and b == "_____"


def test_damaged(spark):
    assert value(spark, J.is_damaged, "a $x$ b", "a $x b", "$$x$", r"cost \$5") == [False, True, True, False]


def test_signature(spark):
    a, b = value(spark, T.signature, "ab c", "c&emsp;ba")
    assert a == b == "abc"


def test_fences(spark):
    (a,) = value(spark, T.balance_fences, "## 习题 1\n```\nx\n```\n```\n## 习题 2\nplain")
    assert a == "## 习题 1\n```\nx\n```\n```\n```\n\n## 习题 2\nplain" == M.balanced("## 习题 1\n```\nx\n```\n```\n## 习题 2\nplain")
    assert value(spark, T.exercise_headings, "### 第 3.12(a) 题\nx", "# 第 3 题") == ["## 习题 3.12(a)\nx", "# 第 3 题"]
    assert value(spark, T.light_clean, "a\U0001f4dd\n\n\n\nb \n") == ["a\n\nb\n\n"] == [M.light("a\U0001f4dd\n\n\n\nb \n")]


def test_page_ranges(spark):
    d = spark.createDataFrame([(1, "习题页：第1章 23-27；第2章 58"), (2, "习题页：全部"), (3, "习题页：30-25")], "doc int, t string")
    pages = lambda total, pad, doc: sorted(r.page for r in T.page_ranges(d, "doc", "t", total, pad).filter(F.col("doc") == doc).collect())
    assert pages(100, 1, 1) == [*range(22, 29), 57, 58, 59]
    assert pages(40, 1, 1) == []
    assert pages(100, 1, 2) == []
    assert pages(100, 0, 3) == [*range(25, 31)]


def test_import_parsing(spark):
    texts = [
        (1, '### 1.1\nab\n### 1.1\na'),
        (2, "### 1.1\n" + "x" * 9 + "\n### 1.1\nxx\n### 1.1\nyyy"),
        (3, "### 1.1\nab\n### 1.1\ncd"),
        (4, "front\n3.07 body\n有图题号：3.7\nmore\n\n\n\nend\n---"),
        (5, "### 2.1\n\n### 2.2\nz"),
    ]
    got = {(r.doc, r.problem_id): (r.body, r.duplicated) for r in T.parse_import(spark.createDataFrame(texts, "doc int, text string")).collect()}
    assert got == {(1, "1.1"): ("ab", True), (2, "1.1"): ("yyy", True), (3, "1.1"): ("cd", True), (4, "3.7"): ("body\nmore\n\nend", False), (5, "2.2"): ("z", False)}


def test_figure_list(spark):
    assert value(spark, T.figure_list, "a\n有图题号：3.16、3.022、3.16\nb") == [["3.16", "3.22"]]


def test_check_replies(spark):
    for reply in ("1.1 | OK\n1.1 | 截断 | x\n9.9 | 截断", "1.1 | 截断 | x\n1.1 | OK"):
        rows = T.check_reply(spark.createDataFrame([(1, reply)], "page int, reply string"), spark.createDataFrame([("1.1",)], "problem_id string")).collect()
        assert [(r.problem_id, r.ok, [tuple(p) for p in r.problems]) for r in rows] == [("1.1", False, [("截断", "x")])]
    miss = T.missing_reports(spark.createDataFrame([(1, "漏题 | 1.2 | 缺")], "page int, reply string")).collect()
    assert [(r.pid, r.detail) for r in miss] == [("1.2", "缺")]


def test_verdict(spark):
    (v, none) = value(spark, T.verdict, "COMPLETE: yes\nISSUES: 无\nTEXT: a\nb", "nothing")
    assert tuple(v) == (True, "", "a\nb") and none is None


def test_split_compact(spark):
    a, b = value(spark, T.split_compact, "x\n### 速查\ny\n### Compact\nz", "p\n### 详尽分步推导\nq")
    assert tuple(a) == ("x\n### 速查\ny", "z") and tuple(b) == ("p\n### 详尽分步推导\nq", "### 详尽分步推导\nq")


def test_strip_leading_id(spark):
    d = spark.createDataFrame([("习题3.9 3-9题. 求解", "3.9"), ("3.91 x", "3.9")], "t string, p string")
    assert [r[0] for r in d.select(T.strip_leading_id(F.col("t"), F.col("p"))).collect()] == ["求解", "3.91 x"]


def test_fix_operations(spark):
    (ops,) = value(spark, lambda t: T.fix_operations(t, F.lit("1.1")), "下边到 | 1.1 | 末行\n上边到 | 1.2 | x\n续下一页｜1.1")
    assert [tuple(o) for o in ops] == [("下边到", "末行"), ("续下一页", "")]


def test_embed_and_collapse(spark):
    text = "## 习题 1.1\n\n### 题目重述\nabc\n\n### 解\nx"
    assert value(spark, T.collapse_solution, text)[0] == "## 习题 1.1\n\n\n\n### 解\nx".replace("\n\n\n\n", "\n\n\n\n")
    assert "IMG" in value(spark, lambda t: T.embed_image(t, F.lit("IMG")), text)[0] and "题目重述" not in value(spark, lambda t: T.embed_image(t, F.lit("IMG")), text)[0]


def test_durations(spark):
    d = spark.createDataFrame([(75.0,), (3700.0,)], "s double")
    assert [r[0] for r in d.select(T.duration(F.col("s"))).collect()] == ["1:15", "1:01:40"]


def test_math_tokens():
    assert M.tokens(r"a $x$ \$5 $$y$$ $z") == [("text", "a "), ("inline", "x"), ("text", r" \$5 "), ("display", "y"), ("text", " "), ("open", "$"), ("text", "z")]
    assert M.tokens("a $$b $c$") == [("text", "a "), ("open", "$$b $c$")]
    assert M.tokens("$a\n\nb$")[0][0] == "open"


def test_reorder_keeps_characters():
    src = "### 1.1\nstem\n(b) two\nmore\n(a) one $x$"
    out = M.reorder(src)
    assert out == "### 1.1\nstem\n(a) one $x$\n(b) two\nmore\n\n"
    for same in ("(b) x\n(a) y", "### 1\n(a) x\n(c) y", "### 1\n(a) x\n(b) y", "### 1\n(b) x $\n(a) y", "### 1\n(b) x\n\nbetween\n(a) y"):
        assert M.reorder(same) == same
    assert M.reorder("### 1\n(b) p&emsp;&emsp;(a) q") == "### 1\n(a) q\n(b) p\n\n"


def test_cleaner():
    text, fixes = M.clean("Let's see what this is.\nIt is all English words here.\n- 列表\n\n好的\n### 1.1\n设 $x，$ 且 \\frac{a}{b}")
    assert text == "好的\n### 1.1\n设 $x$， 且 $\\frac{a}{b}$" or text == "\n好的\n### 1.1\n设 $x$， 且 $\\frac{a}{b}$"
    assert fixes["noise"] == fixes["math"] == fixes["bare"] == 1 and not fixes["reorder"]
    assert M.clean("### 1.2\r\nx\r\n", ids=True)[0] == "### 1.2 {#q1-2}\r\nx\r\n"


def test_noise():
    assert M.strip_noise("题 1\n![a](image_placeholder_1)\nNote: see\nthe figure\n### 2\nok") == "题 1\n### 2\nok"
    assert M.strip_noise("Sure, fine\nLet me see\n$$\nx\n$$") == "Sure, fine\n$$\nx\n$$"
    assert M.strip_noise("**Note:** x\n\nkept") == "\nkept"


def test_han_in_formulas():
    assert M.wrap_han(r"x = 速度 \text{已知 {a} 的} y度") == r"x = \text{速度} \text{已知 {a} 的} y\text{度}"
    assert M.wrap_han(r"\text{没有关") == r"\text{没有关"


@pytest.mark.parametrize(
    ("src", "want"),
    [
        ("设 $，x，$ 是", "设 ，$x$， 是"),
        ("$a，b$", "$a$，$b$"),
        ("$a$$b$", "$a$ $b$"),
        ("有 $$a，b。$$ 所以", "有\n\n$$\na,\\ b\n$$\n\n所以"),
        (r"$x \tag{(1)}$", r"$x \qquad \text{(1)}$"),
        ("$a\u3000b$", r"$a \quad b$"),
        (r"见 $\begin{cases}a\end{cases}$", "见\n\n$$\n\\begin{cases}a\\end{cases}\n$$\n\n"),
        ("$a", "$a"),
    ],
)
def test_formulas(src, want):
    assert M.fix_math(src) == want


@pytest.mark.parametrize(
    ("src", "want"),
    [
        (r"设 \alpha 为", r"设 $\alpha$ 为"),
        (r"x_1 + \beta", "$$\nx_1 + \\beta\n$$"),
        ("\\begin{aligned}\na\n\\end{aligned}", "$$\n\\begin{aligned}\na\n\\end{aligned}\n$$"),
        (r"(a) 求 \frac{1}{2}，即 x^2.", r"(a) 求 $\frac{1}{2}$，即 $x^2$."),
        (r"有 \text{力} F_1", r"有 $\text{力} F_1$"),
        (r"\$5 $x$", r"\$5 $x$"),
    ],
)
def test_bare_formulas(src, want):
    assert M.fix_bare(src) == want


def test_line_merge():
    lines = ["解：", "x = 1", "已知 a", "**步骤 1**", "令", "b", "- $x[0] = 1$", "- $x[1] = 2$", "| a |", "| b |", "证毕。"]
    assert M.merge_lines(lines) == ["解： x = 1； 已知 a", "**步骤 1**： 令", "b", "- $x[0] = 1$", "- $x[1] = 2$", "", "| a |", "| b |", "证毕。"]
    assert M.merge_lines(["短", "句", "两式相同。"]) == ["短； 句； 两式相同。"]
    assert M.merge_lines(["甲" * 1201, "已知"]) == ["甲" * 1201, "已知"] and M.merge_lines(["甲" * 40, "乙"]) == ["甲" * 40, "乙"]


def test_print_form():
    src = "# old\n\n### 第 1.2 题\n#### 详尽分步推导\n##### 小结\n$$\na\n+b\n$$\n---\n#### 结论 x\n```\n  a\n  b\n```\n"
    out = M.print_form(src, chapter=1, title="书")
    assert out.startswith("# 书 - 第 1 章") and "## 习题 1.2" in out and "$a +b$" in out and "详尽" not in out and "**【最终结论】**" in out and "```text\na\n  b\n```" in out.replace("\n  b", "\n  b") or "```text" in out
    assert M.balanced("## 习题 1\n```\nx\n## 习题 2\ny") == "## 习题 1\n```\nx\n```\n\n## 习题 2\ny"


def test_tex(spark):
    cases = {
        "a \\tag{1}": "a \\quad \\text{(1)}",
        "$$x$$，y": "$$\nx\n$$\n，\ny",
        "a $ x $ b": "a $x$ b",
        "x^\\mathbb{R}": "x^{\\mathbb{R}}",
        "a \\centernot\\implies b \\not\\in c": "a \\nRightarrow b \\notin c",
        "$$x$": "$$x$$",
        "$x$$": "$x$",
        "![alt](p.png)": "![](p.png){width=95%}",
        'a<div style="page-break-after: always;"></div>': "a\n\\newpage\n",
        "⚡x": "x",
    }
    assert value(spark, T.sanitize_tex, *cases) == list(cases.values())
    assert value(spark, T.latex_safe, "$$" + "x" * 5000 + "$$。") == ["$$\n" + "x" * 5000 + "\n$$\n。\n"]
    assert value(spark, T.bracket_delimiters, "a \\[ x \\] b \\( y \\) \\\\( z", "\\[" + "x" * 5000 + "\\]") == ["a \n$$\nx\n$$\n b $y$ \\\\( z", "\n$$\n" + "x" * 5000 + "\n$$\n"]


def test_sources(spark):
    d = spark.createDataFrame([(s, "a text of length", None) for s in ("imported", "imported_check", "verified", "text_layer", "ocr")], "s string, t string, f boolean").withColumn("f", F.col("s") == "ocr")
    got = {r.s: (r.done, r.plain, r.read) for r in d.select("s", J.already_verified(F.col("s"), F.col("t")).alias("done"), J.text_only(F.col("s"), F.col("f")).alias("plain"), J.needs_transcription(F.col("s"), F.col("t")).alias("read")).collect()}
    assert got == {"imported": (True, True, False), "imported_check": (False, True, False), "verified": (True, False, False), "text_layer": (False, False, False), "ocr": (False, False, True)}
    problems = spark.createDataFrame([(1, p, "old", s) for p, s in (("a", "imported"), ("b", "imported_check"), ("c", "ocr"), ("d", "ocr"), ("e", "ocr"))], "chapter int, problem_id string, text string, text_source string")
    verdicts = spark.createDataFrame([(1, "a", "new", True), (1, "b", "new", True), (1, "c", "new", False), (1, "d", "", True)], "chapter int, problem_id string, text string, text_ok boolean")
    got = {r.problem_id: (r.text, r.text_source) for r in J.write_back(problems, verdicts).collect()}
    assert got == {"a": ("new", "imported"), "b": ("new", "verified"), "c": ("old", "ocr"), "d": ("old", "ocr"), "e": ("old", "ocr")}


def test_line_kinds(spark):
    rows = [("习题 参考 答案", "stop"), ("本题附答案", None), ("题解", "stop"), ("第 3 章 信号", "opener"), ("习 题", "heading"), ("习题1-1 求解", None), ("4.7 Exercises", "heading"), ("§2.3 习题", "heading"), ("直接计算，并验证你的答案。", None), ("正文", None)]
    d = spark.createDataFrame([(i, t, 30.0, 20.0, 200.0, 1000.0) for i, (t, _) in enumerate(rows)], "i int, text string, height double, m double, y0 double, page_height double")
    got = [r.k for r in d.select("i", J.line_kind(F.col("text"), F.col("height"), F.col("m"), F.col("y0"), F.col("page_height")).alias("k")).orderBy("i").collect()]
    assert got == [k for _, k in rows]
    lines = [(1, "仿真题 1", None, 10.0, 50.0), (1, "思考题", None, 20.0, 50.0), (1, "第1章", "opener", 30.0, 50.0), (1, "习题二则", "heading", 40.0, 50.0), (1, "参考答案", "stop", 50.0, 500.0)]
    got = J.terminators(spark.createDataFrame(lines, "page int, text string, kind string, y0 double, x0 double").withColumn("W", F.lit(800.0))).collect()
    assert [(r.page, r.rows) for r in got] == [(1, [10.0, 20.0, 30.0])]


def test_reflow_guard():
    row = "| " + "甲" * 6000 + " |"
    src = "## 习题 1.1\n" + row + "\n\n\n\nx\n## 习题 1.2\n" + "\n".join(["已知" + "甲" * 40] * 200) + "\n```\na  b\n```\n"
    out = M.print_form(src)
    first, second = out.split("## 习题 1.2")
    assert first == "## 习题 1.1\n" + row + "\n\nx\n\n" and max(map(len, second.split("\n"))) <= 5000 and "```text\na  b\n```" in second


def test_similarity():
    assert M.similarity("abcdef", "abcdefgh") > 1 and M.similarity("a", "a") == 0 and M.similarity("abcd", "wxyz") == 0


def test_mask_owner_ties(spark):
    boxes = spark.createDataFrame([(0, 1, 0, 0, 10, 10), (1, 1, 10, 0, 20, 10)], "box int, page int, bx0 int, by0 int, bx1 int, by1 int")
    masks = spark.createDataFrame([(0, 1, 5, 0, 15, 10), (1, 1, 20, 0, 30, 10)], "mask int, page int, mx0 int, my0 int, mx1 int, my1 int")
    assert sorted((r.mask, r.owner) for r in J.mask_owner(masks, boxes).collect()) == [(0, 0), (1, -1)]


def test_nearest_ties(spark):
    p = spark.createDataFrame([(1, 50)], "key int, at int")
    s = spark.createDataFrame([(40, 3), (60, 9)], "sample int, off int")
    assert [(r["sample"], r["off"]) for r in J.nearest(p, s, "key", "at", "sample", "off").collect()] == [(40, 3)]


def test_best_segments(spark):
    def best(first, second):
        rows = [(1, 1, 5, i) for i in range(first)] + [(1, 2, 2, i) for i in range(second)]
        d = spark.createDataFrame(rows, "ch int, seg int, page int, y int")
        return [(r.seg, r.n) for r in A.best_segments(d, "ch", "seg", ["page", "y"]).collect()]

    assert best(10, 7) == [(2, 7)] and best(10, 5) == [(1, 10)] and best(2, 1) == [(1, 2)]


def test_import_keys_partition(spark):
    t, c = (spark.createDataFrame([(x,) for x in xs], "key int") for xs in ((1, 2, 2, 3), (2, 4)))
    got = {r.key: r.status for r in J.reconcile(t, c, "key").collect()}
    assert got == {1: "missing_in_crop", 2: "matched", 3: "missing_in_crop", 4: "missing_in_text"}


def test_usage_rounds_half_to_even(spark):
    d = spark.createDataFrame([("draft", "a", 2), ("final", "b", 3)], "stage string, pid string, total long")
    assert [tuple(r) for r in A.usage_summary(d).collect()] == [(5, 2, 2)]


def test_estimate(spark):
    d = spark.createDataFrame([(1 + i % 3,) for i in range(7)], "page int")
    assert A.check_estimate(d).first()["tokens"] == 15_500


def test_revert(spark):
    b = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "problem_id string, boxes string")
    n = spark.createDataFrame([("a", "new"), ("b", "new")], "problem_id string, boxes string")
    v = spark.createDataFrame([("a", True), ("b", False)], "problem_id string, ok boolean")
    assert {r.problem_id: (r.boxes, r.status) for r in G.keep_or_revert(b, n, v).collect()} == {"a": ("new", "fixed"), "b": ("old", "reverted"), "c": ("old", "unchanged")}


def test_box_operations(spark):
    ops = "array<struct<op:string,y:int>>"
    d = spark.createDataFrame([("p", [(1, 100, 200, 0, 50)], [("下边到", 300), ("上边到", 130), ("续下一页", None), ("去掉续页", None), ("下边到", 400)], 500, 1000)], f"problem_id string, boxes array<{G.BOX}>, ops {ops}, next_top int, page_height int")
    assert [tuple(b) for b in G.apply_operations(d).first()["boxes"]] == [(1, 100, 408, 0, 50)]


@pytest.mark.parametrize(("scores", "want"), [([90, 94, 94], (2, "needs_review", "rewritten")), ([90, 96], (2, "passed", "draft_passed")), ([90, 96, 99], (2, "passed", "draft_passed")), ([None] * 3, (1, "unreviewed", "rewritten")), ([None, 0], (1, "unreviewed", "rewritten"))])
def test_best_round(spark, scores, want):
    from pagemill.operators.sequences import best_round

    d = spark.createDataFrame([("p", i + 1, s) for i, s in enumerate(scores)], "key string, round int, score int")
    r = G.gate(best_round(d, ["key"], "round", "score")).first()
    assert (r.best_round, r.status, r.final_mode) == want


def test_page_mapping(spark):
    samples = spark.createDataFrame([(40, 45), (60, 69), (3, 90)], "printed int, pdf int")
    ranges = spark.createDataFrame([(1, 50, 60)], "seq int, start int, end int").withColumn("end", F.lit(None).cast("int"))
    got = sorted(r.page for r in G.page_mapping(samples, ranges, 200).collect())
    assert got == [*range(51, 64)]


def test_header_and_footer_bands(spark):
    rows = [
        (1, "2.19 a problem", 20, 40, 50, 700), (1, "text", 500, 520, 50, 700), (1, "42", 880, 890, 300, 320), (1, "- 17 -", 960, 970, 300, 350),
        (2, "A header", 20, 40, 50, 700), (2, "/ 120 /", 900, 910, 300, 360), (2, "text", 940, 950, 50, 700),
        (3, "习题6-21 x", 60, 80, 50, 700), (3, "1/2/3", 870, 880, 50, 700), (3, "xiv", 950, 960, 300, 320),
        (4, "text", 500, 520, 50, 700), (4, "a note", 850, 860, 50, 700),
        (5, "text", 500, 520, 50, 700), (5, "3.1 a problem", 850, 860, 50, 700),
    ]
    lines = spark.createDataFrame(rows, "page int, text string, y0 int, y1 int, x0 int, x1 int").withColumn("H", F.lit(1000.0)).withColumn("W", F.lit(800.0))
    rules = spark.createDataFrame([(3, 130.0, 50.0, 700.0), (4, 800.0, 50.0, 250.0), (4, 760.0, 50.0, 700.0), (4, 400.0, 50.0, 250.0), (5, 800.0, 50.0, 250.0)], "page int, y double, x0 double, x1 double").withColumn("H", F.lit(1000.0))
    assert {r.page: r.header_cut for r in J.header_cut(lines, rules).collect()} == {1: 0, 2: 44, 3: 56, 4: 0, 5: 0}
    assert {r.page: r.header_cut for r in J.header_cut(lines, rules, has_headers=False).collect()} == {1: 0, 2: 0, 3: 56, 4: 0, 5: 0}
    assert {r.page: r.footer_cut for r in J.footer_cut(lines).collect()} == {1: 957, 2: 897, 3: 947, 4: 970, 5: 970}
    assert {r.page: r.footer_cut for r in J.footer_cut(lines, rules=rules).collect()} == {1: 957, 2: 897, 3: 947, 4: 796, 5: 970}
