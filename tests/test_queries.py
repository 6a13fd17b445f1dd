import difflib
import re

import pytest
from compare import assert_same

from pagemill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf).toPandas(), registry.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["chapter", "n_items", "n_distinct", "last_index", "missing", "duplicated"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_similarity_top1_against_all_pairs(spark, sf):
    """The query compares a name with the types of its first letter; of equal scores the line with the least hash wins."""
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", "upper(p_name) AS name", "upper(p_type) AS type", "xxhash64(upper(p_type)) AS line").collect()
    form = lambda s: re.sub(r"[\s$\\{}^_、，。,.:：；;（）()\[\]【】]", "", s)
    types = {(r.line, r.type) for r in rows}
    want = {}
    for r in rows:
        found = []
        for line, text in types:
            q = form(r.name)[:12]
            t = form(text)[: len(q) + 2]
            if r.name[:1] == text[:1]:
                score = difflib.SequenceMatcher(None, q, t).ratio() + 0.3 * t.startswith(q[:4]) if len(q) > 1 and t else 0.0
                found.append((-score, line, text))
        if found and -min(found)[0] >= 0.55:
            want[r.p_partkey] = (min(found)[2], pytest.approx(-min(found)[0], abs=1e-6))
    got = registry.QUERIES["similarity_top1"](spark, sf).collect()
    assert want and len(got) == len(want) and {r.key: (r.best, r.score) for r in got} == want


def test_math_tokens_against_a_pattern(spark, sf):
    part = re.compile(r"(?s)\\.|(?P<display>\$\$(?:\\.|(?!\$\$)[^\\])*\$\$)|(?P<inline>\$(?!\$)(?:\\.|[^\\$])*\$)|(?P<open>\$)")
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = "" if r.text is None else r.text + (" $a+b$ and $$c$$ \\$5" if r.doc_id % 2 == 0 else " $x")
        n, plain, at, problems = {"inline": 0, "display": 0}, [""], 0, []
        for m in part.finditer(text):
            plain[-1] += text[at : m.start()]
            at = m.end()
            if m["open"] or m["inline"] and "\n\n" in m[0]:
                problems, at = ["unclosed"], len(text)
                break
            if m.lastgroup:
                n[m.lastgroup] += 1
                plain.append("")
            else:
                plain[-1] += m[0]
        plain[-1] += text[at:]
        if any(re.search(r"\\(?:frac|sqrt|sum|int|alpha|beta|omega)\b", x) for x in plain):
            problems.append("bare_command")
        want[r.doc_id] = (n["inline"], n["display"], ",".join(problems))
    got = registry.QUERIES["math_tokens"](spark, sf).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_inline, r.n_disp, r.problems) for r in got} == want
