"""Each operator against a plain version of its own, over whole small tables."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import assert_same
from tokenizers import Tokenizer

from pagemill.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoded(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: t.encode(r.text or "", add_special_tokens=False).ids for d, r in docs.items()}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, sf, name):
    assert_same(Q.QUERIES[name](spark, sf).toPandas(), Q.ORACLE_SQL[name], sf)


def test_op1_keeps_the_article(spark, sf):
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = Q.op1_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html or "", re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body[1] if body else "")]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_op3_round_trip(spark, sf, encoded):
    got = Q.op3_packing(spark, sf).toPandas().sort_values(["doc_id", "start"])
    assert set(got.doc_id) == set(encoded)
    for d, g in got.groupby("doc_id"):
        ids = np.array([*encoded[d], 1], "<u4")
        assert (g.doc_tokens == len(ids)).all() and g.length.sum() == len(ids)
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    q = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert (q.sum() <= 2048).all() and (q.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    sizes = q.sum()
    padded = sizes[(sizes & (sizes - 1)) != 0]
    assert (2048 - padded).sum() < 0.03 * sizes.sum()


def test_op4_targets_and_rounding(spark, sf, docs):
    got = Q.op4_mixing(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs)
    size = {d: len(WORD.findall(r.text or "")) for d, r in docs.items()}
    assert all(size[r.doc_id] == r.size for r in got.itertuples())
    totals = collections.Counter()
    for d, r in docs.items():
        totals[r.source] += size[d]
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    while True:  # shares by weight; what is too much goes round again
        left = sum(totals.values()) - sum(target[s] for s in order if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * totals[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * totals[s] for s in over}
        open_ -= over
    for s, g in got.groupby("source", dropna=False):
        s = None if s != s else s
        assert np.allclose(g.target, target[s]) and (g.source_size == totals[s]).all()
        assert abs(g.taken.sum() - target[s]) <= g["size"].max()
    assert (got.taken <= 3 * got["size"]).all()
    again = Q.op4_mixing(spark, sf).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_op5_against_all_pairs(spark, sf):
    from pyspark.sql import functions as F

    from pagemill.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(3)
    base = [np.array(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(300).collect()]
    base += [base[i % 40] + rng.normal(0, 0.06, 64) * np.linalg.norm(base[i % 40]) / 8 * (1 + i % 5) for i in range(200)]
    base += [base[7]] * 5
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>").withColumn("label", F.lit(0))
    got = near_vectors(rows).toPandas().set_index("vec_id").loc[range(len(base))]
    x = np.array(base)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert got.n_links.sum() >= 0.99 * link.sum() and (got.n_links.to_numpy() <= link.sum(1)).all()
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(1))
        if (new == comp).all():
            break
        comp = new
    assert (got.component_id.to_numpy() == comp).mean() > 0.99 and (got.kept == (got.index == got.component_id)).all()


def test_op5_tight_groups_beside_each_other(spark):
    """Groups of more vectors than a list holds fill each list from within; the links across count all the same."""
    from pagemill.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(5)
    e, far = np.eye(64), math.acos(0.93)
    middles = [e[0], math.cos(far) * e[0] + math.sin(far) * e[1], e[5]]
    x = np.concatenate([m + rng.normal(0, 0.004, (15, 64)) for m in middles])
    x = np.concatenate([x, rng.normal(0, 1, (40, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert link[:15, 15:30].all() and link[:30].sum() == 870
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").loc[range(len(x))]
    assert got.n_links.tolist() == link.sum(1).tolist()
    assert got.component_id.tolist() == [0] * 30 + [30] * 15 + list(range(45, 85)) and (got.kept == (got.index == got.component_id)).all()


def test_op5_lone_pairs_are_not_lost_beside_a_crowd(spark, monkeypatch):
    """With too few trees and rounds the audit has to notice that pairs are missing, and to find them."""
    from pagemill.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "TREES", 1)
    monkeypatch.setattr(embedding_dedup, "ROUNDS", 0)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (2500, 64))
    x[:300] = x[0] + rng.normal(0, 0.1, (300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(0, 1, (100, 64))
    side -= (side * x[300:400]).sum(1)[:, None] * x[300:400]
    x[400:500] = 0.91 * x[300:400] + math.sqrt(1 - 0.91**2) * side / np.linalg.norm(side, axis=1)[:, None]
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert link[300:500].sum() == 200
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").loc[range(len(x))]
    assert (got.n_links.to_numpy() <= link.sum(1)).all()
    assert got.n_links[300:500].sum() >= 0.97 * 200 and got.n_links[:300].sum() >= 0.99 * link[:300].sum()


def test_op6_counts(spark, sf, docs, encoded):
    for r in Q.op6_token_counts(spark, sf).collect():
        assert r.n_tokens == len(encoded[r.doc_id]) and r.n_bytes == len((docs[r.doc_id].text or "").encode()) and r.over_limit == (r.n_tokens > 512)


def test_op6_shortcut_is_proven():
    from pagemill.llm import bpe

    whole = bpe.prove_whole_tokens()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = sorted(whole)[::97]
    assert len(whole) > 40_000 and all(len(t.encode(s, add_special_tokens=False).ids) == 1 for s in some)


def test_op8_base_and_gain(spark, sf, docs):
    got = Q.op8_lm_scoring(spark, sf).toPandas().set_index("doc_id")
    words = {d: [*WORD.findall(lower(r.text)), None] for d, r in docs.items()}
    fold = {d: zlib.crc32(str(d).encode()) % 7 for d in docs}
    c = collections.Counter(w for d, ws in words.items() if fold[d] != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        r = got.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, fold[d] == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()


def interpolated(texts, probes):
    """Log10 probabilities of ``probes`` by a plain interpolated bigram model of ``texts`` (id: text), and its parts."""
    from pagemill.llm import lm_scoring

    fold = {d: zlib.crc32(str(d).encode()) % 7 for d in texts}
    words = {d: ["<start>", *WORD.findall(lower(t)), None] for d, t in texts.items()}

    def counts(ids):
        pair = collections.Counter((a, b) for d in ids for a, b in zip(words[d], words[d][1:]))
        word = collections.Counter(w for d in ids for w in words[d][1:])
        context = word + collections.Counter({"<start>": len(ids)})
        return pair, word, context

    train = [d for d in texts if fold[d] != 2]
    pair, word, context = counts([d for d in train if fold[d] != 3])
    asked, _, _ = counts([d for d in train if fold[d] == 3])
    n, keys = max(1, sum(word.values())), sorted(asked, key=str)
    c = np.array([context[a] for a, _ in keys])
    f2 = np.array([pair[k] / context[k[0]] if context[k[0]] else 0.0 for k in keys])
    cell = lambda x: 0 if x <= 0 else min(400, max(1, 400 + round(5 * math.log2(x))))
    f1 = np.array([word[b] / n for _, b in keys])
    groups = collections.defaultdict(lambda: np.zeros(3))
    for b, x2, x1, k in zip(np.minimum(31, np.ceil(np.log2(c + 1))).astype(int), f2, f1, keys):
        groups[b, cell(x2), cell(x1)] += asked[k] * np.array([1, x2, x1])
    order = sorted(groups)
    w, s2, s1 = np.array([groups[g] for g in order]).T
    lam = lm_scoring.em(np.array([g[0] for g in order]), w, s2 / w, s1 / w, 1 / (len(word) + 1))
    pair, word, context = counts(train)
    n, v = sum(word.values()), len(word)

    def p(a, b):
        m = lam[min(31, math.ceil(math.log2(context[a] + 1)))]
        return m[0] * (pair[a, b] / context[a] if context[a] else 0) + m[1] * word[b] / n + m[2] / (v + 1)

    scores = {d: sum(math.log10(p(a, b)) for a, b in zip(words[d], words[d][1:])) for d in probes}
    return scores, p, word, context


@pytest.mark.parametrize("small", [False, True])
def test_op8_score_is_the_interpolated_model(spark, sf, docs, monkeypatch, small):
    from pagemill.llm import lm_scoring

    if small:  # many blocks, long texts in parts, places that hear groups of groups of blocks
        for name, value in (("BLOCK_BYTES", 20_000), ("PART_BYTES", 700), ("PLACE_BYTES", 9_000), ("FAN", 3)):
            monkeypatch.setattr(lm_scoring, name, value)
    texts = {d: r.text for d, r in docs.items()}
    want, p, word, context = interpolated(texts, texts)
    got = {r.doc_id: r.score for r in Q.op8_lm_scoring(spark, sf).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-6) for d in want)
    for a in ["<start>", *sorted((w for w in word if w), key=lambda w: (-word[w], w))[:20]]:
        assert math.isclose(sum(p(a, b) for b in word) + p(a, "never seen"), 1, rel_tol=1e-9)


def test_op9_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = Q.op9_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.93
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())


def test_op10_against_all_pairs(spark, sf, docs):
    sets = {}
    for d, r in docs.items():
        w = WORD.findall(lower(r.text))
        sets[d] = set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for r in Q.op10_minhash_near_dedup(spark, sf).collect():
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == root(r.doc_id) and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("side", [2048, 7])
def test_op10_a_large_group_of_variants(spark, monkeypatch, side):
    """Variants that are often less similar than asked, so that many buckets hold several components; in one block or many."""
    from pagemill.llm import near_dedup as N
    from pagemill.llm.near_dedup import near_dedup

    monkeypatch.setattr(N, "SIDE", side)
    monkeypatch.setattr(N, "TOGETHER", side)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):
        w = list(base)
        for j in rng.choice(150, rng.integers(0, 9), replace=False):
            w[j] = f"x{i}y{j}"
        texts.append(" ".join(w))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    comp = list(range(300))
    changed = True
    link = [[j for j in range(300) if j != i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(300)]
    while changed:
        new = [min([comp[i], *(comp[j] for j in link[i])]) for i in range(300)]
        changed, comp = new != comp, new
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(300)] == comp


def test_op10_joining_is_exact():
    """Sets at the limit count as they are, also where they agree in the upper half of some elements."""
    from pagemill.llm.near_dedup import joining

    base = np.arange(1, 102, dtype=np.uint64) << np.uint64(33)
    twin = base[0] + np.uint64(1)  # another element with the same upper half
    a, b = np.sort(np.append(base[:88], twin)), np.sort(np.append(base[12:100], twin))
    at_limit = (np.sort(np.append(base[:75], twin)), np.sort(np.append(base[:100], twin)))  # 76 of 101
    below = (base[:74], base[:99])  # 74 of 99
    for (x, y), want in ((at_limit, ([3], [5])), (below, ([], [])), ((a, b), ([3], [5]) if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) else ([], []))):
        assert joining(np.array([5, 3]), np.array([1, 2]), np.array([2, 1]), [x, y]) == want
    assert joining(np.array([5, 3]), np.array([1, 1]), np.array([2, 1]), [base, base]) == ([], [])


def test_op5_a_bridge_between_far_clusters(spark):
    """Two clusters 40 degrees apart, each with one vector 8 degrees towards the other, which link."""
    from pagemill.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(11)
    e = np.eye(48)
    turn = lambda d: math.cos(math.radians(d)) * e[0] + math.sin(math.radians(d)) * e[1]
    x = np.concatenate([turn(0) + rng.normal(0, 0.003, (300, 48)), turn(40) + rng.normal(0, 0.003, (300, 48)), [turn(8), turn(32)]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert link[600, 601] and not link[:300, 300:600].any()
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").loc[range(len(x))]
    assert got.n_links.tolist() == link.sum(1).tolist() and (got.component_id == 0).all()


def test_runs_of_batches():
    import pyarrow as pa

    from pagemill.llm._common import runs

    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 9, 200))
    for most in (None, 1, 4, 300):
        batches, at = [], 0
        while at < 200:
            n = int(rng.integers(0, 30))
            batches.append(pa.record_batch([pa.array(keys[at : at + n]), pa.array(np.arange(200)[at : at + n])], names=["k", "v"]))
            at += n
        got = [(t["k"].to_pylist(), t["v"].to_pylist()) for t in runs(iter(batches), ["k"], most)]
        assert [v for _, x in got for v in x] == list(range(200)) and all(len(set(k)) == 1 for k, _ in got)
        sizes = [(int(k), int((keys == k).sum())) for k in np.unique(keys)]
        want = [(k, min(most or n, n - i)) for k, n in sizes for i in range(0, n, most or n)]
        assert [(k[0], len(k)) for k, _ in got] == want


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    cur = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        cur = spark.createDataFrame(stage(spark, cur, sf).collect(), docs.schema)
        kept[name] = [r.doc_id for r in cur.collect()]
        assert cur.columns == docs.columns
    text = {r.doc_id: lower(r.text) for r in docs.collect()}
    after = kept["exact_dedup"]
    assert len({text[d] for d in after}) == len(after) and {text[d] for d in after} == {text[d] for d in kept["quality_classifier"]}
    assert set(kept["minhash_near_dedup"]) <= set(after) and len(set(kept["minhash_near_dedup"])) == len(kept["minhash_near_dedup"])
    assert max(collections.Counter(kept["mixing"]).values()) <= 3
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out.doc_id) == set(kept["mixing"]) and out.groupby("sequence_id").length.sum().max() <= 2048
    assert all(len(r.ids) == r.length for r in out.itertuples())
