"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat_format, embedding_dedup, exact_dedup, html_extraction, lm_scoring, mixing, near_dedup, packing, quality, token_counts

LONG = "lorem ipsum dolor sit amet. " * 20_000
ROWS = [(1, "a b c d e f", "s"), (2, None, "s"), (3, "", None), (4, "A b c d e f", "t"), (4, "A b c d e f", "t"), (None, "x", "s"), (5, LONG, "t"), (6, " \t\n ", "s"), (7, "<|endoftext|> 　é\x1c  b", "t"), (8, LONG + "tail", "t")]
SCHEMA = "doc_id long, text string, source string"
CLASH = ["id", "t", "b", "n", "name", "rid", "score", "size", "taken", "u", "block", "fold", "label", "key", "cid", "n_tokens", "kept"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (9, None), (None, 1)], "doc_id long, quality int")


def operators(labels):
    return {
        "pack": packing.pack,
        "mix": mixing.mix,
        "tokens": token_counts.token_counts,
        "exact": exact_dedup.exact_dedup,
        "lm": lm_scoring.lm_scores,
        "quality": lambda d: quality.classify(d, labels),
        "near": near_dedup.near_dedup,
    }


@pytest.mark.parametrize("name", ["pack", "mix", "tokens", "exact", "lm", "quality", "near"])
def test_rows_and_columns(spark, labels, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    op = operators(labels)[name]
    plain = op(docs).toPandas()
    clash = docs
    for c in CLASH:
        clash = clash.withColumn(c, F.lit("clash"))
    assert sorted(op(clash).columns) == sorted(plain.columns)
    assert len(op(clash).toPandas()) == len(plain)
    if name != "pack":
        assert len(plain) == len(ROWS)
    empty = op(spark.createDataFrame([], SCHEMA))
    assert empty.columns == list(plain.columns) and empty.count() == 0


#: Names that the helpers use for columns of their own.
TAKEN = ["_id", "_source", "_size", "_copies", "_words", "_at", "_copy", "_kept_id", "_kept_sha", "_sha", "_rest", "_place", "_score", "_SHA_"]


def test_rows_that_stay_keep_their_columns(spark, labels):
    plain = spark.createDataFrame(ROWS, SCHEMA)
    docs = plain
    for c in TAKEN:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce("source", F.lit("-"))))
    empty = docs.limit(0)
    for keep, want in ((exact_dedup.drop_exact_duplicates, 7), (near_dedup.keep_first, 7), (lambda d: quality.drop_rejected(d, labels), None), (mixing.apply_mix, None)):
        out = keep(docs)
        got = out.collect()
        assert got and out.columns == docs.columns and all(r[c] == c + (r.source or "-") for r in got for c in TAKEN)
        assert want is None or len({(r.doc_id, r.text) for r in got}) == want
        out = keep(empty)
        assert out.columns == docs.columns and out.count() == 0
        if keep is exact_dedup.drop_exact_duplicates:
            assert sorted((r.doc_id or -1) for r in got) == [-1, 3, 4, 5, 6, 7, 8]  # of the two rows with id 4 and one text, one
        if keep is near_dedup.keep_first:
            assert {r.doc_id for r in got} == {1, 2, 3, 5, 6, 7, None}  # 4 is 1's copy, 8 is 5's
        if keep is mixing.apply_mix:
            assert {r.doc_id for r in got} <= {1, 4, 5, 7, 8, None}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.count() > 0
        if name != "packing":
            assert got.columns == corpus_pipeline.COLUMNS
        none = stage(spark, docs.limit(0).withColumn("_sha", F.lit(1)).withColumn("id", F.lit(2)), str(tmp_path))
        assert none.columns == got.columns and none.count() == 0


def test_quality_learns_from_both_labels_of_repeated_ids(spark):
    """As many rows as the sample takes, of both labels, where each id has several texts."""
    good, bad = "the of and to in a is that for it was with be by on not he his " * 4, "zx qq 12 !! ## kk vv " * 6
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + str(k)) for i in range(120) for k in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample=100)
    scores = model.score(quality.statistics([good + "1", bad + "1"]))
    assert scores[0] > 0.9 and scores[1] < 0.1


def test_quality_model_against_a_walk(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, len(quality.NAMES)))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    probe = rng.normal(size=(50, len(quality.NAMES)))

    def walk(row):
        margin = model.prior
        for feature, threshold, leaves in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += leaves[node - len(feature)]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(model.score(probe), [walk(r) for r in probe])


def test_exact(spark):
    got = exact_dedup.exact_dedup(spark.createDataFrame(ROWS, SCHEMA), block_bytes=64, hot=3).toPandas()
    assert got.kept.sum() == 7  # one of a..f, one empty, x, two long ones, the blank and the special
    g = {(r.keep_id, r.group_size) for r in got.itertuples() if r.doc_id in (1, 4)}
    assert g == {(4.0, 3)} and {r.keep_id for r in got.itertuples() if r.doc_id in (2, 3)} == {3.0}


def test_exact_hot_blocks(spark):
    texts = ["x" * 300] * 40 + ["x" * 300 + str(i % 7) for i in range(40)] + ["y" * 64 + "x" * 236] * 3
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.exact_dedup(d, block_bytes=64, hot=5).toPandas().set_index("doc_id")
    want = {t: max(i for i, x in enumerate(texts) if x == t) for t in texts}
    assert [got.keep_id[i] for i in range(len(texts))] == [want[t] for t in texts]
    assert [got.group_size[i] for i in range(len(texts))] == [texts.count(t) for t in texts]


def test_near_edges(spark):
    got = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got[2, 0].component_id == 2 and got[6, 0].component_id == 6 and got[4, 2].component_id == 1
    assert {r.component_id for r in got.values() if r.doc_id in (5, 8)} == {5}


def test_pack_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    got = packing.pack(docs, window=64).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 64
    assert got[got.doc_id == 2].length.tolist() == [1]
    no_stop = packing.pack(spark.createDataFrame([(1, "word " * 3000)], "doc_id long, text string")).toPandas()
    assert no_stop.length.sum() == no_stop.doc_tokens.iloc[0]


def stream(lengths, stops, window):
    ends = np.cumsum(lengths)
    return packing.boundaries(int(ends[-1]), ends, np.concatenate([s + e - n for s, e, n in zip(stops, ends, lengths, strict=True)]), window)


def test_pack_prefers_document_ends():
    at, cost = stream([1000, 1040, 2048, 8], [np.array([500]), np.array([900]), np.array([], int), np.array([], int)], 2048)
    assert packing.windows(at, cost) == [2040, 4088, 4096]


def test_pack_is_optimal():
    """Against the cost that the docstring states, over all pairs of boundaries."""
    rng = np.random.default_rng(0)
    short = 0
    for turn in range(60):
        window = 64
        lengths = rng.integers(1, (40, 200)[turn % 2], 8).tolist()
        at, cost = stream(lengths, [np.unique(rng.integers(1, n + 1, 3)) for n in lengths], window)
        p = at.tolist()

        def price(size):
            return min(window - size, packing.SHORT if size & (size - 1) == 0 else window)

        best = [0.0] + [float("inf")] * (len(p) - 1)
        for j in range(1, len(p)):
            best[j] = min(best[i] + price(p[j] - p[i]) for i in range(j) if p[j] - p[i] <= window) + cost[j]
        cuts = packing.best_cuts(at, cost, window)
        sizes = [p[j] - p[i] for i, j in zip([0, *cuts], cuts, strict=False)]
        short += sum(packing.SHORT < window - x and x & (x - 1) == 0 for x in sizes)
        assert sum(map(price, sizes)) + sum(cost[j] for j in cuts) == best[-1]
    assert short  # powers of two below half a window are used


def test_slices_encode_as_the_whole(monkeypatch):
    from pagemill.llm import bpe

    monkeypatch.setattr(bpe, "SLICE", 50)
    e, whole_tokens = bpe.encoder(), bpe.prove_whole_tokens()
    for text in ("one two  three.\n\n four " * 40, "x" * 400, "中文 字  和 mixed　text, é ü <|endoftext|> 1234 " * 20, " " * 300, "a\t\tb\r\n" * 90):
        parts = list(bpe.slices(text))
        assert "".join(parts) == text and (len(parts) > 1) == bool(re.search(r"\S\s", text[50:]))
        whole = e.exact.encode(text, add_special_tokens=False).ids
        assert np.concatenate([e.array(p) for p in parts]).tolist() == whole == e.array(text).tolist()
        assert sum(sum(bpe.Counts(e, whole_tokens).of(bpe.PIECE.findall(p))) for p in parts) == len(whole)


def test_pack_in_segments(spark, monkeypatch):
    """Documents longer than a segment, and segments that end inside them, give whole documents all the same."""
    import zlib

    from pagemill.llm import bpe

    monkeypatch.setattr(packing, "SEGMENT", 3000)
    texts = ["a few words. " * 30, "", "no stop at all " * 4000, "one two three. " * 3000, "long beyond a slice. " * 60_000, "x", "é — ü. " * 2000] * 2
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), window=256, with_ids=True).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= 256 and sorted(sizes.index) == list(range(len(sizes)))
    want = [[*bpe.encoder().exact.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for d, g in got.sort_values("start").groupby("doc_id"):
        ids = np.concatenate(g.ids.to_list())
        assert ids.tolist() == want[d] and (g.doc_tokens == len(ids)).all() and g.start.tolist() == [0, *g.length.cumsum()][:-1]
        assert [zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in g.ids] == g.ids_crc32.tolist()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()][:-1]


def test_mix_repeats(spark):
    rows = [(1, "a b c", "s")] * 7 + [(2, "d e", "s"), (3, "f " * 40, "t"), (4, "", "u")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 10 and (got.taken <= 3 * got["size"]).all() and got[got.source == "u"].target.tolist() == [0.0]
    out = mixing.apply_mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(out) == (got.taken[got["size"] > 0] / got["size"][got["size"] > 0]).sum()


def test_mix_expectation(spark):
    """Over many seeds a document is taken as often as its source's ratio says."""
    rows = [(i, "w " * (3 + i % 5), "s" if i % 3 else "t") for i in range(60)]
    d = spark.createDataFrame(rows, SCHEMA)
    runs = [mixing.mix(d, seed=s).toPandas().set_index("doc_id") for s in range(12)]
    share = sum(r.copies for r in runs) / len(runs)
    ratio = runs[0].target / runs[0].source_size
    for s, g in ratio.groupby(runs[0].source):
        assert abs(share[g.index].mean() - g.iloc[0]) < 0.08


def test_embeddings_edges(spark):
    e = [1.0, 0.0]
    rows = [(1, e), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [2.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, []), (9, e), (None, e), (10, [1e-300, 0.0]), (11, [float("inf"), 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == (4, 1) and got[9] == (4, 1) and got[10] == (4, 1) and got[6] == (4, 1) and got[None][0] == 4
    assert all(got[i] == (0, i) for i in (2, 3, 4, 5, 7, 8, 11))
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_saturated_lists(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=32)
    rows = [(i, [float(x) for x in c + rng.normal(size=32) * 0.05]) for i in range(600)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert (got.n_links == 599).all() and (got.component_id == 0).all() and got.kept.sum() == 1


PAGES = {
    "<p>The of and to in it was <b>bold &amp; &lt;x&gt;</b> that is for the reader of this long page, and more of it.</p><div class='ad'>Buy</div>": "The of and to in it was bold & <x> that is for the reader of this long page, and more of it.",
    "<nav><p>Menu</p></nav><main><h1>T&eacute;st</h1><p>one\n two&nbsp;three</p><ul><li>a<li>b</ul></main><footer>f</footer>": "Tést\none two three\na\nb",
    "<article><p>x<script>if (a<b) '</p>'</script>y<!-- c --><style>p{}</style></p><form><input><p>f</p></form><aside>s</aside></article><div id=comments><p>c</p></div>": "xy",
    "": "",
    "<html><body></body></html>": "",
    "<p": "",
    "plain < text": "plain < text",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_extraction.main_text(page) == PAGES[page]


FIRST = "The first paragraph, and it's long: the of and to in a is that for it was with be by on not he his but."
TAGS = {
    f'<img alt="Queen\'s speech"><p>{FIRST}</p>': FIRST,
    f"<p data-json='{{\"a\": \"{'x > y ' * 2000}\"}}'>{FIRST}</p>": FIRST,
    f'<p title="a > b" data-x=\'c > "d\' lang=en>{FIRST}</p>': FIRST,
    f"<p title=it's>{FIRST}</p>": FIRST,
    f'<p title="never closed>{FIRST}</p>': FIRST,
    f"<p/ a = 'b>' c><br/>{FIRST}</p >": FIRST,
}


@pytest.mark.parametrize("page", TAGS, ids=range(len(TAGS)))
def test_quotes_in_tags(page):
    assert html_extraction.main_text(page) == TAGS[page]


LINE = "It was for the reader of this that the words were put in, and they are not to be lost by it at all."
KEPT = [
    f'<p>The of <a href="/hidden-gems?id=ads">these gems</a> {LINE}</p>',
    f'<p title="a hidden truth" data-hidden="false" data-class="ad">{LINE}</p>',
    *(f'<div class="{c}"><p>{LINE}</p></div>' for c in ("content has-sidebar", "no-sidebar", "overflow-hidden", "post-header", "legal-news")),
    f'<div class="widget"><h2>The title</h2><p>{LINE} {LINE} {LINE}</p><p>{LINE}</p></div>',
    f'<div class="widget"><p>{"長い文章です。" * 60}</p><p>短い文。</p></div>',
]


@pytest.mark.parametrize("page", KEPT, ids=range(len(KEPT)))
def test_names_do_not_drop_an_article(page):
    lines = re.split(r"</(?:p|h2)>", page)
    assert html_extraction.main_text(page) == "\n".join(x for x in (re.sub("<[^>]*>", "", line) for line in lines) if x)


def test_named_boxes_stay_out():
    around = "<p>" + LINE + "</p>"
    for box in ('<div class="cookie-banner">We use it.</div>', '<div id="navMenu2"><p>To the shop</p></div>', "<p hidden>" + LINE + "</p>", '<div class="x related">' + "<p>And more of the same.</p>" * 9 + "</div>", '<div role="dialog">' + around + "</div>"):
        assert html_extraction.main_text(around + box + around) == LINE + "\n" + LINE
        assert html_extraction.main_text("<article>" + around + box + "</article>") == LINE
    assert html_extraction.main_text(f'<p>{LINE} <span class="share">Share <b>it</b></span>and so on</p><p>{LINE}</p>') == f"{LINE} and so on\n{LINE}"


def test_comments_stay_out():
    long = " ".join([LINE] * 4)
    article = f"<article><h1>Title</h1><p>{LINE}</p></article>"
    for box in (f'<article class="comment"><p>{long}</p></article>', f'<div class="comments"><article><p>{long}</p></article></div>', f'<section id="comments-area"><p>{long}</p><p>{long}</p></section>', f'<li class="comment-12"><p>{long}</p></li>', f'<div itemprop="comment"><p>{long}</p></div>'):
        assert html_extraction.main_text(article + box) == f"Title\n{LINE}"
        assert html_extraction.main_text(f"<main>{article}{box}</main>") == f"Title\n{LINE}"
    assert html_extraction.main_text(f'<div class="comments-enabled"><p>{LINE}</p></div>') == LINE


def test_shapes_of_articles():
    assert html_extraction.main_text(f"<div><script>x</script><p>{LINE}</p></div><script>y</script><p>{LINE}</p>") == f"{LINE}\n{LINE}"
    for wrapper in ('class="container with-sidebar"', 'id="page" class="no-header"'):
        assert html_extraction.main_text(f"<div {wrapper}><h1>Title</h1><p>{LINE}</p><p>{LINE}</p></div>") == f"Title\n{LINE}\n{LINE}"
    assert html_extraction.main_text(f'<article class="post"><div class="entry-header"><h1>Title</h1></div><p>{LINE}</p></article>') == f"Title\n{LINE}"
    for opening, nxt in (('<p class="ad">', "<p>"), ("<p hidden>", "<p>"), ("<p hidden>", "<div>"), ('<li class="ad">', "<li>"), ("<li hidden>", "<li>")):
        assert html_extraction.main_text(f"<div>{opening}Buy now{nxt}{LINE}{nxt}{LINE}</div>") == f"{LINE}\n{LINE}"


def test_unclosed_tags_cost_no_more_each(spark):
    import time

    def seconds(n):
        began = time.process_time()
        html_extraction.main_text("<div>" * n + "x" + "</i>" * n)
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.005)


def test_no_pages(spark):
    out = html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 0


def test_page_rows(spark):
    d = spark.createDataFrame([(1, "u", None), (None, None, "<p>x</p>"), (2, "v", "<p>" + LONG + "</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(d).collect()}
    assert got[1] == ("", 0) and got[2][1] == len(LONG.strip())


def test_chat(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "x"), (2, 0, "system", "alone"), (None, 0, "ann", "lost")]
    seg = chat_format.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    whole = {r.perspective: r for r in chat_format.assembled(seg).collect()}
    assert set(whole) == {"ann", "bob", "unknown"} and seg.count() == 15
    a = whole["ann"]
    assert a.text.startswith("<|im_start|>user name=unknown\nx<|im_end|>\n<|im_start|>system\nbe good<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n")
    assert [a.text[s["from"] : s["to"]] for s in a.spans] == ["hi < |im_end|><|im_end|>\n"]
    assert chat_format.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_and_vectors_with_clashing_columns(spark):
    turns = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, "bob", "ho"), (1, 1, "bob", "ho")], "conv_id long, turn long, role string, text string")
    clash = turns
    for c in ("conv", "speaker", "perspective", "segment", "start", "as_role", "body", "mask_from"):
        clash = clash.withColumn(c, F.lit("clash"))
    want = sorted(map(str, chat_format.perspectives(turns).collect()))
    assert sorted(map(str, chat_format.perspectives(clash).collect())) == want and len(want) == 6
    seg = chat_format.perspectives(turns).withColumns({"p": F.lit(1), "text": F.lit("clash"), "spans": F.lit(2)})
    assert {r.perspective: len(r.spans) for r in chat_format.assembled(seg).collect()} == {"ann": 1, "bob": 2}
    assert chat_format.assembled(seg.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    for c in ("id", "raw", "dim", "cid", "v", "m", "rep", "label", "n", "a", "b", "sim", "node"):
        vectors = vectors.withColumn(c, F.lit("clash"))
    assert sorted(map(tuple, embedding_dedup.near_vectors(vectors).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_chat_long(spark):
    rows = [(1, i, ("ann", "bob")[i % 2], "m" * (i % 13)) for i in range(1500)]
    seg = chat_format.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    a = {r.perspective: r for r in chat_format.assembled(seg).collect()}["bob"]
    last = seg.filter("perspective = 'bob'").orderBy(F.desc("start")).first()
    assert a.text[last.start :] == last.segment and len(a.spans) == 750


def test_lm_without_training(spark):
    got = lm_scoring.lm_scores(spark.createDataFrame([(i, "a b") for i in range(30)], "doc_id long, text string").filter("crc32(cast(doc_id as string)) % 7 = 2")).toPandas()
    assert len(got) and (got.train_tokens == 0).all() and np.allclose(got.score, 0) and np.allclose(got.base_score, 0)


def test_words_and_shingles():
    from pagemill.llm import shingles, wordhash

    texts = ["Aa bB\x0bcc", None, "", "a" * 5000 + " b", "aa bb cc"]
    h, n = wordhash.words(texts)
    assert n.tolist() == [3, 0, 0, 2, 3] and (h[:3] == h[-3:]).all() and len(set(h.tolist())) == 5
    long = "w1 w2 w3 " * 200_000
    assert wordhash.words([long])[1].tolist() == [600_000]
    _, sizes = shingles.shingle_sets(["a b c d e f", "a b", "", "a a a a a a a"])
    assert sizes.tolist() == [2, 1, 0, 1]


def test_own_text_beside_blank_rows(spark):
    """Rows that share an id, of which the last in a batch are blank."""
    from pagemill.llm import wordhash
    from pagemill.llm.shingles import shingle_sets

    text = "one two three four five six seven"
    elements, sizes = shingle_sets([text])
    f1 = int(wordhash.mix(elements).sum().view(np.int64))
    rows = [(1, int(sizes[0]), f1, 0, t) for t in (" ", text, "", None)]
    found = spark.createDataFrame(rows, "cid long, n long, f1 long, f2 long, t string").coalesce(1)
    assert [tuple(r) for r in near_dedup._own_text(found).collect()] == [(1, text)]
    assert near_dedup._own_text(found.filter("trim(t) = '' or t is null")).count() == 0


def test_scratch_tables_go(spark):
    import os

    from pagemill.llm import _common

    _common.clear_scratch(spark)
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a" * 9000), (2, "b"), (3, "a" * 9000)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.keep_id) for r in got.collect()) == [(1, 3), (2, 2), (3, 3)]
    bases = [b.removeprefix("file://") for b in _common._made]
    assert bases and all(set(os.listdir(b)) <= {"rows", "groups"} for b in bases if os.path.isdir(b))
    _common.clear_scratch(spark)
    assert not any(os.path.isdir(b) for b in bases)
