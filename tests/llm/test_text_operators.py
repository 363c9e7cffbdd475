"""Classifiers on held-out rows, language, decontamination, mixing and HTML: accuracy, brute force, awkward rows."""

import random
import time

import numpy as np
import pytest
from corpus import edited, frame, prose
from pyspark.sql import functions as F

from skycadence.llm import catalog, html_tree, language_id, mixing, quality, toxicity
from skycadence.llm.decontamination import Benchmark, contaminated, decontaminated, edits, word_hashes

AWKWARD = [None, "", " \n", "7 !", "é", "x" * 200_000, "x" * 200_000]


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, score double")


@pytest.mark.parametrize("name, label, floor", [("op4_cnn_toxicity", "toxic", 0.97), ("op7_rule_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, floor):
    sf = "/root/testdata/sf0.1"
    found = catalog.QUERIES[name](spark, sf)
    right = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").agg(
        F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("share"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert right.share >= floor and 0 <= right.low <= right.high <= 1
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = catalog.QUERIES["op6_bitmask_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert found.where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifier_awkward_rows(spark, operator):
    rng = random.Random(1)
    texts = AWKWARD + [prose(rng, 40) + (" vile vile vile" if k % 2 else "") + ("!!! " * 30 if k % 2 else "") for k in range(200)]
    ids = [None, 1, 1, *range(3, len(texts))]
    docs = frame(spark, texts, ids=ids)
    labels = labels_frame(spark, [(i, k % 2, k % 2, "t", 0.0) for k, i in enumerate(ids) if k > 6] + [(None, 1, 1, "", 0.0), (3, None, None, "", 0.0)])
    got = operator(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    again = {(r.doc_id, k): r for k, r in enumerate(sorted(operator(docs.repartition(5), labels).collect(), key=lambda r: (str(r.doc_id), r.score)))}
    for k, r in enumerate(sorted(got, key=lambda r: (str(r.doc_id), r.score))):
        assert again[r.doc_id, k].predicted == r.predicted and abs(again[r.doc_id, k].score - r.score) < 0.05
    none = operator(docs, labels.where("false")).collect()
    assert len(none) == len(texts) and {r.score for r in none} == {0.0}
    assert operator(frame(spark, []), labels).count() == 0


def test_toxic_rows_go_and_columns_stay(spark):
    texts = [prose(random.Random(k), 30) + (" vile" if k % 2 else "") for k in range(300)] + [None]
    docs = frame(spark, texts)
    left = toxicity.without_toxic(docs, labels_frame(spark, [(k, 1, k % 2, "", 0.0) for k in range(200)]))
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {k for k in range(301) if k % 2 == 0}


def test_word_windows_do_not_cross_documents():
    """Scores of a slice of documents equal the scores of each document alone."""
    import pyarrow as pa
    from skycadence.llm import textkit as tk
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 30)) + (" vile" if k % 2 else "") for k in range(60)]
    model = toxicity.fit(pa.array(texts), np.arange(60) % 2, ["en", "de"] * 30)
    whole = model.scores(*toxicity.word_ids(*tk.utf8(pa.array(texts))))
    alone = [model.scores(*toxicity.word_ids(*tk.utf8(pa.array([t]))))[0] for t in texts]
    assert np.allclose(whole, alone, atol=1e-5)


def test_rules_as_columns_equal_rules_in_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.7)).astype(float)
    made = quality.fit(x, y)
    z = made.base + sum(w * quality.holds(r, x) for r, w in zip(made.rules, made.weights))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], ["k", *quality.STATISTICS])
    got = {r.k: r.s for r in df.select("k", made.score().alias("s")).collect()}
    assert np.allclose([got[k] for k in range(400)], 1 / (1 + np.exp(-z)))
    assert 0 < len(made.rules) < 200 and ((np.array([got[k] for k in range(400)]) > 0.5) == y).mean() > 0.97


def test_language_awkward_rows(spark):
    rng = random.Random(2)
    pools = {"en": ["the", "with", "house", "tion"], "de": ["der", "und", "schön", "keit"], "xx": ["кот", "дом", "мир"]}
    langs = [rng.choice(list(pools)) for _ in range(150)]
    texts = AWKWARD + [" ".join(rng.choices(pools[x], k=12)) for x in langs]
    docs = frame(spark, texts, langs=[None] * len(AWKWARD) + langs, ids=[None, *range(1, len(texts))])
    got = language_id.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (None, 1, 2, 3)] == ["und"] * 4 and by[4].lang_pred != "und"
    assert all(by[k + len(AWKWARD)].lang_pred == x for k, x in enumerate(langs)) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(frame(spark, [])).count() == 0


def test_more_languages_than_one_mask_holds():
    rng = random.Random(5)
    names = [f"l{k:03d}" for k in range(70)]
    pools = {x: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(30)] for x in names}
    text = lambda x: " ".join(rng.choices(pools[x], k=25))
    rows = [(text(x), x) for x in names for _ in range(4)]
    filters = language_id.fit([t for t, _ in rows], [x for _, x in rows])
    best, score = filters.predict([text(x).encode() for x in names])
    assert [filters.names[k] for k in best] == names and len(filters.planes) == 2


# decontamination

def nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def benchmark_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string, edits string")


def test_decontamination_brute_force(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.randrange(5, 60), 3000) for _ in range(40)]
    texts = AWKWARD[:5] + ["x " * 30_000]
    for k in range(150):
        item = rng.choice(items)
        n = len(item.split())
        near = edited(rng, item, rng.randrange(0, int(0.3 * n) + 2))
        texts.append(" ".join([prose(rng, rng.randrange(40), 3000), near.upper() if k % 3 == 0 else near.replace(" ", ", "), prose(rng, rng.randrange(40), 3000)]))
    docs = frame(spark, texts, ids=[None, *range(1, len(texts))])
    got = {(r.doc_id, r.item_id): r.edits for r in contaminated(docs, benchmark_frame(spark, [
        *((k, t, "d", "e") for k, t in enumerate(items)), (None, items[0], "", ""), (90, None, "", ""), (91, "", "", ""), (92, " - ", "", "")])).collect()}
    want = {}
    for i, t in enumerate(texts):
        words = (t or "").lower().replace(",", " ").split() if i > 5 else []
        for k, item in enumerate(items):
            d = nearest(item.split(), words)
            if d <= edits(len(item.split()), 0.8):
                want[i, k] = d
    assert len(want) > 60 and got == want


def test_decontamination_recall_on_planted_passages():
    """Every passage with the largest number of edits that counts is found in long clean text, at 99 % at least."""
    rng = random.Random(7)
    items = [prose(rng, rng.randrange(14, 60), 5000) for _ in range(100)]
    held, found = Benchmark(list(enumerate(items)), 0.8), 0
    for k, item in enumerate(items):
        n = len(item.split())
        text = " ".join([prose(rng, 300, 5000), edited(rng, item, edits(n, 0.8)), prose(rng, 300, 5000)]).encode()
        buf = np.frombuffer(text, np.uint8)
        found += any(m[1] == k for m in held.matches(*word_hashes(buf, np.array([0, len(text)]))))
    assert found >= 99


@pytest.mark.parametrize("kind", ["deleted", "inserted", "mixed"])
def test_decontamination_finds_all_edits_of_long_items(kind):
    """Insertions and deletions at the bound, in items of up to 320 words: every one is found, with a right count."""
    rng = random.Random(9)
    items = [prose(rng, n, 5000) for n in (5, 7, 8, 15, 60, 80, 160, 320) for _ in range(5)]
    held = Benchmark(list(enumerate(items)), 0.8)
    for k, item in enumerate(items):
        words = item.split()
        most = edits(len(words), 0.8)
        for e in range(most):
            at = rng.randrange(len(words))
            if kind == "deleted" or kind == "mixed" and e % 2:
                del words[at]
            else:
                words.insert(at, f"new{e}")
        text = " ".join([prose(rng, 300, 5000), *words, prose(rng, 300, 5000)]).encode()
        got = {m[1]: m[2] for m in held.matches(*word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)])))}
        assert k in got and got[k] <= most


def test_decontaminated_keeps_clean_rows(spark):
    rng = random.Random(8)
    item = prose(rng, 20)
    docs = frame(spark, [item, prose(rng, 50), None, "", item + " more"], ids=[1, 2, 3, None, None])
    left = decontaminated(docs, benchmark_frame(spark, [(1, item, "", "")]))
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "None", "None"]
    for empty in (contaminated(docs, benchmark_frame(spark, [])), contaminated(frame(spark, []), benchmark_frame(spark, [(1, item, "", "")]))):
        assert empty.count() == 0


# mixing

def test_mixture_reaches_its_weights(spark):
    rng = random.Random(9)
    sources = [rng.choice(["hot"] * 6 + ["src1", "src2", None, "other"]) for _ in range(6000)]
    docs = frame(spark, [prose(rng, 10) for _ in sources], sources=sources)
    mixed = mixing.mix(docs, {"hot": 1, "src1": 5, "src2": 2, "absent": 9, mixing.REST: 2})
    mass = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.octet_length("text"))).collect()}
    total = sum(mass.values())
    assert abs(total / docs.agg(F.sum(F.octet_length("text"))).first()[0] - 1) < 0.05
    assert abs(mass["hot"] / total - 0.1) < 0.02 and abs(mass["src1"] / total - 0.5) < 0.03
    one = mixed.select("doc_id", "copy").distinct().count()
    assert one == mixed.count() == mixed.where("copy BETWEEN 1 AND repeats").count()


def test_mixture_counts_are_poisson(spark):
    """Counts follow the distribution at a small rate and at one that takes several pieces."""
    docs = frame(spark, ["t"] * 4000, sources=["small"] * 3900 + ["big"] * 100)
    mixed = mixing.mix(docs, {"small": 1, "big": 3})
    big = [r.n for r in mixed.where("source = 'big'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert abs(np.mean(big) - 30) < 2.5 and 15 < np.var(big) < 50
    zero = 3900 - mixed.where("source = 'small'").select("doc_id").distinct().count()
    assert abs(zero / 3900 - np.exp(-4000 / 4 / 3900)) < 0.03


def test_mixture_awkward_rows(spark):
    docs = frame(spark, AWKWARD, ids=[None, 1, 1, 2, 3, 4, 5], sources=[None, "src1", "src1", "", "src0", None, "src0"])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns + ["copy", "repeats", "rate"]
    first = sorted(map(str, mixed.select("doc_id", "copy", "repeats").collect()))
    assert first == sorted(map(str, mixing.mix(docs.repartition(3)).select("doc_id", "copy", "repeats").collect()))
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mix(docs, {"nobody": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": -1})


# HTML

ARTICLE = "<h1>The &amp; title</h1><p>First <b>bold</b> part&nbsp;here,\n with   space. A second sentence follows, and a third one. </p><p>Next<br>line. It goes on for a while, too.<ul><li>One item, long enough to read.<li>Two items.</ul>"
WANT = "The & title First bold part here, with space. A second sentence follows, and a third one. Next line. It goes on for a while, too. One item, long enough to read. Two items."
PAGES = {
    "article": f"<body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; us</footer>",
    "class names": f"<div class='site-header'><a href=/>Logo</a></div><div class=\"post-content\">{ARTICLE}</div><div class=sidebar><h3>More</h3><p>Aside text.</p></div>",
    "comments inside": f"<main>{ARTICLE}<section class='comments'><h3>Comments</h3><div class=comment><p>I liked this, thanks.</p></div></section></main>",
    "ad inside": f"<article>{ARTICLE}<div class=ad>Buy this now.</div><script>var a = '<p>no</p>';</script><form><p>Name</p><input></form></article>",
    "cookie notice": f"<div id='cookie-notice'><p>We use cookies, as all do.</p></div><!-- <p>hidden</p> --><article>{ARTICLE}</article></body></html>",
}


@pytest.fixture(scope="module")
def model():
    return html_tree.fit([html_tree.labelled(x) for x in html_tree.drawn_pages()])


@pytest.mark.parametrize("name", PAGES)
def test_main_text(model, name):
    assert html_tree.main_text(PAGES[name], model) == WANT


def test_marginals_equal_enumeration(model):
    """Sum-product on a small tree against the sum over all labellings."""
    import itertools
    import math
    nodes, runs = html_tree.parse("<div><p>some words here, yes.<b>x</b></p><ul><li>a</li></ul></div>")
    feats = html_tree.features(nodes, runs)
    own = [sum(model.unary.get(f, 0) for f in fs) for fs in feats]
    total, ones = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(o for o, y in zip(own, labels) if y) + sum(
            model.pair[html_tree._kind(nodes[k])][2 * labels[nodes[k].parent] + labels[k]] for k in range(1, len(nodes))))
        total += w
        ones = [a + w * y for a, y in zip(ones, labels)]
    got, pairs = model.marginals(nodes, feats)
    assert np.allclose(got, [x / total for x in ones]) and all(abs(sum(p) - 1) < 1e-9 for p in pairs[1:])


def test_drawn_pages_not_fitted_on(model):
    rng = random.Random(77)
    right = total = 0
    for _ in range(100):
        nodes, feats, labels = html_tree.labelled(html_tree._layout(rng))
        found, _ = model.marginals(nodes, feats)
        right += sum((p >= 0.5) == y for p, y in zip(found, labels))
        total += len(labels)
    assert right / total > 0.98


def test_pages_of_the_table(spark):
    """On pages that mark their article, the text is the article's."""
    import html
    import re
    sf = "/root/testdata/sf0.01"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = catalog.QUERIES["op10_dom_marginals"](spark, sf).collect()
    assert len(got) == len(source)
    for r in got:
        inside = re.search("<article>(.*)</article>", source[r.page_id], re.S)[1]
        text = re.sub("<[^>]*>", lambda x: "" if x[0] in ("<b>", "</b>") else " ", inside)
        assert r.text == " ".join(html.unescape(text).split()) and r.n_chars == len(r.text)


def test_pages_awkward_rows(spark):
    pages = spark.createDataFrame([
        (1, "u", None, "t", 0), (1, None, "", "t", 0), (None, "u", "<p", "t", 0), (4, "u", "</p></div>plain", "t", 0),
        (5, "u", "<article><p>" + "word. " * 50_000 + "</p></article>", "t", 0), (6, "u", "<div>" * 3000 + "deep", "t", 0),
        (7, "u", "<article><p>a &lt;b&gt; &#233; &bogus; end.</p></article>", "t", 0)], "page_id long, url string, html string, text string, n_chars int")
    got = html_tree.extract(pages).collect()
    by = {r.page_id: r for r in got if r.page_id not in (1, None)}
    assert len(got) == 7 and by[5].n_chars == 299_999 and by[7].text == "a <b> é &bogus; end."
    assert [r.text for r in got if r.page_id == 1] == ["", ""]
    assert html_tree.extract(pages.where("false")).count() == 0


BROKEN = {"tags without an end": "<a " * 1_400_000, "quotes without an end": '<p x="' * 700_000, "comments without an end": "<!-- " * 800_000,
          "other tags closed": "<b>" * 600_000 + "</i>" * 500_000, "closed behind a cell": "<i><td>" + "<b>" * 500_000 + "</i>" * 400_000,
          "rules inside": "<b>" * 500_000 + "<hr>" * 400_000, "one long attribute": "<a " + "x" * 4_000_000 + ">", "mixed quotes": "<a '\" " * 600_000,
          "nested tables": "<table>" * 200_000 + "<tr><td>" * 200_000}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_long_broken_pages_are_read_in_one_pass(name):
    start = time.process_time()
    nodes, _ = html_tree.parse(BROKEN[name])
    assert nodes and time.process_time() - start < 20  # about 4 MB; 7 s at most here


def test_broken_pages_have_a_text(model):
    for text in ["<p>one, two. " * 20_000, "<b>" * 20_000 + "words here, yes. " + "</i>" * 20_000, '<p x="' * 20_000]:
        start = time.process_time()
        assert isinstance(html_tree.main_text(text, model), str) and time.process_time() - start < 20
