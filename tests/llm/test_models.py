"""Held-out accuracy of the classifiers, and main-text extraction against a plain reading of the pages."""

import html
import re
import zlib

import numpy as np
import pytest

from tests.llm.util import odd_docs

SF = "/root/testdata/sf0.01"


def test_language(spark):
    from wayfarer.llm.queries import op1_language_id

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op1_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in own]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.01


def test_language_brute_force(spark):
    """Every text's language and score, by loops over n-grams and centroids, from the fitted numbers."""
    import math

    from wayfarer.llm.langid import DIM, UNKNOWN, fit_on_documents, identify

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_on_documents(docs, fit_rows=40)
    assert len(model.langs) > len(set(model.langs)) > 1  # several centroids each

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2**64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def brute(text):
        letters = re.sub(r"_+", "_", "".join(c if c.isalpha() else "_" for c in f"{text or ''} ".lower())).lstrip("_")
        code = [0 if c == "_" else ord(c) for c in letters]
        counts = {}
        for n in (1, 2, 3):
            for k in range(len(code) - n + 1):
                h = n
                for c in code[k : k + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                counts[mixed(h) >> 52] = counts.get(mixed(h) >> 52, 0) + 1
        if not any(code):
            return UNKNOWN, 0.0
        v = {t: math.log1p(n) * float(model.idf[t]) for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[t]) for t, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        return model.langs[best], cos[best]

    assert DIM == 1 << 12
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 20_000}
    for r in identify(docs, model).collect():
        if r["doc_id"] in rows:
            lang, score = brute(rows[r["doc_id"]])
            assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(min(1, max(0, score)), abs=1e-4))


def test_machine_brute_force():
    """A logit is the sum over all terms and over all pairs of terms."""
    import itertools

    import pyarrow as pa

    from wayfarer.llm.toxicity import BITS, Machine, features

    rng = np.random.default_rng(5)
    m = Machine(-0.3, *(rng.normal(0, 0.1, shape).astype(np.float32) for shape in (1 << BITS, (1 << BITS, 3))), 0.7, rng.normal(0, 0.1, (1 << BITS, 3)).astype(np.float32))
    column = pa.array(["one two three two", "", None, "a", "You, YOU and you; a b c d e f g", "x " * 500 + "long " + " ".join(map(str, range(300)))])
    term, count = features(column)
    got, at = m.logits(term, count), np.cumsum(count) - count
    assert count.tolist()[:4] == [3, 0, 0, 1]
    for k, n in enumerate(count.tolist()):
        t = term[at[k] : at[k] + n]
        pairs = sum(float(m.factors[i].astype(float) @ m.factors[j]) + float(m.weak[i].astype(float) @ m.weak[j]) / n for i, j in itertools.combinations(t, 2))
        assert got[k] == pytest.approx(-0.3 + sum(float(m.weights[i]) for i in t) + 0.7 * pairs, abs=1e-3)


def test_language_odd(spark):
    from pyspark.sql import functions as F

    from wayfarer.llm.langid import fit, identify

    train = spark.createDataFrame([(1, "the cat and the dog and the house", "en"), (2, "der hund und die katze und das haus", "de"), (3, None, "fr"), (4, "ein text ohne sprache", None)], "doc_id long, text string, lang string")
    rows = {(r["doc_id"], r["lang_pred"]) for r in identify(odd_docs(spark), fit(train)).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (9, "und"), (10, "und")} <= rows
    assert (12, "en") in rows
    none = identify(odd_docs(spark), fit(train.where(F.lit(False)))).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in none} == {("und", 0.0, True)}
    assert identify(odd_docs(spark, []), fit(train)).collect() == []


def test_language_rejects(spark):
    from wayfarer.llm.langid import fit_on_documents

    model = fit_on_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    lang, score, away = model.predict(["привет как дела сегодня вечером у тебя все хорошо " * 8, "the of and that was for the thing on her and with"])
    assert away.tolist() == [True, False]
    assert lang[1] == "en"


def test_pairs_count():
    """Neither of two terms alone tells the class; only their pair does."""
    import pyarrow as pa

    from wayfarer.llm.toxicity import features, fit

    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(300)]
    texts, labels, both = [], [], []
    for _ in range(3600):
        insult, group = rng.random(2) < 0.3
        texts.append(" ".join([*rng.choice(words, 8), *["vile"] * bool(insult), *["people"] * bool(group)]))
        labels.append(int(insult == group))  # additive weights put texts with both on the wrong side of those with one
        both.append(bool(insult and group))
    z = fit(texts[:3000], np.array(labels[:3000]), np.ones(3000)).logits(*features(pa.array(texts[3000:])))
    y, pair = np.array(labels[3000:]), np.array(both[3000:])
    assert np.mean(z[pair][:, None] > z[y == 0][None, :]) > 0.85


@pytest.mark.parametrize("rate", [0.02, 0.05, 0.2])
@pytest.mark.parametrize("seed", [0, 1])
def test_rare_pairs_count(seed, rate):
    """Toxic texts hold two terms together, clean ones hold each apart, in that share of either class: neither frequency nor signal tells of them."""
    import pyarrow as pa

    from wayfarer.llm.toxicity import features, fit

    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)]
    labels = (rng.random(8000) < 0.5).astype(int)
    vile, group = rng.random((2, 8000)) < rate
    group = np.where(labels == 1, vile, group)
    texts = [" ".join([*rng.choice(words, 8), *["vile"] * int(a), *["people"] * int(b)]) for a, b in zip(vile, group, strict=True)]
    z = fit(texts[:5000], labels[:5000], np.ones(5000)).logits(*features(pa.array(texts[5000:])))
    both, one = (vile & group)[5000:] & (labels[5000:] == 1), (vile ^ group)[5000:]
    assert np.mean(z[both][:, None] > z[one][None, :]) > 0.95
    assert np.mean(z[both][:, None] > z[labels[5000:] == 0][None, :]) > 0.9


def test_toxicity_odd(spark):
    from wayfarer.llm.toxicity import fit_on_labels, toxicity

    docs = odd_docs(spark)
    none = fit_on_labels(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(round(r["score"], 4), r["predicted"]) for r in toxicity(docs, none).collect()} == {(0.001, 0)}
    some = fit_on_labels(docs, spark.createDataFrame([(1, 1, 0), (4, None, 1), (5, 0, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int"))
    rows = toxicity(docs, some).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity(odd_docs(spark, []), some).collect() == []


def test_fits_on_bounded_samples(spark):
    """An id on very many rows gives one text, and very long texts none."""
    from wayfarer.llm.langid import fit as fit_languages
    from wayfarer.llm.toxicity import fit_on_labels, toxicity

    rows = [(k, f"the cat and the {k}", "en") for k in range(30)] + [(k, f"der hund und die {k}", "de") for k in range(30, 60)]
    more = rows + [(5, f"row number {k}", "en") for k in range(3000)] + [(31, "x" * 60_000, "de")]
    schema = "doc_id long, text string, lang string"
    model = fit_languages(spark.createDataFrame(more, schema), centroids=2)
    assert sorted(set(model.langs)) == ["de", "en"]
    assert model.predict(["the cat and the dog", "der hund und die katze"])[0] == ["en", "de"]
    labels = spark.createDataFrame([(k, 1, int(k >= 30)) for k in range(60)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(more, schema)
    score = {r["doc_id"]: r["score"] for r in toxicity(docs, fit_on_labels(docs, labels)).collect()}
    assert score[40] > 0.5 > score[10]


def test_toxicity_held_out(spark):
    """The small tables have 300 labelled texts to learn from; sf0.1 has ten times as many."""
    from wayfarer.llm.queries import op7_toxicity

    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(truth[r["doc_id"]], r["predicted"]) for r in op7_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p for t, p in own if t == 1]) > 0.9
    assert np.mean([p for t, p in own if t == 0]) < 0.01


def plain(page):
    m = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page)
    inner = re.sub(r"<[^>]*$", "", re.sub(r"<br>", " ", m[1]))
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_extraction(spark):
    from wayfarer.llm.queries import op9_html_extraction

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op9_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], plain(pages[r["page_id"]]["html"]), len(r["text"]))


PAGES = [
    ('<div class="wrapper menu-open"><article><p>Body one two three.</p></article></div>', "Body one two three."), ('<article><p title="' + ">" * 9 + '">kept</article>', "kept"), ("<article><p title='a > b'>kept", "kept"),
    ("<div class=ad>Advert</div><article><h1>A title of this page</h1><p>" + "many words of text " * 9 + "</article>", "A title of this page\n" + ("many words of text " * 9).strip()),
    (None, ""), ("", ""), ("no tags", ""), ("<p", ""), ("<article><p>a &lt; b &am", "a < b &am"), ("<article><p>one<br>two&nbsp;\n three</p><!-- <p>no</p> --><p>x > y <i>z", "one two three\nx > y z"),
    ("<body><nav><a href=x>Home</a></nav><main><h1>T</h1><p>Body text.</p><aside>Aside</aside><div class='comments'><p>Nice one!</p></div></main><footer>f</footer>", "T\nBody text."),
    ('<article><p title="a > b">kept</p><form><p>mail</p></form><script>var a="</p>";</script><div class="ad">buy</div><ul><li><a href="/r">Related</a></li></ul></article>', "kept"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    from wayfarer.llm.extraction import main_text

    assert main_text(page) == text


LONG, LAST = "the river rose for three days before anyone thought to move the boats away from it " * 3, "it fell by sunday"
ARTICLE = [
    "<article class='post tag-politics'><h1>T</h1><p>{0}</p><p>{1}</p></article>", "<main class='content has-sidebar'><h1>T</h1><p>{0}</p><p>{1}</p></main>", "<main class='sidebar'><h1>T</h1><p>{0}</p><p>{1}</p></main>",
    "<article><div class='entry-header'><h1>T</h1></div><p>{0}</p><p>{1}</p></article>", "<div class='layout sidebar'><article><h1>T</h1><p>{0}</p><p>{1}</p></article></div>",
    "<nav><a href=x>Home</a></nav><div class='single-post comments-open'><h1>T</h1><p>{0}</p><p>{1}</p><p>{0}</p></div><footer>f</footer>",
    "<article class='post'><h1>T</h1><p>{0}</p><p>{1}</p><div class='share-buttons'>Share</div><ol class='comment-list'><li>so very true</li></ol></article><div class='comments'><article><p>{0}</p></article></div>",
]


@pytest.mark.parametrize("page", ARTICLE)
def test_marked_articles(page):
    """A furniture word in a class, or in a part of one, doesn't make an article furniture."""
    from wayfarer.llm.extraction import main_text

    found = main_text(page.format(LONG, LAST)).split("\n")
    assert found == ["T", LONG.strip(), LAST] + ([LONG.strip()] if "comments-open" in page else [])


def test_without_article_tags():
    """Nothing but the blocks' lengths and links, and their neighbours', tells the text from what stands around it."""
    from wayfarer.llm.extraction import main_text

    menu = "<div><a href=/>Home</a> <a href=/n>News</a></div>"
    body = "<div><h1>How the boats were moved</h1><p>{0}</p><p>{1}</p><p>{0} <a href=/r>as told before</a></p></div>".format(LONG, "And then it rained.")
    end = "<div><a href=/1>Another page about boats</a> <a href=/2>Yet another one</a></div><div>Printed by the river press</div>"
    want = f"How the boats were moved\n{LONG.strip()}\nAnd then it rained.\n{LONG.strip()} as told before"
    assert main_text(menu + body + end) == want
    assert main_text(f"<table><tr><td>{menu}</td><td>{body}</td></tr></table>{end}") == want
    assert main_text(menu + end) == ""


def test_tree_uses_neighbours():
    from wayfarer.llm.extraction import tree

    used = set()

    def walk(node):
        if not isinstance(node, int):
            used.add(node[0])
            walk(node[2]), walk(node[3])

    walk(tree())
    assert used & {2, 3}, "the block before"
    assert used & {4, 5}, "the block after"


TAGS = [
    '<p data-x="' + "<b>x</b>" * 20 + '">kept</p>', "<p title='a > b'>kept</p>", "<p onclick='if (a > b) { say(\"<p>no</p>\") }' class=x>kept</p>", '<p title="it\'s > that">kept</p>', "<p title=it's>kept</p>", "<p a = '>' b='>'>kept</p>",
    "<p a=>kept</p>", '<p "x>kept</p>', '<p title="never closed>kept</p>', "<a href=/x?y='z'>kept</a>", "<div data-x=' class=ad ' data-y=ad>kept</div>", "<p>kept<br/></p>", "<p a='1'b=\"2>3\">kept</p>",
]


@pytest.mark.parametrize("tag", TAGS)
def test_quoted_signs(tag):
    """Signs within quotes, however many, belong to the attribute."""
    from wayfarer.llm.extraction import blocks

    assert [t for t, *_, place in blocks(f"<article>{tag}</article>") if place == 2] == ["kept"]


def test_linear_scan():
    import time

    from wayfarer.llm.extraction import blocks

    for page in ("<p a='" * 40_000, '<p a="' + "<p b=x>" * 40_000, "<p a=\"'>" * 40_000, "<p " + "a = " * 100_000, "<p " + "/" * 200_000):
        began = time.perf_counter()
        blocks(page)
        assert time.perf_counter() - began < 5


def test_extraction_odd(spark):
    from wayfarer.llm.extraction import extract

    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<article><p>a</p></article>", "x"), (2, "u", "<article><p>" + "long text " * 20000, "x")], "page_id long, url string, html string, text string")
    assert sorted((r["n_chars"] for r in extract(df).collect())) == [0, 1, 199_999]
    assert extract(df.where("false")).collect() == []
