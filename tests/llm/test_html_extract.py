import random

import numpy as np
import pytest

from stockflow.llm import html_extract as he
from stockflow.llm.boosting import BoostedTrees

WORDS = "the harbour was quiet and boats lay still while people walked along the old wall, talking of rain. Nobody came; the lamps stayed dark until morning".split()


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    sample = [he.made_page(rng, [say(rng, rng.randint(6, 30)) for _ in range(30)]) for _ in range(30)]
    return he.fitted(sample, made=200)


def test_unseen_pages(model):
    rng = random.Random(99)
    good = total = 0
    for _ in range(60):
        page, y = he.labelled(he.Page(he.made_page(rng, [say(rng, rng.randint(8, 30)) for _ in range(20)])))
        (stay,) = model.kept([page])
        for v, run, _ in page.runs:
            total += len(run)
            good += len(run) * (stay[v] == y[v])
    assert good > 0.93 * total


def test_no_node_stays_without_its_parent(model):
    rng = random.Random(5)
    for _ in range(20):
        page = he.Page(he.made_page(rng, [say(rng, 12) for _ in range(9)]))
        (stay,) = model.kept([page])
        assert all(stay[page.parent[v]] for v in range(1, len(stay)) if stay[v])


def test_an_article(model):
    rng = random.Random(7)
    one, two, three = say(rng, 40), say(rng, 35), say(rng, 30)
    source = f"""<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body><nav class="menu"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
<article class="post-content"><h1>A quiet harbour</h1><p>{one}<!-- no --><p>{two.replace("the", "th&#101;")} <b>bold</b>\n\n text<script>var x = "<p>";</script></p><div class="ad">Buy now</div><p>{three}</article>
<section class="comments"><p>{say(rng, 6)}</p></section><footer class="footer">&copy; 2020</footer></body></html>"""
    (text,) = model.texts([source])
    for part in (one, two, three, "bold text"):
        assert part in text
    assert "Home" not in text and "var x" not in text and "2020" not in text and "Buy now" not in text


def test_parser():
    page = he.Page("<div><p>a &amp; b<p>c<ul><li>d<li>e</ul><br>f<table><tr><td>g<td>h</table><textarea>no</textarea></div></div>i<img alt='<p>'>j<a href=x>k</a> < 5 </p")
    assert [r[1] for r in page.runs] == ["a & b", "c", "d", "e", "f", "g", "h", "ijk < 5"]
    assert he.Page("").runs == [] and he.Page("<" * 5000).runs and he.Page("<p " * 20_000).parent == [-1]
    assert he.Page("<div>" * 3000 + "deep").runs[0][1] == "deep"


def test_rows(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain words"), (4, "u", "<p>x</p>" * 20_000), (None, "u", "<div>"), (3, None, "plain words")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = he.extract(pages, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2)} == {1: "", 2: ""} and {r.text for r in got if r.page_id == 3} == {"plain words"}
    assert he.extract(pages.where("false"), model).count() == 0
    assert he.sampled(pages.where("false")) == [] and he.fitted([], made=20).texts([]) == []


def test_query(spark, sf):
    got = he.op10_html_text(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count() and got.where("n_chars = 0").count() < got.count() / 2


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((trees.logits(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95
    assert np.isfinite(BoostedTrees(rounds=3).fit(x[:5] * 0, np.ones(5)).logits(x[:2])).all()


@pytest.mark.parametrize("attribute", ['style="overflow:hidden"', 'data-title="The hidden valley"', 'data-hidden="false"', "aria-hidden='false'", "title='hidden", 'data-id="nav" itemid="menu" data-x=\'class="ad"\''])
def test_words_within_attributes_hide_nothing(model, attribute):
    page = he.Page(f"<div {attribute}><p>text</p></div>")
    assert page.hidden == [False] * 3 and page.tokens[1] == ()
    rng = random.Random(7)
    parts = [say(rng, 40) for _ in range(3)]
    source = f'<html><body><nav class="menu"><a href=/>Home</a></nav><div {attribute}><article class="post-content"><h1>A quiet harbour</h1>{"".join(f"<p>{p}</p>" for p in parts)}</article></div></body></html>'
    assert all(p in model.texts([source])[0] for p in parts)


def test_hidden_nodes():
    for attribute in ("hidden", "HIDDEN=''", 'class="a" hidden', 'aria-hidden="TRUE"', "aria-hidden=true", 'style="color:red; display : none"', "style=display:none;", 'style="display:none !important"'):
        assert he.Page(f"<div {attribute}><p>text</p></div>").hidden == [False, True, False]
    page = he.Page('<div class="post main" title="a > b" id=x7 role=\'main\' data-role="no"><p>text</p></div>')
    assert page.tokens[1] == ("post", "main", "x", "7", "main") and page.hidden == [False] * 3


def test_lines_go_on_through_what_is_not_shown():
    runs = lambda s: [r[1] for r in he.Page(s).runs]
    assert runs("<p>sub<script>x()</script>way <style>p{}</style>line</p>") == ["subway line"]
    assert runs("<p>a <span hidden>no <span>no</span> no</span>b <b style='display: none'>no</b>c</p>") == ["a b c"]
    page = he.Page('<p>a <span class="ad-slot">buy</span>b <a class="address" id=x>c</a> <i class="overflow-hidden">d</i></p>')
    assert page.runs[0][1] == "a " and page.text([True] * 5) == "a buyb c d" and page.text([True, True, False, True, True]) == "a b c d"
    assert runs("<div><p>a <span hidden>never closed</p><p>b</p></div><p>c") == ["a", "b", "c"]
    assert runs("<p>a <span hidden>no<p>b") == ["a", "b"]


HAND_MADE = [
    (
        """<html lang=en><head><title>Bread</title></head><body><div id="top"><a href="/">Home</a> <a href="/r">Recipes</a> <a href="/s">Shop</a></div>
<div class="page"><div class="post"><h1>Bread at home</h1><p>Mix flour, water and salt in a large bowl, and let the dough stand for an hour before it is kneaded.</p>
<p>Bake it for forty minutes in a hot oven. It is done when it sounds hollow; leave it to cool on a rack, as it cuts badly while it is hot.</p></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Cake</a></li><li><a href="/2">Soup</a></li></ul></div></div><div class="footer">&copy; 2019 Kitchen</div></body></html>""",
        ["Mix flour, water and salt in a large bowl, and let the dough stand for an hour before it is kneaded.", "Bake it for forty minutes in a hot oven. It is done when it sounds hollow; leave it to cool on a rack, as it cuts badly while it is hot."],
        ["Recipes", "Popular", "Soup", "2019"],
    ),
    (
        """<body><header><h2>The Daily</h2><nav><a href=/a>World</a><a href=/b>Sport</a></nav></header><main><article><h1>Ferry late again</h1>
<p>The ferry to the island left two hours late on Monday, the third time in a week, and passengers waited in the rain without being told why.</p>
<aside class="ad">Cheap flights! <a href=/x>Book now</a></aside><p>A spokesman said that a pump had failed, and that a spare one would come from the mainland &amp; be fitted by the end of the week.</p></article>
<section class="comments"><h3>Comments</h3><p>Typical, they never tell anybody.</p></section></main><footer><p>Contact us. Privacy.</p></footer></body>""",
        ["The ferry to the island left two hours late on Monday, the third time in a week, and passengers waited in the rain without being told why.", "A spokesman said that a pump had failed, and that a spare one would come from the mainland & be fitted by the end of the week."],
        ["World", "Book now", "Typical", "Privacy"],
    ),
    (
        """<div class="cookie-banner">We use cookies. <button>Accept</button></div><div class="content"><p>Owls hear better than they see, and turn their heads to find where a mouse rustles in the leaves.</p><p style="overflow:hidden">Their feathers make
no sound in flight, so that the mouse hears nothing until it is too late to run.</p></div><form class="newsletter"><label>Mail</label><input name=q><p>Subscribe to our letter.</p></form>""",
        ["Owls hear better than they see, and turn their heads to find where a mouse rustles in the leaves.", "Their feathers make no sound in flight, so that the mouse hears nothing until it is too late to run."],
        ["cookies", "Accept", "Subscribe"],
    ),
]


@pytest.mark.parametrize("source,kept,gone", HAND_MADE)
def test_pages_written_by_hand(model, source, kept, gone):
    (text,) = model.texts([source])
    assert all(x in text for x in kept), text
    assert not any(x in text for x in gone), text


A, B, C = [
    "The mill by the river has ground corn for the village since the old king reigned, and its wheel still turns on most days of the year.",
    "In spring the water stands so high that the miller opens both gates; in summer he waits for rain, and mends the sails of his brother's boat.",
    "Visitors may see the stones and the great oak shaft, and buy a bag of flour at the door, which keeps for a month in a dry place.",
]
CASES = [
    ('He won a <span class="promotion">promotion to manager</span> last year', "He won a promotion to manager last year"),
    ('See <a class="sponsor-link">the sponsor of the race</a> in the text', "See the sponsor of the race in the text"),
    ("Let <math><mi>x</mi>=5</math> be", "Let x=5 be"),
    ("This is un<x-y>believ</x-y>able", "This is unbelievable"),
    ("They say <ruby>kan<rt>ji</rt></ruby> here", "They say kanji here"),
    ('a <span class="footer">word of note</span>, then', "a word of note, then"),
    ('a <em id="menu">word</em>s', "a words"),
    ('<b class="c">bold</b> <i class="d">then</i> plain', "bold then plain"),
    ("one<!-- two --> three&nbsp;four &lt;five&gt;", "one three four <five>"),
    ("one <span hidden>two </span>three", "one three"),
    ("one<br>two", "one two"),
    ("sub<wbr>way<script>x()</script> line", "subway line"),
    ('<span class="outer">a <span>b</span> c</span> d', "a b c d"),
    ('<a class="x" href="/y">never closed', "never closed"),
    ("a </span>stray end", "a stray end"),
    ("H<sub>2</sub>O and E=mc<sup>2</sup>", "H2O and E=mc2"),
    ("&#x41;&amp;&eacute;", "A&é"),
    ("tabs\t and\n lines\r\n", "tabs and lines"),
    ('<unknown-thing class="comment">aside from that</unknown-thing> it works', "aside from that it works"),
    ("", ""),
]


@pytest.mark.parametrize("line,want", CASES)
def test_whole_text_of_a_page(model, line, want):
    source = f"""<!DOCTYPE html><html><head><title>Mill</title></head><body><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav>
<article class="post-content"><p>{A}</p><p>{B} {line}</p><p>{C}</p></article><footer class="footer">&copy; 2020 <a href="/p">Privacy</a></footer></body></html>"""
    assert model.texts([source]) == [" ".join(f"{A} {B} {want} {C}".split())]


def test_advert_within_a_line(model):
    source = f'<html><body><article class="post-content"><p>{A}</p><p>{B} <span class="ad-slot">home news</span> {A}</p><p>{C}</p></article></body></html>'
    assert model.texts([source]) == [f"{A} {B} {A} {C}"]


def test_choice_down_the_tree_is_the_one_of_plain_recursion(model):
    """kept() against a recursion over children: what a node is worth, and that nothing stays in what goes."""
    rng = random.Random(11)
    for _ in range(10):
        page = he.Page(he.made_page(rng, [say(rng, 12) for _ in range(9)]))
        x = he.features(page, model.odds)
        own, children = np.clip(model.trees.logits(x), -6, 6), {}
        for v, u in enumerate(page.parent):
            children.setdefault(u, []).append(v)

        def worth(v):
            below = [(c, worth(c)) for c in children.get(v, [])]
            return -99.0 if page.hidden[v] else own[v] + sum(w * min(1.0, x[c, 11]) for c, w in below if w > 0)

        def staying(v):
            return {v}.union(*(staying(c) for c in children.get(v, []) if worth(c) > 0))

        (stay,) = model.kept([page])
        assert {v for v, s in enumerate(stay) if s} == staying(0)
