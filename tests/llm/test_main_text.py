"""Main text of pages: the DOM reader, the trees, the decoding, and whole pages against an independent reading."""

from __future__ import annotations

import html
import itertools
import random
import re

import numpy as np
import pytest

from crosspanel.llm import boosted, layouts, main_text
from crosspanel.llm.common import prepare
from crosspanel.llm.dom import KINDS, RUN, parse

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return prepare(spark).read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return main_text.fit(pages)


def plain_article(page):
    """The text of the article element, read with expressions: the given pages have one, of headings and paragraphs."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(x for x in blocks if x)


def test_given_pages_exactly(pages, model):
    rows = {r.page_id: r for r in main_text.extract(pages, model).collect()}
    given = pages.collect()
    assert len(rows) == len(given)
    assert [p.page_id for p in given if rows[p.page_id].text != plain_article(p.html)] == []


def blocks(page):
    return [t for t in parse(page).text if t]


@pytest.mark.parametrize("page,want", [
    ("", []),
    ("a &lt; b &amp;&amp; c&nbsp;d &#233;&eacute;", ["a < b && c d éé"]),
    ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
    ("<p><b>one<br>two<p>three</b> four", ["one two", "three four"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
    ("a<script>if (x < y) { '<p>no</p>' }</script>b<style>p{}</style>c<!-- <p>no -->d", ["abcd"]),
    ("<script>never ended <p>no", []),
    ("a<!-- never ended <p>no", ["a"]),
    ("1 < 2 <3 <a", ["1 < 2 <3 <a"]),
    ("x</p>y</nothing>z</>w<!doctype html><?php no ?>v", ["xyzwv"]),
    ("<p hidden>no</p><div style='display: none'>no <p>no</p></div><p>yes", ["yes"]),
    ("<a title='x > y'>in</a> <i class=x>side</i>", ["in side"]),
    ("<div><span>a<div>b</div>c</span></div>", ["a", "b", "c"]),
    ("<h1>a<h2>b</h2>c", ["a", "b", "c"]),
    ("<select><option>no</select><button>no</button>yes", ["yes"]),
    ("<" * 50_000, ["<" * 50_000]),
    ("<div>" * 3_000 + "deep", ["deep"]),
    ("<title>no</title><textarea><p>no</textarea>yes", ["yes"]),
])
def test_reader(page, want):
    assert blocks(page) == want


def test_trees_find_the_best_split():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (300, 4)).astype(float)
    y = ((x[:, 2] > 3) ^ (rng.random(300) < 0.1)).astype(int)
    first = boosted.fit(x, y, rounds=1, depth=1, rate=1.0)
    p = (y.sum() + 0.5) / 301
    g, h = p - y, np.full(300, p * (1 - p))
    gain = lambda on: g[on].sum() ** 2 / (h[on].sum() + 1)
    best = max(itertools.product(range(4), range(5)), key=lambda fc: gain(x[:, fc[0]] <= fc[1]) + gain(x[:, fc[0]] > fc[1]))
    assert first.feature[0, 0] == best[0] and best[1] <= first.cut[0, 0] < best[1] + 1
    left = x[:, best[0]] <= best[1]
    assert np.allclose(first.logit(x)[left], np.log(p / (1 - p)) - g[left].sum() / (h[left].sum() + 1))
    more = boosted.fit(x, y, rounds=20, depth=3)
    assert ((more.logit(x) > 0) == y).mean() > 0.85
    assert len(boosted.fit(x, np.zeros(300, int)).feature) == 0


def test_decoding_is_the_best_closed_set():
    rng = random.Random(2)
    page = "<div><p>a<p>b<div><p>c<ul><li>d</ul></div></div><p>e"
    f = main_text._forest([page, "", "<p>x"])
    n = len(f.kind)
    for _ in range(30):
        logit = np.array([rng.uniform(-2, 2) for _ in range(n)])
        sets = (s for s in itertools.product([False, True], repeat=n) if all(f.parent[i] < 0 or s[f.parent[i]] for i in range(n) if s[i]))
        best = max(sets, key=lambda s: logit[np.array(s)].sum())
        assert np.isclose(logit[f.keep(logit)].sum(), logit[np.array(best)].sum())
        kept = f.keep(logit)
        assert all(kept[f.parent[i]] for i in range(n) if kept[i] and f.parent[i] >= 0)


PROSE = "The river ran high that spring, and the mill stood idle for weeks. Nobody in the village minded much, as there was little to grind."
WHOLE = {
    "sidebar and comments": (
        f"<body><header class='site-header'><a href='/'>Daily</a></header><nav><a href='/a'>A</a> <a href='/b'>B</a></nav><div id='content'><article><h1>The mill</h1><p>{PROSE}</p>"
        f"<div class='ad'>Buy our bread, it is good.</div><ul><li>flour</li><li>water</li></ul><p>{PROSE}</p></article><section class='comments'><div class='comment'><b>Ann</b><p>{PROSE}</p></div></section></div>"
        f"<aside class='sidebar'><h3>Related</h3><p>{PROSE}</p></aside><footer>&copy; 2020 Daily. {PROSE}</footer></body>",
        ["The mill", PROSE, "flour", "water", PROSE]),
    "no article element": (
        f"<div class='cookie-notice'>We use cookies to make this site better for you, as everybody does.</div><ul class='menu'><li><a href='#'>Home</a></li><li><a href='#'>News</a></li></ul>"
        f"<div class='post-content'><h1>The mill</h1><p>{PROSE}<p>Short.<blockquote>{PROSE}</blockquote></div><form class='newsletter'><p>{PROSE}</p><input></form><div class='footer'>{PROSE}</div>",
        ["The mill", PROSE, "Short.", PROSE]),
    "laid out as a table": (
        f"<table><tr><td><a href='1'>Home</a><br><a href='2'>News</a></td><td><h1>The mill</h1><p>{PROSE}</p><p>{PROSE}</p></td></tr></table>", ["The mill", PROSE, PROSE]),
    "replies after the text": (
        f"<div role='main' class='entry'><h2>The mill</h2><p>{PROSE}</p></div><section id='respond'><h3>Reader comments</h3><p>{PROSE}</p></section>", ["The mill", PROSE]),
    "words of another language": (
        "<nav><a href='/'>Start</a></nav><div class='inhalt'><h1>Die Mühle</h1><p>Der Fluss stand in diesem Frühling hoch, und die Mühle ruhte.</p><p>Kurz.</p></div><div class='fuss'>Impressum</div>",
        ["Die Mühle", "Der Fluss stand in diesem Frühling hoch, und die Mühle ruhte.", "Kurz."]),
    "only paragraphs": (f"<p>{PROSE}</p><p>{PROSE}</p>", [PROSE, PROSE]),
    "only text": (PROSE, [PROSE]),
    "only a menu": ("<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav><footer>&copy; Daily</footer>", []),
}


@pytest.mark.parametrize("name", WHOLE)
def test_other_layouts(model, name):
    page, want = WHOLE[name]
    assert main_text.main_texts([page], model)[0] == "\n".join(want)


def test_held_out_layouts(pages, model):
    fragments = [t[:600] for r in pages.orderBy("page_id").limit(50).collect() for t in parse(r.html).text if len(t) > 2]
    made = layouts.pages(fragments, 200, 99)
    hit = miss = wrong = 0
    for page, text in zip(made, main_text.main_texts([p.replace(layouts.MARK, "") for p in made], model)):
        want, got = [t.replace(layouts.MARK, "") for t in parse(page).text if layouts.MARK in t], text.split("\n") if text else []
        hit += (common := len(set(want) & set(got)))
        miss += len(set(want)) - common
        wrong += len(set(got)) - common
    assert hit / (hit + miss) > 0.95 and hit / (hit + wrong) > 0.95


def test_odd_tables(spark, model):
    rows = spark.createDataFrame([(1, None, "x", "u"), (1, None, "x", "u"), (None, "", "y", None), (3, "<p>" + "word " * 100_000, None, "v")], "page_id long, html string, text string, url string")
    got = sorted((r.page_id or 0, r.url or "", len(r.text)) for r in main_text.extract(rows, model).collect())
    assert got == [(0, "", 0), (1, "u", 0), (1, "u", 0), (3, "v", 499_999)]
    assert main_text.extract(rows.limit(0), model).columns == ["page_id", "url", "text"]
    assert main_text.extract(rows.limit(0), model).count() == 0
    assert main_text.main_texts([WHOLE["sidebar and comments"][0]], main_text.fit(rows.limit(0), made_pages=150))


def test_kinds_cover_runs():
    assert KINDS[RUN] == 0 and len(set(KINDS.values())) == len(KINDS)
