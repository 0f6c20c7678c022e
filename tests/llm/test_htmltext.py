import itertools
import re
from html import unescape

import numpy as np
import pytest

from ropewalk.llm import boosting, htmltext, layouts
from ropewalk.llm.dom import parse

from .cases import ODD

LONG = "The committee met again on Tuesday, and after a long debate it agreed to publish the full report. "

PAGES = {
    "news": (f"""<html><head><title>T</title></head><body><header class="site-header"><a href="/">Daily</a><nav><ul>
        <li><a href=a>World</a><li><a href=b>Sport</a></ul></nav></header><div class="cookie-consent"><p>We use cookies to improve
        this site.</p><button>Accept</button></div><div class="container"><main><article class="post"><h1>A report</h1>
        <p>{LONG * 3}</p><div class="ad-slot">Buy now, pay later!</div><p>{LONG * 2}<a href=x>more &amp; more</a></p>
        <ul><li>First point, made early.<li>Second point.</ul></article>
        <section id="comments"><h3>2 comments</h3><div class="comment"><b>ann</b><p>{LONG}</p></div>
        <div class="comment"><b>bob</b><p>I agree with all of this, really.</p></div>
        <form><label>Name</label><input><textarea>x</textarea><button>Send</button></form></section></main>
        <aside class="sidebar"><h4>Popular</h4><ul><li><a href=1>One thing</a><li><a href=2>Other thing</a></ul></aside></div>
        <footer><p>&copy; 2020 Daily &middot; All rights reserved.</p></footer></body></html>""",
             ["A report", LONG * 3, LONG * 2 + "more & more", "First point, made early.", "Second point."]),
    "no elements made for it": (f"""<body><div id="header"><h2>My site</h2></div><div id="menu"><a href=a>Home</a> | <a href=b>About</a>
        </div><div id="wrapper"><div class="left-column"><h3>Archives</h3><ul><li><a href=1>May 2004</a></li><li><a href=2>June</a></li>
        </ul></div><div class="entry-content"><h2>On walking</h2><p>{LONG * 2}<p>Short one.<p>{LONG}</div></div>
        <div id="footer">Powered by nothing in particular. <a href=t>Terms</a></div></body>""",
                                ["On walking", LONG * 2, "Short one.", LONG]),
    "cut": (f"<nav><a href=/>Home</a> <a href=/b>Blog</a></nav><article><h1>Cut</h1><p>{LONG}</p><p>{LONG} <em>and th",
            ["Cut", LONG, LONG + "and th"]),
}


def blocks(texts):
    return "\n\n".join(" ".join(t.split()) for t in texts)


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert htmltext.fit().texts([html]) == [blocks(want)]


def given_article(html):
    """Blocks of the one layout of the given pages: headings and paragraphs of the article element."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = re.split(r"</?p>|</?h1>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
    return "\n\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)


def test_all_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: given_article(r.html) for r in rows.collect()}
    got = htmltext.report(rows).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) and r.url for r in got)


def test_layouts_that_were_not_fitted():
    model, hit, lost, extra = htmltext.fit(), 0, 0, 0
    for seed in range(10 ** 6, 10 ** 6 + 150):
        html = layouts.page(seed)
        want = [t.replace(layouts.MARK, "").strip() for t in parse(html).text if layouts.MARK in t]
        got = model.texts([html.replace(layouts.MARK, "")])[0].split("\n\n")
        both = sum(len(t) for t in want if t in got)
        hit, lost, extra = hit + both, lost + sum(map(len, want)) - both, extra + sum(len(t) for t in got if t not in want)
    assert hit / (hit + lost) > 0.97 and hit / (hit + extra) > 0.98


def runs(html):
    return [t for t in parse(html).text if t]


@pytest.mark.parametrize("html, want", [
    ("a<p>b<p>c</p>d", ["a", "b", "c", "d"]), ("<p><b>x<br>y<p>z</b> w", ["x y", "z w"]), ("a &lt;b&gt; &amp &am &copy;", ["a <b> & &am ©"]),
    ("1 < 2 <3 </ > <", ["1 < 2 <3 <"]), ("<!-- <p>no</p> -->yes<!--> too<!-- open", ["yes too"]),
    ("<script>if (a < b) '</p>'</script>t<style>p{}</style>", ["t"]), ("<SCRIPT>x</sCrIpT >t<textarea>u</textarea><title>v", ["t"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ('<a title="x>y" class=\'p q\'>l</a>m', ["lm"]), ("<div class=>e</div><p a='1>f", ["e", "f"]), ("<p>g<div>h</p>i</div>", ["g", "h", "i"]),
    ("<h1>a<h2>b</h1>c", ["a", "b", "c"]), ("a\x00b  c\n\td", ["a\x00b c d"]), ("<td>x</div></td></p>y</body>z", ["x", "yz"]),
    ("<svg/>p<svg><text>no</text></svg>q <select><option>r</select>s", ["pq s"]), ("", []), (None, []), ("<", ["<"]), ("<p", []),
    ("<head><meta x><title>t</title>text<p>u", ["text", "u"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
])
def test_reading(html, want):
    assert runs(html) == want


def test_trees_are_trees_and_long_pages_end():
    for html in [layouts.page(s) for s in range(60)] + ["<div>" * 3000 + "x", "<b><p>" * 2000, "<a b='" * 20000, "<!" * 50000, "</x" * 20000]:
        p = parse(html)
        assert p.parent[0] == -1 and all(0 <= q < i and p.end[i] <= p.end[q] for i, q in list(enumerate(p.parent))[1:])
        f = htmltext.forest([p])
        assert (f.parent < np.arange(len(f.parent))).all() and f.end[0] == len(f.tags)


def test_deep_and_large_pages():
    deep = "<div>" * 1500 + f"<article><p>{LONG}</p></article>"
    wide = "<nav><a href=x>Home</a></nav><article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    texts = htmltext.fit().texts([deep, wide, None])
    assert texts[1] == blocks([LONG] * 5000) and texts[2] == ""


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        parent = [-1] + sorted(int(rng.integers(0, i)) for i in range(1, n))
        # page order: a node's subtree must be contiguous
        order, kids = [], {i: [j for j in range(n) if parent[j] == i] for i in range(n)}

        def walk(i):
            order.append(i)
            for j in kids[i]:
                walk(j)
        walk(0)
        place = {x: k for k, x in enumerate(order)}
        par = np.array([place[parent[x]] if parent[x] >= 0 else -1 for x in order])
        size = [1] * n
        for i in reversed(range(1, n)):
            size[par[i]] += size[i]
        tags = ["div" if size[i] > 1 else "#text" for i in range(n)]
        f = htmltext.Forest(tags, [()] * n, [""] * n, par, np.arange(n) + size, np.zeros(n, int), np.zeros((n, 9)))
        log = np.log(rng.dirichlet([1, 1, 1], n))

        def total(states):
            for i, s in enumerate(states):
                if tags[i] == "#text" and s == htmltext.SOME or par[i] >= 0 and states[par[i]] not in (htmltext.SOME, s):
                    return -np.inf
            return sum(log[i, s] for i, s in enumerate(states))

        got = htmltext.decoded(f, log)
        best = max(itertools.product(range(3), repeat=n), key=total)
        assert total(tuple(got)) == pytest.approx(total(best)) and np.isfinite(total(tuple(got)))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = np.where(x[:, 4] > 0.8, 2, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int))
    model = boosting.fit(x[:2000], y[:2000], 3)
    log = model.log_chances(x[2000:])
    assert (log.argmax(1) == y[2000:]).mean() > 0.95 and np.allclose(np.exp(log).sum(1), 1)


def test_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", PAGES["news"][0]), (3, "", "plain " * 3), (4, "x", "<nav><a>a</a></nav>")]
    rows += [(100 + i, "o", r[1]) for i, r in enumerate(ODD)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 AS text", "'c' AS n_chars", "2 AS _html")
    got = htmltext.report(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {r.page_id: r for r in got}
    assert by[1].text == by[None].text == by[4].text == "" and by[2].text == blocks(PAGES["news"][1])
    assert htmltext.report(df.limit(0)).collect() == []
