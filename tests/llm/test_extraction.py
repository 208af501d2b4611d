"""Main text: the parser, exact marginals against enumeration, hand-written pages, held-out layouts, awkward rows."""

import itertools
import random

import numpy as np
import pytest

from reachlens.llm import dom, extraction, layouts

SYLLABLES = "ta lo mi ren sa vor el un dis ka pe or an ti".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    return extraction.fit_pages([])


def leaves(html):
    tree = dom.parse(html)
    return [x for x, tag in zip(tree.text, tree.tag, strict=True) if tag == "#text"]


@pytest.mark.parametrize(("html", "want"), [
    ("", []), ("plain  text\n here", ["plain text here"]), ("a &lt;b&gt; &amp; c&nbsp;d &am", ["a <b> & c d &am"]), ("<p>one<br>two<p>three", ["one two", "three"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]), ("<script>if (a < b) '</p>'</script>x<!-- y -->z", ["xz"]), ("<script>never closed <p>x", []),
    ("<div><b>bold <i>x</div>after</b>", ["bold x", "after"]), ("</div></p>x</table>", ["x"]), ("a < b and c > d", ["a < b and c > d"]), ("<p class='un>x</p>y", ["x", "y"]),
    ("<h2>head</h3>text", ["head", "text"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<dl><dt>t<dd>d<dt>u</dl>", ["t", "d", "u"]), ("<TITLE>no</TITLE><P>Yes", ["Yes"]),
    ("<p>cut off <a href=", ["cut off"]), ("<!-- never closed <p>x", []), ("<p>in<span>line</span></p>", ["inline"]), ("<textarea><p>no</textarea>x<hr>y", ["x", "y"])])
def test_parse(html, want):
    assert leaves(html) == want


def test_links_end_with_what_holds_them():
    tree = dom.parse("<div><a href=x>open link</div><p>not linked <a>linked</a></p>")
    assert [(x, n) for x, n, tag in zip(tree.text, tree.linked, tree.tag, strict=True) if tag == "#text"] == [("open link", 9), ("not linked linked", 6)]


def test_marginals_are_exact():
    """Sum-product against all assignments of a few small trees at once."""
    rng = np.random.default_rng(2)
    trees = [dom.parse(x) for x in ("<div class=a><p>x<p>y z</div><ul><li>q</ul>", "one", "<article><div><div>deep</div></div>t</article>", "")]
    batch = extraction.Batch(trees)
    model = extraction.Model(rng.normal(size=extraction.WIDTH), rng.normal(size=(3, 2, 2)))
    got, edge = model.messages(batch)
    unary = model.unary(batch)
    for page in range(len(trees)):
        nodes = np.flatnonzero(batch.page == page)
        total, ones = 0.0, np.zeros(len(nodes))
        for states in itertools.product((0, 1), repeat=len(nodes)):
            log = sum(s * unary[k] for s, k in zip(states, nodes, strict=True))
            log += sum(model.pairs[batch.kind[k], states[batch.parent[k] - nodes[0]], s] for s, k in zip(states, nodes, strict=True) if batch.parent[k] >= 0)
            total += np.exp(log)
            ones += np.exp(log) * np.array(states)
        assert np.allclose(got[nodes], ones / total)
    inner = np.flatnonzero(batch.parent >= 0)
    norm = np.exp(edge[inner] - edge[inner].max((1, 2), keepdims=True))
    assert np.allclose((norm / norm.sum((1, 2), keepdims=True))[:, :, 1].sum(1), got[inner])  # edges agree with nodes


def hand_written(rng):
    """(html, blocks) of pages unlike the layouts' generator: other names, other orders."""
    p = [prose(rng, rng.randint(12, 60)) for _ in range(12)]
    title, a, b, c, d = prose(rng, 6), *p[:4]
    yield f"""<html><head><title>{title}</title><meta name=x><style>p {{ }}</style></head><body><header class="site-header"><a href="/">The Site</a><nav class="main-nav"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav></header>
      <div class="cookie-notice"><p>{p[4]}</p><button>OK</button></div><main><article><h1>{title}</h1><p>{a}</p><div class="ad-slot">{p[5]}</div><p>{b}</p><blockquote><p>{c}</p></blockquote></article>
      <section class="comments"><h2>Comments</h2><div class="comment"><b>ann</b><p>{p[6]}</p></div><div class="comment"><b>bo</b><p>{p[7]}</p></div></section></main>
      <aside class="sidebar"><h3>Popular</h3><p>{p[8]}</p></aside><footer><p>{p[9]}</p></footer></body></html>""", [title, a, b, c]
    yield f"""<body><div id="top"><div id="menu"><a href=/>Home</a> | <a href=/x>More</a> | <a href=/y>Contact us</a></div></div><div id="content"><div class="post"><h2>{title}</h2><p>{a}<p>{b} <a href=z>see</a> {c}<p>{d}</div>
      <div id="comments"><ol><li class="comment"><p>{p[5]}</p></li><li class="comment"><p>{p[6]}</p></li></ol></div></div><div id="sidebar"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id="footer">&copy; {p[7]}</div>""", [title, a, f"{b} see {c}", d]
    yield f"""<html><body><nav><ul><li><a href=a>a</a><li><a href=b>b</a></ul></nav><div class=alert>{p[4]}</div><article><header><h1>{title}</h1></header><p>{a}</p><aside class="related"><h4>Read more</h4><ul><li><a href=q>{prose(rng, 5)}</a></ul></aside>
      <p>{b}</p><ul><li>{c}</li></ul><form class="newsletter"><label>Email</label><input><button>Go</button></form></article><footer>{p[5]}</footer>""", [title, a, b, c]


def test_hand_written_pages(model):
    right = total = wrong = 0
    for seed in range(20):
        for html, want in hand_written(random.Random(seed)):
            (got,) = extraction.extracted([html], model)
            right, total, wrong = right + sum(x in got for x in want), total + len(want), wrong + sum(x not in want for x in got)
    assert right >= 0.97 * total and wrong <= 0.05 * total


def test_held_out_layouts(model):
    rng = random.Random(8)
    good, rest = [prose(rng, rng.randint(2, 50)) for _ in range(300)], [prose(rng, rng.randint(1, 4))[:-1] for _ in range(100)]
    batch = extraction.Batch([dom.parse(x) for x in layouts.pages(150, good, rest, 4321)])
    want, (got, _) = extraction.inherited(batch), model.messages(batch)
    got = got >= 0.5
    assert (got == want)[batch.leaf].mean() > 0.95
    assert want[batch.leaf].mean() not in (0, 1)


def test_fit_learns_from_markup():
    """Names that no layout has, told by the sample's own markup."""
    rng = random.Random(3)
    page = lambda: f"<body><article class=zork><p>{prose(rng, 3)}</p><p>{prose(rng, 20)}</p></article><footer class=blorb><p>{prose(rng, 20)}</p></footer>"
    model = extraction.fit_pages([page() for _ in range(60)], n_layouts=100, steps=80)
    first, second, away = prose(rng, 3), prose(rng, 20), prose(rng, 20)
    assert extraction.extracted([f"<body><div class=blorb><p>{away}</p></div><div class=zork><p>{first}</p><p>{second}</p></div>"], model) == [[first, second]]


def test_rows(spark, model):
    rng = random.Random(1)
    html, want = next(hand_written(rng))
    deep = "<div>" * 3000 + f"<p>{prose(rng, 30)}"
    long = "<article>" + "".join(f"<p>{prose(rng, 40)}</p>" for _ in range(4000)) + "</article>"
    rows = [(1, "u", html), (1, "u", html), (2, None, None), (3, "v", ""), (None, "w", "<nav><a href=x>y</a></nav>"), (5, "x", deep), (6, "y", long), (7, "z", "<" * 5000 + "&" * 5000)]
    pages = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extraction.main_text(pages, model, with_blocks=True).collect()
    assert len(got) == len(rows) and [(r.page_id, r.url) for r in got] == [r[:2] for r in rows]
    assert got[0] == got[1] and set(want) <= set(got[0].blocks) and got[0].text == "\n\n".join(got[0].blocks)
    assert [r.text for r in got[2:5]] == ["", "", ""] and all(r.n_chars == len(r.text) for r in got)
    assert len(got[6].blocks) == 4000
    assert extraction.main_text(pages.limit(0), model).count() == 0 and extraction.fit(pages.limit(0)).weights.any()
