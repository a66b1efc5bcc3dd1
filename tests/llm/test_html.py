"""HTML extraction: markup, wrapper and odd pages."""
from collections import Counter

from assetlake.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string, host string, wrapper string, pick string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def test_markup():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
      <div id="cookie-notice">Accept</div><!-- <p>no</p> --><main><h1>T &amp; x</h1><div class="share">Share</div><p>a<br>b &nbsp; c <i>d</i>e
      <ul><li>one<li>two</ul><table><tr><td>x<td>y</table><form><input>go</form><section class="comments"><article class="comment">hi</article>
      </section><script>if(a<b){"</p>"}</script></main><aside>no</aside><footer>no</footer>"""
    assert H.main_text(H.parse(page)) == "T & x\n\na b c de\n\none\n\ntwo\n\nx\n\ny"
    assert H.main_text(H.parse("<article><p><b>A &lt;b&gt;<br><p>B</p> C</article><p>no")) == "A <b>\n\nB\n\nC"
    assert H.main_text(H.parse("just <b>text</b> &eacute;&#233;")) == "just text éé"
    assert H.main_text(H.parse("")) == "" and H.main_text(H.parse("<script>x")) == ""
    assert H.main_text(H.parse("<div>" * 4000 + "deep" + "</p></div>")) == "deep"
    assert H.main_text(H.parse("<article><p>x</article></article></div>y")) == "x"


def test_tree_matching():
    m = H.Matcher()
    a, b = H.parse("<div><p>1</p><ul><li>x</li><li>y</li></ul><p>2</p></div>"), H.parse("<div><h1>0</h1><p>1</p><ul><li>x</li></ul><p>2</p><p>3</p></div>")
    m.sign(a), m.sign(b)
    assert m.weight(a, b) == 6  # root, div, two p, ul, one li
    for i, n in enumerate(H.nodes(a)):
        n.slot = i
    m.align(a, b)
    assert [n.tag for n in H.nodes(b) if n.slot is not None] == ["#root", "div", "p", "ul", "li", "p"]


def page(i, body):
    return f'<html><body><div class="x1"><b>Menu of the site</b></div><div class="x2"><h2>Story {i}</h2>{body}</div><div class="x3">All rights {i % 2}</div></body></html>'


def test_wrapper(spark):
    """Without telling markup, what is constant or repeats over the pages of a host is template."""
    rows = [(i, f"https://One.example/{i}", page(i, "".join(f"<p>para {i} {k} &amp; so</p>" for k in range(i % 4 + 1)))) for i in range(30)]
    rows += [(100 + i, "https://two.example/x", page(7, "<p>copy</p>")) for i in range(20)]  # one page again and again is no template
    rows += [(200, None, page(1, "<p>lone</p>")), (201, "https://one.example/none", None), (202, "/rel", ""), (None, "https://one.example/n", page(99, "<p>z</p>")),
             (203, "https://one.example/long", "<article>" + "<p>long text</p>" * 3000 + "</article>"), (0, *rows[0][1:])]
    got = H.extract_pages(frame(spark, rows).repartition(4)).collect()
    want = {(i, u): "\n\n".join([f"Story {i}"] + [f"para {i} {k} & so" for k in range(i % 4 + 1)]) for i, u, _ in rows[:30]}
    count = Counter((r.page_id, r.url) for r in got)
    assert count == Counter((i, u) for i, u, _ in rows)
    by = {(r.page_id, r.url): r.text for r in got}
    assert {k: by[k] for k in want} == want
    assert all(by[100 + i, "https://two.example/x"] == "Menu of the site\n\nStory 7\n\ncopy\n\nAll rights 1" for i in range(20))
    assert by[201, "https://one.example/none"] == "" and by[202, "/rel"] == "" and by[None, "https://one.example/n"] == "Story 99\n\nz"
    assert by[200, None].endswith("lone\n\nAll rights 1") and by[203, "https://one.example/long"].count("long text") == 3000
    salted = H.extract_pages(frame(spark, rows), max_broadcast=-1).collect()
    assert Counter((r.page_id, r.url, r.text) for r in salted) == Counter((r.page_id, r.url, r.text) for r in got)
    assert H.extract_pages(frame(spark, [])).count() == 0
