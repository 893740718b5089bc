"""Markup as intervals: main text, TEI and captions."""

import random

from siltwork.operators import markup as M

PAGE = """<html><head><title>T</title><style>p {}</style></head><body>
<div class="side"><ul><li><a href="/1">Home page of the site</a></li><li><a href="/2">All other pages</a></li></ul><p><a href="/3">More</a> of it</p></div>
<div id="main"><h1>The story</h1><p>It begins with a <a href="/x">link</a> and goes on for a while, as prose does.</p>
<p>Second <b>bold</b> paragraph.<script>var x = "no";</script></p><ul><li>one item</li><li>two item</li></ul><blockquote><p>quoted words</p></blockquote></div>
<nav><p>navigation</p></nav><footer><p>closing words</p></footer></body></html>"""


def frame(spark, *pages):
    return M.nodes(spark.createDataFrame(list(enumerate(pages)), "k long, html string"), "k", "html")


def test_a_sidebar_goes_by_its_links(spark):
    out = M.main_blocks(frame(spark, PAGE)).orderBy("begin").collect()
    assert [(r.tag, r.content) for r in out] == [
        ("h1", "The story"), ("p", "It begins with a link and goes on for a while, as prose does."), ("p", "Second bold paragraph."), ("li", "one item"), ("li", "two item"), ("blockquote", "quoted words"),
    ]


def test_odd_markup(spark):
    pages = ["", None, "plain text only", "<p>unclosed <b>bold <p>next", "</div></p>", "<p>a &lt;b&gt; &amp; c</p>", "<div><p>x</div></p><p>y</p>", "<br><img src=x.png>"]
    rows = frame(spark, *pages).collect()
    for r in rows:
        assert r.begin is not None and r.end is not None and r.end >= r.begin
    out = {}
    for r in M.main_blocks(frame(spark, *pages)).collect():
        out.setdefault(r.doc, []).append(r.content)
    assert out[5] == ["a <b> & c"] and sorted(out[6]) == ["x", "y"] and 0 not in out and 1 not in out


def test_intervals_nest(spark):
    rng = random.Random(1)
    page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "word ", "<br>", "</i>"]) for _ in range(400))
    rows = [(r.begin, r.end) for r in frame(spark, page).collect()]
    assert all(not (a < c <= b < d) for a, b in rows for c, d in rows if (a, b) != (c, d))


def test_tei_levels_lists_and_captions(spark):
    xml = """<TEI><teiHeader><p>hidden</p></teiHeader><text><head rend="h1">A</head><head rend="h3">B</head><head>C</head><p>Table 1: T</p><table><row><cell>1</cell></row></table>
    <p>x</p><table><row/></table><list><item>i</item><item> </item></list><list></list><code>a = 1</code></text></TEI>"""
    out = M.tei_elements(frame(spark, xml)).orderBy("pos").collect()
    assert [(r.type, r.text_level, r.text, r.table_caption) for r in out] == [
        ("text", 1, "A", None), ("text", 3, "B", None), ("text", None, "C", None), ("text", None, "Table 1: T", None), ("table", None, "<table><tr><td>1</td></tr></table>", "Table 1: T"),
        ("text", None, "x", None), ("list", None, "- i", None), ("code", None, "a = 1", None),
    ]


def test_captions_of_figures_and_of_near_texts(spark):
    far = "w " * 400
    page = f"""<p>Figure 1 far</p><p>{far}</p><figure><img src="a.png" alt="A"><figcaption>Own <i>caption</i></figcaption></figure><img src="b.png"><p>Fig. 2: near</p><img src="logo.png"><p>{far}</p>
    <img src="c.png"><p>{far}</p><img src="b.png"><img src="data:x"><figure><img src="d.png"></figure><p>figure 3 in prose</p>"""
    out = {r.src: (r.alt, r.caption) for r in M.captioned_images(frame(spark, page)).collect()}
    assert out == {"a.png": ("A", "Own caption"), "b.png": (None, "Fig. 2: near"), "c.png": (None, None), "d.png": (None, None)}


def test_tei_elements_need_one_shuffle_and_no_broadcast(spark):
    plan = M.tei_elements(frame(spark, "<TEI><p>a</p><list><item>b</item></list></TEI>"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 1, plan


def test_tei_of_nested_lists_and_tables(spark):
    xml = """<text><p>a <lb/>b <graphic/></p><list><item>i <list><item>j</item></list></item><item>k</item></list>
    <table><row><cell>1<table><row><cell>2</cell></row></table></cell><cell/></row><row/></table></text>"""
    out = M.tei_elements(frame(spark, xml, None)).orderBy("pos").collect()
    assert [(r.type, r.text) for r in out] == [("text", "a b"), ("list", "- i j\n- k"), ("table", "<table><tr><td>12</td><td></td></tr></table>")]
