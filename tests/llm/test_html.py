from entitylink.llm import html

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul>'
    '<li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now</div><article><h1>Head</h1><p><b>First &amp; best<br>'
    "<p>second\n  part&nbsp;here</p></article><footer>&copy; somebody</footer></body></html>"
)
FREE = (
    '<body class="has-sidebar"><div id="menu"><a href=x>Home</a></div><div class="content"><h1>Head</h1><p>One <b>bo</b>ld two.</p><ul><li>item one</li>'
    '<li>item two</li></ul><div class="sponsored">' + "buy " * 30 + "</div><p>Last.</p></div><aside>side words</aside>"
    '<section class="comments"><p>I disagree very much</p></section><form><label>Name</label></form><footer>2020</footer>'
)
NESTED = (
    '<div class="cookie-notice"><p>We use cookies</p></div><header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>one two</p>'
    '<article class="comment"><p>nice words</p></article><p>three</p></article>'
)


def table(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' as text", "1 as n_chars", "'y' as kind")


def weights(spark, pages=(PAGE,)):
    return html.trained(table(spark, [(k, "u", p) for k, p in enumerate(pages)]))


def test_main_text(spark):
    w = weights(spark)
    assert html.main_text(PAGE, w) == "Head First & best second part here"
    assert html.main_text(FREE, w) == "Head One bold two. item one item two Last."
    assert html.main_text(NESTED, w) == "Head one two three"
    assert html.main_text("", w) == ""
    assert html.main_text("<p>a &lt; b &#233; < c</p>", w) == "a < b é < c"
    assert html.main_text('<p title="a > b">kept</p><p hidden>not</p>', w) == "kept"
    assert html.main_text("<script>never closed <p>x</p>", w) == ""


def test_region_is_the_best_of_all(spark):
    """The scan against every pair of ends."""
    w = weights(spark)
    for page in (PAGE, FREE, NESTED):
        rows = [r for r in html.pieces(page) if r[0] != "w:space"]
        score = [w.get(k, html._DEFAULT[k[0]]) * (1 if t is None else len(t.split())) for k, t, _, _ in rows]
        best = max(((sum(score[a:b]), -a, -b) for a in range(len(rows)) for b in range(a + 1, len(rows) + 1)))
        inside = [t for k, t, _, _ in rows[-best[1] : -best[2]] if t is not None and k != "w:apart"]
        assert "".join(html.main_text(page, w).split()) == "".join(html.unescape("".join(inside)).split())


def test_weights_are_counted_over_all_pages(spark):
    w = weights(spark, (PAGE, FREE, PAGE))
    assert w["w:p"] > 0 and w["w:apart"] == w["t:apart"] == html.LEAST_TAG
    assert all(v <= html.LEAST_TAG for k, v in w.items() if k[0] == "t")
    assert w == html.weights_of({k: 2 * v for k, v in html.counted(PAGE).items()})
    assert html.counted(FREE) == {}


def test_awkward_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "u", "no tags at all"), (5, "u", PAGE.replace("second", "word " * 200_000))]
    got = html.extracted(table(spark, rows), weights(spark)).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [r[:2] for r in rows]
    assert got[0]["text"] == got[1]["text"] and got[2]["text"] == got[3]["text"] == "" and got[5]["text"].count("word") == 200_000
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    empty = table(spark, [])
    assert html.extracted(empty, html.trained(empty)).count() == 0
    assert html.main_text("<p>words of text</p>", html.trained(empty)) == "words of text"


def test_broken_pages_take_linear_time(spark):
    import time

    w = weights(spark)
    began = time.monotonic()
    for page in ("<div>" * 20_000 + "x" + "</div>" * 20_000, "<" * 200_000, "<a " * 50_000, "<p title='" * 20_000 + ">", "<!--" * 50_000, "<!x" * 50_000):
        html.main_text(page, w)
    assert time.monotonic() - began < 20
    assert html.main_text(f'<p data-x="{"y" * 100_000}">kept</p>', w) == "kept"


def test_quoted_values_of_any_length(spark):
    w = weights(spark)
    value = '<p>not text</p> > <div class=ad id="menu"> hidden ' * 200
    assert html.main_text(f"<p data-x='{value}'>kept</p>", w) == "kept"
    value = value.replace('"', "'")
    assert html.main_text(f'<p data-x="{value}">kept</p><p data-y="{value}" class="ad">not</p><p>too</p>', w) == "kept too"
    assert [r[0] for r in html.pieces(f'<p data-x="{value}" class="text">')] == ["t:p"]
    assert html.counted(f'<article><p srcdoc="{value}">one two</p></article>') == html.counted("<article><p>one two</p></article>")


def test_unclosed_quotes_take_linear_time(spark):
    import time

    began = time.monotonic()
    for unit in ('<a" "', "<a \"'", "<a '\" ", '<a b="c', "<a b='\"", '<a x="" "', "<a '' y"):
        for page in (unit * 100_000, unit * 100_000 + ">"):
            html.pieces(page)
    html.pieces("<p " + "y " * 500_000 + "y" * 500_000 + ">")
    assert time.monotonic() - began < 30


def test_rare_tags_of_html_are_counted(spark):
    """One page in 10,001 uses them: HTML's own tags have their counted weight, an
    invented one that of an unseen tag."""
    rare = "<article>" + "<dl><dt>a</dt><dd>b</dd></dl><x-own>c</x-own>" * 50 + "</article><ruby>d</ruby>"
    plain = spark.range(10_000).selectExpr("id as page_id", "'u' as url", "'<article><p>one</p></article><p>two</p>' as html")
    w = html.trained(plain.unionByName(spark.createDataFrame([(-1, "u", rare)], plain.schema)))
    assert {"t:dl", "t:/dl", "t:dd", "t:ruby", "w:dd"} <= set(w) and "t:x-own" not in w
