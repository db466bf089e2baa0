import pytest

from tendril.llm import html_extract as H
from tendril.llm import urls


def text(html, template=None):
    return H.main_text(H.read_page(html), template)[0]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<div>a<p>b<p>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>one<li>two</ul>", "one\ntwo"),
        ("x < y &amp; z &lt;b&gt; &eacute;&#233;&nbsp;q", "x < y & z <b> éé q"),
        ('<a title="a>b">k</a>', "k"),
        ("<article><h1>T</h1><p>a<br>b\n  c</p><div class='comments'>bad</div></article>menu", "T\na b c"),
        ("<nav>menu</nav><header>top</header><main><p>m</p><aside>s</aside></main><footer>f</footer>", "m"),
        ("<div class='ad'>x</div><p>t</p><form>f</form><div id='cookie-notice'>c</div>", "t"),
        ("<article><header><h1>Title</h1></header><p>p</p><footer>by</footer></article>", "Title\np"),
        ("<p>a</p><script>var x='<p>no</p>'</script><style>p{}</style><!-- no --><p>b", "a\nb"),
        ("<script>unclosed <p>a", ""),
        ("<p>cut <b>of", "cut of"),
        ("</p></div>q", "q"),
        ("<table><tr><td>c<td>d</table>", "c\nd"),
        ("<div hidden>h</div><div style='display: none'>n</div><p>v</p>", "v"),
        ("", ""),
        ("<html></html>", ""),
        ("plain", "plain"),
    ],
)
def test_main_text(html, expected):
    assert text(html) == expected


def test_long_broken_markup_is_linear():
    assert text("<p title='" * 20_000) is not None
    assert text("<" * 100_000).startswith("<")
    assert text("<div>" * 5_000 + "x") == "x"


def page(k, article):
    return f"<body><div class='box'><a>Home</a> <a>Shop</a></div><article><h1>T{k}</h1>{article}<div>Read our best stories</div></article><div>Imprint of the site</div></body>"


def test_template_by_host(spark):
    common = "<p>This sentence stands in every article.</p>"
    rows = [(k, f"https://a.example/{k}", page(k, f"<p>text {k}</p>{common}")) for k in range(12)]
    rows += [(100, "https://b.example/1", page(100, common)), (101, None, "<p>x</p>"), (102, "no host", None), (103, "https://c.example/", "<div>a</div><div>b</div>"), (103, "https://c.example/", "<div>a</div><div>b</div>")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, template int")
    found = {r["page_id"]: (r["text"], r["n_template"]) for r in H.extract(pages).collect()}
    for k in range(12):  # prose of the article stays, boxes of the site go
        assert found[k][0] == f"T{k}\ntext {k}\nThis sentence stands in every article."
        assert found[k][1] >= 2
    assert found[100] == ("T100\nThis sentence stands in every article.\nRead our best stories", 0)
    assert found[101][0] == "x" and found[102][0] == "" and found[103][0] == "a\nb"
    assert H.extract(pages).count() == len(rows)


def test_template_in_pages_without_article(spark):
    rows = [(k, f"https://d.example/{k}", f"<div class='x'>Always here</div><div><p>own {k}</p></div>") for k in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in H.extract(pages).collect()} == {f"own {k}" for k in range(10)}


def test_copies_of_a_page_are_no_template(spark):
    rows = [(k, f"https://e.example/{k}", "<div>one text</div><div>another text</div>") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in H.extract(pages).collect()} == {"one text\nanother text"}


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def varied(k, tag="div", rng=None):
    """A page without telling names: menu and advert differ from page to page, a repeated passage stands in the text."""
    menu = "".join(f"<li><a href='/{k}{j}'>entry {k * 7 + j}</a></li>" for j in range(5))
    prose = "".join(f"<p>Sentence {k} {j} of a text that is long enough to be the main part of its page.</p>" for j in range(3))
    return (
        f"<html><body><div class='x1'><ul>{menu}</ul></div><div class='x2'>Offer number {k} today</div><{tag} class='x3'><h1>Title {k}</h1>{prose}<p>This passage stands on every page.</p>"
        f"<table><tr><td>cell {k}</td></tr></table><div class='x4'><a>more {k}</a> <a>less {k}</a></div></{tag}><div class='x5'>Line {k} of the house</div></body></html>",
        "\n".join([f"Title {k}", *(f"Sentence {k} {j} of a text that is long enough to be the main part of its page." for j in range(3)), "This passage stands on every page.", f"cell {k}"]),
    )


@pytest.mark.parametrize("tag", ["div", "article"])
@pytest.mark.parametrize("marks", [True, False])
def test_template_without_telling_names(spark, tag, marks):
    rows = [(k, f"https://g.example/{k}", varied(k, tag)[0]) for k in range(12)]
    found = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), marks=marks).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: varied(k)[1] for k in range(12)}
    assert {r["n_template"] for r in found} == {4}


def test_small_hosts_share_their_domain(spark):
    rows = [(k, f"https://h{k % 6}.sites.example/{k}", varied(k)[0]) for k in range(12)]
    found = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), marks=False).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: varied(k)[1] for k in range(12)}


def test_counts_and_texts_as_brute_force(spark):
    """The whole operator against sets and loops over the same pages."""
    rows = [(k, f"https://f{k % 2}.example/{k}", page(k % 11, f"<p>{k % 5}</p><div>note {k % 3}</div>") if k % 3 else varied(k)[0]) for k in range(60)]
    sites = {}
    for _, url, html in rows:
        sites.setdefault(url.split("/")[2], {})[html] = H.read_page(html)
    expected = {}
    for host, pages in sites.items():
        content, at = {}, {}
        for html, read in pages.items():
            for h in H.content_hashes(read):
                content.setdefault(h, set()).add(html)
            for place, values in H.places(read).items():
                at.setdefault(place, []).append((*values, read.elements[0].chars))
        often = lambda n: n >= H.MIN_PAGES and n >= H.MIN_SHARE * len(pages)  # noqa: E731, B023
        at = {p: v for p, v in at.items() if often(len(v))}
        way = {p for p, v in at.items() if sum(x[4] for x in v) >= H.HEAVY * sum(x[6] for x in v) and 2 * len({x[3] for x in v}) >= len(v)}
        forks = {at[p][0][0] for p in way}
        gone = {p for p, v in at.items() if p not in way and v[0][1] and v[0][0] in way and (v[0][2] or v[0][0] in forks)}
        gone |= {p for p, v in at.items() if p not in way and sum(x[5] for x in v) >= H.LINKED * sum(x[4] for x in v)}
        expected[host] = ({h for h, v in content.items() if often(len(v))}, gone, way)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["host"]: (set(r["content"]), set(r["places"]), set(r["way"])) for r in H.site_templates(frame).collect()}
    assert found == expected
    texts = {r["page_id"]: r["text"] for r in H.extract(frame).collect()}
    for k, url, html in rows:
        assert texts[k] == text(html, H.Template(*map(frozenset, expected[url.split("/")[2]])))


def test_places_far_down_and_long_pages():
    body = "<div class='a'>" * 300 + "".join(f"<p>word {k}</p>" for k in range(20_000))
    read = H.read_page(body)
    assert len(H.places(read)) == 300 and text(body).count("\n") == 19_999


@pytest.mark.parametrize(
    "url, host, path, query",
    [("HTTPS://WWW.É.Com/A/b?x=1#y", "www.É.com", "/A/b", "x=1"), ("http://h", "h", "", ""), ("h/p", "", "", ""), (None, "", "", ""), ("a://b://c/d", "b:", "//c/d", ""), ("http://h?q/x", "h", "", "q/x"), ("http://h#f", "h", "", ""), ("http://h/a\nb", "h", "/a\nb", "")],
)
def test_url_parts(spark, url, host, path, query):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(url,)], "u string").select(urls.host_of(F.col("u")), urls.path_of(F.col("u")), urls.query_of(F.col("u"))).first()
    assert tuple(row) == (host, path, query)
