import pytest

from pathweave.llm import html_main


def text(page):
    p = html_main.parse(page)
    return p.text if p.text is not None else " ".join(p.open)


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain  text\n", "plain text"), ("<p>a<b>b</b>c<br>d", "abc d"),
    ("<nav>x</nav><article><h1>T</h1><p><b>one<br><p>two</p></article><footer>f</footer>", "T one two"),
    ("<article>a &amp; b &lt;p&gt; &am", "a & b <p> &am"), ("<article><p>a &amp", "a &"), ("<article><p>a <b", "a"),
    ("<article>x<!-- no <p> --> y<script>var t='</p>';</script>z</article>", "x yz"),
    ("<title>t</title><style>p{}</style><div class='ad'>buy</div><article>a<div class=\"ad box\">buy</div>b</article>", "a b"),
    ("<article>a<section class=comments><article class=comment>hey</article></section>b</article>c", "a b"),
    ("<main><header>h</header><p>m</p><aside>s</aside></main>x", "m"), ("<main>m<article>a</article></main>", "a"),
    ("<div class='page sidebar-left'><article>a</article></div>", "a"), ("<form>q<input name=a></form><article>a<form>f</form>b</article>", "a b"),
    ("<article><p title='a>b'>t</p><ul><li>1<li>2</ul></article>", "t 1 2"), ("<ARTICLE>A<P CLASS=Notice>n</P>B</ARTICLE>", "A B"),
    ("<article>&#233;t&eacute; &nbsp; x</article>", "été x"), ("a < b <3 c", "a < b <3 c"), ("<article>1 <2 & 3</article>", "1 <2 & 3"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<article><p>a<!-- open", "a"), ("<article>x<textarea>no</textarea>y</article>", "xy"),
    ("<header><nav>n</nav></header><div role=navigation>n</div><div role='main'>m</div>", "m"),
])
def test_text(page, want):
    assert text(page) == want


def test_host_boilerplate(spark):
    menu = "Home News Sport Weather Shop Travel Future Culture More"
    copy = "an article that stands on two pages of the host word for word and stays"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>page {i} has its own words number {i * 7} here</div><div>{menu} end</div>", 0) for i in range(5)]
    rows += [(10, "http://h.example/a", f"<article>{copy}</article>", 0), (11, "http://h.example/b", f"<article>{copy}</article>", 0)]
    rows += [(20, "http://other.example/a", f"<div>{copy}</div>", 0), (21, "http://other.example/b", f"<div>{copy}</div>", 0), (22, "http://third.example/b", f"<p>{menu}</p>", 0)]
    rows += [(30, None, None, 0), (31, "", "", 0), (None, "http://h.example/n", "<p>z", 0), (0, *rows[0][1:])]
    got = sorted(((-1 if r.page_id is None else r.page_id, r.text, r.n_chars) for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()))
    # "page", "here" and "end" continue runs that all pages share
    want = [(i, f"{i} has its own words number {i * 7}") for i in range(5)]
    want += [(10, copy), (11, copy), (20, copy), (21, copy), (22, menu), (30, ""), (31, ""), (-1, "z"), want[0]]
    assert got == sorted((i, t, len(t)) for i, t in want)


def test_empty_table(spark):
    assert html_main.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_teasers_do_not_take_the_place_of_the_main_text():
    text = lambda page: html_main.parse(page).text
    teaser = "<div class=related><article>teaser one</article></div>"
    for page in (f"{teaser}<main>main text here</main>", f"<main>main text here</main>{teaser}", f"<main>main <p>text here<aside>{teaser}</aside></main>",
                 f"<article>main text here</article>{teaser}", "<main>main text here</main><article>teaser</article>"):
        assert text(page) == "main text here", page
    assert text("<div class=banner><article>all the text of the page</article></div><p>x</p>") == "all the text of the page"
    assert text("<div class=related><article>teaser</article></div><p>all the text of the page</p>") is None
    assert html_main.parse("<div class=related><article>teaser</article></div><p>all the text of the page</p>").open == ["all the text of the page"]
    assert text("<main>path<article>one</article><article>two</article></main>") == "one two"
