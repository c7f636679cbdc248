from __future__ import annotations

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import wrapper
from ledgerflow.llm.common import table
from ledgerflow.llm.queries import op7_wrapper

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>T &amp; U</h1><p>a  b<br>c<p>d</article>", "T & U\na b c\nd"),
        ("<nav><a href=x>m</a></nav><article><p><b>x<br><p>y</b></p></article><footer>f", "x\ny"),
        ("<body class='has-sidebar'><div class=ad>buy</div><main>text<aside>side</aside> more</main>", "text\nmore"),
        ("<script>var t='<article>no</article>'</script><article>yes<!-- <p>no --></article>", "yes"),
        ("<article>one<section class='comments'><p>first!</section><form><p>mail</form></article>", "one"),
        ("<article>one</article><article class='comment'>two</article>", "one"),
        ("<header><p>site</header><div><p>just text</div><ul><li><a href=1>l</a><li><a href=2>k</a></ul>", "just text"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></article>", "1\n2\na\nb"),
        ("<article>&lt;b&gt; 1 < 2 &eacute;</article>", "<b> 1 < 2 \u00e9"),
        ("<div id='cookie-notice'>ok?</div><div hidden>h</div>plain", "plain"),
        ("<div class='site-header'>s</div><div id=main-nav>n</div><div class='page-body'>text</div><div class='content-sidebar'>r</div><div class='post-comments'>c</div>", "text"),
        ("<div class='content-with-sidebar nav-open'><div class='entry-header'>title</div>text<div class='ad-slot'>buy</div><div class='comment-body'>c</div></div>", "title\ntext"),
        ("<div role=main>text<div role=complementary>r</div></div><p>out", "text"),
        ("", ""), (None, ""), ("<script>never closed", ""), ("   ", ""), ("</p></div>x", "x"),
    ],
)
def test_one_page(page, text):
    assert wrapper.main_text(page, None) == text


def words(draw, n=12):
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 8))) for _ in range(n))


def site(draw, layout):
    body = [words(draw) for _ in range(draw.randint(1, 9))]
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    return layout.format(title=words(draw, 3), menu=words(draw, 2), body=paragraphs), body


LAYOUT = "<html><body><div class=top><p>Welcome to the site</p></div><div class=x><h1>{title}</h1>{body}<p>Read our rules before you write to us.</p></div><div><p>All the best from us</p></div></body></html>"


def test_constant_texts_are_template():
    draw = random.Random(3)
    made = [site(draw, LAYOUT) for _ in range(8)]
    learned = wrapper.induce([page for page, _ in made])
    assert learned
    page, body = site(draw, LAYOUT)
    lines = wrapper.main_text(page, learned).split("\n")
    assert lines[1:] == body
    assert "Welcome to the site" in wrapper.main_text(page, None)


def test_copies_and_few_pages_teach_nothing():
    draw = random.Random(4)
    page, _ = site(draw, LAYOUT)
    assert wrapper.induce([page] * 8) is None
    assert wrapper.induce([page, site(draw, LAYOUT)[0]]) is None


def slow_match(a, b):
    if a[0] != b[0]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), best(xs[1:], ys[1:]) + slow_match(xs[0], ys[0]))

    return 1 + best(a[1], b[1])


def test_matching_equals_the_definition():
    draw = random.Random(5)

    def tree(depth):
        return [draw.choice("ab"), [tree(depth - 1) for _ in range(draw.randint(0, 3))] if depth else [], []]

    for _ in range(150):
        a, b = tree(3), tree(3)
        count, pairs = wrapper.match(a, b, lambda x, y: False)
        assert count == slow_match(a, b) == len(pairs)


def test_article_text_of_all_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    got = op7_wrapper(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_odd_pages_stay_linear():
    started = time.time()
    for page in ("<div>" * 100_000, "<p>x" * 50_000, "<a '" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<" * 200_000, "<p class='" + "a" * 200_000, "<ul>" + "<li>a<li><b>b</b>" * 20_000):
        wrapper.main_text("<article>" + page, ["", [["article", [["p", [], ["x"]]], []]], []])
    assert time.time() - started < 40


def test_odd_rows(spark):
    draw = random.Random(6)
    rows = [(i, f"http://A.example:80/{i}", site(draw, LAYOUT)[0], "t", 1) for i in range(30)]
    rows += [(100, None, "<p>no address", "t", 1), (101, "http://a.example/", None, "t", 1), (102, "not an address", "", "t", 1), (3, rows[3][1], rows[3][2], "t", 1), (None, "http://b.example", "<article>b</article>", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = wrapper.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    found = got.collect()
    assert len(found) == len(rows)
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[100] == "no address" and texts[101] == texts[102] == "" and texts[None] == "b"
    assert not any("rules" in texts[i] or "Welcome" in texts[i] for i in range(30))
    assert wrapper.extract(pages.limit(0)).count() == 0
    hosts = pages.select(wrapper.host_of(F.col("url")).alias("h")).distinct().collect()
    assert {r["h"] for r in hosts} == {"a.example", "b.example", ""}


def texts_of(spark, pages):
    rows = [(i, f"http://a.example/{i}", page) for i, page in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_near_copies_do_not_hide_the_template(spark):
    draw = random.Random(7)
    article = "".join(f"<p>{words(draw, 20)}</p>" for _ in range(6))
    copies = [LAYOUT.format(title="One title", menu="", body=article + f"<p>{words(draw, 4)}</p>") for _ in range(120)]
    others = [site(draw, LAYOUT) for _ in range(8)]
    got = texts_of(spark, copies + [page for page, _ in others])
    said = re.findall("<p>(.*?)</p>", article)
    for i in range(120):
        assert got[i].split("\n")[:-1] == ["One title", *said]
    for i, (_, body) in enumerate(others, 120):
        assert got[i].split("\n")[1:] == body


def test_every_layout_of_a_host_has_its_template(spark):
    draw = random.Random(8)
    layouts = [f"<body><div class=l{'abcdef'[n]}><h1>{{title}}</h1>{{body}}<p>Rules of part {n}, which all who write here must read.</p></div></body>" for n in range(6)]
    made = [site(draw, layouts[n % 6]) for n in range(60)]
    got = texts_of(spark, [page for page, _ in made])
    for i, (_, body) in enumerate(made):
        assert got[i].split("\n")[1:] == body


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div><p>Before.<p>See <a href=1>the whole report of the committee</a>.<p>After.</div>", "Before.\nSee the whole report of the committee.\nAfter."),
        ("<div><p>one<p><a href=1>a paragraph that is one link</a></div>", "one\na paragraph that is one link"),
        ("<div>text<ul><li>plain item<li><a href=1>linked item</a></ul></div>", "text\nplain item\nlinked item"),
        ("<div>text<ul><li><a href=1>A sentence in a link.</a><li><a href=2>more</a></ul></div>", "text\nA sentence in a link.\nmore"),
        ("<div>text<ul><li><a href=1>only item</a></ul></div>", "text\nonly item"),
        ("<div>text<ul><li><a href=1>Home</a> |<li><a href=2>News &amp; more</a><ul><li><a href=3>Local</a></ul></ul></div>", "text"),
        ("<div>text<ul><li>Parts<ul><li><a href=1>One</a><li><a href=2>Two</a></ul></ul></div>", "text\nParts\nOne\nTwo"),
    ],
)
def test_only_whole_lists_of_links_are_menus(page, text):
    assert wrapper.main_text(page, None) == text


@pytest.mark.parametrize("attribute", [
    'style="overflow: hidden"', "style='overflow:hidden'", 'title="hidden gem"', 'data-hidden="false"', 'data-hidden', 'data-id="comment"', 'data-role="search"',
    'aria-hidden="false"', 'aria-label="class=comments"', 'x-class="sidebar"', 'alt="id=footer"', 'data-x="a" data-y=\'role="navigation"\'', 'class = "lead"', 'class=text id=p1',
])
def test_values_are_not_taken_for_names(attribute):
    _, blocks = wrapper.parse(f"<body><article><p {attribute}>Kept text.</p></article></body>")
    assert [(b.text, b.content) for b in blocks] == [("Kept text.", True)]


@pytest.mark.parametrize("attribute", ["hidden", 'HIDDEN=""', 'style="color: red" hidden', 'aria-hidden="true"', "role=navigation", 'Class="comments"', "data-x='1'id='sidebar'"])
def test_names_still_count(attribute):
    _, blocks = wrapper.parse(f"<body><article><p {attribute}>Gone text.</p></article></body>")
    assert [b.content for b in blocks] == [False]


@pytest.mark.parametrize("junk", ["<!", "<?", "<script ", "<style x=", "<script \"", "<p class='", "<!-", "<a href=\"x"])
def test_unclosed_markup_stays_linear(junk):
    started = time.perf_counter()
    wrapper.parse("<body><p>Text.</p>" + junk * 200_000)
    assert time.perf_counter() - started < 5


def shape(text):
    return wrapper.outline(*wrapper.parse(text))[1]


def slow_weight(t, p):
    """The best weight of an order-keeping matching of trees whose children are all known to each other, by trying all."""
    if t[0].split(" ")[0] != p[0].split(" ")[0]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), best(xs[1:], ys[1:]) + slow_weight(xs[0], ys[0]))

    return (3 if t[0] == p[0] else 1) + best(t[1], p[1])


def test_alignment_equals_the_definition():
    draw = random.Random(15)

    def tree(depth):
        # Both names are among the children, so none is unknown to the other side.
        return [draw.choice(["a", "a x"]), [["a", []], ["a x", []], *(tree(depth - 1) for _ in range(draw.randint(0, 2)))] if depth else []]

    for _ in range(60):
        a, b = tree(2), tree(2)
        both = wrapper.Alignment(a, b)
        assert both.weight(a, b) == slow_weight(a, b)


@pytest.mark.parametrize("page", [
    "<body><div class=w><div class=top>a</div><div class=x><h1>t</h1><p>b</p></div></div></body>",
    "<body><div class=w><div class=v><div class=top>a</div><div class=x><h1>t</h1><p>b</p></div></div></div></body>",
    "<body><div class=top>a</div><div class=x><div class=w><h1>t</h1><p>b</p></div></div></body>",
    "<body><div class=top>a</div><div class=y><h1>t</h1><p>b</p></div></body>",
])
def test_elements_around_are_seen_through(page):
    template = shape("<body><div class=top>a</div><div class=x><h1>t</h1><p>b</p></div></body>")
    for left, right in ((template, shape(page)), (shape(page), template)):
        known = dict(zip((n[0] for n in wrapper._preorder(left)), wrapper.paths(left)))
        places = dict(zip((n[0] for n in wrapper._preorder(right)), wrapper.located(left, right)))
        assert all(places[tag] == known[tag] for tag in ("div top", "h1", "p"))


def test_inserted_elements_do_not_hide_the_template(spark):
    draw = random.Random(9)
    made = []
    for i in range(24):
        page, body = site(draw, LAYOUT)
        if i % 2:
            name = "w" + "abcdefghijklm"[i // 2]
            page = page.replace("<body>", f"<body><div class={name}>").replace("</body>", "</div></body>")
        made.append((page, body))
    got = texts_of(spark, [page for page, _ in made])
    for i, (_, body) in enumerate(made):
        assert got[i].split("\n")[1:] == body


def test_merged_templates_hold_all_places_once():
    a, b = shape("<body><div class=x><p>t</div></body>"), shape("<body><div class=w><div class=x><p>t<ul><li>1</ul></div></div><table><tr><td>1</table></body>")
    whole = wrapper.merged([a, b])
    names = [n[0] for n in wrapper._preorder(whole)]
    assert len(names) == len(set(names)) and {"div x", "p", "ul", "li", "table"} <= set(names) and "div w" not in names


def test_alignment_of_odd_shapes_ends_soon():
    started = time.perf_counter()
    template = shape("<body>" + "".join(f"<div class={'abcdefgh'[i % 8]}{'xyz'[i % 3]}><p>t<ul><li>1</ul></div>" for i in range(200)) + "</body>")
    nested = shape("<body>" + "".join(f"<div class={'qrstuv'[i % 6]}>t" for i in range(55)) + "<p>x</body>")
    wide = shape("<body>" + "".join(f"<div class={'qrstuv'[i % 6]}><p>a<h{1 + i % 5}>b</h{1 + i % 5}></div>" for i in range(600)) + "</body>")
    for page in (nested, wide, template):
        assert len(wrapper.located(template, page)) == len(list(wrapper._preorder(page)))
        assert len(wrapper.located(page, template)) == len(list(wrapper._preorder(template)))
    assert time.perf_counter() - started < 20
