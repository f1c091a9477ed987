import html
import math
import random
import re
import time

import pytest

from tidemark.llm.html_text import Page, extract, main_text


def test_articles_of_whole_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = " ".join(b for b in blocks if b)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


PARA = "<p>A paragraph of the article with enough words to make it dense.</p>"


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []), ("plain text", ["plain text"]), ("<p>a<p>b", ["a", "b"]), ("<body><!-- open", []), ("a <!-- b --> c", ["a c"]),
        ("<a title=it's>k</a> <b>x", ["k x"]), ("<ul><li>a<li>b</ul>", ["a", "b"]), ("a&nbsp;&lt;b&gt;&#233;", ["a <b>é"]),
        ("<article><header><h1>T</h1></header><p>in<i>line</i><br>x</p><div class='comments'><p>reader</p></div></article><form>f</form>", ["T", "inline x"]),
        ("<script>if (a < b) { x('</p>') }</script><style>p{}</style><p>t</p>", ["t"]),
        ("<div role=navigation>m</div><div id='cookie-notice'>c</div><p hidden>h</p><p>t</p><aside>s</aside>", ["t"]),
    ],
)
def test_shapes(page, blocks):
    assert main_text(page) == blocks


def test_links_lower_the_density_and_thresholds_drop_what_is_beside():
    menu = "<div>" + "".join(f"<a href={i}>link {i}</a> " for i in range(30)) + "</div>"
    got = main_text(f"<body>{menu}<div>{PARA * 6}</div>{menu}</body>")
    assert got == ["A paragraph of the article with enough words to make it dense."] * 6


def test_densities_are_sums_of_children():
    p = Page(f"<div>{PARA}{PARA}</div><div><a href=x>y</a></div>")
    density, total, *_ = p.densities()
    for i in range(len(p.tag)):
        assert total[i] == pytest.approx(sum(density[j] for j in range(len(p.tag)) if p.parent[j] == i))


def test_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article>" + PARA * 5000 + "</article>"), (3, "u", "<p>x"), (None, "u", "<p>y"), (4, "u", "<div>" * 1500 + "deep"), (5, "u", "<" * 3000)]
    got = extract(spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {(r.page_id, r.text) for r in got if r.page_id in (1, 2, None)} == {(1, ""), (2, ""), (None, "y")}
    assert max(r.n_blocks for r in got) == 5000
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "A long sentence without any link that goes on for quite a while, so that its element is denser than the page. " * 3


def test_several_articles_and_text_outside_of_them():
    long, para = LONG.strip(), "A paragraph of the article with enough words to make it dense."
    links = "<ul>" + "".join(f"<li><a href={i}>link {i}</a></li>" for i in range(20)) + "</ul>"
    a, b = f"<article><h2>A</h2>{PARA * 20}</article>", f"<article><p>{LONG}</p></article>"
    got = ["A", *[para] * 20, long]
    assert main_text(f"<main>{a}{b}{links}</main>") == got
    assert main_text(f"{links}{a}<section><p>{LONG}</p></section>{links}") == got
    assert main_text(f"{links}<div><div>{PARA * 9}</div><article><p>{LONG}</p><p>{LONG}</p></article></div>") == [para] * 9 + [long] * 2


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content has-sidebar'><article>{}</article></div>", "<div id=page-with-comments><div>{}</div></div>", "<main><div class='social-sciences'>{}</div></main>", "<div style='overflow:hidden'>{}</div>", '<div title="a hidden gem">{}</div>',
        "<div data-id=related>{}</div>", "<div data-x='class=ad' id=x>{}</div>", "<div data-role=navigation>{}</div>", "<div data-hidden>{}</div>", "<div class='has-sidebar'><div class=widget>w</div><div>{}</div></div>",
    ],
)
def test_names_and_values_that_only_look_like_noise(page):
    assert main_text(page.format(PARA * 5)) == ["A paragraph of the article with enough words to make it dense."] * 5


@pytest.mark.parametrize("beside", ["<div CLASS=comments>{}</div>", "<div id = 'related'>{}</div>", "<p hidden>{}</p>", "<p hidden=''>{}</p>", "<div class=x role='navigation'>{}</div>", "<div aria-hidden=true>{}</div>"])
def test_real_noise_still_goes(beside):
    assert main_text(f"<div class=has-sidebar>{beside.format('other words ' * 9)}<article>{PARA * 5}</article></div>") == ["A paragraph of the article with enough words to make it dense."] * 5


def test_most_of_the_text_under_a_noise_name():
    para = "A paragraph of the article with enough words to make it dense."
    assert main_text(f"<div class=comments>{PARA * 5}</div>") == [para] * 5
    assert main_text(f"<div class=ad>{PARA * 5}</div><article><p>short</p></article>") == ["short"]
    assert main_text(f"<div class=has-sidebar>{PARA * 5}</div><article><p>short</p></article>")[:5] == [para] * 5


TALK = "<p>What a reader has to say about it, at some length and without any link in it at all.</p>"
WANT = ["A paragraph of the article with enough words to make it dense."] * 5


@pytest.mark.parametrize(
    "page",
    [
        "<article>{a}</article><div class='post-comments'>{c}</div>", "<div>{a}</div><div class='post-comments'>{c}</div>", "<main>{a}</main><section class=comments><article>{c}</article></section>",
        "<main>{a}</main><section class=comments-area>{c}</section>", "<div id=main>{a}</div><div class=user-comments>{c}</div>", "<article>{a}</article><div id=comments><article>{c}</article></div>",
        "<article>{a}<ol class=commentlist><li>{c}</li></ol></article>", "<article>{a}<div class=comment-thread>{c}</div></article>", "<main><article>{a}</article><article class='comment'>{c}</article></main>",
        "<div id='left-rail'>{c}</div><article>{a}</article>", "<article>{a}</article><div class='layout-sidebar-right'>{c}</div>", "<form action=/page><div>{a}</div></form>", "<form><article>{a}</article><div class=comments>{c}</div></form>",
        "<article>{a}</article><form><p>Your name</p><input name=q></form>", "<div class=sidebar-layout><article>{a}</article></div><p hidden>x</p>", "<table><tr><td>{a}</td><td class=sidebar>{c}</td></tr></table>", "<div class='page has-comments'>{a}</div>",
    ],
)
@pytest.mark.parametrize("size", [1, 40])
def test_comments_sidebars_and_forms(page, size):
    assert main_text(page.format(a=PARA * 5, c=TALK * size)) == WANT


def test_short_parts_beside_the_densest_one():
    page = f"<div id=top><a href=x>site</a></div><div id=page><div><h2>Title</h2></div><div>{PARA * 5}</div><div><p>End.</p></div><div><a href=a>next</a></div></div>"
    assert main_text(page) == ["Title", *WANT, "End."]


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", ("<b>" * 20_000) + "</i>" * 20_000 + "x", "<p><table><td>" + "<div>" * 20_000 + "x", "<ul><li>" * 10_000 + "x", "<b></p>" * 20_000 + "x"])
def test_deep_pages_take_linear_time(page):
    start = time.perf_counter()
    assert main_text(page) == ["x"]
    assert time.perf_counter() - start < 3


def plain_choice(p):
    """Densities and the chosen subtree of a page, straight from the definitions, node by node."""
    n = len(p.tag)
    below = lambda i: [j for j in range(n) if j == i or (j and any(k == i for k in up(j)))]

    def up(j):
        while j > 0:
            j = p.parent[j]
            yield j

    def size(nodes):
        return sum(len(t.strip()) for k, t in p.runs if k in nodes)

    linked = lambda j: p.tag[j] == "a" or any(p.tag[k] == "a" for k in up(j))
    every = set(range(n))
    share = size({j for j in every if linked(j)}) / max(size(every), 1)
    density = []
    for i in range(n):
        tree = set(below(i))
        c, lc = size(tree), size({j for j in tree if any(p.tag[k] == "a" for k in [j, *up(j)] if k in tree)})
        t, lt = max(len(tree) - 1, 1), max(sum(p.tag[j] == "a" for j in tree), 1)
        if not c:
            density.append(0.0)
            continue
        base = math.log(c / max(c - lc, 1) * max(lc, 0) + share * c + math.e)
        ratio = max(c / max(lc, 1) * t / lt, 1.0)
        density.append(c / t * (math.log(ratio) / math.log(base + 1e-9) if base > 1 + 1e-9 else math.log(ratio + 1)))
    sums = [sum(density[j] for j in range(n) if j and p.parent[j] == i) for i in range(n)]
    return density, sums


def test_densities_equal_the_definitions():
    rng = random.Random(4)
    for _ in range(25):
        parts = [rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "some words here ", "x", LONG, "<b>", "</b>"]) for _ in range(40)]
        p = Page("".join(parts))
        density, total, *_ = p.densities()
        want, sums = plain_choice(p)
        assert density == pytest.approx(want) and total == pytest.approx(sums)
        kept = p.kept_nodes()
        assert kept[max(range(len(sums)), key=lambda i: total[i])]
