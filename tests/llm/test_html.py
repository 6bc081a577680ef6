import html as entities
import random
import re
import time

import pytest

from sievework.llm import html
from sievework.llm.html import extract, main_text
from sievework.llm.queries import op2_html

LONG = "A paragraph, with commas, and enough words in it to count as running text of an article."
OTHER = "Another one, which goes on, and on, until there is enough of it to be taken for an article's text."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>no title</title>{head}</head><body>{body}</body></html>"


CASES = {
    "article": (page(f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>{OTHER}</p></article><footer>&copy; x</footer>"), ["Title", LONG, OTHER]),
    "divs": (page(f"<div class='menu'><ul><li><a>One</a><li><a>Two</a></ul></div><div id=content><h2>Head</h2><p>{LONG}<p>{OTHER}</div><div class=sidebar><p>{LONG}</p></div>"), ["Head", LONG, OTHER]),
    "comments": (page(f"<main><p>{LONG}</p><p>{OTHER}</p><section id='comments'>" + f"<div class='comment'><p>{OTHER * 4}</p></div>" * 9 + "</section></main>"), [LONG, OTHER]),
    "comment articles": (page(f"<div class=post><p>{LONG}</p></div><div class='comment-list'>" + f"<article><p>{OTHER}</p></article>" * 5 + "</div>"), [LONG]),
    "notice, ad and form": (page(f"<div class='cookie-notice'><p>{OTHER}</p></div><article><p>{LONG}</p><div class='ad'>Buy, buy, buy now</div><form><p>{OTHER}</p><input></form><p>{OTHER}</p><aside><p>{LONG}</p></aside></article>"), [LONG, OTHER]),
    "page and article headers": (page(f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p></article>"), ["Title", LONG]),
    "raw text": (page(f"<article><script>var a='</p><p>x';if(a<b){{}}</script><p>{LONG}</p><style>p>b{{}}</style><!-- <p>gone</p> --></article>"), [LONG]),
    "entities and space": (page(f"<article><p>A&nbsp;&amp;\n\t B&#233;&lt;i&gt; x<br>y <b>bo</b>ld, {LONG}</p></article>"), [f"A & Bé<i> x y bold, {LONG}"]),
    "unclosed": (f"<html><body><article><p><b>{LONG}<br><p>{OTHER} cut of", [LONG, OTHER + " cut of"]),
    "cut in a tag": (f"<article><p>{LONG}</p><p>{OTHER}<a href='x", [LONG, OTHER]),
    "cut in an entity": (f"<article><p>{LONG} &am", [LONG + " &am"]),
    "lists and tables": (page(f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>c  d</pre></article>"), [LONG, "one", "two", "a", "b", "c d"]),
    "body class": (page(f"<div class='with-sidebar'><article><p>{LONG}</p></article><div class='sidebar'>side</div></div>"), [LONG]),
    "quotes in attributes": (page(f"<article><p title=\"a>b\" data-x='<p>'>{LONG}</p><p class=it's>{OTHER}</p></article>"), [LONG, OTHER]),
    "short": (page("<nav><a>x</a></nav><article><p>Hi.</p></article>"), ["Hi."]),
    "hidden": (page(f"<article><p>{LONG}</p><div style='display: none'>x</div><p hidden>y</p><p aria-hidden=true>z</p></article>"), [LONG]),
    "text right in a div": (page(f"<div><a>menu</a></div><div>{LONG} {OTHER}</div>"), [f"{LONG} {OTHER}"]),
    "menu and remarks without a tag": (f"<main><div class=top-links><a href=/>Home</a> <a href=/a>About</a></div><p>{LONG}</p><p>{OTHER}</p><ol class=responses><li><p>{OTHER}</p></li><li><p>{LONG}</p></li></ol></main>", [LONG, OTHER]),
    "feedback beside the article": (page(f"<article><p>{LONG}</p><p>{OTHER}</p></article><div class='user-feedback'><p>{OTHER}{OTHER}</p></div>"), [LONG, OTHER]),
    "one word of a name": (page(f"<article><p>{LONG}</p><div class='legal-analysis'><p>{OTHER}</p></div><table class='data tools'><tr><td>a<td>b</table></article>"), [LONG, OTHER, "a", "b"]),
    "no names": (page(f"<div><div><a href=/>Home</a><a href=/b>Blog</a></div><div><h1>T</h1><p>{LONG}</p><p>{OTHER}</p></div><div><p><a href=x>other one</a></p></div></div>"), ["T", LONG, OTHER]),
    "remarks by structure": (page(f"<div><p>{LONG}</p><p>{OTHER}</p></div><div>" + f"<div class=z><p><cite>Bob</cite></p><p>{OTHER}{OTHER}</p></div>" * 3 + "</div>"), [LONG, OTHER]),
    "links to reply": (page(f"<div><p>{LONG}</p></div><ul>" + f"<li><p>{OTHER}</p><p><a href=#>Reply</a></p></li>" * 3 + "</ul>"), [LONG]),
    "dates in a list": (page(f"<div><p>{LONG}</p><ul>" + "<li><time>1990</time> it began, and went on</li>" * 3 + "</ul></div>"), [LONG] + ["1990 it began, and went on"] * 3),
    "dated sections": (page("<article>" + f"<section><h2>S</h2><p><time>1990</time></p><p>{LONG}</p></section>" * 2 + "</article>"), ["S", "1990", LONG] * 2),
    "heading of links": (page(f"<article><h1>T</h1><p>{LONG}</p><h3>Related</h3><ul><li><a href=a>one thing</a></li><li><a href=b>two</a></li></ul></article>"), ["T", LONG]),
    "links between running text": (page(f"<article><p>{LONG}</p><ul><li><a href=a>one thing</a></li></ul><p>{OTHER}</p></article>"), [LONG, "one thing", OTHER]),
    "a blog's page": (
        page(
            f"<div id=page class=site><div class='site-header'><h1>My site</h1><p>{OTHER}</p></div><div id=content class='site-content'><div id=primary class='content-area'><div class='post hentry'>"
            f"<div class='post-header'><h1>Title</h1></div><div class='entry-content'><p>{LONG}</p><div class='sponsored-content'><p>{OTHER}</p></div><h2>Part</h2><p>{OTHER}</p></div><div class='entry-footer'><a href=t>tag</a> <a href=u>tags</a></div></div>"
            f"<div class='related-posts'><h3>Related</h3><p>{OTHER}</p></div><div id=comments class='comments-area'><h2>2 thoughts</h2><ol class='comment-list'><li class=comment><p>{OTHER}</p></li></ol></div></div>"
            f"<div id=secondary class='widget-area'><p>{OTHER}</p></div></div></div>"
        ),
        ["Title", LONG, "Part", OTHER],
    ),
    "frame": (page(f"<div class='widget'><div><p>{LONG}</p><p>{OTHER}</p></div></div><div class=sidebar><p>side text here</p></div>"), [LONG, OTHER]),
    "equal containers": (page(f"<section><div><p>{LONG}</p></div><div class=right-box><p>{LONG}</p></div></section>"), [LONG, LONG]),
    "header with the title": (page(f"<article><header><h1>T</h1></header><div class=body><p>{LONG}</p><p>{OTHER}</p></div></article>"), ["T", LONG, OTHER]),
    "link list": (page("<div><p><a href=1>" + LONG + "</a></p></div>" + f"<div><p>{OTHER}</p></div>"), [OTHER]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    source, blocks = CASES[name]
    assert main_text(source) == "\n\n".join(blocks)


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><head><title>x</title></head>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<div>" * 20_000 + LONG) == LONG
    assert main_text("<" * 5000 + "a " + "<p " * 3000).startswith("<")
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 20_000)) == 20_000 * (len(LONG) + 2) - 2
    assert main_text("<a " + "\"'=" * 30_000) == ""


def test_depth_is_no_cost():
    began = time.perf_counter()
    assert main_text("<div>" * 40_000 + LONG) == LONG
    once = time.perf_counter() - began
    began = time.perf_counter()
    main_text("<p><ul><li>" * 15_000 + "</i></li>" * 15_000 + LONG)
    main_text("<div>" * 20_000 + "<li></li></x>" * 20_000)
    assert once < 4 and time.perf_counter() - began < 12  # a generous bound: quadratic time takes minutes


def plain_choice(page):
    """The chosen container by its definition: every container's points from all blocks, one by one."""
    _, nodes, blocks = html.parse(page)
    html.exclude(nodes, blocks)
    blocks = [b for b in blocks if not b.owner.out]

    def up(node):
        out = []
        while node is not None:
            out.append(node)
            node = node.parent
        return out

    best = None
    for node in nodes:
        points = text = linked = 0
        for b in blocks:
            chain = up(b.owner)
            if node not in chain:
                continue
            text, linked = text + len(b.text), linked + b.linked
            steps = chain.index(node) + (0 if b.owner.tag in ("p", "li") else 1)
            if b.owner.tag in ("h1", "h2") or 2 * b.linked > len(b.text) or not 1 <= steps <= 5:
                continue
            points += (0.5 if any(x.mark == 1 for x in chain) else 1) * (1 + b.text.count(",") + min(3, len(b.text) / 100)) / steps
        score = points * (1 - (linked / text if text else 0)) * (2.2 if node.home else 1)
        if score > 1e-9 and (best is None or score > best[0] + 1e-9):
            best = (score, node.at)
    return best and best[1]


def test_choice_against_its_definition():
    rng = random.Random(5)
    words = ["one,", "two", "three", "four,", "five"]

    def tree(depth):
        out = ""
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["p", "p", "div", "section", "h2", "article", "a"]) if depth else rng.choice(["p", "h2", "a"])
            text = " ".join(rng.choice(words) for _ in range(rng.choice([2, 30, 80])))
            name = rng.choice(["", "", " class='legal-analysis'", " class=sidebar"])
            out += f"<div><a href=x>{text}</a></div>" if kind == "a" else f"<{kind}>{text}</{kind}>" if kind in ("p", "h2") else f"<{kind}{name}>{tree(depth - 1)}</{kind}>"
        return out

    for _ in range(150):
        source = f"<body>{tree(4)}</body>"
        _, nodes, blocks = html.parse(source)
        html.exclude(nodes, blocks)
        got = html.choose(nodes, [b for b in blocks if not b.owner.out])
        want = plain_choice(source)
        assert (got and got.at) == want or abs(html.value(got) - html.value(nodes[want])) < 1e-9, source


def test_query(spark, tmp_path):
    rows = [(1, "u", CASES["article"][0], "t"), (2, None, None, "t"), (2, None, None, "t"), (None, "v", "<p>x", "t")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, op2_html(spark, str(tmp_path)).collect()), key=str)
    text = f"Title\n\n{LONG}\n\n{OTHER}"
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (2, None, "", 0), (None, "v", "x", 1)], key=str)


def test_driver_pages(spark):
    """Against a direct reading of the pages' one template."""
    path = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    for r in op2_html(spark, path).collect():
        own = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        own = re.sub(r"<[^>]*\Z|</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", own)))
        assert r.text == "\n\n".join(x for x in (" ".join(entities.unescape(y).split()) for y in own.split("\0")) if x)


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id int, html string")).count() == 0
