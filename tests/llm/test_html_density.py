import html
import re
import time

import pytest
from tablewright.llm import html_density as h
from tablewright.llm.queries import op1_html_extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header><a href="/">Site header</a></header><nav><ul><li><a href="/a">Menu a</a><li><a href="/b">Menu b</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, do you agree to that?</div><div id="content">
<div class="post"><h1>The &amp; title</h1><p>First  paragraph with an <a href="x>y">inline&nbsp;link</a> and
more text that is long enough to count as prose.<p>Second one, <b>bold <i>and</b> so on</i>.<br>After the break &#233;&eacute; &lt;p&gt;.
<ul><li>item one<li>item two</ul><table><tr><td>cell a<td>cell b</table></div>
<div class="AdBox">Buy this now, buy it today, buy all of it.</div></div>
<aside><p>Sidebar text that is long as well, and has several words.</p></aside>
<section id="comments"><article class="comment"><p>A reader says many things here, and at great length.</p></article></section>
<form><p>Your mail address please</p><input value="x"></form><!-- a <p>comment</p> --><footer>&copy; Footer</footer>"""
WANT = [
    "The & title", "First paragraph with an inline link and more text that is long enough to count as prose.",
    "Second one, bold and so on.", "After the break éé <p>.", "item one", "item two", "cell a", "cell b",
]


def test_page_without_semantic_elements():
    assert h.main_text(PAGE).split("\n") == WANT


def test_page_with_article():
    page = PAGE.replace('<div class="post">', "<article>").replace("</table></div>", "</table></article>")
    assert h.main_text(page).split("\n") == WANT
    short = '<body><nav><a href="/">A long menu entry that goes on</a></nav><article><h1>Hi</h1></article><footer>Much longer than it</footer>'
    assert h.main_text(short) == "Hi"


@pytest.mark.parametrize("page", [None, "", " ", "<p", "<!--", "<!-- x", "<script>var x", "<body></body>", "</p></b>", "<a href='x"])
def test_nothing(page):
    assert h.main_text(page) == ""


def test_deep_and_broken_pages():
    assert h.main_text("<div>" * 30000 + "deep text") == "deep text"
    assert h.main_text("plain text &amp more") == "plain text & more"
    assert h.main_text("<body><p>cut off in the mid &am") == "cut off in the mid &am"
    assert h.main_text('<p title="a>b">x</p><p title="never closed>y</p>') == "x\ny"
    assert "last" in h.main_text("<p>" + "word " * 200000 + "last")


def test_two_parts_around_an_advert():
    part = "<div class=text><p>A long paragraph of prose number {}, with words and words and words in it.</p><p>And {} more of it, also words.</p></div>"
    page = f"<body><div>{part.format(1, 2)}<div class=ad>Buy</div>{part.format(3, 4)}</div></body>"
    assert [x.split(",")[0] for x in h.main_text(page).split("\n")] == [
        "A long paragraph of prose number 1", "And 2 more of it", "A long paragraph of prose number 3", "And 4 more of it",
    ]


def plain(page):
    """What the generated pages hold, by their one template."""
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p|br)>", re.sub(r"</?b>", "", article))
    return "\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))


def test_query_on_generated_pages(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op1_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "old", 5)], "page_id long, html string, text string, extra int")
    out = h.extract_main_text(df)
    assert out.columns == ["page_id", "extra", "text", "n_chars"]
    assert out.collect()[0].asDict() == {"page_id": 1, "extra": 5, "text": "", "n_chars": 0}
    assert h.extract_main_text(df.limit(0)).count() == 0


def test_long_attribute_values():
    """op1_html_extraction: a quoted value of any length is no text, and unclosed quotes cost no more than a scan."""
    for n in (10, 3000, 30000):
        for q in "\"'":
            payload = "data:image/svg+xml,<svg>" + "<g/>words " * n + "</svg>"
            assert h.main_text(f"<body><p>before</p><img src={q}{payload}{q} alt=x><p>after</p>") == "before\nafter"
    for part in ("<x \">", "<a \"", "<a '\">", '<x "><x" ', "<a b='>"):
        for tail in ("", "'", '"'):
            begin = time.process_time()
            h.parse(part * 40000 + tail)
            assert time.process_time() - begin < 5


ARTICLE = "<h1>Title</h1><p>A long paragraph of prose, with words and words and words in it.</p><p>And more of it, also words.</p>"
COMMENTS = '<div class="comment-list"><p>A reader says many things, at great length.</p></div>'


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "layout-banner", "page-with-comments", "widget Blog"])
def test_wrappers_with_names_of_other_parts(name):
    """op1_html_extraction: a name does not cut what holds the article."""
    want = ["Title", "A long paragraph of prose, with words and words and words in it.", "And more of it, also words."]
    ad = '<div class="ad">Buy this now</div><div class="sidebar"><p>Read this as well.</p></div>'
    for inner in (f"<div>{ARTICLE}</div>", f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>", ARTICLE):
        for more in ("", COMMENTS, COMMENTS.replace("<p>", "<article><p>").replace("</p>", "</p></article>")):
            page = f'<body><div class="{name}">{inner}{ad}{more}</div></body>'
            assert h.main_text(page).split("\n") == want
            assert h.main_text(f"<body><p>Short line.</p>{page[6:]}").split("\n")[-3:] == want
    long = COMMENTS.replace("length", "length and on and on" * 30)
    for names in ("comments", "comment-list"):
        page = f'<body><div class="post">{ARTICLE}</div><div class="{names}">{long}</div></body>'
        assert h.main_text(page).split("\n") == want


def test_names_alone_never_empty_a_page():
    assert h.main_text('<body><div class="sidebar"><p>One half.</p></div><div class="widget"><p>The rest.</p></div></body>')


class Node:
    """A tree as it is written, for the plain version below."""

    def __init__(self, tag, items):
        self.tag, self.items = tag, items
        self.nodes = [x for x in items if isinstance(x, Node)]

    def html(self):
        return f"<{self.tag}>{''.join(x.html() if isinstance(x, Node) else x for x in self.items)}</{self.tag}>"

    def walk(self):
        yield self
        for x in self.nodes:
            yield from x.walk()

    def text(self):
        return "".join(x.text() if isinstance(x, Node) else "".join(x.split()) for x in self.items)

    def counts(self, inside_link=False):
        """Characters, structural tags and links below, linked characters, links."""
        inside = inside_link or self.tag == "a"
        below = [x.counts(inside) for x in self.nodes]
        own = sum(len("".join(x.split())) for x in self.items if isinstance(x, str))
        tags = sum(b[1] + (x.tag == "a" or x.tag not in h.INLINE) for b, x in zip(below, self.nodes))
        return (
            own + sum(b[0] for b in below), tags, (own if inside else 0) + sum(b[2] for b in below),
            (self.tag == "a") + sum(b[3] for b in below),
        )

    def own(self):
        return sum(len("".join(x.split())) if isinstance(x, str) else x.own() if x.tag in h.INLINE else 0 for x in self.items)

    def structure(self):
        return [y for x in self.nodes for y in (x.structure() if x.tag in h.INLINE else [x])]


def plain_choice(body):
    """The main block by its definition, everything counted anew for every node."""
    import math

    of_body = body.counts()[2] / max(1, body.counts()[0])

    def density(c, t, lc, links):
        if c <= 0:
            return 0.0
        t, links = max(1, t), max(1, links)
        base = math.log(c / max(1, c - lc) * lc + of_body * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / links) + math.e - 1) / math.log(base + math.e - 1)

    def weight(x):
        total = sum(density(*y.counts()) for y in x.structure())
        if own := x.own():
            total += density(own, 1, min(own, x.counts()[2]), x.counts()[3])
        return total * (h.PREFERRED if x.tag in h.WHOLE else 1)

    every = [x for x in body.walk() if x is body or x.tag not in h.INLINE and x.text()]
    best = max(every, key=lambda x: (round(weight(x), 6), x.counts()[0], -every.index(x)))
    path = [x for x in every if best in x.walk()]  # from the body to the main block
    chosen = best
    for x in reversed(path[1:]):
        if x is not best and x.tag in h.WHOLE:
            a, b = x.counts(), chosen.counts()
            more = density(*(i - j for i, j in zip(a, b)))
            if a[0] - a[2] <= 2 * (b[0] - b[2]) or more >= h.SIMILAR * density(*b):
                chosen = x
    return chosen


def random_tree(random, depth=0):
    tags = ["div", "section", "article", "ul", "p"] if depth < 4 else ["p"]
    tag = "body" if not depth else random.choice(tags)
    items = []
    for _ in range(random.randint(1, 5)):
        kind = random.random()
        if tag not in ("p",) and kind < 0.6 and depth < 5:
            items.append(random_tree(random, depth + 1))
        elif kind < 0.7:
            items.append(Node(random.choice(["a", "b", "span"]), ["w" * random.randint(1, 30)]))
        else:
            items.append("x" * random.choice([1, 5, 40, 300]) + " ")
    return Node(tag, items)


def test_choice_against_its_definition():
    import random

    r, varied = random.Random(5), 0
    for _ in range(300):
        body = random_tree(r)
        want = plain_choice(body)
        page = body.html()
        got = h.main_text(page)
        kept = "".join(got.split())
        if len(list(want.walk())) < 2:
            continue
        # list-of-links blocks aside, all of the chosen block's text is in the result
        if all(x.counts()[3] < h.LINKS for x in want.walk()):
            assert want.text() in kept, page
        raw = type("Raw", (h.Measures,), {"of": lambda self, c, t, lc, n: float(c)})
        varied += h.main_text(page, raw) != got
    assert varied > 50  # the densities decide


@pytest.mark.parametrize("name", ["has-sidebar", "site menu-open", "layout header-fixed"])
def test_wrappers_around_everything(name):
    want = ["Title", "A long paragraph of prose, with words and words and words in it.", "And more of it, also words.", "The price is right."]
    article = ARTICLE + '<p class="share-price">The price is right.</p>'
    for inner in (f"<article>{article}</article>", f"<main>{article}</main>"):
        assert h.main_text(f'<body><div class="{name}"><nav>Menu</nav>{inner}</div><footer>f</footer></body>').split("\n") == want


def test_lists_of_links_inside_main():
    links = "".join(f'<li><a href="/{i}">Another story number {i}</a></li>' for i in range(30))
    for wrap in ("main", "article", "div"):
        text = h.main_text(f"<body><{wrap}>{ARTICLE * 3}<ul>{links}</ul></{wrap}></body>")
        assert "Another story" not in text and text.count("long paragraph") == 3


def test_sections_and_short_paragraphs():
    """Equal sections are all found, with and without an element that says so; so are short paragraphs between them."""
    sections = "".join(f"<section><h2>Part {i}</h2><p>Words of part {i}, {'and on ' * 30}</p><p>Short.</p></section>" for i in range(12))
    side = '<div><p>Seen today</p><p>By nobody</p><a href="/">home</a></div>'
    for wrap in ("article", "main", "div"):
        text = h.main_text(f"<body>{side}<{wrap}>{sections}</{wrap}>{side}</body>")
        assert text.count("Short.") == 12 and text.count("Part ") == 12 and "nobody" not in text


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>a b</p>", "x", "y", 1)], "page_id long, html string, __html string, TEXT string, N_Chars int")
    out = h.extract_main_text(df)
    assert out.columns == ["page_id", "__html", "text", "n_chars"] and out.first()[1:] == ("x", "a b", 3)
