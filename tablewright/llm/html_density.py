"""Main-text extraction by composite text density.

A page is parsed into a tree once. Parts whose element, role or class says that they are not the article (menus,
forms, adverts, comments ...) are cut. A class or id alone does not cut what holds the page's article or main element or
most of its unlinked text, and cuts nothing where nothing else would remain. For every remaining node the density is its
characters per tag, adjusted by the characters and tags inside links; a node's sum is the sum of its children's
densities. Formatting inside running text is no structure: its tags do not count and its children are those of the node
around it.

The node with the largest sum is the main block; ``article`` and ``main`` count ``PREFERRED`` times. From there the
choice climbs to an ``article`` or ``main`` around it if what that adds is no more text than is chosen already, or about
as dense. The smallest density on the path from the body to the main block is the threshold, and every part outside that
reaches a share of it (``SIMILAR``; beside an ``article`` or ``main`` a multiple, ``BESIDE``) contributes its own
largest-sum subtree, as does a heading directly before. Lists of links inside are left out again.

Pages are independent: no shuffle and no state. All passes over a tree are loops, so depth is not bounded by the
stack. Defined results: a null or empty page, or one without text, gives an empty text; pages may be of any length;
markup that is cut off or badly nested is closed as browsers do; of equal sums the node of more text is chosen, then the
outer one; repeated pages give equal rows; an empty table gives an empty result; extra columns pass through, and those
with the name of a result (in any case) are replaced by it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, free_name, others, text_steps

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul caption legend".split()
)
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCKS - frozenset("br td th tr tbody thead tfoot caption html body option legend".split())
#: An open element of the key's kind ends where one of the values begins, up to the given boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
IMPLIED["tfoot"] = IMPLIED["thead"] = IMPLIED["tbody"]
#: Never part of an article's text.
CUT = frozenset(
    "script style noscript template iframe object embed canvas audio video svg math form button select textarea input "
    "datalist nav footer aside menu dialog head title xmp noembed noframes plaintext map".split()
)
CUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form".split()
)
#: Parts of class names and ids that mark what is not the article.
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login paywall "
    "sidebar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc toolbar footer "
    "header masthead topbar comment comments commentlist disqus respond reply replies share sharing social related "
    "recommended recommendations widget widgets copyright disclaimer legal skip hidden".split()
)
#: What readers add: a name that begins with one of these is not the article, however long.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
WHOLE = frozenset(("article", "main"))
#: Formatting inside running text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: How much more the sum of an article or main element counts, how dense a part is that is like another, and how much
#: denser than the threshold a part beside an article or main element must be.
PREFERRED, SIMILAR, BESIDE = 2.0, 0.5, 4.0
#: A block of so many links whose text is linked for the most part is a list of links.
LINKS, LINKED = 5, 0.8
KEPT = frozenset(("html", "body", "article", "main"))

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)(>?)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
QUOTE_OR_END = re.compile("[>\"']")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Tree:
    """Parallel lists, a node's number being its place in page order; ``items`` holds children and text in order."""

    def __init__(self):
        self.tag, self.parent, self.items, self.attrs = ["#root"], [-1], [[]], [""]

    def add(self, tag: str, parent: int, attrs: str) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.items.append([])
        self.attrs.append(attrs)
        self.items[parent].append(node)
        return node


class Quotes:
    """Where tags with quoted attribute values end. A quote that leads to no end is remembered, so that all tags of a
    page together are searched once."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """The place of the '>' outside quotes that ends a tag, from a place outside quotes; the first '>' of all (or
        the page's end) where a quote is never closed or no '>' follows outside quotes."""
        first, seen = at, []
        while m := QUOTE_OR_END.search(self.page, at):
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            if m.start() >= self.last[m[0]]:
                break
            at = self.page.find(m[0], m.end()) + 1
        self.dead.update(seen)
        gt = self.page.find(">", first)
        return gt if gt >= 0 else len(self.page)


def parse(page: str) -> Tree:
    quotes = Quotes(page)
    tree, stack, at = Tree(), [0], 0
    once: set[str] = set()
    tag_of, opened = tree.tag, Counter()  # how many elements of a name are open: most searches of the stack end here

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            opened[tag_of[node]] -= 1
        del stack[depth:]

    def close(names, bounds) -> None:
        """Ends the outermost open element among names above the nearest bound."""
        if not any(opened[name] for name in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = tag_of[stack[depth]]
            if name in names:
                lowest = depth
                while lowest > 1 and tag_of[stack[lowest - 1]] in names:
                    lowest -= 1
                cut(lowest)
                return
            if name in bounds:
                return

    while m := TAG.search(page, at):
        if m.start() > at:
            tree.items[stack[-1]].append(page[at : m.start()])
        at = m.end()
        end, name, attrs = m[1], m[2], m[3]
        if not name:
            continue
        if not m[4]:
            gt = quotes.end(at)
            attrs, at = page[m.start(3) : gt], min(gt + 1, len(page))
        name = name.lower()
        if end:
            if name == "br":
                tree.add("br", stack[-1], "")
            for depth in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if tag_of[stack[depth]] == name:
                    cut(depth)
                    break
                if name == "p" and tag_of[stack[depth]] in ("td", "th", "button"):
                    break
            continue
        if name in ENDS_P:
            close({"p"}, {"button", "td", "th", "caption", "table"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ("html", "body", "head") and name in once:
            continue
        if name in ("html", "body", "head"):
            once.add(name)
        node = tree.add(name, stack[-1], attrs)
        if name in RAW:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            inner = page[at : stop.start()] if stop else page[at:]
            if name not in CUT:
                tree.items[node].append(inner)
            at = stop.start() if stop else len(page)
            if stop:
                gt = page.find(">", at)
                at = gt + 1 if gt >= 0 else len(page)
        elif name not in VOID:
            stack.append(node)
            opened[name] += 1
    if at < len(page):
        tree.items[stack[-1]].append(page[at:])
    return tree


def noise(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in CUT:
        return True
    if tag == "header" and not in_article:
        return True
    if not attrs or tag in KEPT:
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.strip().lower() in CUT_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def named(attrs: str, tag: str = "div") -> tuple[bool, bool]:
    """Whether a class or id says that a node is not the article, and whether one says that it is its readers'. One part
    of a name is enough for a container; a paragraph's must say nothing else (a ``share-price`` is no share button)."""
    cut = readers = False
    for name, *values in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id"):
            for token in entities.unescape("".join(values)).split():
                parts = [p.lower() for p in NAME_PARTS.findall(token)]
                says = CUT_NAMES.issuperset(parts) if tag in PARAGRAPHS else not CUT_NAMES.isdisjoint(parts)
                cut = cut or bool(parts) and says
                readers = readers or bool(parts) and parts[0] in READERS
    return cut, readers


def prune(tree: Tree) -> list[bool]:
    """Which nodes remain."""
    n = len(tree.tag)
    kept, inside, cuts = [True], [False], {}
    for node in range(1, n):
        up, tag, attrs = tree.parent[node], tree.tag[node], tree.attrs[node]
        inside.append(inside[up] or tag in WHOLE)
        kept.append(kept[up] and not noise(tag, attrs, inside[up]))
        if kept[node] and attrs and tag != "html" and tag != "body":
            cut, readers = named(attrs, tag)
            if cut:
                cuts[node] = readers
    if not any(tree.tag[node] not in KEPT for node in cuts):
        return kept
    # characters outside links, and under how many named nodes each node stands
    chars, linked, under, replied = [0] * n, [False] * n, [0] * n, [False] * n
    for node in range(1, n):
        up = tree.parent[node]
        linked[node] = linked[up] or tree.tag[node] == "a"
        under[node] = under[up] + (node in cuts and tree.tag[node] not in KEPT)
        replied[node] = replied[up] or cuts.get(node, False)
    for node in range(n - 1, -1, -1):
        if kept[node]:
            if not linked[node]:
                chars[node] += sum(len("".join(x.split())) for x in tree.items[node] if isinstance(x, str))
            if node:
                chars[tree.parent[node]] += chars[node]
    # of articles the outermost by names: comments and teasers may be articles, too
    articles = [i for i in range(n) if kept[i] and chars[i] and tree.tag[i] in WHOLE and i not in cuts and not replied[i]]
    least = min((under[i] for i in articles), default=0)
    holds, outside = set(), chars[0] - sum(chars[i] for i in cuts if under[i] == 1 and tree.tag[i] not in KEPT)
    for node in articles:
        at = node
        while at > 0 and at not in holds and under[node] == least:
            if chars[node] > outside or tree.tag[node] == "main":
                holds.add(at)
            at = tree.parent[at]
    after = list(kept)
    for node in range(1, n):
        after[node] = kept[node] and after[tree.parent[node]]
        if after[node] and node in cuts and tree.tag[node] not in KEPT and node not in holds:
            after[node] = 2 * chars[node] > chars[0] and not cuts[node] and not (articles and least == 0)
    if any(after[i] and any(isinstance(x, str) and x.strip() for x in tree.items[i]) for i in range(n)):
        return after
    return kept


class Measures:
    """For every node its characters, tags, linked characters and links, its composite density, and the sum of its
    children's densities. Text of a node's own counts as one child."""

    def __init__(self, tree: Tree, kept: list[bool], body: int):
        n = len(tree.tag)
        self.chars, self.tags, self.link_chars, self.links, own = ([0] * n for _ in range(5))
        chars, tags, link_chars, links = self.chars, self.tags, self.link_chars, self.links
        for node in range(n - 1, -1, -1):  # children come after their parents
            if not kept[node]:
                continue
            tag, up = tree.tag[node], tree.parent[node]
            text = sum(len("".join(x.split())) for x in tree.items[node] if isinstance(x, str))
            chars[node] += text
            own[node] += text
            if tag == "a":
                link_chars[node], links[node] = chars[node], links[node] + 1
            if up >= 0:
                chars[up] += chars[node]
                tags[up] += tags[node] + (tag == "a" or tag not in INLINE)
                link_chars[up] += link_chars[node]
                links[up] += links[node]
                if tag in INLINE:
                    own[up] += own[node]
        self.of_body = link_chars[body] / max(1, chars[body])
        self.density, self.sums = [0.0] * n, [0.0] * n
        for node in range(n - 1, -1, -1):
            if not kept[node]:
                continue
            inline, up = tree.tag[node] in INLINE, tree.parent[node]
            self.density[node] = self.of(chars[node], tags[node], link_chars[node], links[node])
            if own[node] and not inline:
                self.sums[node] += self.of(own[node], 1, min(own[node], link_chars[node]), links[node])
            if up >= 0:
                self.sums[up] += self.sums[node] if inline else self.density[node]

    def of(self, chars: int, tags: int, link_chars: int, links: int) -> float:
        """The composite density of a part with these counts."""
        if chars <= 0:
            return 0.0
        tags, links = max(1, tags), max(1, links)
        base = math.log(chars / max(1, chars - link_chars) * link_chars + self.of_body * chars + math.e)
        share = max(1.0, chars / max(1, link_chars) * tags / links)
        return chars / tags * math.log(share + math.e - 1) / math.log(base + math.e - 1)


def content(tree: Tree, measures=Measures) -> tuple[list[bool], list[bool]]:
    """Which nodes belong to the main text, and which remained at all."""
    n, kept = len(tree.tag), prune(tree)
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    m = measures(tree, kept, body)
    density, chars = m.density, m.chars
    sums = [x * PREFERRED if tree.tag[i] in WHOLE else x for i, x in enumerate(m.sums)]
    last = list(range(n))  # the last node of each subtree
    for node in range(n - 1, 0, -1):
        last[tree.parent[node]] = max(last[tree.parent[node]], last[node])
    marked = [False] * n
    if not chars[body]:
        return marked, kept

    def best_in(node: int) -> int:
        """The node of the largest sum in a subtree, of equals that of more text, then the outer one."""
        inside = (i for i in range(node, last[node] + 1) if i == node or kept[i] and tree.tag[i] not in INLINE)
        return max(inside, key=lambda i: (chars[i] > 0, sums[i], chars[i], -i))

    def climbed(node: int) -> int:
        """The outermost article or main around a node that adds little to it, or more of its kind."""
        out, at = node, tree.parent[node]
        while at > 0 and node != body:
            if tree.tag[at] in WHOLE:
                more = (x[at] - x[out] for x in (m.chars, m.tags, m.link_chars, m.links))
                unlinked = [chars[i] - m.link_chars[i] for i in (out, at)]
                if unlinked[1] <= 2 * unlinked[0] or m.of(*more) >= SIMILAR * density[out]:
                    out = at
            if at == body:
                break
            at = tree.parent[at]
        return out

    def mark(node: int) -> None:
        i = node
        while i <= last[node]:
            if i != node and tree.tag[i] not in INLINE and m.links[i] >= LINKS and m.link_chars[i] >= LINKED * chars[i]:
                i = last[i] + 1
                continue
            marked[i] = True
            i += 1

    top = best_in(body)
    threshold, at = density[top], top
    while at != body:
        at = tree.parent[at]
        threshold = min(threshold, density[at])
    main = climbed(top)
    mark(main)
    threshold *= BESIDE if tree.tag[main] in WHOLE else SIMILAR
    path, at = {main}, main
    while at != body and at > 0:
        at = tree.parent[at]
        path.add(at)
    node, titles = body + 1, []
    while node <= last[body]:
        if node in path and node != main:
            node += 1
            continue
        if node != main and kept[node] and tree.tag[node] in HEADINGS and chars[node] > 2 * m.link_chars[node] and node < main:
            titles.append(node)  # directly before the main block, as far as all headings here are
        elif node == main:
            for title in titles:
                mark(title)
        elif kept[node] and chars[node]:
            titles = [] if node < main else titles
            if density[node] >= threshold and tree.tag[node] not in INLINE:
                mark(best_in(node))
        node = last[node] + 1
    return marked, kept


def main_text(page: str | None, measures=Measures) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    tree = parse(page)
    marked, kept = content(tree, measures)
    blocks, line = [], []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(line)).split()):
            blocks.append(text)
        line.clear()

    todo: list = [0]  # nodes to enter, texts, and None - node for nodes to leave
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            if x[0] is None:
                flush()
            else:
                line.append(x[0])
            continue
        if not kept[x]:
            continue
        is_block = tree.tag[x] in BLOCKS
        if is_block:
            flush()
            todo.append((None,))
        for item in reversed(tree.items[x]):
            if isinstance(item, int):
                todo.append(item)
            elif marked[x]:
                todo.append((item,))
    flush()
    return "\n".join(blocks)


def extract_main_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """df with ``html`` replaced by ``text`` (never null) and ``n_chars``, its code points."""
    names = others(df, html, text, "n_chars")
    own = [F.col(f"`{c}`") for c in names]
    schema = extended(df.select(*own), (text, "string"), ("n_chars", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, len(names)):
                texts = [main_text(p) for p in part.column(len(names)).to_pylist()]
                columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, text, "n_chars"])

    return df.select(*own, F.col(f"`{html}`").alias(free_name(df, "__html"))).mapInArrow(run, schema)
