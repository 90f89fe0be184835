"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted by how much of its text and how many of its
tags are links. The node with the largest sum of its children's densities is the core of the article,
among the nodes at least as dense as the thinnest node on the path from the body to the densest sum.
The nearest ``article`` around the core (else ``main``, else siblings as dense as the threshold) completes
the article; other ``article`` elements are teasers or replies and no part of it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.llm.tables import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
SKIP = frozenset("head nav footer aside form script style noscript template textarea button select option menu dialog iframe object svg canvas audio video label datalist noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE_SCOPE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: What a start tag closes, up to the first element of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
P_CLOSERS = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "title", "figcaption", "summary"}
P_SCOPE = frozenset("html body table td th caption button object article aside section div main nav header footer form blockquote li dd dt ul ol dl figure details".split())
#: Words of class and id names, and roles, of what is no article text.
LAYOUT_WORDS = frozenset("banner sidebar nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer widget widgets toolbar pagination pager search skip overlay modal share sharing social".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion".split())
OTHER_WORDS = frozenset("comment comments commentlist disqus replies reply respond reactions related recommended recommendations cookie cookies consent gdpr notice notices popup newsletter subscribe subscription signup login paywall tracking".split())
#: Words that say nothing by themselves: a name is noise if it has noise words and else only these.
COMMON_WORDS = frozenset("area articles author bar block body bottom box button buttons card column container content entry feed form group head header holder icon icons image inner item items left link links list main media meta nested outer page panel posts primary right row secondary section site slot stories text thread title top tree unit user wrap wrapper".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose names count; others are noise only as an advert by class.
CONTAINERS = frozenset("article center details div dl header li ol section span table td ul".split())
#: A core inside a container named as noise is believed if it is so many times as dense as the best one outside.
BELIEVED = 2.0


class _Tree:
    """Nodes as parallel lists, parents before children; text as (node, string) in page order."""

    def __init__(self) -> None:
        self.tag, self.parent, self.noise, self.maybe = ["#root"], [-1], [False], [0]
        self.text: list[tuple[int, str]] = []

    def add(self, tag: str, parent: int, noise: bool, maybe: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.noise.append(noise)
        self.maybe.append(maybe)
        return len(self.tag) - 1


#: What the name of an element says: nothing, perhaps no article text (its density may say otherwise), surely none.
_PLAIN, _LAYOUT, _OTHER = 0, 1, 2
_STRICT, _NOISE = ADVERT_WORDS | OTHER_WORDS, ADVERT_WORDS | OTHER_WORDS | LAYOUT_WORDS | COMMON_WORDS


def _named(value: str) -> int:
    """By the names in a class or id: ``related-posts`` and ``sidebar`` are noise, ``related-work`` and ``has-sidebar`` aren't."""
    found = _PLAIN
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words <= _NOISE and not words <= COMMON_WORDS:
            found = max(found, _LAYOUT if words.isdisjoint(_STRICT) else _OTHER)
        elif not words.isdisjoint(ADVERT_WORDS):
            found = max(found, _LAYOUT)
    return found


def _noise(tag: str, attributes: str) -> tuple[bool, int]:
    """(surely no article text, what its name says)."""
    if tag in SKIP:
        return True, _PLAIN
    found = _LAYOUT if tag == "header" else _PLAIN
    if not attributes or attributes.isspace():
        return False, found
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), a or b or c
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, _PLAIN
        if tag in CONTAINERS:
            if name == "role" and value.lower() in NOISE_ROLES:
                found = max(found, _LAYOUT)
            elif name in ("class", "id"):
                found = max(found, _named(value))
        elif name == "class" and tag not in ("html", "body", "main") and not ADVERT_WORDS.isdisjoint(value.lower().split()):
            found = _OTHER
    return False, found


def _parse(page: str) -> _Tree:
    tree = _Tree()
    stack = [0]
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            tree.text.append((stack[-1], page[at:]))
            break
        if m.start() > at:
            tree.text.append((stack[-1], page[at : m.start()]))
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):  # end tag
            for i in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[i]] == tag:
                    del stack[i:]
                    break
                if tag in INLINE_SCOPE and tree.tag[stack[i]] not in INLINE_SCOPE or tag == "p" and tree.tag[stack[i]] in P_SCOPE:
                    break
            if tag in BLOCK:
                tree.text.append((stack[-1], " "))
            continue
        if tag in P_CLOSERS:
            for i in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[i]] == "p":
                    del stack[i:]
                    break
                if tree.tag[stack[i]] in P_SCOPE:
                    break
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[i]] in ends:
                    del stack[i:]
                    break
                if tree.tag[stack[i]] in scope:
                    break
        if tag in BLOCK:
            tree.text.append((stack[-1], " "))
        attributes = m.group(3)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            tree.add(tag, stack[-1], True, _PLAIN)
            continue
        node = tree.add(tag, stack[-1], *_noise(tag, attributes))
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return tree


def _completed(core: int, tag: list[str], parent: list[int], counts, dense) -> list[int]:
    """The nodes of an article without element of its own: up from its core while all siblings with text fit."""
    node, children = core, {}
    for j in range(1, len(tag)):
        children.setdefault(parent[j], []).append(j)
    while node > 0 and parent[node] > 0:
        above = parent[node]
        beside = [j for j in children[above] if counts(j)]
        fit = [j for j in beside if j == node or dense(j) or tag[j] == "p" or tag[j] in HEADINGS]
        if tag[above] in ("body", "html"):
            return fit if tag[node] == "p" or tag[node] in HEADINGS else [node]
        if len(fit) < len(beside):
            return fit
        node = above
    return [node]


class _Densities:
    """Composite densities of a page without the nodes that are ``out``, and its core."""

    def __init__(self, tree: _Tree, plain: list[tuple[int, str]], out: list[bool]) -> None:
        n, tag, parent = len(tree.tag), tree.tag, tree.parent
        self.out = out
        self.chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        chars = self.chars
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[parent[i]] or tag[i] == "a"
        for node, t in plain:
            if not out[node]:
                size = len(" ".join(t.split()))
                chars[node] += size
                if linked[node]:
                    links[node] += size
        for i in range(n - 1, 0, -1):
            if not out[i]:
                p = parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        body = next((i for i in range(1, n) if tag[i] == "body"), 0)
        body = body if chars[body] else 0
        self.density, self.sums, self.core, self.threshold, self.within = [0.0] * n, [0.0] * n, None, 0.0, [False] * n
        if not chars[body]:
            return
        density, sums, within = self.density, self.sums, self.within
        ratio = links[body] / chars[body]
        for i in range(n):
            c = chars[i]
            if c and not out[i]:
                lc, lt, t = max(links[i], 1), max(link_tags[i], 1), max(tags[i], 1)
                base = math.log(c / max(c - links[i], 1) * links[i] + ratio * c + math.e)
                density[i] = max(0.0, c / t * math.log(max(c / lc * t / lt, 1.0)) / base) or c / t * 1e-3
        for i in range(1, n):
            sums[parent[i]] += density[i]
        for i in range(n):
            sums[i] = sums[i] or density[i]
        within[body] = True
        for i in range(body + 1, n):
            within[i] = within[parent[i]] and not out[i]
        core = max((i for i in range(n) if within[i]), key=lambda i: sums[i])
        self.threshold, i = density[core], core
        while i != body and i > 0:
            i = parent[i]
            self.threshold = min(self.threshold, density[i])
        self.core = max((i for i in range(n) if within[i] and density[i] >= self.threshold), key=lambda i: sums[i], default=core)


def _without(tree: _Tree, least: int, believed: set[int]) -> list[bool]:
    """The nodes that are no article text: by tag, by a name of at least ``least``, or inside such a node."""
    n, tag, parent = len(tree.tag), tree.tag, tree.parent
    out, inside = [False] * n, [False] * n
    for i in range(1, n):
        p = parent[i]
        inside[i] = inside[p] or tag[i] in ("article", "main")
        bad = tree.maybe[i] >= least and i not in believed and not (tag[i] == "header" and inside[p])
        out[i] = out[p] or tree.noise[i] or bad
    return out


def _chosen(tree: _Tree, found: _Densities) -> tuple[list[int], set[int]]:
    """The article's nodes, and elements inside them that are articles of their own."""
    tag, parent, core, chars = tree.tag, tree.parent, found.core, found.chars
    above, i = set(), core
    while i > 0:
        above.add(i)
        i = parent[i]
    own = max((i for i in above if tag[i] == "article"), default=None)  # parents come first, so it is the nearest
    inner: dict[int, bool] = {}
    others = []  # outermost articles that don't hold the core
    for i in range(1, len(tag)):
        inner[i] = inner.get(parent[i], False)
        if tag[i] == "article" and i not in above and not found.out[i] and chars[i]:
            if not inner[i]:
                others.append(i)
            inner[i] = True
    if own is not None:
        return [own], set(others)
    inside = [i for i in others if _under(i, core, parent)]
    if inside:
        best = max(inside, key=lambda i: found.sums[i])
        if chars[best] >= chars[core] - sum(chars[i] for i in inside):
            return [best], set()
    main = next((i for i in sorted(above) if tag[i] == "main"), None)
    if main is not None:
        return [main], set(others)
    holds = {i for x in others for i in _path(x, parent)}
    nodes = _completed(core, tag, parent, lambda j: found.within[j] and chars[j] > 0, lambda j: found.density[j] >= found.threshold and j not in holds)
    return nodes, set(others)


def _path(i: int, parent: list[int]) -> Iterator[int]:
    while i > 0:
        yield i
        i = parent[i]


def _under(i: int, top: int, parent: list[int]) -> bool:
    return top in _path(i, parent) or top == 0


def main_text(page: str) -> str:
    """The article's text of one page; empty if it has none.

    No article text are the elements of ``SKIP``, hidden ones, containers named as adverts, notices, comments or related
    pages, and containers named as parts of a layout, unless the densest core of all lies in one and is ``BELIEVED``
    times as dense as the best core outside: wrappers around an article are named like that too. Headings and paragraphs are never judged by
    their names (but for adverts by class). Of several ``article`` elements it is the one with the core.
    """
    if not page:
        return ""
    tree = _parse(page)
    parent = tree.parent
    plain = [(node, entities.unescape(t) if "&" in t else t) for node, t in tree.text]
    found = _Densities(tree, plain, _without(tree, _LAYOUT, set()))
    if any(m == _LAYOUT for m in tree.maybe):
        wide = _Densities(tree, plain, _without(tree, _OTHER, set()))
        if wide.core is not None and found.out[wide.core] and (found.core is None or wide.sums[wide.core] >= BELIEVED * found.sums[found.core]):
            wrappers = {i for i in _path(wide.core, parent) if tree.maybe[i] == _LAYOUT}
            found = _Densities(tree, plain, _without(tree, _LAYOUT, wrappers))
    if found.core is None:
        return ""
    nodes, others = _chosen(tree, found)
    n = len(tree.tag)
    keep = [False] * n
    for i in range(n):
        keep[i] = not found.out[i] and i not in others and (i in nodes or i > 0 and keep[parent[i]])
    # a block's edge is written to the parent, so keep those spaces wherever they are
    return " ".join("".join(t for node, t in plain if keep[node] or t == " ").split())


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` of every row, from its whole page, without a shuffle.

    ``main_text`` says what is no article text. Null, empty and text-less pages have empty text. Repeated rows and null ids come back as given;
    an empty table gives an empty result; other columns are not read.
    """
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = source.mapInArrow(run, f"id {fields[id_col]}, url {fields[url_col]}, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
