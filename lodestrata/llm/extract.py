"""Main text of web pages by composite text density.

A page is read into its tree of blocks; marks within a line (b, i, span, br and the like) are part of their block. A node with
C characters in T blocks below it, of which LC characters in LT links, has the density

    C / T * log(C / LC * T / LT, base)   with   base = ln(C / (C - LC) * LC + LCpage / Cpage * C + e)

so long plain text under few tags scores high and lists of links score low (counts of 0 are taken as 1 where they divide; on a
page without any link it is C / T). The densities of a node's children are summed. From the node of the largest sum up to the
body, the smallest density is the threshold: from the body down, every node that reaches it yields the subtree of the largest
sum below it, and these subtrees together are the main text. What is no content whatever its density (scripts, menus, forms,
adverts, notices, comments of readers) is out before densities are taken, and a choice inside an article is the whole article.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune

# Element names of HTML and the usual names of parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
OUT = frozenset("head script style title noscript noframes noembed template iframe object embed svg canvas audio video map nav footer aside form button select option textarea input menu dialog datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead header footer comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup related recommended share sharing social widget toolbar pagination pager login copyright".split()
)
#: A paragraph ends where one of these begins.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: Elements that end where one of the second kind begins, unless one of the third lies between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of which one marks comments of readers; an article of its own within them is one too.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())

_TOKEN = re.compile(r"<!--(?:.*?--!?>|>|->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Page:
    """The elements of a page in order, each with its parent, and the pieces of text with the element they are in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.words = ["body"], [0], [False], [frozenset()]
        self.text: list[str] = []
        self.owner: list[int] = []
        self.stack, at = [0], 0
        while m := _TOKEN.search(source, at):
            self._add(source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if name in ("", "html", "body"):
                continue
            if m[1]:
                self._end(name)
                continue
            self._begin(name, m[3])
            if name in RAW:
                at = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I).search(source, at).start()
        self._add(source[at:])

    def _add(self, piece: str) -> None:
        if piece:
            self.text.append(html.unescape(piece) if "&" in piece else piece)
            self.owner.append(self.stack[-1])

    def _pop(self, depth: int) -> None:
        blocks = any(self.tag[x] not in INLINE for x in self.stack[depth:])
        del self.stack[depth:]
        if blocks:
            self._add(" ")

    def _end(self, name: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag == name:
                return self._pop(depth)
            if name in INLINE and tag not in INLINE:  # a mark within a line ends nothing around it
                return None
        return None

    def _implied(self, same, border) -> None:
        """Ends the outermost open element of a kind that lies within no border."""
        cut = 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in same:
                cut = depth
            elif border(tag):
                break
        if cut:
            self._pop(cut)

    def _begin(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._implied(("p",), lambda tag: tag not in INLINE)
        if name in SIBLINGS:
            same, border = SIBLINGS[name]
            self._implied(same, border.__contains__)
        if name not in INLINE or name == "br":
            self._add(" ")
        if name in VOID:
            return
        out, words = name in OUT or name == "header" and not any(self.tag[x] in ("article", "main") for x in self.stack), set()
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                words.update(_WORD.findall(value))
            elif key == "role":
                out = out or value.strip() in OUT_ROLES
            elif key == "style":
                out = out or bool(_HIDDEN.search(value))
            elif key == "hidden" or key == "aria-hidden" and value.strip() == "true":
                out = True
        self.stack.append(len(self.tag))
        self.tag.append(name)
        self.parent.append(self.stack[-2])
        self.out.append(out)
        self.words.append(OUT_WORDS & words)


def _left_out(page: Page) -> list[bool]:
    """Whether each element is in a part that is no content by its kind or name; a part that holds the page's heading, its
    main part or an article is not taken by its name, nor is an article but for `comment`."""
    tag, parent, words = page.tag, page.parent, page.words
    named = [bool(w) if t not in ("article", "main") else t == "article" and "comment" in w for t, w in zip(tag, words)]
    heart, story = [t in ("h1", "main") for t in tag], [t == "article" and not n for t, n in zip(tag, named)]
    for i in range(len(tag) - 1, 0, -1):
        heart[parent[i]] |= heart[i]
        story[parent[i]] |= story[i]
    out = list(page.out)
    for i in range(1, len(tag)):
        out[i] = out[i] or out[parent[i]] or named[i] and not heart[i] and (not story[i] or bool(words[i] & COMMENTS))
    return out


def _densities(page: Page, out: list[bool]) -> tuple[list[int], list[float]]:
    """Characters (but white space) and density of each block."""
    tag, parent, count = page.tag, page.parent, len(page.tag)
    in_link, in_raw = [False] * count, [False] * count
    for i in range(1, count):
        in_link[i], in_raw[i] = tag[i] == "a" or in_link[parent[i]], tag[i] in RAW or tag[i] == "head" or in_raw[parent[i]]
    chars, linked, tags, links = ([0] * count for _ in range(4))
    page_chars = page_linked = 0
    for piece, i in zip(page.text, page.owner):
        n = sum(map(len, piece.split()))
        if not in_raw[i]:  # links of menus count for the page
            page_chars += n
            page_linked += n * in_link[i]
        if not out[i]:
            chars[i] += n
            linked[i] += n * in_link[i]
    for i in range(count - 1, 0, -1):
        if not out[i]:
            up, link = parent[i], tag[i] == "a"
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i] + (link or tag[i] not in INLINE)
            links[up] += links[i] + link
    density = [c / max(t, 1) for c, t in zip(chars, tags)]
    if page_linked:
        for i, c in enumerate(chars):
            if c:
                base = math.log(c / max(c - linked[i], 1) * linked[i] + page_linked / page_chars * c + math.e)
                density[i] *= max(math.log(c / max(linked[i], 1) * max(tags[i], 1) / max(links[i], 1)), 0) / math.log(base)
    return chars, density


def main_text(source: str | None) -> str:
    """The main text of a page; empty if there is none."""
    page = Page(source or "")
    tag, parent, count = page.tag, page.parent, len(page.tag)
    out = _left_out(page)
    chars, density = _densities(page, out)
    if not chars[0]:
        return ""
    block = [not o and (t not in INLINE) for o, t in zip(out, tag)]
    above = [0] * count  # the block around each element
    for i in range(1, count):
        above[i] = parent[i] if block[parent[i]] else above[parent[i]]
    sums, inner, best = [0.0] * count, [-1] * count, list(range(count))
    for i in range(count - 1, -1, -1):
        if not block[i]:
            continue
        if inner[i] < 0:  # without blocks in it
            sums[i] = density[i]
        elif sums[inner[i]] > sums[i]:
            best[i] = inner[i]
        if i:
            up = above[i]
            sums[up] += density[i]
            if inner[up] < 0 or sums[best[i]] >= sums[inner[up]]:
                inner[up] = best[i]
    threshold, i = density[best[0]], best[0]
    while i:
        i = above[i]
        threshold = min(threshold, density[i])

    def whole(i: int) -> int:
        path = []
        while i:
            path.append(i)
            i = parent[i]
        return next((x for kind in ("article", "main") for x in path if tag[x] == kind), path[0] if path else 0)

    reached, chosen, beside = [False] * count, [False] * count, [False] * count
    for i in range(count):
        if block[i] and (i == 0 or reached[above[i]]) and density[i] >= threshold and chars[i]:
            reached[i] = True
            pick = whole(best[i])
            chosen[pick] = beside[parent[pick]] = True
    for i in range(1, count):  # a heading goes with the chosen parts beside it
        chosen[i] = chosen[i] or chosen[parent[i]] or beside[parent[i]] and tag[i] in HEADINGS
    return " ".join("".join([p if chosen[i] else " " for p, i in zip(page.text, page.owner) if not out[i]]).split())


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of each in text_col, empty if there is none; text_col is replaced if it is there.

    A null or empty page has an empty text, and so has one without content. Markup that is never closed ends with the page.
    Repeated rows are extracted each, null and repeated ids do not matter, and the other columns stay as they are. A page is
    read as a whole in one task; its tree takes some hundred bytes a tag.
    """
    tune(pages.sparkSession)
    at = pages.columns.index(html_col)
    kept = [f for f in pages.schema if f.name != text_col or f.name == html_col]
    places = [i for i, f in enumerate(pages.schema) if f in kept]
    if text_col == html_col:
        places, kept = [i for i in places if i != at], [f for f in kept if f.name != html_col]
    names = [*(f.name for f in kept), text_col]

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(texts, pa.string())], names)

    return pages.mapInArrow(run, T.StructType(kept).add(text_col, "string"))


def digest(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
