"""Main text of HTML pages by composite text density.

Each page is parsed once into a DOM (regular-expression tokens, implied end
tags, raw-text elements).  For every node

    density = chars / tags * log_b((chars / link chars) * (tags / link tags)),
    b = ln(chars * link chars / plain chars + page link share * chars + e)

with counts over its subtree, so links lower it.  A node's density sum adds up
the densities of the blocks in it that are nearest (inline markup is looked
through).  The node with the largest sum holds the article; the least density on
the path from it to the body is the threshold, and in every other subtree whose
density reaches it the node of the largest sum is content too.  ``article`` and
``main`` decide only ties.

A page's one heading of first order that stands before what is chosen, and is no
link, belongs to it.  Menus, footers, asides, forms, scripts, dialogs and hidden
elements have no density and are never taken.  Words in a class or id (sidebar, related, ...)
lower the density of an element to nothing, so nothing in it is chosen.  Within
what is chosen they count only where a whole class name is made of them, and
never against a heading, a paragraph, a list item or a table cell.  Words for
readers' comments count on boxes alone, and on an ``article`` where one is a whole
class name and something else is the article.

The column is a row-local Arrow function: no shuffle, nothing gathered.

Defined cases: null or empty html, and html without text, give an empty text; an
empty table gives no rows; an unclosed comment, declaration or script reaches to
the end of the page; a broken tag is text; pages of any length are read whole, in linear
time; of nodes of one sum, an ``article`` or ``main`` and then the first in page
order is chosen; repeated rows each get their own result; further columns play
no part, whatever their names.
"""

from __future__ import annotations

import html as htmllib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

_TAG = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>"
)
_ATTRIBUTE = re.compile(r"(?i)(?:^|[\s\"'])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noframes xmp".split())
_BLOCK = frozenset(
    "html body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption tbody thead tfoot tr td th "
    "blockquote pre figure figcaption header footer nav aside address hr form fieldset details summary center".split()
)
#: An opening tag of the first kind ends an open element of the second.
_ENDS = {
    **{t: ("p",) for t in _BLOCK - {"html", "body", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "summary"}},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
}
#: Elements that an implied end does not reach across.
_SCOPE = frozenset("html body table td th div section article main ul ol dl blockquote button nav aside header footer form".split())
_OUT = frozenset(
    "head script style title textarea noscript iframe noframes xmp template svg object select option button nav aside "
    "footer dialog menu form input".split()
)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription share sharing social related recommended recommendations disqus respond "
    "widget widgets toolbar pagination pager login signup skip header".split()
)
#: Words that, beside those above, may make up a class name that counts within the article too.
_BOX_WORDS = frozenset(
    "box wrap wrapper container block area section list links link buttons button bar unit slot site page top bottom inner "
    "outer left right posts post articles icons icon text form mobile desktop item items".split()
)
#: Elements that no class word takes out of the article.
_KEPT = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figure figcaption article main body html".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_COMMENT_WORDS = frozenset("comment comments reply replies commentlist".split())
#: Elements that no word for comments takes out; an ``article`` only where it is a whole class name.
_NO_COMMENT = frozenset("main h1 h2 h3 h4 h5 h6 p li td th dd dt blockquote pre figure figcaption".split())


class Page:
    """A parsed page: nodes in page order, each after its parent."""

    def __init__(self, html: str, comments: bool = False) -> None:
        #: Whether an article that is called a comment may be content, and whether one was left out.
        self.comments, self.commented = comments, False
        self.tag, self.parent = ["#root"], [-1]
        #: By all class words, and by those that count within the article too.
        self.out, self.strict = [0], [0]
        #: What follows in page order: (node, text) or (node, None) for the edge of a block.
        self.flow: list[tuple[int, str | None]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        at, open_nodes, n = 0, [0], len(html)
        open_of: dict[str, int] = {}
        while at < n:
            m = _TAG.search(html, at)
            end = m.start() if m else n
            if end > at:
                self.flow.append((open_nodes[-1], html[at:end]))
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if open_of.get(name):
                    while True:
                        node = open_nodes.pop()
                        open_of[self.tag[node]] -= 1
                        self._edge(node)
                        if self.tag[node] == name:
                            break
                elif name == "p":
                    self.flow.append((open_nodes[-1], None))
                continue
            for ended in _ENDS.get(name, ()):
                if open_of.get(ended):
                    self._end(ended, open_nodes, open_of)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(open_nodes[-1])
            self.out.append(self._verdict(name, m[3], False))
            self.strict.append(self._verdict(name, m[3], True) if self.out[-1] else 0)
            self._edge(node)
            if name == "br":
                self.flow.append((open_nodes[-1], " "))
            if name in _RAW:
                close = html.find("</" + m[2], at)
                if close < 0:
                    found = re.compile("</" + name, re.I).search(html, at)
                    close = found.start() if found else n
                at = close
                stop = html.find(">", at)
                at = n if stop < 0 else stop + 1
            elif name not in _VOID and not m[3].endswith("/"):
                open_nodes.append(node)
                open_of[name] = open_of.get(name, 0) + 1

    def _end(self, name: str, open_nodes: list[int], open_of: dict[str, int]) -> None:
        """End an open element if no element that scopes it is open inside."""
        for depth in range(len(open_nodes) - 1, 0, -1):
            tag = self.tag[open_nodes[depth]]
            if tag == name:
                for node in reversed(open_nodes[depth:]):
                    open_of[self.tag[node]] -= 1
                    self._edge(node)
                del open_nodes[depth:]
                return
            if tag in _SCOPE:
                return

    def _edge(self, node: int) -> None:
        if self.tag[node] in _BLOCK:
            self.flow.append((node, None))

    def _verdict(self, name: str, attributes: str, strict: bool) -> int:
        """0: ordinary; 1: out unless it holds the article or most text; 2: out; 3: out unless it holds the article."""
        found = 2 if name in _OUT - {"form", "aside"} else 1 if name in _OUT else 0
        if not attributes or name in ("html", "body"):
            return found
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                found = max(found, 1)
            elif key == "style":
                if "display:none" in value.replace(" ", ""):
                    found = 2
            elif key == "role":
                if value in _OUT_ROLES:
                    found = max(found, 1)
            else:
                words = _WORDS.findall(value)
                if name == "article":
                    if not self.comments and any(set(_WORDS.findall(x)) <= _COMMENT_WORDS for x in value.split() if _WORDS.search(x)):
                        found, self.commented = 2, True
                elif name not in _NO_COMMENT and any(w in _COMMENT_WORDS for w in words):
                    found = 3 if found < 2 else found
                elif name not in ("main", "h1") and (_names_a_box(value, name) if strict else any(w in _OUT_WORDS for w in words)):
                    found = max(found, 1)
        return found


def _names_a_box(value: str, tag: str) -> bool:
    """Whether one of the class names is made of box words alone, such as ``ad-container``."""
    if tag in _KEPT:
        return False
    for token in value.split():
        words = _WORDS.findall(token)
        if any(w in _OUT_WORDS and w != "header" for w in words) and all(w in _OUT_WORDS or w in _BOX_WORDS for w in words):
            return True
    return False


def _left_out(page: Page, verdicts: list[int]) -> list[bool]:
    """Which nodes are left out, by themselves or by an ancestor."""
    n = len(page.tag)
    wraps = [False] * n  # holds a heading of first order, an article or a main element
    for i in range(n - 1, 0, -1):
        if (page.tag[i] in ("h1", "article", "main") and verdicts[i] < 2) or wraps[i]:
            wraps[page.parent[i]] = True
    size, paragraphs = [0] * n, [0] * n
    surely = [False] * n
    for i in range(1, n):
        surely[i] = surely[page.parent[i]] or verdicts[i] >= 2
    for i, text in page.flow:
        if text and not surely[i]:
            size[i] += len(text)
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        paragraphs[page.parent[i]] += paragraphs[i] + (page.tag[i] == "p")
    in_article = [False] * n
    out = [False] * n
    for i in range(1, n):
        up = page.parent[i]
        in_article[i] = in_article[up] or page.tag[i] in ("article", "main")
        own = verdicts[i] == 2 or (verdicts[i] == 3 and not wraps[i])
        own = own or (verdicts[i] == 1 and not wraps[i] and (paragraphs[i] < 2 or size[i] <= 0.6 * size[0]))
        own = own or (page.tag[i] == "header" and not in_article[i])
        out[i] = out[up] or own
    return out


def _densities(page: Page, out: list[bool]) -> tuple[list[float], list[float]]:
    """Density of each node and the sum of its children's."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
        if not out[i]:
            tags[i] += 1
            link_tags[i] += page.tag[i] == "a"
    for i, text in page.flow:
        if text and not out[i]:
            size = len(" ".join(text.split()))
            chars[i] += size
            if in_link[i]:
                link_chars[i] += size
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        chars[up] += chars[i]
        tags[up] += tags[i]
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i]
    share = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c = chars[i]
        if c:
            t, lc, lt = max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
            base = math.log(c * lc / max(1, c - lc) + share * c + math.e)
            density[i] = c / t * max(0.0, math.log(c / lc * t / lt)) / max(math.log(base), 1e-9) if base > 1 else 0.0
        if i:
            total[page.parent[i]] += total[i] if page.tag[i] in _INLINE else density[i]
    return density, total


def _lone_heading(page: Page, taken: list[bool], left_out: list[bool]) -> int:
    """The page's one heading of first order where it stands before what is taken, without a link; 0 if there is none."""
    heads = [i for i, tag in enumerate(page.tag) if tag == "h1" and not left_out[i]]
    first = next((i for i, t in enumerate(taken) if t), 0)
    if len(heads) != 1 or heads[0] >= first:
        return 0
    inside = {heads[0]}
    for i in range(heads[0] + 1, len(page.tag)):
        if page.parent[i] in inside:
            inside.add(i)
            if page.tag[i] == "a":
                return 0
    up = heads[0]
    while up > 0:
        up = page.parent[up]
        if page.tag[up] == "a":
            return 0
    return heads[0]


def extract(html: str, comments: bool = False) -> str:
    """Main text of a page: its blocks, joined by line ends."""
    page = Page(html, comments)
    out, removed = _left_out(page, page.out), _left_out(page, page.strict)
    density, total = _densities(page, out)
    n = len(page.tag)
    chosen = max(range(n), key=lambda i: (total[i], page.tag[i] in ("article", "main")))
    if total[chosen] == 0:
        chosen = 0
    path, threshold = chosen, density[chosen]
    while path > 0 and page.tag[path] != "body":
        path = page.parent[path]
        if path and density[path]:
            threshold = min(threshold, density[path])
    # The largest sum in each subtree, so that other dense subtrees find their content.
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if total[best[i]] > total[best[up]]:
            best[up] = best[i]
    is_root = [False] * n
    is_root[chosen] = True
    on_path = [False] * n
    at = chosen
    while at >= 0:
        on_path[at] = True
        at = page.parent[at]
    # Beside the path to the body, dense subtrees are content too.
    for i in range(1, n):
        if not out[i] and not on_path[i] and on_path[page.parent[i]] and density[i] >= threshold and total[best[i]] > 0:
            is_root[best[i]] = True
    taken = [False] * n
    taken[0] = is_root[0]
    for i in range(1, n):
        taken[i] = taken[page.parent[i]] or is_root[i]
    if not any(t and tag == "h1" for t, tag in zip(taken, page.tag)):
        head = _lone_heading(page, taken, [a or b for a, b in zip(out, removed)])
        for i in range(head, n if head else 0):
            taken[i] = taken[i] or i == head or (page.parent[i] > 0 and page.parent[i] >= head and taken[page.parent[i]])
    blocks, block = [], []
    for i, text in page.flow:
        if text is None:
            if block:
                blocks.append(block)
                block = []
        elif taken[i] and not removed[i]:
            block.append(text)
    blocks.append(block)
    lines = (" ".join(htmllib.unescape("".join(b)).split()) for b in blocks)
    found = "\n".join(x for x in lines if x)
    if not found and page.commented:  # the article itself is called a comment
        return extract(html, comments=True)
    return found


def main_text(html: Column) -> Column:
    """Column of the main text of an html column; null is the empty text."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([extract(h) if h else "" for h in pages.to_pylist()], type=pa.string())

    return F.arrow_udf(run, "string")(html)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    text = pages.select("page_id", "url", main_text(pages["html"].cast("string")).alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLE_SQL: dict[str, str] = {}
