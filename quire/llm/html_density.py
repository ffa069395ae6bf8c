"""Main text of web pages by composite text density.

For every DOM node, with C characters and T tags below it and LC and LT of these inside links, the
composite density is C/T scaled by a logarithm that falls as links take over. A node's density sum
is that of its children. The subtree of the largest density sum is the core of the content; from there
it grows to the container around it while what that adds is not mostly links, up to an article, a
main element or the body. The least density on the path from the body to the core is the threshold, and
other subtrees outside the content join in when they reach it. Page furniture is cut off before: hidden elements, elements that are furniture
by name or role, and blocks whose class or id says so. The latter stay if they hold the article, or
most of the page's text while no heading or article stands elsewhere; so do forms, fieldsets, labels,
searches and dialogs, which may wrap a whole page. Other furniture stays only around a main element.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
# One attribute after the other: a name, then perhaps a value, which is consumed whole.
_ATTRIBUTE = re.compile(r"""([^\s>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())
_BITS = re.compile(r"[a-z]+|[0-9]+")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|\Z)")

# Element names of HTML by what they mean here, and words of class names and ids.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = frozenset("nav footer aside form head button select option input dialog menu object canvas audio video label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Of these names and roles, those that may wrap the article; and controls, which hold none.
_WRAPPERS = frozenset("form dialog label fieldset search alertdialog".split())
_DIALOGS = frozenset(["dialog", "alertdialog"])
_CONTROLS = frozenset("button select option input canvas audio video".split())
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu"
    " sidebar aside footer header masthead topbar toolbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices"
    " banner alert popup modal overlay comment comments disqus discussion replies respond reply related recommended"
    " share sharing social subscribe newsletter signup login search widget pagination pager copyright disclaimer".split()
)
#: Words that say where or what kind of box it is, beside words of the list above.
_PLACES = frozenset(
    "site global main top bottom left right box block wrap wrapper container section area bar list links link buttons button icons inner outer"
    " panel slot unit zone row col column group item items posts form block strip fixed sticky inline native".split()
)
#: Elements of the text itself, which a class name never cuts within an article.
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p table thead tbody tr td th pre blockquote figure figcaption ul ol li dl dt dd".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may be a whole article, and where it ends at the latest.
_CONTAINERS = frozenset("article center div form main section table td".split())
_BOXES = frozenset("div section ul ol table center".split())
_WHOLE = frozenset(["article", "main"])
#: An open element of the second set ends when one of the first begins.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P = frozenset(["p"])
_P_SCOPE = frozenset("table td th button article section div body html li blockquote".split())


def _hint(value: str) -> int:
    """2 if a class or id names furniture and nothing else, as an ad does, 1 if it has other words, too, as ad-hoc."""
    found = 0
    for token in value.split():
        bits = [x for x in _BITS.findall(token) if not x.isdigit()]
        if any(x in _HINTS for x in bits):
            found = max(found, 1 + all(x in _HINTS or x in _PLACES for x in bits))
    return found


class Page:
    """The DOM of one page as parallel lists; node 0 is the document, parents come before children."""

    def __init__(self, source: str):
        self.names, self.parents, self.cut, self.hinted = ["html"], [-1], [False], [False]
        self.furniture = [frozenset()]  # the names and roles by which a node is furniture
        self.texts: list[tuple[int, str]] = []  # text and the node it stands in
        self.breaks: set[int] = set()  # indexes into texts where a block begins or ends
        self.open = Counter()  # open elements by name
        self.sure = [False]  # whether the class or id names nothing but furniture
        self.nested = [False]  # whether an article or main element is open around a node
        stack, at = [0], 0
        for m in _MARKUP.finditer(source):
            if m.start() > at:
                self.texts.append((stack[-1], html.unescape(source[at : m.start()])))
            at = m.end()
            if not (name := m["name"]):
                continue
            name = name.lower()
            if name in _BLOCKS:
                self.breaks.add(len(self.texts))
            if m["close"]:
                self._close(stack, name)
            elif name not in ("html", "body") or len(stack) == 1:
                self._open(stack, name, m["rest"])
        if at < len(source):
            self.texts.append((stack[-1], html.unescape(source[at:])))

    def _pop(self, stack: list[int], i: int) -> None:
        for node in stack[i:]:
            self.open[self.names[node]] -= 1
        del stack[i:]

    def _until(self, stack: list[int], names: frozenset, scope: frozenset) -> None:
        """Close the innermost open element of these names, unless one of the scope lies between."""
        if not any(self.open[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.names[stack[i]] in names:
                self._pop(stack, i)
                return
            if self.names[stack[i]] in scope:
                return

    def _open(self, stack: list[int], name: str, rest: str) -> None:
        if name in _BLOCKS:
            self._until(stack, _P, _P_SCOPE)
        if name in _ENDS:
            self._until(stack, *_ENDS[name])
        node, inside = len(self.names), bool(self.open["article"] or self.open["main"])
        cut, hinted, sure, furniture = name in _CONTROLS, False, False, set()
        if name in _FURNITURE or name == "header" and not inside:
            furniture.add(name)
        if rest and not rest.isspace():
            for m in _ATTRIBUTE.finditer(rest):
                if m[1].lower() not in _ATTRIBUTES:
                    continue
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key == "role":
                    furniture |= {value} & _ROLES
                elif key in ("class", "id"):
                    hint = _hint(value)
                    hinted |= hint == 2 or hint == 1 and not inside
                    sure |= hint == 2
                elif key == "style":
                    cut |= bool(_UNSHOWN.search(value))
                else:
                    cut |= key == "hidden" or value == "true"
        self.names.append(name)
        self.parents.append(stack[-1])
        self.cut.append(cut and name not in ("html", "body"))
        self.furniture.append(frozenset() if name in ("html", "body") else frozenset(furniture))
        self.hinted.append(hinted and name not in ("html", "body", "main") and name not in _HEADS and not (inside and name in _TEXT))
        self.sure.append(sure)
        self.nested.append(self.open["article"] > 0)
        if name not in _VOID:
            stack.append(node)
            self.open[name] += 1
        elif name in ("br", "hr"):
            self.texts.append((stack[-1], " "))

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open[name]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.names[stack[i]] == name:
                self._pop(stack, i)
                return

    def _sums(self, own: list[float]) -> list[float]:
        out = own[:]
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def prune(self) -> None:
        """Extend the cuts to what lies below them, and cut furniture and hinted blocks that aren't the
        page itself."""
        n = len(self.names)
        own = [0.0] * n
        for node, text in self.texts:
            own[node] += len(text)
        chars = self._sums(own)
        plain = [not h for h in self.hinted]
        holds = self._sums([float(x in ("article", "main") and p) for x, p in zip(self.names, plain)])
        anchors = self._sums([float(x in ("article", "main", "h1") and p) for x, p in zip(self.names, plain)])
        mains = self._sums([float(x == "main" and p) for x, p in zip(self.names, plain)])
        bare = self.cut[:]  # what is never the article, so that its text says nothing of what is around it
        for i in range(1, n):
            bare[i] |= bare[self.parents[i]] or bool(self.furniture[i] - _WRAPPERS) and not mains[i]
        prose = self._sums([x * (not b) for x, b in zip(own, bare)])
        heads = self._sums([float(x in ("article", "main", "h1") and p and not b) for x, p, b in zip(self.names, plain, bare)])
        titles = self._sums([float(x == "h1") for x in self.names])
        for i in range(1, n):
            # the box of a title, by whatever name
            self.hinted[i] = self.hinted[i] and not (titles[i] == titles[0] > 0 and not self.sure[i] and 4 * chars[i] < chars[0])
            if self.furniture[i] and not mains[i]:
                # most of the text, and a heading or article if the page has one; or all of these
                every = heads[i] == heads[0]
                most = 2 * prose[i] >= prose[0] > 0 and (every or heads[i] > 0 and not self.furniture[i] & _DIALOGS)
                every = every and holds[i] > 0
                self.cut[i] |= not self.furniture[i] <= _WRAPPERS or not (most or every)
            if self.hinted[i]:
                if self.names[i] == "article":
                    self.cut[i] |= self.nested[i]  # as reader comments may be
                elif not holds[i]:
                    # a large one goes too when the page's heading or article stands elsewhere
                    self.cut[i] |= 2 * chars[i] < chars[0] or not anchors[i] and anchors[0] > 0
            self.cut[i] |= self.cut[self.parents[i]]

    def content(self) -> set[int]:
        """The roots of the content."""
        n = len(self.names)
        chars, link = [0.0] * n, [False] * n
        for i in range(1, n):
            link[i] = link[self.parents[i]] or self.names[i] == "a"
        linked = [0.0] * n
        for node, text in self.texts:
            if not self.cut[node]:
                size = len("".join(text.split()))
                chars[node] += size
                linked[node] += size * link[node]
        tags = self._sums([float(not c) for c in self.cut])
        link_tags = self._sums([float(not c and x == "a") for c, x in zip(self.cut, self.names)])
        c, lc = self._sums(chars), self._sums(linked)
        if not c[0]:
            return set()
        share, density = lc[0] / c[0], [0.0] * n
        for i in range(n):
            if c[i]:
                t, l, lt = max(1.0, tags[i] - 1), max(1.0, lc[i]), max(1.0, link_tags[i])
                base = math.log(c[i] / max(1.0, c[i] - lc[i]) * lc[i] + share * c[i] + math.e)
                density[i] = c[i] / t * max(0.0, math.log(max(1.0, c[i] / l * (t / lt))) / max(1e-9, math.log(base)) if base > 1.0001 else math.log(max(1.0, c[i] / l * (t / lt))) + 1)
        sums = [0.0] * n
        for i in range(1, n):
            sums[self.parents[i]] += density[i]
        for i in range(n):
            sums[i] = sums[i] or density[i] * (c[i] > 0)  # a leaf stands for itself
        best = max(range(n), key=lambda i: (sums[i], -i))
        threshold, i = density[best], best
        while i >= 0:
            if self.names[i] != "html":
                threshold = min(threshold, density[i])
            i = self.parents[i]
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[self.parents[i]].append(i)
        heads = self._sums([float(x in _HEADS and not k) for x, k in zip(self.names, self.cut)])
        root = i = best
        while self.names[root] not in _WHOLE and self.parents[i] > 0 and self.names[self.parents[i]] != "body":
            below, i = i, self.parents[i]
            # a paragraph or a bold word is never all of an article; more joins it while some of what stands beside it
            # is as dense as the path, or a heading, and links are the lesser part
            joins = any(x != below and c[x] and (density[x] >= threshold or heads[x]) for x in children[i])
            if joins and lc[i] - lc[root] <= 0.3 * (c[i] - c[root]) or self.names[root] not in _CONTAINERS:
                root = i
        roots, above, inside, i = {root}, set(), [False] * n, root
        while i >= 0:
            above.add(i)
            i = self.parents[i]
        for i in range(n):
            p = self.parents[i]
            inside[i] = i == root or p >= 0 and (inside[p] or p in roots)
            # a box of links in the content that the threshold leaves out
            if inside[i] and i != root and self.names[i] in _BOXES and c[i] and density[i] < threshold and lc[i] > 0.7 * c[i] and not heads[i]:
                self.cut[i] = True
            self.cut[i] = self.cut[i] or p >= 0 and self.cut[p]
            if not inside[i] and i not in above and not self.cut[i] and self.names[i] in _BLOCKS and density[i] >= threshold and c[i] and lc[i] <= 0.3 * c[i]:
                roots.add(i)
        return roots

    def blocks(self, roots: set[int]) -> list[str]:
        """The texts of the blocks below the roots, in page order."""
        inside = [False] * len(self.names)
        for i, p in enumerate(self.parents):
            inside[i] = i in roots or p >= 0 and inside[p]
        out, parts = [], []
        for k, (node, text) in enumerate(self.texts):
            if k in self.breaks:
                out.append(parts)
                parts = []
            if inside[node] and not self.cut[node]:
                parts.append(text)
        out.append(parts)
        return [x for p in out if (x := " ".join("".join(p).split()))]


def main_text(source: str | None) -> str:
    """The text of a page's article; empty for a null or empty page, or one without content."""
    if not source:
        return ""
    page = Page(source)
    page.prune()
    roots = page.content()
    return "\n\n".join(page.blocks(roots)) if roots else ""


@F.arrow_udf(T.StringType())
def _extract(column: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in column], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """pages with text, the main text of html: its blocks joined by two newlines, white space inside
    a block as one space, character references decoded. Null, empty and contentless pages give the
    empty text. Other columns stay, an existing text column is replaced, repeated rows are extracted
    each, very long ones whole, an empty table gives no rows."""
    return pages.drop("text").withColumn("text", _extract(F.col("html").cast("string")))
