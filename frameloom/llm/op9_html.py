"""Main text of web pages by tree scoring.

A page is read into a tree by one pass over its tags (void, raw-text and implied-end tags heeded; a stray end
tag is ignored). Navigation, headers and footers of the page, asides, forms, scripts, styles, hidden parts and
parts whose class or id names them as menus, adverts, notices or comments are left out, but never a named part
that holds an article or main element or, by a name that isn't plain, most of the page's text. Every block with text
of its own is a paragraph: it passes a point, a point a comma and a point each hundred characters (three at
most) to its parent, half to its grandparent and less above. A container's points are discounted by its link
density; the best one is kept, widened to the article or main element around it, with the siblings that read
like its text. Lists and tables that are mostly links go, but not those of an article.

Edge cases: null or empty html gives an empty text; a page without a scored container gives the text of the
whole body less what is left out; repeated rows are kept; texts of any length are read whole.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import table

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
LEFT_OUT = frozenset("head nav footer aside form button select option dialog menu svg canvas object".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tr article section div body main td th blockquote".split())
CONTAINERS = frozenset("article main".split())
LISTS = frozenset("ul ol dl table div section".split())
#: Words of class and id names that mark a part as not the article.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "related reply replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar tags widget widgets".split()
)
#: Of those, what says nothing of the kind within an article: headings, tags and references are its own.
OWN = frozenset("banner footer header masthead notice notices related reply skip tags".split())
#: Words that make a class name say what a part has, not what it is.
QUALIFIERS = frozenset("has have with without no is are show hide hides".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NAME = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]")


def names_unwanted(value: str, in_article: bool) -> int:
    """2 if a token of a class or id as a whole names a part that isn't the article, 1 if one of its words does; within an article only the whole counts."""
    most = 0
    for token in value.split():
        words = [w.lower() for w in NAME.findall(token)]
        if not QUALIFIERS.isdisjoint(words):
            continue
        if words and all(w in UNWANTED and not (in_article and w in OWN) for w in words):
            most = 2
        elif not in_article and any(w in UNWANTED for w in words):
            most = max(most, 1)
    return most


def unwanted(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """Whether a part is left out for what it is, and how its class or id names it as unwanted."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return True, 0
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, 0
    named = 0
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            named = max(named, names_unwanted(value, in_article))
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, named
    return False, named


class Tree:
    """Nodes in page order, parents before children; runs: (node, text), text None at a block's edge."""

    def __init__(self, page: str):
        self.tag, self.parent, self.out, self.article, self.named = ["#"], [0], [False], [False], [0]
        self.runs: list[tuple[int, str | None]] = []
        self.opened: Counter[str] = Counter()  # how many of a name are on the stack: no search for what isn't there
        stack, at, end = [0], 0, len(page)
        while at < end:
            m = TAG.search(page, at)
            if (upto := m.start() if m else end) > at and not self.out[stack[-1]]:
                self.runs.append((stack[-1], html_lib.unescape(page[at:upto])))
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self.close(stack, name)
            else:
                at = self.open(stack, name, m[3] or m[6] or "", page, at)

    def edge(self, stack: list[int], name: str) -> None:
        if name not in INLINE:
            self.runs.append((stack[-1], None))

    def pop(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            self.edge(stack, self.tag[stack[-1]])
            self.opened[self.tag[stack.pop()]] -= 1

    def close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1) if self.opened[name] else ():
            if self.tag[stack[k]] == name:
                self.pop(stack, k)
                return
            if name in INLINE and self.tag[stack[k]] not in INLINE:
                return  # an inline end tag doesn't end blocks
        self.edge(stack, name)

    def open(self, stack: list[int], name: str, attrs: str, page: str, at: int) -> int:
        if name in CLOSES_P and self.opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == "p":
                    self.pop(stack, k)
                    break
                if self.tag[stack[k]] not in INLINE:
                    break
        if name in ENDS and any(self.opened[t] for t in ENDS[name]):
            for k in range(len(stack) - 1, 0, -1):
                if (t := self.tag[stack[k]]) in ENDS[name]:
                    self.pop(stack, k)
                    if name != "tr" or t == "tr":
                        break
                elif t in SCOPE and not (name == "tr" and t in ("td", "th")):
                    break
        self.edge(stack, name)
        if name in VOID:
            return at
        if name == "body" and len(stack) > 1:  # what head left open ends here
            self.pop(stack, 1 + (self.tag[stack[1]] == "html"))
        up = stack[-1]
        self.tag.append(name)
        self.parent.append(up)
        self.article.append(self.article[up] or name in CONTAINERS)
        out, named = unwanted(name, attrs, self.article[up])
        self.out.append(self.out[up] or out)
        self.named.append(named)
        if attrs.rstrip().endswith("/") and name in ("svg", "path"):
            return at
        if name in RAW:
            m = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            return m.end() if m else len(page)
        stack.append(len(self.tag) - 1)
        self.opened[name] += 1
        return at


def leave_out_named(t: Tree) -> None:
    """Leaves out what is named as unwanted, but never what holds an article or main element.

    Nor what holds all of the page's text or, if its name isn't plain, most of it: a long list of comments isn't the article.
    """
    n = len(t.tag)
    holds, total = [t.tag[i] in CONTAINERS and not t.out[i] for i in range(n)], [0] * n
    for i, text in t.runs:
        total[i] += len(" ".join(text.split())) if text else 0
    for i in range(n - 1, 0, -1):
        holds[t.parent[i]] = holds[t.parent[i]] or holds[i]
        total[t.parent[i]] += total[i]
    for i in range(1, n):
        t.out[i] = t.out[i] or t.out[t.parent[i]] or t.named[i] > 0 and not holds[i] and (total[i] < total[0] if t.named[i] == 2 else 2 * total[i] <= total[0])
    t.runs = [(i, text) for i, text in t.runs if text is None or not t.out[i]]


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order joined by one space, white space inside a block as one space."""
    if not page:
        return ""
    t = Tree(page)
    leave_out_named(t)
    n = len(t.tag)
    block, link = list(range(n)), [False] * n
    for i in range(1, n):
        link[i] = t.tag[i] == "a" or link[t.parent[i]]
        if t.tag[i] in INLINE:
            block[i] = block[t.parent[i]]
    size, commas, linked = [0] * n, [0] * n, [0] * n
    for i, text in t.runs:
        if text:
            k = len(" ".join(text.split()))
            size[block[i]] += k
            commas[block[i]] += text.count(",")
            linked[block[i]] += k * link[i]
    points, total, total_linked = [0.0] * n, size[:], linked[:]
    for i in range(n - 1, 0, -1):
        if size[i]:
            p = (1 + commas[i] + min(size[i] // 100, 3)) * (1 - linked[i] / size[i])
            up, share = t.parent[i], 1.0
            if t.tag[i] in ("div", "section", "article", "main", "body"):
                points[i] += p
            for depth in range(2, 6):
                points[up] += p * share
                if not up:
                    break
                up, share = t.parent[up], 1 / depth if depth == 2 else 1 / (3 * (depth - 1))
        total[t.parent[i]] += total[i]
        total_linked[t.parent[i]] += total_linked[i]
    density = [total_linked[i] / total[i] if total[i] else 0.0 for i in range(n)]
    bonus = {"article": 1.25, "main": 1.2, "html": 0.1, "#": 0.1}
    scores = [points[i] * (1 - density[i]) * bonus.get(t.tag[i], 1.0) if t.tag[i] not in INLINE else 0.0 for i in range(n)]
    best = max(range(n), key=scores.__getitem__, default=0)
    if scores[best] <= 0:
        best = next((i for i in range(n) if t.tag[i] in CONTAINERS and total[i] and not t.out[i]), 0)
    kept = {best}
    if best:
        up = best
        while up and t.tag[up] not in CONTAINERS:
            up = t.parent[up]
        if up:
            kept = {up}
        else:
            for i in range(1, n):
                if t.parent[i] == t.parent[best] and i != best and not t.out[i] and total[i]:
                    reads = t.tag[i] in ("p", "pre", "blockquote", "h1", "h2", "h3") and density[i] < (0.25 if total[i] > 80 else 0.01)
                    if reads or scores[i] >= max(10.0, 0.2 * scores[best]):
                        kept.add(i)
    inside = [False] * n
    inside[0] = 0 in kept
    for i in range(1, n):
        inside[i] = (i in kept or inside[t.parent[i]]) and not (t.tag[i] in LISTS and i not in kept and not t.article[i] and total[i] and density[i] > 0.5)
    return " ".join("".join(" " if text is None else text for i, text in t.runs if text is None or inside[i]).split())


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds text, the main text of html_col, to pages; columns of that name are replaced."""
    names = [c for c in pages.columns if c != "text"]
    schema = pages.select(*names).schema.add("text", "string")
    at = names.index(html_col)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "text"])

    return pages.select(*names).mapInArrow(extracted, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html": op9_html}
ORACLES: dict[str, str] = {}
