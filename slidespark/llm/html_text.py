"""Main text of HTML pages by tree scoring.

Method: a tolerant tree of the page is built. Every paragraph earns points for its length and commas, less its
share of link text; its container takes them in full, the container above half, the next a third. The container
with the most points and those siblings of it and of its ancestors that look like text are kept; boilerplate elements
are dropped by element name, role and class (a class says so if all of its parts do). Of containers with equal
points the first is taken.

Edge cases: null, empty or text-free html gives the empty string; markup that never closes, unknown elements and
very long or deeply nested pages are read whole (the tree is arrays, without recursion); plain text without any
markup is one block; repeated rows are read row by row; other columns of the input are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, STR, schema

# fixed values: element names of the HTML standard, and names used for page furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas audio video select option button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("head nav header footer aside form fieldset menu dialog search".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar sidenav rail aside footer header masthead comment comments commentlist disqus reply replies respond share sharing social cookie cookies consent gdpr"
    " notice notices notification alert popup modal overlay newsletter subscribe subscription signup login related recommended recommendations widget toolbar"
    " pagination pager popular trending taboola outbrain feedback hidden skip".split()
)
#: Words that may stand beside a furniture name in a class without changing what it says.
BESIDE = frozenset(
    "site page main post posts entry article top bottom left right upper lower global local primary secondary inner outer wrapper wrap container box block bar list item items"
    " section area region panel content unit slot zone module links link icons buttons button text form bg row col column grid fixed sticky mobile desktop js is the"
    " body user users reader readers thread threads author count tools tool message messages articles story stories posts fb facebook".split()
)
OPENED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table td th article section main body html div aside nav header footer form blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))", re.I)
NAME = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
#: Words of readers' comments: one of them in a class decides alone. Words before a name that only say what a container has.
COMMENT, HAS = re.compile(r"comment(s|er|ers|list|lists|thread|threads|body|box|form|area|section)?"), frozenset("with has have no not without hide show".split())


def _furniture(tag: str, attrs: str) -> bool:
    if tag in DROP:
        return True
    if not attrs.strip() or tag in ("html", "body"):
        return False
    for k, v in ATTR.findall(attrs):
        k, names = k.lower(), v.strip("\"'")
        v = names.lower()
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v in ROLES:
            return True
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
            return True
        if k in ("class", "id"):
            if tag in ("article", "main") and not re.search(r"comment|reply|related|sponsor|advert|promo", v):
                continue
            for name in names.split():
                parts = [x.lower() for x in NAME.findall(name)]
                if HAS.isdisjoint(parts) and (any(map(COMMENT.fullmatch, parts)) or any(p in FURNITURE for p in parts) and all(p in FURNITURE or p in BESIDE for p in parts)):
                    return True
    return False


def main_text(html: str) -> str:
    """The main text of one page: blocks in page order, joined by line feeds."""
    tags, parent, dead, stack = ["#root"], [-1], [False], [0]
    chunks: list[tuple[int, int, str, bool]] = []  # (node, block number, text, in a link)
    block, at, links = 0, 0, 0
    n = len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            chunks.append((stack[-1], block, html[at:], links > 0))
            break
        if m.start() > at:
            chunks.append((stack[-1], block, html[at : m.start()], links > 0))
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in BLOCK or tag == "p":
                lim = next((i for i in range(len(stack) - 1, 0, -1) if tags[stack[i]] in SCOPE), 0)
            else:
                lim = 0
            for i in range(len(stack) - 1, lim, -1) if tag not in SCOPE or tag == "p" else range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == tag:
                    links -= sum(tags[x] == "a" for x in stack[i:])
                    del stack[i:]
                    break
            if tag in BLOCK:
                block += 1
            continue
        if tag == "br":
            chunks.append((stack[-1], block, " ", links > 0))
            continue
        if tag in BLOCK:
            block += 1
            closes = OPENED_BY.get(tag)
            for i in range(len(stack) - 1, 0, -1):
                t = tags[stack[i]]
                if t == "p" or closes and t in closes:
                    links -= sum(tags[x] == "a" for x in stack[i:])
                    del stack[i:]
                    if t != "p":
                        break
                elif t in SCOPE:
                    break
        if tag in VOID:
            continue
        tags.append(tag)
        parent.append(stack[-1])
        # the header of the article itself holds its title
        own = tag == "header" and any(tags[x] in ("article", "main") for x in stack)
        # a quotation set beside its article is text of it, and so is the name of a button within a sentence
        own = own or tag == "aside" and re.search(r"pull-?_?quote", m[3], re.I) is not None or tag == "button" and any(tags[x] == "p" for x in stack)
        dead.append(dead[stack[-1]] or _furniture("div" if own else tag, m[3]))
        if tag in RAW and not own:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at) if not m[3].rstrip().endswith("/") else None
            if end:
                at = end.end()
            elif tag in ("script", "style") and not m[3].rstrip().endswith("/"):
                at = n
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        links += tag == "a"
        stack.append(len(tags) - 1)
    size = len(tags)
    # paragraphs: the living text of one block
    text: dict[int, list] = {}
    for node, b, s, linked in chunks:
        if not dead[node]:
            s = unescape(s)
            x = text.setdefault(b, [node, [], 0, 0])
            x[1].append((node, s))
            k = len(s.split())
            x[2] += k
            x[3] += k * linked
    score, words, linked_words = [0.0] * size, [0] * size, [0] * size
    for node, parts, k, in_link in text.values():
        s = " ".join("".join(p for _, p in parts).split())
        if not s:
            continue
        while node and tags[node] not in BLOCK:
            node = parent[node]
        points = ((len(s) >= 25) + sum(map(s.count, ",،，、")) + min(len(s) / 100, 3)) * (1 - in_link / max(k, 1))
        i = node if tags[node] in ("div", "section", "article", "main", "body", "#root") else max(parent[node], 0)
        for share in (1, 1 / 2, 1 / 3):
            if i < 0:
                break
            score[i] += points * share
            i = parent[i]
        i = node
        words[i] += k
        linked_words[i] += in_link
    for i in range(size - 1, 0, -1):
        words[parent[i]] += words[i]
        linked_words[parent[i]] += linked_words[i]
    density = [b / a if a else 0.0 for a, b in zip(words, linked_words, strict=True)]
    final = [s * (1 - d) for s, d in zip(score, density, strict=True)]
    best = max(range(size), key=lambda i: (final[i], -i)) if size else 0
    if final[best] <= 0:
        roots = {0}
    else:
        i = top = best
        while i > 0:
            if tags[i] in ("article", "main"):
                top = i
            i = parent[i]
        roots = {top}
        # siblings of the best container and of its ancestors that look like text
        least = max(3.0, final[top] * 0.2)
        beside, i = set(), top
        while parent[i] >= 0:
            beside.add(i)
            i = parent[i]
        up_to = {parent[i]: i for i in beside}
        for j in range(1, size):
            if parent[j] in up_to and j not in beside and not dead[j] and density[j] < 0.25:
                few = 1 if parent[j] == parent[top] else 10
                if final[j] >= least or tags[j] in ("p", "h1", "h2", "h3", "blockquote", "pre") and words[j] >= few:
                    roots.add(j)
    named = any(tags[i] in ("article", "main") for i in roots)
    inside = [False] * size
    for i in range(size):
        up = parent[i]
        inside[i] = not dead[i] and (i in roots or up >= 0 and inside[up])
        # boxes of links outside of an article; within it lists of links, such as sources, are text
        if inside[i] and i not in roots and not named and tags[i] in ("ul", "ol", "div", "section", "table", "dl") and words[i] and density[i] > 0.6:
            inside[i] = False
    out = []
    for b in sorted(text):
        s = " ".join("".join(p for node, p in text[b][1] if inside[node]).split())
        if s:
            out.append(s)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page; text is the main text, empty if none."""

    def run(batches):
        for b in batches:
            text = pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, schema(page_id=LONG, url=STR, text=STR))
