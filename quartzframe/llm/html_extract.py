"""Main text of web pages with removal of site templates.

1. Each page is parsed once into a tree, and every element's subtree is hashed (tags and text).
2. Spark counts, for each host, the different pages that hold a subtree; copies of one article count once, as a page
   counts by the hash of its main part. A subtree on ``least_pages`` different pages of a host is its template. Inside
   an article it takes ``article_pages``, and paragraphs and headings stay however often they recur, as near copies of
   an article share them: there containers go (boxes, lists, tables), and parts that are named like templates.
   Both limits are absolute, so a host's growth brings no template back.
3. Each page is parsed again without such subtrees. Text blocks are joined by one space, in page order.

Names decide alone where counts cannot: parts that no article has by their tag or role, and parts whose class or id
says nothing but adverts, comments, menus and the like. Names that may mean content, too ("related", "notice"), decide
only on hosts with fewer than ``least_pages`` different pages, and only for boxes.

Which elements of a page go is gathered by host and page, and pages meet that by a join where only rows that a filter of
a fixed size lets pass are shuffled (``common.join_filtered``). Subtrees meet the templates likewise, hot ones by a
broadcast of at most ten thousand. Counting has partial sums, so a host with a third of all pages, all with one menu, is
one row a task.

Rows: a null html is an empty page with empty text. A null url is a host of its own. Repeated rows give a row each. A
null page_id is kept. Pages are parsed whole, whatever their nesting. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzframe.llm import common

LEAST_PAGES = 10
ARTICLE_PAGES = 20
#: Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video nav footer aside form button select textarea input label option datalist dialog menu noembed noframes applet map fieldset legend progress meter".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the same group, within the nearest of the third group.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table select html body article section div main td th".split())
#: Words of class, id or role names that mark parts which are not the article.
NOISE = frozenset(
    "ad ads adv advert advertisement advertising adsbygoogle sponsor sponsored nav navbar navigation menu menubar topbar breadcrumb breadcrumbs sidebar masthead footer"
    " cookie cookies consent gdpr popup modal overlay comment comments disqus replies sharing share social newsletter subscription pagination pager contentinfo complementary".split()
)
#: Words that mark such parts, or parts of an article.
PERHAPS = frozenset(
    "banner promo promotion notice notices notification alert dialog widget widgets rail toolbar respond reply follow subscribe signup login search related recommended recommendations"
    " skip copyright disclaimer aside foot".split()
)
#: Words that say nothing beside them, as in "footer-links" but not in "market-share".
BESIDE = frozenset(
    "area bar block body box button buttons bottom col column container content fixed form global group heading icon icons image inner item items js left lg link links list main md"
    " outer page panel post posts primary right row secondary section site sm slot sticky text title top unit wrap wrapper xl zone".split()
)
#: Roles of parts that are not the article.
LANDMARKS = frozenset("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Inside articles, elements that are removed if they recur.
CONTAINERS = frozenset("div section ul ol dl table figure center details".split())
#: Elements that do not end an open head.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: A quote opens a value only after an equals sign.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACES = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element; number: its place among the page's start tags."""

    __slots__ = ("tag", "noise", "perhaps", "main", "number", "items")

    def __init__(self, tag: str, number: int = 0, noise: bool = False, perhaps: bool = False, main: bool = False):
        self.tag, self.number, self.noise, self.perhaps, self.main, self.items = tag, number, noise, perhaps, main, []


def _says(names: list[set[str]], words: frozenset | set) -> bool:
    """Does a name consist of words, and others that say nothing beside them."""
    return any(n & words and n <= words | BESIDE for n in names)


def _marks(tag: str, attributes: str, plain: bool) -> tuple[bool, bool, bool]:
    """Is the element noise; perhaps; the main part. plain: it is outside of such a part."""
    if not attributes.strip(" /\n\t\r"):
        return tag in DROPPED or (tag == "header" and plain), False, tag in ("article", "main")
    found = {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    names = [{w.lower() for w in _NAME.findall(x)} - {""} for k in ("class", "id") for x in found.get(k, "").split()] + [{w.lower() for w in _NAME.findall(found.get("aria-label", ""))}]
    names = [{w for w in n if not w.isdigit()} for n in names]
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    named = tag not in ("html", "body", "main") and (_says(names, NOISE) or role in LANDMARKS)
    noise = tag in DROPPED or hidden or named or (plain and (tag == "header" or role == "banner" or _says(names, {"header"})))
    return noise, tag in CONTAINERS and _says(names, NOISE | PERHAPS), main


def parse(html: str) -> Node:
    """The element tree; text items are strings. Missing and stray end tags are repaired as browsers do in the main."""
    root = Node("html")
    stack, open_tags, at, number = [root], defaultdict(int), 0, 0
    end = len(html)
    while at < end:
        found = _TAG.search(html, at)
        if found is None:
            stack[-1].items.append(html[at:])
            break
        if found.start() > at:
            stack[-1].items.append(html[at : found.start()])
        at = found.end()
        cdata, closing, tag, attributes = found.groups()
        if cdata is not None:
            stack[-1].items.append(cdata)
        if tag is None:
            continue
        tag = tag.lower()

        def pop(to: int) -> None:
            while len(stack) > to:
                open_tags[stack.pop().tag] -= 1

        if closing:
            if open_tags[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                pop(depth)
            continue
        if open_tags["head"] and tag not in IN_HEAD:
            depth = len(stack) - 1
            while stack[depth].tag != "head":
                depth -= 1
            pop(depth)
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and open_tags["p"] > 0:
            depth = len(stack) - 1
            while depth and stack[depth].tag != "p" and (stack[depth].tag in INLINE or stack[depth].tag == "p"):
                depth -= 1
            if stack[depth].tag == "p":
                pop(depth)
        if tag in SIBLINGS:
            depth = len(stack) - 1
            to = None
            while depth and (stack[depth].tag not in SCOPES or stack[depth].tag in SIBLINGS[tag]):
                if stack[depth].tag in SIBLINGS[tag]:
                    to = depth
                depth -= 1
            if to is not None:
                pop(to)
        number += 1
        node = Node(tag, number, *_marks(tag, attributes, open_tags["article"] + open_tags["main"] == 0))
        stack[-1].items.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if tag not in DROPPED:
                node.items.append(html[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID:
            stack.append(node)
            open_tags[tag] += 1
    return root


def _parts(root: Node) -> list[Node]:
    """The outermost main parts that are not in noise, or else the whole page."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.noise and node is not root:
            continue
        if node.main:
            found.append(node)
        else:
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    if articles := [x for x in found if x.tag == "main"]:
        return articles
    return found or [root]


def _key(parts: tuple) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest("\x00".join(parts).encode()) - (1 << 63)


def subtrees(root: Node) -> tuple[list[tuple[Node, int, bool, bool]], int]:
    """Elements with text that may be removed as templates, with the hash of their subtree, whether they lie inside a main
    part, and whether their text would stay without that; and the hash of the main parts."""
    hashes: dict[int, int] = {}
    inside: dict[int, bool] = {}
    stays: dict[int, bool] = {}
    order: list[Node] = []
    parts = _parts(root)
    starts, shown = {id(p) for p in parts if p.main}, {id(p) for p in parts}
    todo: list[tuple[Node, bool, bool, bool]] = [(root, False, False, False)]
    while todo:
        node, done, within, stay = todo.pop()
        children = [x for x in node.items if isinstance(x, Node)]
        if not done:
            stay = id(node) in shown or (stay and not node.noise)
            inside[id(node)], stays[id(node)] = within, stay
            within = within or id(node) in starts
            todo.append((node, True, within, stay))
            todo += [(x, False, within, stay) for x in children]
            continue
        inner = [t for x in node.items if (t := str(hashes.get(id(x), "")) if isinstance(x, Node) else _SPACES.sub(" ", x).strip())]
        if inner:
            hashes[id(node)] = _key((node.tag, *inner))
            order.append(node)
    found = [(n, hashes[id(n)], inside[id(n)], stays[id(n)]) for n in order if n.number and id(n) not in starts and (not inside[id(n)] or n.tag in CONTAINERS or n.perhaps or n.noise)]
    return found, _key(tuple(str(hashes.get(id(p), "")) for p in parts))


def blocks(root: Node, without: frozenset | set = frozenset()) -> list[str]:
    """Text blocks of the main parts in page order, without noise and the elements of the numbers in without."""
    out, current = [], []

    def flush() -> None:
        if text := _SPACES.sub(" ", unescape("".join(current))).strip():
            out.append(text)
        current.clear()

    for part in _parts(root):
        todo: list = [part]
        while todo:
            node = todo.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                current.append(node)
            elif node is not part and (node.noise or node.number in without):
                if node.tag not in INLINE:
                    flush()
            elif node.tag in INLINE:
                todo += reversed(node.items)
            else:
                flush()
                todo.append(None)
                todo += reversed(node.items)
        flush()
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("page_key"), F.length(html).alias("page_size"))


SUBTREES = "host string, page_key long, page_size int, page long, subtree long, in_article boolean, stays boolean, perhaps boolean, number int"


def _subtree_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for host, key, size, html in zip(batch["host"], batch["page_key"], batch["page_size"], batch["html"], strict=True):
            found, main = subtrees(parse(html))
            out += [(host, key, size, main, x, inside, stay, node.perhaps and not node.noise, node.number) for node, x, inside, stay in found]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SUBTREES.split(", ")])


def counted_subtrees(pages: DataFrame) -> DataFrame:
    """SUBTREES of all pages: of which page (key and size of its html, hash of its main part), in the shared folder."""
    rows = common.ship(_rows(pages))
    return common.materialize(rows.select("host", "page_key", "page_size", "html").mapInPandas(_subtree_rows, SUBTREES), "subtrees")


def templates(found: DataFrame, least_pages: int = LEAST_PAGES, article_pages: int = ARTICLE_PAGES) -> DataFrame:
    """host, subtree, in_article, n (rows of found) and n_pages: the subtrees that are their host's template; found: as
    counted_subtrees gives them."""
    once = found.groupBy("host", "subtree", "in_article", "page").agg(F.count(F.lit(1)).alias("rows"))
    counts = once.groupBy("host", "subtree", "in_article").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("n_pages"))
    return counts.where(F.col("n_pages") >= F.when(F.col("in_article"), article_pages).otherwise(least_pages))


def removed(found: DataFrame, least_pages: int = LEAST_PAGES, article_pages: int = ARTICLE_PAGES) -> DataFrame:
    """host, page_key, page_size, without (numbers of elements) and n (rows) of the pages that lose some."""
    known = common.materialize(templates(found, least_pages, article_pages).drop("n_pages"), "templates")
    every = found
    found = found.where("stays")  # the rest is counted only: it goes by its tag, or lies beside the article
    recurring = common.join_counted(found, known, ["host", "subtree", "in_article"]).drop("n")
    unsure = found.where("perhaps")
    pages = every.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    rows = unsure.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    few = common.materialize(rows.join(pages.where(F.col("pages") < least_pages), "host").select("host", "n"), "few-pages")
    named = common.join_counted(unsure, few, ["host"]).drop("n")
    both = recurring.unionByName(named).groupBy("host", "page_key", "page_size").agg(F.collect_set("number").alias("without"), F.count(F.lit(1)).alias("rows"))
    # an element may be there for both reasons, so this is no less than the page's rows
    return both.withColumn("n", F.ceil(F.col("rows") / F.size("without"))).drop("rows")


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        text = [" ".join(blocks(parse(html), frozenset() if without is None else frozenset(without))) for html, without in zip(batch["html"], batch["without"], strict=True)]
        ids = batch["page_id"].astype("Int64").array
        yield pd.DataFrame({"page_id": ids, "url": batch["url"], "text": text, "n_chars": np.array(list(map(len, text)), np.int64)})


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, article_pages: int = ARTICLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = common.ship(_rows(pages))
    gone = common.materialize(removed(counted_subtrees(pages), least_pages, article_pages), "removed")
    joined = common.join_filtered(rows, gone, ["host", "page_key", "page_size"], "left")
    return joined.select("page_id", "url", "html", "without").mapInPandas(_texts, "page_id long, url string, text string, n_chars long")
