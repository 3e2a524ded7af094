"""Main text of web pages, site templates removed.

Every page is parsed into a tree and the element subtrees are hashed.  Spark counts on
how many pages of its host each subtree stands; subtrees that recur on many pages of
that host (menus, notices, adverts and the like) are deleted, inside the article too.
Pages of the same text count once, and a page counts for a subtree only if it has text
of its own besides, so that copies are no templates.  Since articles may quote each
other, plain prose elements (no class, id or role) inside an article are never deleted.
Elements whose tag, role or class names them as no part of the article go as well.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import look_up, stored
from parley.session import spread

#: A subtree is a template if it stands on so many pages of its host, and so large a share.
MIN_PAGES = 5
MIN_SHARE = 0.3
#: Subtrees other than running text also on so many pages and this share: sections of large
#: hosts.  The share bounds the list of templates that a host's pages are joined with.
SECTION_PAGES, SECTION_SHARE = 50, 0.005
#: A page counts for a subtree if its other text is at least this share of the subtree's.
LEAST_REST = 0.2

#: Fixed values of HTML: elements without content, with raw content, and of block kind.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li"
    " main menu nav ol optgroup option p pre section select summary table tbody td tfoot"
    " th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text; a quotation or a common line in them is no template.
PROSE = HEADINGS | frozenset("p blockquote pre li dt dd td th tr caption figcaption hr address".split())
#: Opening one of these closes an open element of the listed kinds first.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: Where the search for an element to close ends.
SCOPES = frozenset("html body article section div table ul ol dl nav aside main td th".split())

DROPPED_TAGS = frozenset(
    "head nav header footer aside form script style noscript template iframe object embed"
    " button select option textarea input dialog menu svg canvas audio video title".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog"
    " menu menubar toolbar".split()
)
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion"
    " nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer"
    " sidebar aside rail widget related recommended share sharing social cookie cookies"
    " consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " signup login search comment comments commentlist disqus respond reply replies"
    " toolbar pagination pager skip banner".split()
)
#: Never dropped for their class alone.
FRAMES = frozenset(["html", "body", "article", "main"])

_tag = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*)(?:>|\Z)",
    re.S,
)
_attribute = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_name = re.compile(r"[\s_-]+")
_styled = re.compile(r"(?:^|\s)(?:class|id|role)\s*=", re.I)


class Node:
    """``key`` is null for elements that are never deleted for recurring."""

    __slots__ = ("tag", "dropped", "styled", "children", "hash", "key", "chars")

    def __init__(self, tag: str, dropped: bool = False, styled: bool = False):
        self.tag, self.dropped, self.styled, self.children = tag, dropped, styled, []
        self.hash, self.key, self.chars = 0, None, 0


def _dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED_TAGS:
        return True
    if not attributes or attributes.isspace():
        return False
    if tag not in ("html", "body") and _hidden.search(attributes):
        return True
    for name, *values in _attribute.findall(attributes):
        name = name.lower()
        words = {w for w in _name.split("".join(values).lower()) if w}
        if name == "role" and words & DROPPED_ROLES:
            return True
        if name in ("class", "id") and words & DROPPED_NAMES:
            comment = not words.isdisjoint(("comment", "comments", "reply", "replies"))
            if tag not in FRAMES or (tag == "article" and comment):
                return True
    return False


def parse(html: str) -> Node:
    """Tree of a page; forgiving about missing and surplus end tags."""
    root = Node("")
    stack = [root]
    at, size = 0, len(html)
    while at < size:
        found = _tag.search(html, at)
        start = found.start() if found else size
        if start > at:
            stack[-1].children.append(html[at:start])
        if not found:
            break
        at = found.end()
        closing, opening, attributes = found.groups()
        if opening:
            tag = opening.lower()
            closes = CLOSES.get(tag)
            if closes is None and tag in BLOCK:
                closes = frozenset(["p"])
            if closes:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in closes:
                        del stack[depth:]
                        break
                    if stack[depth].tag in SCOPES:
                        break
            node = Node(tag, _dropped(tag, attributes), bool(_styled.search(attributes)))
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
            elif tag not in VOID and not attributes.endswith("/"):
                stack.append(node)
        elif closing:
            tag = closing.lower()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break
    return root


def hashed(root: Node) -> list[Node]:
    """Give every element the hash of its subtree; the elements that may be templates.

    ``key`` is the hash with the last bit set for running text, so that a template among
    frames never deletes the same words in a paragraph.
    """
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        todo += [(c, inside) for c in node.children if isinstance(c, Node)]
    able = []
    for node, inside in reversed(order):
        parts, blocks = [], False
        for child in node.children:
            if isinstance(child, str):
                part = child.strip()
                node.chars += len(part)
            else:
                part = f"<{child.hash}>"
                blocks = blocks or child.tag in BLOCK
                node.chars += 0 if child.dropped else child.chars
            parts.append(part)
        text = "\x00".join([node.tag, *parts]).encode("utf-8", "replace")
        node.hash = int.from_bytes(blake2b(text, digest_size=8).digest(), "big", signed=True)
        if node.tag not in BLOCK or node.tag in ("html", "body", "head") or not node.children:
            continue
        prose = node.tag in PROSE or not (blocks or node.styled)
        if node.tag in ("article", "main") and not inside or inside and prose and not node.styled:
            continue
        node.key = node.hash | 1 if prose else node.hash & ~1
        able.append(node)
    return able


def votes(html: str) -> tuple[int, set[int]]:
    """Hash of a page's text, and the subtrees that the page counts for."""
    root = parse(html)
    able = hashed(root)
    text = main_text(root, frozenset()).encode("utf-8", "replace")
    digest = int.from_bytes(blake2b(text, digest_size=8).digest(), "big", signed=True)
    chars = sum(top.chars for top in _articles(root) or [root])
    return digest, {n.key for n in able if n.dropped or chars - n.chars >= LEAST_REST * n.chars}


def main_text(root: Node, templates: frozenset[int]) -> str:
    """Blocks of the article, or of the whole page where it has no article element."""
    articles = _articles(root)
    blocks: list[str] = []
    current: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            blocks.append(text)

    for top in articles or [root]:
        # (child, parent is a dropped header of an article: only headings count)
        todo: list = [(child, False) for child in reversed(top.children)]
        while todo:
            child, headings = todo.pop()
            if child is None:
                end_block()
            elif isinstance(child, str):
                if not headings:
                    current.append(unescape(child))
            elif child.tag == "br":
                current.append(" ")
            else:
                if child.key in templates:
                    end_block()
                    continue
                if child.dropped:
                    if not (articles and child.tag == "header"):
                        if child.tag in BLOCK:
                            end_block()
                        continue
                    headings = True
                if child.tag in HEADINGS:
                    headings = False
                block = child.tag in BLOCK
                if block:
                    end_block()
                    todo.append((None, False))
                todo += [(c, headings) for c in reversed(child.children)]
        end_block()
    return "\n".join(blocks)


def _articles(root: Node) -> list[Node]:
    """Outermost article elements that are not dropped, else the main elements."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == wanted and not node.dropped:
                found.append(node)
                continue
            todo += [
                c for c in reversed(node.children)
                if isinstance(c, Node) and (not c.dropped or c.tag == "head")
            ]
        if found:
            return found
    return []


def host_of(url: Column) -> Column:
    """Lower-case host of a url, empty where there is none."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.lower(host), F.lit(""))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = MIN_SHARE) -> DataFrame:
    """host and the keys of its recurring subtrees; pages need host and html.

    Counted are the different texts of a host's pages, not its rows.
    """

    def vote(batches):
        for batch in batches:
            seen = set()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, subtrees = votes(html or "")
                seen.add((host, text, None))
                seen.update((host, text, subtree) for subtree in subtrees)
            rows = list(zip(*seen)) or [(), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, k) for r, k in zip(rows, kinds)], ["host", "text", "subtree"]
            )

    voted = pages.select("host", "html").mapInArrow(vote, "host string, text long, subtree long")
    counts = stored(
        voted.distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")), "subtrees"
    )
    pages_of = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    often = counts.where((F.col("n") >= min_pages) & F.col("subtree").isNotNull())
    section = (F.col("subtree").bitwiseAND(F.lit(1)) == 0) & (F.col("n") >= SECTION_PAGES)
    least = F.when(section, F.least(F.lit(SECTION_SHARE), F.lit(share))).otherwise(F.lit(share))
    return (
        look_up(often, pages_of, ["host"], F.col("subtree"))
        .where(F.col("n") >= least * F.col("pages"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("subtree")).alias("templates"))
    )


def extracted(
    pages: DataFrame,
    carry: list[str] | None = None,
    min_pages: int = MIN_PAGES,
    share: float = MIN_SHARE,
) -> DataFrame:
    """Struct ``row`` of the carried columns (all by default) and ``main_text``.

    ``pages`` needs url and html.  Null and empty pages give an empty text; a null or odd
    url belongs to the host of empty name.  Pages are read whole; pages of the same text
    count once for templates; an empty table gives none; clashing names stay inside ``row``.
    """
    inner = spread(
        pages.select(
            F.struct(*(carry or pages.columns)).alias("row"), host_of(F.col("url")).alias("host"), "html"
        )
    )
    recurring = stored(templates(inner, min_pages, share), "templates")
    joined = look_up(inner, recurring, ["host"], F.xxhash64("html")).select("row", "html", "templates")

    def run(batches):
        for batch in batches:
            texts = []
            for html, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                root = parse(html or "")
                if known:
                    hashed(root)
                texts.append(main_text(root, frozenset(known or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["row", "main_text"]
            )

    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {kind}, main_text string")
