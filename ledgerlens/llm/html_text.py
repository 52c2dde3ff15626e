"""HTML main-text extraction with site style trees.

The pages of a host are merged into one tree: a node is an element path (tags and classes from
the root), with the presentation styles (sequences of children) and the contents it has on the
host's pages.  A node's importance joins the entropy of its styles and the rarity of its
contents; a branch in which every node is of low importance is what the site repeats, and is
removed from each page.  Elements that name their purpose (menus, forms, adverts, comments, ...)
are left out on hosts of any size.  An <article> or <main> is a weight, not a gate: its nodes are
taken for more important than the tree alone says, and its text counts more against the rest of
the page, but what the site repeats inside it goes like any other template.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import kept, stored

#: fixed values: elements without content, elements whose content is no markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: fixed values: elements that begin and end a block of text
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu
    nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
#: fixed values: elements that are never main text
NOISE_TAGS = frozenset("""head script style noscript template iframe object svg canvas audio video nav footer
    aside form button select textarea dialog menu search title""".split())
#: fixed values: class, id and role words of such elements
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo
    promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies
    consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription
    comment comments reply replies discussion disqus share sharing social related recommended widget login
    signup search searchbox pagination pager toolbar skip hidden contentinfo complementary""".split())
#: fixed values: an open element of the key's kind ends where one of these begins
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
             "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
             "option": {"option", "optgroup"}, "p": BLOCK - {"body", "html", "head"}}
#: an element that closes implicitly is looked for up to these
SCOPE = frozenset("html body table ul ol dl select article section div td th".split())
#: elements nested deeper share the tree node at this depth
MAX_DEPTH = 64
#: (host, path) pairs that a task remembers to have described
GIVEN_PATHS = 200_000
#: hosts and paths of removed branches are broadcast up to so many (8 bytes a path)
BROADCAST_ROWS, BROADCAST_PATHS = 100_000, 1_000_000
#: weight of a node's contents against its styles, to the power of its number of styles
GAMMA = 0.9
#: branches below this importance are removed
THRESHOLD = 0.35
#: inside an article or main, a node counts as if so many more pages had it with contents of their own
SEMANTIC_PAGES = 2
#: a character inside an article (or main) weighs as many outside when a page's main region is chosen
SEMANTIC_WEIGHT = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_CLOSERS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Node:
    """An open or closed element of a page."""

    tag: str
    path: int
    above: tuple[int, ...]
    noise: bool
    article: int            # 2 inside an article, 1 inside main, 0 elsewhere
    children: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


@dataclass
class Page:
    """What a page is made of: its elements, and its text in blocks (pieces with their element)."""

    nodes: list[Node]
    blocks: list[list[tuple[Node, str]]]


def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    """(tag with its classes, whether the element names itself as no main text)."""
    if not attributes.strip(" /"):
        return tag, tag in NOISE_TAGS
    names = {}
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        names.setdefault(key.lower(), (a or b or c).lower())
    classes = " ".join(sorted(names.get("class", "").split()))
    words = set(re.findall(r"[a-z0-9]+", " ".join(names.get(k, "") for k in ("class", "id", "role"))))
    noise = tag in NOISE_TAGS or bool(words & NOISE_WORDS) or bool(_HIDDEN.search(attributes))
    return (f"{tag}.{classes}" if classes else tag), noise and tag not in ("html", "body", "article", "main")


def parse(html: str) -> Page:
    """Reads a page, however broken, in one pass."""
    root = Node("", _hash(""), (), False, 0)
    stack, nodes, blocks, block = [root], [root], [], []

    def text(raw: str) -> None:
        if raw:
            found = entities.unescape(raw)
            block.append((stack[-1], found))
            if not found.isspace():
                stack[-1].words.append(found)

    def end_block() -> None:
        nonlocal block
        if block:
            blocks.append(block)
            block = []

    def pop_to(tags, scope=frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(entities.escape(m[0][9:-3], quote=False))
            continue
        if m[1]:
            if tag in BLOCK:
                end_block()
            if tag != "br":
                pop_to({tag})
            else:
                text(" ")
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            end_block()
            for kind, closers in CLOSED_BY.items():
                if tag in closers:
                    pop_to({kind}, SCOPE - {kind})
        parent = stack[-1]
        signature, noise = _signature(tag, m[3])
        if parent.children[-1:] != [signature]:            # runs of like children are one
            parent.children.append(signature)
        if tag in VOID:
            continue
        if tag in RAW:
            close = _CLOSERS[tag].search(html, at)
            at = close.end() if close else n
            continue
        deep = len(parent.above) >= MAX_DEPTH
        path = parent.path if deep else _hash(f"{parent.path}/{signature}")
        above = parent.above if deep else (*parent.above, parent.path)
        where = 2 if tag == "article" else max(parent.article, 1 if tag == "main" else 0)
        if tag == "header" and not parent.article:
            noise = True
        node = Node(tag, path, above, parent.noise or noise, 0 if noise else where)
        nodes.append(node)
        if not m[3].rstrip().endswith("/") or tag in BLOCK:
            stack.append(node)
    end_block()
    return Page(nodes, blocks)


def main_text(html: str | None, low: frozenset[int] = frozenset()) -> str:
    """The main text of a page, blocks joined by an empty line; ``low`` are the paths of the
    site's low-importance branches, which go inside and outside of articles.  Of the rest the text
    of articles is the main text, or that of <main>, unless it is shorter than the text outside it
    by more than ``SEMANTIC_WEIGHT``: then the region beyond is taken too.  Where nothing is left
    (one article on many pages of a site), articles keep their repeated text."""
    page = parse(html or "")
    said = [[(node, t) for node, t in block if not node.noise] for block in page.blocks]
    stays = [[(node, t) for node, t in block if not low or (node.path not in low and low.isdisjoint(node.above))]
             for block in said]
    if not any(t.strip() for block in stays for _, t in block):
        stays = [[(node, t) for node, t in block if node.article] for block in said]
    size = [0, 0, 0]
    for block in stays:
        for node, t in block:
            size[node.article] += len("".join(t.split()))
    level = next((x for x in (2, 1) if sum(size[x:]) * SEMANTIC_WEIGHT > sum(size[:x])), 0)
    out = []
    for block in stays:
        joined = " ".join("".join(t for node, t in block if node.article >= level).split())
        if joined:
            out.append(joined)
    return "\n\n".join(out)


def site_nodes(pages: DataFrame) -> DataFrame:
    """``(host, page, path, above, style, content, semantic)``: a row for each path of each page;
    ``page`` is a hash of the html, so copies of a page count once later on; ``semantic`` tells
    paths inside an article or main.  A task gives the paths above a host's path once and null in
    its later rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: set[tuple[str, int]] = set()
        for b in batches:
            if len(given) > GIVEN_PATHS:
                given.clear()
            rows = []
            for host, html in zip(b["host"], b["html"]):
                page, merged = _hash(html or ""), {}
                for node in parse(html or "").nodes:
                    _, styles, words, _ = merged.setdefault(node.path, (node.above, set(), [], node.article > 0))
                    styles.add("/".join(node.children))
                    words += node.words
                for path, (above, styles, words, semantic) in merged.items():
                    content = _hash(" ".join(" ".join(words).split())) if words else None
                    first = (host, path) not in given
                    given.add((host, path))
                    rows.append((host, page, path, list(above) if first else None, _hash("|".join(sorted(styles))), content,
                                 semantic))
            yield pd.DataFrame(rows, columns=["host", "page", "path", "above", "style", "content", "semantic"]).astype(
                {"content": "Int64", "semantic": "bool"})

    return pages.select("host", "html").mapInPandas(
        run, "host string, page long, path long, above array<long>, style long, content long, semantic boolean")


def importance(nodes: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """``(host, path, importance)``: of each branch of each host's tree, the greatest composite
    importance of a node in it.

    Of a node on m pages: styles have the entropy of their shares, to the base m; a content that
    c pages share has importance ``1 - log_m c``; with l styles the composite is
    ``(1 - gamma^l) * styles + gamma^l * contents``.  A node of one page has importance 1.  Inside an
    article or main the tag speaks for the node: its importance is the mean of m pages with the
    composite and ``SEMANTIC_PAGES`` with 1.
    """
    # repeated pages count once
    rows = stored(nodes.groupBy("host", "page", "path", "style", "content")
                  .agg(F.first("above", ignorenulls=True).alias("above"), F.max("semantic").alias("semantic")), "site-nodes")
    node = ["host", "path"]
    total = rows.groupBy(*node).agg(F.count(F.lit(1)).alias("m"),
                                    F.first("above", ignorenulls=True).alias("above"),
                                    F.max("semantic").alias("semantic"))
    styles = rows.groupBy(*node, "style").agg(F.count(F.lit(1)).alias("c")).groupBy(*node).agg(
        F.count(F.lit(1)).alias("l"), F.sum(F.col("c") * F.log("c")).alias("s"))
    contents = (rows.where("content is not null").groupBy(*node, "content").agg(F.count(F.lit(1)).alias("c"))
                .groupBy(*node).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s")))
    own = (total.join(styles, node).join(
        contents.select(*node, F.col("n").alias("said"), F.col("s").alias("t")), node, "left"))
    logm, weight = F.log("m"), F.pow(F.lit(gamma), F.col("l"))
    look = 1 - F.col("s") / (F.col("m") * logm)           # -sum p log_m p
    said = F.when(F.col("said").isNull(), F.lit(0.0)).otherwise(1 - F.col("t") / (F.col("said") * logm))
    own = own.withColumn("own", F.when(F.col("m") == 1, F.lit(1.0)).otherwise((1 - weight) * look + weight * said))
    own = own.withColumn("own", F.when(F.col("semantic"), (F.col("m") * F.col("own") + SEMANTIC_PAGES)
                                       / (F.col("m") + SEMANTIC_PAGES)).otherwise(F.col("own")))
    branches = own.select("host", F.explode(F.concat("above", F.array("path"))).alias("path"), "own")
    return branches.groupBy(*node).agg(F.max("own").alias("importance"))


def host_of(url):
    """The host of an address, lowered, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extracted(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA) -> DataFrame:
    """``pages`` with ``text``, the main text of the whole ``html``.

    Null and empty html give an empty text.  Pages without a host are read by themselves.  All
    rows and columns are kept (a column ``text`` is replaced); repeated rows each get their text;
    an empty table stays empty.
    """
    rows = pages.drop("text").select(F.struct("*").alias("row"))      # no name can clash
    hosted = rows.withColumn("host", host_of(F.col("row.url")))
    tree = importance(site_nodes(hosted.where("host <> ''").select("host", F.col("row.html").alias("html"))), gamma)
    low = kept(tree.where(F.col("importance") < threshold).groupBy("host").agg(F.collect_set("path").alias("low")))

    size = low.agg(F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(F.size("low")), F.lit(0)).alias("paths")).first()
    if size["hosts"] <= BROADCAST_ROWS and size["paths"] <= BROADCAST_PATHS:
        low = F.broadcast(low)

    @F.pandas_udf("string")
    def text(html: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset(() if x is None else x.tolist())) for h, x in zip(html, low)],
                         dtype=object)

    found = hosted.join(low, "host", "left").withColumn("text", text("row.html", "low"))
    return found.select("row.*", "text")
