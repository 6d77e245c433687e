r"""Main text of pages by a site style tree.

Pages of one host are merged into a style tree: a node is an element's path of tags,
classes and ids; record numbers in them (post-123) count as equal. A path is known by a
hash of its parent's and its own step, so deep pages cost no more than flat ones. Each node's
importance is evidence times entropy. Entropy is that of what the node shows over the
host's different pages, as a share of the most it could be: of its contents (the text
right inside it) and of its presentation (the tags of its children), the larger
counting. Evidence is what the markup says: 1; times ``HINTED`` below an element whose
class, id or role has a part such as share, widget or related, which may be a box of
links or the article's own section on share prices; and outside of article and main
elements, on pages that have them, times the share of the page's text that stands outside
as well: it is near 0 beside a whole article and near 1 around a teaser. A branch is
as important as its most important node on the page. Branches of importance below
``least``, on at least ``pages_needed`` pages of the host, are removed from each page: they
show the same everywhere, or stand beside the article. Pages with the same article (or the
same blocks, where it isn't most of the page) count once, whatever menus and adverts stand
around it, so that a copied article doesn't look like a template.

Evidence is ``NAMED``, which is below ``least`` whatever the entropy, in elements one of whose
classes, or whose id or role, is an advert's, menu's, sidebar's or comment list's name, or
outside of an article a banner's, notice's or related list's. Only scripts, styles, forms,
navigation, headers, footers and asides, by their element names, never enter the tree. Inside of an article that has most of its page's text, parts
without a hint are certain to stay: articles that are nearly the same would look like a
template. On a page without one, a copied text between unnamed parts that change from page
to page can't be told from a template.

Counts per (host, path, content) are aggregations that combine before their shuffle;
no host's pages meet in one task. Only nodes of low importance travel with pages: broadcast
where they are at most ``broadcast_nodes``, as is usual, so that pages aren't shuffled at
all; else each page gets those of its own nodes, so no list grows with a host.

Text: character references are decoded, white space inside a block becomes one space,
blocks are joined in page order by a blank line. Nulls: a null html has the empty
text, a null url its own host. Repeated rows and extra columns stay out of each
other's way: one result row per row. An empty table gives no rows.
"""

from __future__ import annotations

import html as H
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[/!?a-zA-Z](?:[^'\"<>]|\"[^\"]*\"|'[^']*')*>|<[/!?a-zA-Z][^<>]*(?:>|$)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Numbers of records in classes and ids: pages of one template differ in them
#: (post-123). Shorter ones are places in a layout (col-2), which stay apart.
DIGITS = re.compile(r"\d{3,}")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Element names and words in class, id or role. Fixed values.
DROPPED = set("script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu head title".split())
RAW = set("script style noscript template textarea title iframe".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comments comment-list comments-area complementary consent contentinfo cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond sharing side-bar sidebar site-header sponsor sponsored subscribe toolbar topbar".split())
HINTS = re.compile(r"(?:^|[\s_-])(ads?|adverts?|advertisement|advertising|alert|banner|breadcrumbs?|comments?|consent|cookies?|discussion|disqus|footer|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|promo|promoted|related|replies|respond|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|topbar|widget)(?=$|[\s_-])", re.I)
HINTED, NAMED = 0.5, 0.1


#: Those that inside of an article may be a part of it.
AMBIGUOUS = set("banner notice notices popup promo promoted related replies respond sharing".split())
#: Names that may end an open p or li, or keep one from being ended.
OUTER = set("p ul ol table td".split())


@dataclass
class Node:
    """An element's path: its hash, its parent, its last step, and what it shows."""

    key: int
    parent: int
    step: str
    inside: bool
    hinted: bool
    named: bool
    shown: list[str]
    children: list[int]


class Page:
    """A page's nodes, the first of which is its root, and (node, text) of every block of
    text that markup alone doesn't remove, in page order."""

    def __init__(self, page: str | None):
        self.nodes, self.blocks = [Node(0, -1, "", False, False, False, [], [])], []
        self._parse(page or "")
        sizes = [(self.nodes[n].inside, len(t)) for n, t in self.blocks if not self.nodes[n].named]
        #: The share of the text, without that of named nodes, inside of article and main elements.
        self.share = sum(size for inside, size in sizes if inside) / max(1, sum(size for _, size in sizes))
        for n, text in self.blocks:
            self.nodes[n].shown.append(text)

    def certain(self, n: int) -> bool:
        node = self.nodes[n]
        return node.inside and not node.hinted and not node.named and self.share >= 0.5

    def evidence(self, n: int) -> float:
        node = self.nodes[n]
        return (NAMED if node.named else HINTED if node.hinted else 1.0) * (1.0 if node.inside else 1.0 - self.share)

    def _parse(self, page: str) -> None:
        import xxhash

        known: dict[int, int] = {0: 0}
        stack: list[tuple[str, int, int, int]] = []  # name, node, dropped, article
        opened: Counter = Counter()  # how often each name is open
        enders: list[int] = []  # places in the stack of OUTER
        items: list[int] = []  # and of those and li
        text: list[str] = []
        dropped = article = 0

        def flush() -> None:
            nonlocal text
            if text:
                words = " ".join(H.unescape("".join(text)).split())
                if words and not dropped:
                    self.blocks.append((stack[-1][1] if stack else 0, words))
                text = []

        def pop() -> None:
            nonlocal dropped, article
            name, _, gone, is_article = stack.pop()
            opened[name] -= 1
            for places in (enders, items):
                if places and places[-1] == len(stack):
                    places.pop()
            dropped -= gone
            article -= is_article

        at = 0
        while at < len(page):
            m = TOKEN.search(page, at)
            if not m:
                text.append(page[at:])
                break
            if m.start() > at:
                text.append(page[at : m.start()])
            at, tag = m.end(), m.group()
            got = NAME.match(tag)
            if not got:
                continue
            name = got[1].lower()
            if tag[1] == "/":
                if opened[name]:
                    if name in BLOCKS:
                        flush()
                    while True:
                        last = stack[-1][0]
                        if last in BLOCKS:
                            flush()
                        pop()
                        if last == name:
                            break
                continue
            if name in BLOCKS:
                flush()
                if name not in ("html", "body"):
                    places = items if name == "li" else enders
                    if places and stack[places[-1]][0] in ("p", "li"):
                        least = places[-1]
                        while len(stack) > least:
                            pop()
            elif name == "br":
                text.append(" ")
            if name in VOID or tag.endswith("/>"):
                continue
            said = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(tag)) if "=" in tag else ""
            own = name not in ("html", "body") and said
            names = set(said.lower().split()) & NOISE if own else set()
            named = bool(names - AMBIGUOUS if article else names)
            gone = name in DROPPED or (name == "header" and not article)
            hint = bool(own and name not in ("article", "main") and HINTS.search(said))
            if named or (gone and not dropped):
                flush()
            is_article = name in ("article", "main")
            above = stack[-1][1] if stack else 0
            node = above
            if name in BLOCKS or named:
                step = name + ("." + ".".join(sorted(DIGITS.sub("0", said).split())) if said else "")
                key = xxhash.xxh3_64_intdigest(f"{self.nodes[above].key}/{step}".encode("utf-8", "surrogatepass")) >> 1
                if key not in known:
                    known[key] = len(self.nodes)
                    up = self.nodes[above]
                    self.nodes.append(Node(key, above, step, up.inside or is_article, up.hinted or hint, up.named or named, [], []))
                    up.children.append(known[key])
                node = known[key]
            if name in OUTER:
                enders.append(len(stack))
            if name in OUTER or name == "li":
                items.append(len(stack))
            stack.append((name, node, int(gone), int(is_article)))
            opened[name] += 1
            dropped += gone
            article += is_article
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(page, at)
                at = end.start() if end else len(page)
        flush()

    def text(self, low: set[int], least: float) -> str:
        """The blocks that stay when branches go of which all nodes on the page are low: by
        the tree, or because evidence, which importance can't exceed, is less than least."""
        stays = [self.evidence(n) >= least and node.key not in low for n, node in enumerate(self.nodes)]
        for n in range(len(self.nodes) - 1, 0, -1):  # children come after their parents
            if stays[n]:
                stays[self.nodes[n].parent] = True
        return "\n\n".join(t for n, t in self.blocks if self.certain(n) or stays[n])


def _nodes(least: float):
    """What each page shows at each node: the text right inside it and its children."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _shown(batches, least)

    return f


def _shown(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    import xxhash

    digest = lambda parts: xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) >> 1
    for frame in batches:
        rows = []
        for host, html in zip(frame["host"], frame["html"]):
            page = Page(html)
            main = page.share >= 0.5
            same = digest(f"{page.nodes[n].key}\0{t}" for n, t in page.blocks if not page.nodes[n].named and (page.nodes[n].inside or not main))
            used, certain = _used(page)
            for n in sorted(used):
                node = page.nodes[n]
                if page.evidence(n) < least and n not in certain:
                    continue  # importance can't reach it; no need of statistics
                rows.append((host, same, node.key, digest(node.shown), digest(page.nodes[c].step for c in node.children if c in used), page.evidence(n), n in certain))
        yield pd.DataFrame(rows, columns=["host", "same", "path", "content", "look", "evidence", "certain"])


def _used(page: Page) -> tuple[set[int], set[int]]:
    """The nodes with text in them or below, and those with text that is certain to stay."""
    used: set[int] = set()
    certain: set[int] = set()
    for n, _ in page.blocks:
        for marked in (used, certain) if page.certain(n) else (used,):
            at = n
            while at >= 0 and at not in marked:
                marked.add(at)
                at = page.nodes[at].parent
    return used, certain


def importance(pages: DataFrame, least: float = 0.0) -> DataFrame:
    """(host, path, pages, importance) of the style trees' nodes, from (host, html);
    1 at least for nodes that are certain to stay. Pages on which evidence for a node is
    below least have no part in its statistics."""
    nodes = pages.mapInPandas(_nodes(least), "host string, same long, path long, content long, look long, evidence double, certain boolean")
    # A page's copies count once: of alike pages the evidence that says most.
    nodes = nodes.groupBy("host", "same", "path").agg(F.max(F.struct("evidence", "content", "look")).alias("v"), F.max("certain").alias("certain")).select("host", "path", "certain", "v.*")
    both = nodes.select("host", "path", "evidence", "certain", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("look").alias("v")))).alias("x"))
    counts = both.groupBy("host", "path", "x").agg(F.count(F.lit(1)).alias("k"), F.sum("evidence").alias("e"), F.max("certain").alias("c"))
    by = counts.groupBy("host", "path", F.col("x.kind").alias("kind")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("s"), F.sum("e").alias("e"), F.max("c").alias("c"))
    share = F.when(F.col("n") > 1, (F.ln("n") - F.col("s") / F.col("n")) / F.ln("n")).otherwise(1.0)
    return by.groupBy("host", "path").agg(F.max("n").alias("pages"), F.max(F.when(F.col("c"), 1.0).otherwise(share * F.col("e") / F.col("n"))).alias("importance"))


def low_nodes(tree: DataFrame, least: float, pages_needed: int) -> DataFrame:
    """(host, path): the nodes of low importance."""
    return tree.where((F.col("importance") < least) & (F.col("pages") >= pages_needed)).select("host", "path")


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of each page."""
    for frame in batches:
        rows = []
        for k1, k2, host, html in zip(frame["k1"], frame["k2"], frame["host"], frame["html"]):
            page = Page(html)
            rows += [(k1, k2, host, page.nodes[n].key) for n in _used(page)[0]]
        yield pd.DataFrame(rows, columns=["k1", "k2", "host", "path"])


def _texts(least: float):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = [Page(html).text(set() if low is None else set(low.tolist()), least) for html, low in zip(frame["html"], frame["low"])]
            out = frame.drop(columns=["html", "low"])
            yield out.assign(text=texts, n_chars=[len(t) for t in texts])

    return f


def extract(pages: DataFrame, least: float = 0.2, pages_needed: int = 3, broadcast_nodes: int = 50_000) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]+)", 1)), F.lit("")))
    nodes = written(low_nodes(importance(p.select("host", "html"), least), least, pages_needed), "style-nodes")
    if nodes.count() <= broadcast_nodes:
        low = F.broadcast(nodes.groupBy("host").agg(F.collect_list("path").alias("low")))  # broadcast_nodes paths in all
        rows = p.join(low, "host", "left")
    else:
        p = p.withColumns({"k1": F.xxhash64("host", "html"), "k2": F.xxhash64(F.lit(1), "host", "html")})
        own = p.select("k1", "k2", "host", "html").mapInPandas(_paths, "k1 long, k2 long, host string, path long").distinct()
        low = written(own.join(nodes, ["host", "path"]).groupBy("k1", "k2").agg(F.collect_list("path").alias("low")), "page-nodes")
        rows = p.join(low, ["k1", "k2"], "left")
    return rows.select("page_id", "url", "html", "low").mapInPandas(_texts(least), "page_id long, url string, text string, n_chars long")


def digest_query(pages: DataFrame) -> DataFrame:
    """What is asked of op10."""
    return extract(pages)
