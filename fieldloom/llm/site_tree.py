"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of presentations: a node is a place in the page (tags, classes, ids and
roles from the body down; digits are one sign), its styles are the sequences of children it is seen with, and its
content is the blocks of text found there.  Importance is entropy: a place whose presentation varies, or whose texts
are spread over few pages each, matters; the same text on all pages does not.  The numbers of a place come from
counts over all pages of the host, summed in Spark: each distinct page counts once, so copies of a page weigh
nothing, and every place of a page counts, also those that its markup takes out.  Per page the importance of a branch
is composed from its own style and its children, and a branch is cut off where it and all in it are of low importance.

Entropy needs several pages of a host.  What the markup itself says holds for every page: navigation, headers and
footers of the page, asides, forms, scripts, and places whose class, id or role names a menu, an advert, a notice, a
sidebar or reader comments are no content, and ``main`` or ``article`` (or else a place named as content) holds it.

Defined results
---------------
* null or empty html, and pages without a body text, give an empty text and 0 characters.
* markup that is cut off or badly nested is read as browsers do: paragraphs, items, rows and cells end where the next
  one begins, unknown ends are passed over, comments and scripts may hold anything.
* a branch inside the article is judged by the tree only if it, or what it stands in, has a class, id or role of its own, and
  holds at most ``MOST_OF_TEXT`` of the article; a page is never emptied by the tree.
* a null url has no host: its page is read by its markup alone.  Equal rows give equal results; a page id may repeat.
* whole pages are read, of any length; other columns are never read.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable

#: Distinct pages that a place must be seen on to be judged, importance under which it goes, weight of a style, share of an article.
LEAST_PAGES, LEAST_IMPORTANCE, DAMPING, MOST_OF_TEXT = 5, 0.3, 0.9, 0.2
#: Places of all hosts that travel with the tasks as a whole; more are joined with the pages that have them.
BROADCAST_PLACES = 100_000

# How browsers read tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("head noscript template svg math object canvas audio video map select option optgroup datalist button output applet frameset".split())
NO_PARAGRAPH = BLOCKS - frozenset("html body caption tbody td tfoot th thead tr legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start of the first ends an open one of the second, if none of the third is in between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    **{t: (frozenset("dd dt".split()), frozenset(["dl"])) for t in ("dd", "dt")},
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])),
    **{t: (frozenset("td th".split()), frozenset("tr table".split())) for t in ("td", "th")},
    **{t: (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
}
TABLE_SCOPE = frozenset("table td th caption html".split())
# What names of classes, ids and roles say.
NOISE_TAGS = frozenset("nav aside footer form dialog menu".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adslot adunit banner sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus menubar submenu breadcrumb breadcrumbs pagination pager toolbar sidebar sidebars rail complementary "
    "footer colophon copyright contentinfo cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay "
    "comment comments commentlist disqus reply replies respond related recommended recommendations trending share sharing social socials "
    "subscribe subscription newsletter signup login signin search searchbox widget widgets".split()
)
#: A class that begins so says what else a page has, not what the place is.
MODIFIERS = re.compile(r"(?:has|have|with|no|without|show|hide|is|not|js)(?=[-_A-Z])")
HEADER_NAMES = frozenset("header masthead topbar".split())
CONTENT_NAMES = frozenset("article articlebody content maincontent post entry story main".split())
# End of the fixed values.

TOKEN = re.compile(
    r"<(?:!--(?:.*?--!?>|.*+\Z)|(?P<end>/?+)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>|[!?/][^>]*+>)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|(?<=[\s\"'/]))(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?(?=[\s/]|$)", re.I | re.S)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    """An element of a page that blocks of text stand in, or that takes text away."""

    tag: str
    parent: int
    place: int = 0
    named: bool = False  # has a class, id or role of its own
    noise: bool = False
    header: bool = False  # a header, unless it is the article's own
    content: bool = False
    children: list[int] = field(default_factory=list)
    signs: list[str] = field(default_factory=list)  # of the children, neighbours once
    letters: int = 0
    linked: int = 0
    links: int = 0


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]  # (node, text) in page order


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Reader:
    """Reads pages; remembers the places it has met, up to a fixed number."""

    def __init__(self) -> None:
        self.places: dict[tuple[int, str], int] = {}
        self.signs: dict[tuple[str, str], tuple] = {}

    def place(self, parent: int, sign: str) -> int:
        key = (parent, sign)
        if key not in self.places:
            if len(self.places) > 100_000:
                self.places.clear()
            self.places[key] = digest(f"{parent}/{sign}")
        return self.places[key]

    def sign(self, tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool, bool]:
        """(sign, named, noise, header, content, unseen) of a start tag."""
        if not attributes or attributes == "/":
            return tag, False, tag in NOISE_TAGS, tag == "header", tag in ("main", "article"), tag in UNSEEN
        key = (tag, attributes)
        if key not in self.signs:
            if len(self.signs) > 20_000:
                self.signs.clear()
            found = {}
            for m in ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), entities.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
            words = " ".join(w for k in ("class", "id", "role") for w in found.get(k, "").split() if not MODIFIERS.match(w))
            names = {n.lower() for n in NAME.findall(words)} | set(re.findall(r"[a-z0-9]+", words.lower()))
            unseen = tag in UNSEEN or "hidden" in found or bool(UNSHOWN.search(found.get("style", "")))
            plain = " ".join(sorted(re.sub(r"\d+", "0", found.get("class", "")).split()))
            sign = f"{tag}.{plain}#{re.sub(r'\d+', '0', found.get('id', ''))}@{found.get('role', '')}"
            # "banner" as a role is the header of the page.
            header = tag == "header" or bool(names & HEADER_NAMES) or found.get("role") == "banner"
            noise = tag in NOISE_TAGS or (bool(names & NOISE_NAMES) and found.get("role") != "banner")
            self.signs[key] = (sign, any(found.get(k, "").strip() for k in ("class", "id", "role")), noise, header, tag in ("main", "article") or bool(names & CONTENT_NAMES), unseen)
        return self.signs[key]

    def read(self, text: str) -> Page:
        nodes = [Node("html", -1, place=1)]
        blocks: list[tuple[int, str]] = []
        stack = [0]  # open nodes
        unseen: list[str] = []  # open elements whose text is not shown
        run: list[str] = []
        links = linked = 0

        def flush() -> None:
            nonlocal links, linked
            if run:
                block = " ".join("".join(run).split())
                run.clear()
                if block:
                    node = nodes[stack[-1]]
                    node.letters += len(block)
                    node.linked += linked
                    blocks.append((stack[-1], block))
                nodes[stack[-1]].links += links
                links = linked = 0

        def close_to(depth: int) -> None:
            flush()
            del stack[depth:]

        def find(tags: frozenset[str], barrier: frozenset[str]) -> int:
            for depth in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[depth]].tag
                if tag in tags:
                    return depth
                if tag in barrier:
                    break
            return 0

        at, size, in_link = 0, len(text), 0
        while at < size:
            m = TOKEN.search(text, at)
            start = m.start() if m else size
            if start > at and not unseen:
                said = text[at:start]
                if "&" in said:
                    said = entities.unescape(said)
                run.append(said)
                if in_link:
                    linked += len(said.strip())
            if not m:
                break
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if unseen:
                    if tag in unseen:
                        del unseen[len(unseen) - 1 - unseen[::-1].index(tag) :]
                    elif tag in ("body", "html") or (unseen == ["head"] and tag not in RAW):
                        unseen.clear()
                    continue
                if tag == "a":
                    in_link = 0
                elif tag in BLOCKS:
                    if tag in HEADINGS:
                        depth = find(HEADINGS, TABLE_SCOPE)
                    elif tag == "p":
                        depth = find(frozenset([tag]), BLOCKS)
                    elif tag == "li":
                        depth = find(frozenset([tag]), frozenset("ul ol menu dir".split()))
                    else:
                        depth = find(frozenset([tag]), frozenset(["html"]) if tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "body") else TABLE_SCOPE)
                    flush()
                    if depth:
                        close_to(depth)
                else:
                    depth = next((d for d in range(len(stack) - 1, 0, -1) if nodes[stack[d]].tag == tag), 0)
                    if depth and nodes[stack[depth]].tag not in BLOCKS and all(nodes[n].tag not in BLOCKS for n in stack[depth:]):
                        close_to(depth)
                continue
            attributes = m["attributes"]
            if (unseen == ["head"] and tag in BLOCKS) or (unseen == ["p"] and tag in NO_PARAGRAPH):
                unseen.clear()  # ends where something else begins
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = end.end() if end else size
                continue
            if unseen:
                if tag not in VOID and not attributes.endswith("/"):
                    if tag in unseen or tag in UNSEEN:
                        unseen.append(tag)
                continue
            if tag in ("br", "hr"):
                flush()
                continue
            if tag in VOID or tag in ("html", "body"):
                continue
            sign, named, noise, header, content, hidden = self.sign(tag, attributes)
            if hidden:
                if tag in BLOCKS:
                    flush()
                if not (attributes.endswith("/") and tag in UNSEEN):
                    unseen.append(tag)
                continue
            if tag == "a":
                in_link, links = 1, links + 1
            if tag in BLOCKS:
                flush()
                if tag in NO_PARAGRAPH and (depth := find(frozenset(["p"]), TABLE_SCOPE | frozenset(["button"]))):
                    close_to(depth)
                if tag in IMPLIED and (depth := find(*IMPLIED[tag])):
                    while depth > 1 and nodes[stack[depth - 1]].tag in IMPLIED[tag][0]:
                        depth -= 1
                    close_to(depth)
            elif not noise or tag == "a":
                continue
            else:
                flush()
            parent = stack[-1]
            if not (nodes[parent].signs and nodes[parent].signs[-1] == sign):
                nodes[parent].signs.append(sign)
            nodes[parent].children.append(len(nodes))
            stack.append(len(nodes))
            nodes.append(Node(tag, parent, self.place(nodes[parent].place, sign), named, noise, header, content))
        flush()
        return Page(nodes, blocks)


# -- what a page says by itself -------------------------------------------------------------------------------------------


def _within(page: Page, marked: list[bool]) -> list[bool]:
    """Nodes that are marked or stand in a marked one."""
    out = list(marked)
    for i, n in enumerate(page.nodes[1:], 1):
        out[i] = out[i] or out[n.parent]
    return out


def _weights(page: Page, gone: list[bool]) -> tuple[list[int], list[int], list[int]]:
    """Letters, letters in links and links in the whole branch of each node, without what is gone."""
    sums = ([0 if gone[i] else n.letters for i, n in enumerate(page.nodes)], [0 if gone[i] else n.linked for i, n in enumerate(page.nodes)], [0 if gone[i] else n.links for i, n in enumerate(page.nodes)])
    for i in range(len(page.nodes) - 1, 0, -1):
        for s in sums:
            s[page.nodes[i].parent] += s[i]
    return sums


def article_of(page: Page) -> tuple[list[bool], list[bool]]:
    """(nodes of the article, nodes that the markup takes out of it)."""
    nodes = page.nodes
    noise = _within(page, [n.noise for n in nodes])
    letters, linked, links = _weights(page, noise)

    def outermost(fits) -> list[int]:
        found: list[int] = []
        inside = [False] * len(nodes)
        for i, n in enumerate(nodes):
            inside[i] = i > 0 and inside[n.parent]
            if not inside[i] and not noise[i] and letters[i] and fits(n):
                inside[i] = True
                found.append(i)
        return found

    is_article = lambda n: n.tag == "article"
    roots = outermost(is_article)
    mains = outermost(lambda n: n.tag == "main")
    if mains and sum(letters[i] for i in roots) * 2 < sum(letters[i] for i in mains):
        roots = mains
    if not roots and not mains:
        named = outermost(lambda n: n.content)
        roots = [max(named, key=lambda i: letters[i])] if named else []
    if not roots:
        # An article inside of what only seems to be noise, such as a form or a wrapper named after its sidebar.
        every, _, _ = _weights(page, [False] * len(nodes))
        wrapped = [i for i, n in enumerate(nodes) if n.content and not n.noise and noise[i] and every[i]]
        if not letters[0] and (wrapped or any(n.tag == "form" for n in nodes)):
            kept = [n.tag == "form" and not wrapped for n in nodes]
            if wrapped:
                roots = [max(wrapped, key=lambda i: (nodes[i].tag in ("article", "main"), every[i]))]
                up = nodes[roots[0]].parent
                while up >= 0:
                    kept[up], up = True, nodes[up].parent
            noise = _within(page, [n.noise and not kept[i] for i, n in enumerate(nodes)])
            letters, linked, links = _weights(page, noise)
    if len(roots) > 1:
        most = max(letters[i] for i in roots)
        roots = [i for i in roots if letters[i] * 10 >= most or linked[i] * 2 < letters[i]]  # without teasers of other articles
    if roots:
        inside = _within(page, [i in set(roots) for i in range(len(nodes))])
        return inside, noise
    headers = _within(page, [n.header for n in nodes])
    lists = _within(page, [n.tag in ("ul", "ol", "table", "div") and links[i] >= 3 and linked[i] * 5 >= letters[i] * 4 > 0 for i, n in enumerate(nodes)])
    return [True] * len(nodes), [a or b or c for a, b, c in zip(noise, headers, lists, strict=True)]


def importances(page: Page, tree: dict[int, tuple[int, int, float, float]]) -> list[float]:
    """Importance of each node's branch: its own style's and its children's, weighted by how many styles it has."""
    own = [tree.get(n.place) for n in page.nodes]
    has_text = [False] * len(page.nodes)
    for i, _ in page.blocks:
        has_text[i] = True
    out = [1.0] * len(page.nodes)
    for i in range(len(page.nodes) - 1, -1, -1):
        known = own[i]
        if known is None or known[0] < LEAST_PAGES:
            continue
        _, styles, node, content = known
        below = [out[c] for c in page.nodes[i].children] + ([content] if has_text[i] else [])
        if not page.nodes[i].children:
            out[i] = content if has_text[i] else 1.0
        else:
            out[i] = (1 - DAMPING**styles) * node + DAMPING**styles * (sum(below) / len(below))
    return out


def peaks(page: Page, tree: dict[int, tuple[int, int, float, float]]) -> list[float]:
    """The highest importance in each node's branch: its own, that of its texts, and those of all nodes in it."""
    out = importances(page, tree)
    for i in {i for i, _ in page.blocks}:
        known = tree.get(page.nodes[i].place)
        out[i] = max(out[i], known[3] if known and known[0] >= LEAST_PAGES else 1.0)
    for i in range(len(page.nodes) - 1, 0, -1):
        parent = page.nodes[i].parent
        out[parent] = max(out[parent], out[i])
    return out


def main_text(page: Page, tree: dict[int, tuple[int, int, float, float]] | None = None) -> str:
    """The article's text; ``tree`` has (pages, styles, importance of presentation, of content) of the host's places."""
    nodes = page.nodes
    inside, gone = article_of(page)
    kept = [a and not b for a, b in zip(inside, gone, strict=True)]
    if tree:
        highest = peaks(page, tree)
        letters, _, _ = _weights(page, [not k for k in kept])
        whole = letters[0]
        named = [False] * len(nodes)
        for i, n in enumerate(nodes[1:], 1):
            named[i] = kept[i] and (n.named and kept[n.parent] or named[n.parent])
        low = _within(page, [k and named[i] and highest[i] < LEAST_IMPORTANCE and letters[i] <= MOST_OF_TEXT * whole for i, k in enumerate(kept)])
        left = [k and not b for k, b in zip(kept, low, strict=True)]
        if any(left[i] for i, _ in page.blocks):
            kept = left
    return " ".join(text for i, text in page.blocks if kept[i])


# -- the trees of all hosts ---------------------------------------------------------------------------------------------------


def hosts_of(url):
    """The host of a url in lower case, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def style_trees(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, place, pages, styles, node, content): the places of each host that ``LEAST_PAGES`` distinct pages have, inside of articles or not.

    ``host`` is a hash here.  ``node`` is the entropy of the styles; ``content`` is one less the mean entropy of the
    texts over pages, both to the base of the number of pages.
    """

    def features(batches):
        reader = Reader()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                page, key = reader.read(text), digest(text)
                seen: dict[tuple[int, bool, int], int] = {}
                for n in page.nodes[1:]:
                    seen[n.place, True, digest(" ".join(n.signs))] = 1
                for i, block in page.blocks:
                    if i:
                        feature = (page.nodes[i].place, False, digest(block))
                        seen[feature] = seen.get(feature, 0) + 1
                for (place, style, feature), n in seen.items():
                    for column, v in zip(rows, (at, place, style, feature, key, n), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["host", "place", "style", "feature", "page", "n"])

    found = pages.where(F.col(host).isNotNull() & (F.length(html) > 0)).select(F.xxhash64(host).alias("host"), F.col(html).alias("html"))
    rows = found.mapInArrow(features, "host long, place long, style boolean, feature long, page long, n int")
    c = F.col("n").cast("double")
    once = rows.groupBy("host", "place", "style", "feature", "page").agg(F.max("n").alias("n"))
    spread = once.groupBy("host", "place", "style", "feature").agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum(c).alias("c"), F.sum(c * F.log(c)).alias("s"))
    k = F.col("k")
    places = spread.groupBy("host", "place").agg(
        F.sum(F.when(F.col("style"), k)).alias("m"), F.count_if("style").alias("styles"), F.sum(F.when(F.col("style"), k * F.log(k))).alias("styled"),
        F.avg(F.when(~F.col("style"), F.log("c") - F.col("s") / F.col("c"))).alias("h"),
    )
    log_m = F.log("m")
    return places.where(F.col("m") >= LEAST_PAGES).select(
        "host", "place", F.col("m").cast("long").alias("pages"), "styles",
        ((log_m - F.col("styled") / F.col("m")) / log_m).alias("node"), (1 - F.coalesce(F.col("h"), F.lit(0.0)) / log_m).alias("content"),
    )


NUMBERS = ["place", "pages", "styles", "node", "content"]


def extract(pages: DataFrame, id_column: str = "page_id", broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    own = pages.select(F.col(id_column).alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), hosts_of(F.col("url")).alias("host"))
    trees = reliable(style_trees(own))
    # Every branch ends in texts or in places that count as important, so a host without any place of low content has nothing that its tree could cut off.
    doubtful = trees.where(F.col("content") < LEAST_IMPORTANCE).select("host").distinct()
    used = trees.join(doubtful, "host", "left_semi")
    known = used.limit(broadcast_places + 1).collect()
    if len(known) <= broadcast_places:
        by_host: dict[int, dict[int, tuple]] = {}
        for r in known:
            by_host.setdefault(r["host"], {})[r["place"]] = tuple(r[c] for c in NUMBERS[1:])
        ready = own.select("page_id", "url", "html", F.xxhash64("host").alias("host"), F.lit(None).cast("array<struct<place:long,pages:long,styles:long,node:double,content:double>>").alias("tree"))
    else:
        by_host = {}
        ready = _with_own_places(own, used)
    ids = own.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            ids_, urls, htmls, hosts, trees_ = batch.columns
            out = []
            for html, host, tree in zip(htmls, hosts.to_pylist(), trees_.to_pylist(), strict=True):
                places = {p["place"]: tuple(p[c] for c in NUMBERS[1:]) for p in tree} if tree else by_host.get(host)
                out.append(main_text(reader.read(html.as_py()), places))
            yield pa.RecordBatch.from_arrays([ids_, urls, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return ready.mapInArrow(texts, f"page_id {ids}, url string, text string, n_chars long")


def _with_own_places(own: DataFrame, used: DataFrame) -> DataFrame:
    """Pages with the numbers of the places they have, for trees too large to travel whole: equal pages of a host are read once."""

    def places(batches):
        reader = Reader()
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = html.as_py()
                found = sorted({n.place for n in reader.read(text).nodes[1:]})
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.int64()), pa.array([digest(text)] * n, pa.int64()), pa.array(found, pa.int64())], ["host", "page", "place"])

    keyed = own.withColumn("host", F.xxhash64("host"))
    on_page = keyed.where("html <> ''").select("host", "html").mapInArrow(places, "host long, page long, place long").distinct()
    numbers = on_page.join(used, ["host", "place"]).groupBy("host", "page").agg(F.collect_list(F.struct(*NUMBERS)).alias("tree"))

    def with_key(batches):
        for batch in batches:
            keys = [digest(h.as_py()) for h in batch.column(batch.schema.get_field_index("html"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "page"])

    ids = own.schema["page_id"].dataType.simpleString()
    read = keyed.mapInArrow(with_key, f"page_id {ids}, url string, html string, host long, page long")
    return read.join(numbers, ["host", "page"], "left").select("page_id", "url", "html", "host", "tree")
