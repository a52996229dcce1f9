"""Main-text extraction with site style trees.

The element trees of all pages of a host are merged: elements on one path of tags and classes are one node. A node has
an importance of presentation (entropy of the child sequences that its pages give it) and of content (entropy of the
texts that they put below it), each relative to the most that so many pages could have. What a site repeats from page to
page scores low, what it writes anew scores high. Branches of low importance are removed from each page, inside a page's
article element too. Elements whose tag or role names them as furniture (menus, footers, forms and so on) are removed as
well. Classes and ids are evidence: a name whose last word is furniture (``comments``, ``site-menu``, ``share-bar``) removes an
element, one that only mentions it (``share-prices``) does so where the element is mostly links, and names of the elements
around an article only choose between several articles. Exact copies of a page count once, and classes and ids that only
a few pages of the host have are left out of the path, so that numbered elements are one node.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.llm.tables import map_batches, stored, texts_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An implied end tag never reaches over one of these.
SCOPE = frozenset("html body article section aside nav header footer main div table ul ol dl td th form blockquote".split())
#: Elements that are never main text.
FURNITURE = frozenset("head nav footer aside form button select input textarea script style noscript template iframe svg canvas object dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice gdpr
    sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended comment comments
    disqus respond reply replies newsletter subscribe signup login popup modal overlay widget pagination pager""".split())
#: A name that begins with one of these tells a state or a subject, not what the element is.
STATES = frozenset("no not non has have with without is hide hidden category cat tag topic type format".split())
#: Words after which the one before says what the element is.
HOLDERS = frozenset("""list bar box container wrapper wrap area section block links link slot unit inner outer panel buttons button icons icon
    posts articles stories items item group row top bottom left right main body holder content header head heading title text message thread strip""".split())
#: An element whose name only mentions furniture is removed from this share of linked text on.
LINKED = 0.5
#: Longer paths are continued from their hash, so a page of deeply nested elements takes memory in proportion to its size.
LONGEST_PATH = 300
#: A node below this importance is removed, if so many pages have text in it; a class or id on fewer pages is no part of a path.
IMPORTANCE, LEAST_PAGES = 0.3, 8
#: Weight of presentation in a node's importance; the rest is content.
PRESENTATION = 0.2


class Node:
    __slots__ = ("tag", "names", "path", "parent", "children", "kind", "in_article")

    def __init__(self, tag: str, names: str, parent: "Node | None", fixed: frozenset[str] = frozenset()):
        self.tag, self.names, self.parent = tag, names, parent
        label = tag + "".join(f".{n}" for n in sorted(fixed.intersection(names.split()))) if names else tag
        above = parent.path if parent else ""
        if len(above) > LONGEST_PATH:
            above = "~" + hashlib.blake2b(above.encode(), digest_size=8).hexdigest()
        self.path = f"{above}/{label}" if parent else label
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        self.children: list = []  # nodes and strings
        self.kind = ""


def parse(source: str, fixed: frozenset[str] = frozenset()) -> Node:
    """Element tree of a page; ends that the page leaves out are implied, ends without a start are passed over.

    Of classes and ids only those in ``fixed`` are part of a path.
    """
    root = node = Node("#", "", None)
    opened: Counter = Counter()  # open elements by tag

    def leave(low: Node, high: Node) -> Node:
        while low is not high:
            opened[low.tag] -= 1
            low = low.parent
        return high

    at = 0
    while True:
        token = TOKEN.search(source, at)
        if token is None:
            break
        if token.start() > at:
            node.children.append(html.unescape(source[at:token.start()]))
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(node, up.parent)
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            node = leave(node, _close(node, {"p"}))
        if tag in SAME_CLOSES and any(opened[t] > 0 for t in SAME_CLOSES[tag]):
            node = leave(node, _close(node, SAME_CLOSES[tag]))
        names, role = _names(token[3])
        new = Node(tag, names, node, fixed)
        new.kind = role
        node.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not token[0].endswith("/>"):
            node = new
            opened[tag] += 1
    if at < len(source):
        node.children.append(html.unescape(source[at:]))
    return root


def _close(node: Node, tags: set[str]) -> Node:
    up = node
    while up.parent is not None and up.tag not in tags:
        if up.tag in SCOPE:
            return node
        up = up.parent
    return up.parent if up.parent is not None else node


def _names(attributes: str) -> tuple[str, str]:
    """Classes and id of an element as words, and its role."""
    if "=" not in attributes:
        return "", ""
    values = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(attributes)}
    return " ".join([values.get("class", ""), values.get("id", "")]).lower().strip(), values.get("role", "").lower()


def furniture(node: Node) -> bool:
    """Whether tag or role say that an element is no main text."""
    return node.tag in FURNITURE or node.kind in ROLES or node.tag == "header" and not node.in_article


@lru_cache(maxsize=10_000)
def named(names: str) -> int:
    """Of an element's classes and id: 2 if one says that it is furniture, 1 if one mentions furniture, else 0."""
    level = 0
    for name in names.split():
        parts = [p for p in re.split(r"[-_\d]+", name) if p]
        if not WORDS.intersection(parts) or parts[0] in STATES:
            continue
        while len(parts) > 1 and parts[-1] in HOLDERS:
            parts.pop()
        level = max(level, 2 if parts[-1] in WORDS else 1)
    return level


def links_of(root: Node) -> dict[int, float]:
    """Share of linked text below each element that has text, by the element's ``id``."""
    sizes: dict[int, tuple[int, int]] = {}
    for node in reversed(list(walk(root))):
        below = [sizes[id(c)] for c in node.children if isinstance(c, Node)]
        total = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(t for t, _ in below)
        sizes[id(node)] = (total, total if node.tag == "a" else sum(x for _, x in below))
    return {k: linked / total for k, (total, linked) in sizes.items() if total}


def walk(node: Node) -> Iterator[Node]:
    """All elements below, in page order, without recursion."""
    stack = [node]
    while stack:
        own = stack.pop()
        yield own
        stack += [c for c in reversed(own.children) if isinstance(c, Node)]


def blocks_of(roots: list[Node], dropped: set[str], everywhere: bool, links: dict[int, float], spared: set[int]) -> list[str]:
    """Text blocks below ``roots`` without furniture, and without paths in ``dropped`` if ``everywhere``.

    Names of the roots and of elements in ``spared`` count for nothing.
    """
    out, held = [], []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    def goes(node: Node) -> bool:
        if furniture(node) or everywhere and node.path in dropped:
            return True
        level = named(node.names) if node.names and node.tag not in ("html", "body") and id(node) not in spared else 0
        return level == 2 or level == 1 and links.get(id(node), 0) >= LINKED

    for root in roots:
        stack: list = [root]
        while stack:
            own = stack.pop()
            if isinstance(own, str):
                held.append(own)
                continue
            if own is None:
                flush()
                continue
            if own is not root and goes(own):
                if own.tag in BLOCK:
                    flush()
                continue
            if own.tag in ("br", "td", "th"):
                held.append(" ")
            if own.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(own.children)
        flush()
    return out


def main_elements(root: Node) -> list[Node]:
    """Outermost article and main elements outside of furniture; those in an element named as furniture only if there are no others."""
    found, stack = [], [(root, False)]
    while stack:
        node, doubtful = stack.pop()
        if furniture(node):
            continue
        doubtful = doubtful or node.tag not in ("html", "body") and named(node.names) == 2
        if node.tag == "article" or node.tag == "main" or node.kind == "main":
            found.append((node, doubtful))
        else:
            stack += [(c, doubtful) for c in reversed(node.children) if isinstance(c, Node)]
    return [n for n, doubtful in found if not doubtful] or [n for n, _ in found]


def main_text(source: str, dropped: set[str], fixed: frozenset[str] = frozenset()) -> str:
    """Where a whole article element is of low importance, the site repeats its articles, and only names tell furniture inside.

    Names of elements around the only article of a main element count for nothing.
    """
    root = parse(source, fixed)
    links, tops, spared = links_of(root), main_elements(root), set()
    inner = [n for top in tops for n in walk(top) if n.tag == "article"]
    if len(inner) == 1:
        up = inner[0]
        while up is not None:
            spared.add(id(up))
            up = up.parent
    articles = [text for n in tops for text in blocks_of([n], dropped, n.path not in dropped, links, spared)]
    return "\n".join(articles or blocks_of(tops, dropped, False, links, spared) or blocks_of([root], dropped, True, links, set()))


def node_features(source: str, fixed: frozenset[str] = frozenset()) -> dict[str, tuple[str, str | None]]:
    """For each path of a page: its child sequences and the text below it (if any), as digests.

    The digest of an element's text is made of its own words and the digests of its children, so each text is read once.
    """
    digest = lambda parts: hashlib.blake2b("\n".join(parts).encode(), digest_size=8).hexdigest()
    content: dict[int, str | None] = {}
    styles: dict[str, list[str]] = {}
    texts: dict[str, list[str]] = {}
    nodes = [n for n in walk(parse(source, fixed)) if n.tag not in RAW and n.tag != "head"]
    for node in reversed(nodes):
        words = " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())
        below = [d for c in node.children if isinstance(c, Node) and (d := content.get(id(c)))]
        content[id(node)] = digest([words, *below]) if words or below else None
    for node in nodes:
        labels = [c.tag for c in node.children if isinstance(c, Node)]
        styles.setdefault(node.path, []).append(",".join(t for k, t in enumerate(labels) if not k or labels[k - 1] != t))
        if content[id(node)]:
            texts.setdefault(node.path, []).append(content[id(node)])
    return {path: (digest(own), digest(texts[path]) if path in texts else None) for path, own in styles.items()}


def host_of(url: Column) -> Column:
    """Host in lower case without port; empty where there is none, and for a null url."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def site_names(pages: DataFrame, url: str = "url", source: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, names): classes and ids that at least ``least_pages`` pages of a host have; the others vary by page."""
    values = F.regexp_extract_all(F.col(source), F.lit(r"(?i)(?<![\w-])(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(1))
    names = F.array_distinct(F.split(F.lower(F.translate(F.array_join(values, " "), "\"'", "")), r"\s+"))
    seen = pages.select(host_of(F.col(url)).alias("host"), F.explode(names).alias("name")).where("name <> ''").groupBy("host", "name").agg(F.count(F.lit(1)).alias("n"))
    return stored(seen.where(F.col("n") >= least_pages).groupBy("host").agg(F.collect_set("name").alias("names")), "site-names")  # a site's template


def style_tree(pages: DataFrame, url: str = "url", source: str = "html", names: DataFrame | None = None) -> DataFrame:
    """(host, path, pages, texts, presentation, content, importance): the merged tree of every host, a row for each node.

    Importances are entropies relative to the largest possible with so many pages; a node that only one page has counts 1.
    ``texts`` is how many pages have text in the node; content is judged over those, and is 0 where there are none.
    Pages of a host with equal sources are one page. Counts of a host are added up before and after the shuffle, so a host
    with many pages is no heavy key. ``names`` are those of ``site_names``.
    """
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            counts: Counter = Counter()
            for host, text, own in zip(batch.column("host").to_pylist(), texts_of(batch, "source"), batch.column("names").to_pylist()):
                for path, (style, content) in node_features(text, frozenset(own or ())).items():
                    counts[host, path, "s", style] += 1
                    if content is not None:
                        counts[host, path, "c", content] += 1
            keys = list(counts)
            yield {"host": [k[0] for k in keys], "path": [k[1] for k in keys], "kind": [k[2] for k in keys], "digest": [k[3] for k in keys], "n": list(counts.values())}

    names = site_names(pages, url, source) if names is None else names
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("source"))
    rows = rows.groupBy("host", F.xxhash64("source").alias("copy")).agg(F.first("source").alias("source")).drop("copy")
    seen = map_batches(rows.join(names, "host", "left"), kernel, "host string, path string, kind string, digest string, n long")
    seen = seen.groupBy("host", "path", "kind", "digest").agg(F.sum("n").alias("n"))
    # entropy from sums: log(m) - sum(n log n) / m
    sums = seen.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m"))).otherwise(F.lit(1.0))
    of = lambda kind, x: F.coalesce(F.max(F.when(F.col("kind") == kind, x)), F.lit(0))
    nodes = sums.groupBy("host", "path").agg(of("s", F.col("m")).alias("pages"), of("c", F.col("m")).alias("texts"), of("s", entropy).alias("presentation"), of("c", entropy).alias("content"))
    return nodes.withColumn("importance", PRESENTATION * F.col("presentation") + (1 - PRESENTATION) * F.col("content"))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", importance: float = IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per row of ``pages``: key, url, text.

    Null and empty pages have the empty text. Null keys and urls pass through; pages without a host form one site.
    Repeated rows get equal results, an empty table an empty one; a page of any size or depth is read in memory proportional to
    its size. Only the three named columns are read, so others may have any name. Character references are decoded, white space
    inside a block becomes one space, blocks are joined by line ends in page order.
    """
    names = site_names(pages, url, source, least_pages)
    low = style_tree(pages, url, source, names).where((F.col("importance") < importance) & (F.col("texts") >= least_pages))
    noise = stored(low.groupBy("host").agg(F.collect_set("path").alias("paths")), "site-noise")  # a site's template
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            paths, names_ = batch.column("paths").to_pylist(), batch.column("names").to_pylist()
            yield {key: batch.column("_key"), url: batch.column("_url"), "text": [main_text(t, set(p or ()), frozenset(n or ())) for t, p, n in zip(texts_of(batch, "_source"), paths, names_)]}

    rows = pages.select(pages[key].alias("_key"), pages[url].alias("_url"), pages[source].alias("_source"), host_of(pages[url]).alias("host"))
    return map_batches(rows.join(noise, "host", "left").join(names, "host", "left").drop("host"), kernel, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string")
