"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes (element name and classes, below the same parents). A node that looks
and reads the same on all pages is template, one that differs from page to page is content. Importance is measured by entropy:

* content node: one minus the mean, over its distinct texts, of the entropy of the text's distribution over the node's ``m`` pages
  to the base ``m`` (0 for a text on one page, 1 for a text on all);
* presentation node: the entropy to the base ``m`` of the ways in which its children are laid out, mixed with the importance of
  the content below it (``(1 - g**l) * layout + g**l * content`` for ``l`` layouts).

All elements go into the tree. Nodes under the threshold, seen on enough pages, without any node of content over it below them are
removed from each page with all that is below them. The importance of elements that say themselves that they are no article (``nav``,
``aside``, ``class="ad"`` and so on) is taken to be less by ``PRIOR``: comments and adverts differ from page to page, so their entropy
alone would keep them. Hosts with fewer pages than the tree needs are judged by this evidence alone. Classes, ids and forms are
weighed first: such an element stays if it holds the page's main heading, or, for words that also name
wrappers of articles (``LOOSE``, forms), if elements of its kind hold most of the text that the tree leaves. If a page has ``article`` or ``main``
elements only these are read. However much of a page is template, what is left is its text; only if the tree leaves no content
(fewer than ``LEAST_LEFT`` letters and digits) the page is read without it: pages of a host that only holds copies would look like
templates.

Statistics are sums over (host, node, feature), added up in each batch first, so a host with a third of all pages is a few rows for
each task. Exact copies of a page on the same host count once.

Defined cases: null or empty html gives an empty text; very long pages are read whole, each tag once; null urls and urls without a host are judged by their own elements alone;
repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import Scratch

LEAST_IMPORTANCE, LEAST_PAGES, DECAY = 0.2, 5, 0.9
#: What is taken off the importance of nodes that call themselves no article.
PRIOR = 1.0
#: The doubt about elements that are no article whatever they hold.
CERTAIN = ("", False)
#: Fewer letters and digits than these, on the whole page, are no content (a counter, a page number, a mark).
LEAST_LEFT = 10
#: Rows of low nodes (with their host) up to which they are broadcast.
BROADCAST_ROWS = 500_000

#: Quotes hold a value behind ``=`` only, whatever its length; one that is never closed is a character like others. All groups are
#: possessive, so that a tag is read once.
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
#: Elements that end an open element of the same kind (within the nearest of their containers).
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "pre", "section", "table", "ul"}
CONTAINERS = {"article", "main", "section", "div", "ul", "ol", "dl", "table", "body", "aside", "nav", "form", "blockquote", "html"}

NO_ARTICLE = {"nav", "footer", "aside", "button", "select", "menu", "dialog", "object", "svg", "canvas", "head", "audio", "video", "map"}
FORMS = {"form", "fieldset"}
NO_ARTICLE_WORDS = {
    "ad", "ads", "advert", "adverts", "alert", "alerts", "announcement", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "hidden", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
NO_ARTICLE_PREFIX = re.compile(r"comment|advert|cookie|sidebar|newsletter|breadcrumb|navbar|navigation|sponsor|disqus|paginat|gdpr|ad(?:s|box|slot|unit|banner|container|wrap)$")
#: Words that wrappers of articles have too.
LOOSE = {"alert", "alerts", "announcement", "banner", "hidden", "modal", "notice", "notices", "popup", "promo", "promotion", "recommended", "related", "search", "share", "sharing", "sidebar", "social", "toolbar", "widget"}
#: A class that begins with one of these tells what the element is beside, or lacks.
BESIDE = {"has", "have", "hide", "no", "not", "with", "without"}
#: A header of one of these belongs to the article.
OF_ARTICLE = {"article", "entry", "post", "content", "section", "title", "story"}
NO_ARTICLE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}


def _h(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


class Node:
    __slots__ = ("article", "children", "doubts", "inline", "noise", "parents", "path", "tag")

    def __init__(self, tag: str, classes: str, above: Node | None, noise: bool, doubt: tuple[str, bool] | None = None):
        self.tag, self.inline = tag, tag in INLINE
        self.noise = noise or bool(above and above.noise)
        self.doubts = (*(above.doubts if above else ()), *([doubt] if doubt else ()))
        self.article = tag in ("article", "main") or bool(above and above.article)
        self.children: list[str] = []
        if self.inline and above:
            self.path, self.parents = above.path, above.parents
        else:
            self.path = _h(f"{above.path if above else ''}/{tag}.{classes}")
            self.parents = (*(above.parents if above else ()), self.path)


def said(tag: str, attributes: str, above: Node | None) -> tuple[str, bool, tuple[str, bool] | None]:
    """Classes of an element (without digits), whether it is no article for certain, and the doubt that its words raise: its kind, and
    whether wrappers of articles may have these words too.
    """
    noise = tag in NO_ARTICLE or (tag == "header" and not (above and above.article))
    if not attributes or attributes.isspace():
        return "", noise, (tag, True) if tag in FORMS else None
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    classes = found.get("class", "")
    names = [re.split(r"[_\-]+", x) for x in f"{classes} {found.get('id', '')}".lower().split()]
    told = {part for x in names if x[0] not in BESIDE for part in x}
    words: set[str] = set()
    if tag == "article":
        noise = noise or any(x.startswith("comment") for x in told) or bool(told & {"reply", "ad", "promo", "sponsored"})
    elif tag not in ("html", "body", "main", "h1"):
        words = {x for x in told if x in NO_ARTICLE_WORDS or NO_ARTICLE_PREFIX.match(x)}
        if "header" in told and not told & OF_ARTICLE and not (above and above.article):
            words.add("header")
        role = found.get("role", "").lower()
        words |= {role} & {"form", "search"}
        noise = noise or role in NO_ARTICLE_ROLES - {"form", "search"}
        noise = noise or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").lower().replace(" ", "")
    classes = " ".join(sorted(re.sub(r"\d+", "", classes).split()))
    doubt = (f"{tag}.{classes}#{re.sub(r'[0-9]+', '', found.get('id', ''))}", words <= LOOSE | {"form"}) if words or tag in FORMS else None
    return classes, noise, doubt


Block = tuple[str, tuple[int, ...], bool, tuple[tuple[str, bool], ...]]


def parse(page: str) -> tuple[list[Block], dict[int, list[str]], set[str]]:
    """Blocks (text, path from the root, in an article, doubts) in page order, the layouts of each style node, and the doubtful kinds of elements that hold the main heading.
    """
    blocks: list[Block] = []
    heads: list[tuple[tuple[str, bool], ...]] = []
    layouts: dict[int, list[str]] = {}
    root = Node("html", "", None, False)
    stack, buffer, aside = [root], [], []
    at, skip = 0, None

    def flush() -> None:
        for held, more in ((buffer, ()), (aside, (CERTAIN,))):
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                held.clear()
                if text:
                    blocks.append((text, stack[-1].parents, stack[-1].article, (*stack[-1].doubts, *more)))

    def pop() -> None:
        node = stack.pop()
        if not node.inline:
            layouts.setdefault(node.path, []).append(">".join(node.children))

    # Nothing behind the last ">" is a tag; up to there each start of a tag has an end, so that none is looked for in vain.
    for m in TOKEN.finditer(page, 0, page.rfind(">") + 1):
        if m.start() < at:
            continue
        if m.start() > at:
            (aside if stack[-1].noise else buffer).append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag = m[2].lower()
        if tag == "html":
            continue
        if not m[1]:
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if tag not in INLINE:
                flush()
            if tag in VOID:
                continue
            ends = CLOSES.get(tag, {"p"} if tag in ENDS_P else None)
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        while len(stack) > k:
                            pop()
                        if tag not in ("tr", "li"):
                            break
                    elif stack[k].tag in CONTAINERS:
                        break
            classes, noise, doubt = said(tag, m[3], stack[-1])
            node = Node(tag, classes, stack[-1], noise, doubt)
            if tag == "h1" and not node.noise:
                heads.append(node.doubts)
            if not node.inline:
                below = next(n for n in reversed(stack) if not n.inline)
                label = f"{tag}.{classes}"
                if below.children[-1:] != [label]:
                    below.children.append(label)
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "path"):
                stack.append(node)
        else:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        pop()
                    break
                if tag in INLINE and not stack[k].inline:
                    break
    if at < len(page):
        (aside if stack[-1].noise else buffer).append(page[at:])
    flush()
    while stack:
        pop()
    main = heads[0] if heads and all(heads) else ()
    return blocks, layouts, {kind for kind, _ in main}


CONTENT, LAYOUT, BELOW = 0, 1, 2


def features(pages: DataFrame) -> DataFrame:
    """(host, kind, node, feature, n): texts and layouts of each style node with the pages that have them, and each node's ancestors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    blocks, layouts, _ = parse(page)
                    own = {(host, CONTENT, path[-1], _h(text)) for text, path, _, _ in blocks}
                    own |= {(host, LAYOUT, node, _h("|".join(sorted(set(ways))))) for node, ways in layouts.items()}
                    own |= {(host, BELOW, path[-1], up) for path in {p for _, p, _, _ in blocks} for up in path}
                    found.update(own)
            rows = list(found)
            for a in range(0, len(rows), 100_000):
                columns = list(zip(*rows[a : a + 100_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int8()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array([found[r] for r in rows[a : a + 100_000]], pa.int64())], ["host", "kind", "node", "feature", "n"])

    made = pages.select("host", "html").mapInArrow(run, "host string, kind tinyint, node bigint, feature bigint, n bigint")
    return made.groupBy("host", "kind", "node", "feature").agg(F.sum("n").alias("n"))


def importance(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, node, pages, importance) of every style node."""
    layout = found.filter(F.col("kind") == LAYOUT)
    pages = layout.groupBy("host", "node").agg(F.sum("n").alias("m"), F.count("*").alias("layouts"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nlogn"))
    # -sum(n/m * ln(n/m)) / ln m
    pages = pages.withColumn("layout", F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0)))
    pages = scratch.save(pages.select("host", "node", "m", "layouts", "layout"))
    texts = found.filter(F.col("kind") == CONTENT).groupBy("host", "node").agg(F.count("*").alias("texts"), F.sum(F.log(F.col("n").cast("double"))).alias("logs"))
    leaves = texts.join(pages, ["host", "node"]).select("host", "node", "texts", F.when(F.col("m") > 1, F.col("texts") - F.col("logs") / F.log("m")).otherwise(F.col("texts").cast("double")).alias("worth"))
    below = found.filter(F.col("kind") == BELOW).select("host", "node", F.col("feature").alias("up"))
    content = below.join(leaves, ["host", "node"]).groupBy("host", "up").agg((F.sum("worth") / F.sum("texts")).alias("content"), F.max(F.when(F.col("up") != F.col("node"), 1).otherwise(0)).alias("inner"))
    share = F.pow(F.lit(DECAY), F.least(F.col("layouts"), F.lit(100)))
    both = content.withColumnRenamed("up", "node").join(pages, ["host", "node"])
    return both.select("host", "node", F.col("m").alias("pages"), F.when(F.col("inner") == 1, (1 - share) * F.col("layout") + share * F.col("content")).otherwise(F.col("content")).alias("importance"))


def without_noise(blocks: list[Block], heading: set[str]) -> list[Block]:
    """The blocks without doubtful elements, but for those that hold the main heading or most of the text; of articles if there are."""
    sizes: Counter = Counter()
    total = 0
    for text, _, _, doubts in blocks:
        if CERTAIN not in doubts and all(loose or kind in heading for kind, loose in doubts):
            total += len(text)
            sizes.update(dict.fromkeys((kind for kind, _ in doubts), len(text)))
    fine = heading | {kind for kind, n in sizes.items() if 2 * n > total}
    kept = [b for b in blocks if all(kind in fine for kind, _ in b[3]) and CERTAIN not in b[3]]
    return [b for b in kept if b[2]] or kept


def text_of(page: str | None, low: set[int], sure: set[int] = frozenset()) -> str:
    """The main text of one page, given the low nodes of its host and those that are above all doubts."""
    if not page:
        return ""
    blocks, _, heading = parse(page)
    if sure:
        blocks = [(text, path, article, () if path[-1] in sure else doubts) for text, path, article, doubts in blocks]
    kept = without_noise([b for b in blocks if low.isdisjoint(b[1])], heading)
    if sum(c.isalnum() for t, *_ in kept for c in t) < LEAST_LEFT:
        kept = without_noise(blocks, heading)
    return "\n".join(t for t, *_ in kept)


def main_text(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    scratch = Scratch(pages.sparkSession, "style-tree")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1))
    read = pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("html"))
    known = read.filter("host <> '' and html is not null")
    copies = known.select("host", F.sha1("html").alias("digest"), "page_id").groupBy("host", "digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = scratch.save(copies.select(F.col("host").alias("of"), "digest", "first"))
    few = copies.count()
    if few:
        copies = F.broadcast(copies) if few <= BROADCAST_ROWS else copies
        known = known.join(copies, (known.host == copies.of) & (F.sha1("html") == copies.digest), "left").filter("first is null or page_id = first")
    found = scratch.save(features(known))
    judged = scratch.save(importance(found, scratch).filter(F.col("pages") >= least_pages))
    # A template that holds content is no noise as a whole: what is below it is judged node by node.
    worthy = judged.filter(F.col("importance") >= least_importance).select("host", "node")
    holders = found.filter(F.col("kind") == BELOW).select("host", "node", F.col("feature").alias("up")).join(worthy, ["host", "node"]).select("host", F.col("up").alias("node"))
    low = judged.filter(F.col("importance") < least_importance).select("host", "node", F.lit(True).alias("is_low")).join(holders, ["host", "node"], "left_anti")
    sure = judged.filter(F.col("importance") >= least_importance + PRIOR).select("host", "node", F.lit(False).alias("is_low"))
    told = scratch.save(low.unionByName(sure))
    some = told.count() <= BROADCAST_ROWS
    lists = told.groupBy(F.col("host").alias("of")).agg(F.collect_list(F.when(F.col("is_low"), F.col("node"))).alias("low"), F.collect_list(F.when(~F.col("is_low"), F.col("node"))).alias("sure"))
    joined = read.join(F.broadcast(lists) if some else lists, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "low", "sure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "low", "sure")), strict=True)
            texts = [text_of(page, set(low or ()), set(sure or ())) for page, low, sure in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
