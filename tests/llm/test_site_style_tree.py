import math
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gapline.llm import site_style_tree as st
from gapline.llm.common import Scratch


def page(k, body):
    return f"<html><head><title>t{k}</title></head><body><div class='x1'>All about us on one line</div>{body}<div class='z9'>Made by the same people</div></body></html>"


def test_parsing():
    text = st.text_of("<article><h1>T&amp;T</h1><p><b>One\n two&nbsp; three<br><p>Four<!-- no --><script>var a='</p>'</script> five<ul><li>a<li>b</ul><div class='ad'>no</div></article><p>out</p>", set())
    assert text == "T&T\nOne two three\nFour five\na\nb"
    assert st.text_of("plain &lt;text&gt; <i>in</i>line", set()) == "plain <text> inline"
    assert st.text_of("<div>a<p class='site-nav'>b</p><form>c</form><p hidden>d<p>e<nav><ul><li>f", set()) == "a\ne"
    inside = "<div class='page-header'>x</div><article><header class='entry-header'><h1>T</h1></header><p>a</p><ol class='commentlist'><li>no</ol><article class='comment'>no</article><div id='cookie-notice'>no</div></article><div class='adbox'>no</div>"
    assert st.text_of(inside, set()) == "T\na"
    assert st.text_of("<div class='header'>x</div><div class='adapter'>y</div>", set()) == "y"
    assert st.text_of("<p title='a > b'>x<unknown>y</p><style>z", set()) == "x\ny"


def test_long_attributes():
    long = "x>" * 50_000
    assert st.text_of(f"<article><p>a<img src=\"data:{long}\">b<p data-props='{long}'>c</article>", set()) == "ab\nc"
    assert st.text_of(f'<div class="nav" data-props="{long}">menu</div><p>text</p>', set()) == "text"
    assert st.text_of("<p title=it's>one</p><p>don't</p><p title=\"two>three</p><!-- > open", set()) == "one\ndon't\nthree"
    start = time.perf_counter()
    for part in ("<a ", '<a "', "<a '\"", '<a x="', "<a x='\"", "<a x=", "<a =\"'>"):
        for end in ("", ">", '">', "='>", '=">"', "=\">'"):
            st.text_of(part * 40_000 + end, set())
    assert time.perf_counter() - start < 30


def test_words_of_wrappers_are_weighed():
    text = "<p>An article that is long enough to be most of the page</p>"
    for wrapper in ("div class='elementor-widget elementor-widget-text-editor'", "div class='content with-sidebar'", "div class='no-sidebar'", "div class='post no-comments'", "div id='search-result-text'", "form id='aspnetForm'"):
        page = f"<{wrapper}>{text}<div class='sidebar'>no</div><div class='comments'>Nobody's words, no matter how many of them there are, are the article of a page</div></{wrapper.split()[0]}><div class='menu'>menu</div>"
        assert st.text_of(page, set()) == text[3:-4], wrapper
    assert st.text_of(f"<div class='banner'><h1>Head</h1></div>{text}<div class='search'>x</div>", set()) == f"Head\n{text[3:-4]}"
    parts = "".join(f"<div class='elementor-widget text'><p>Part {k} of the text</p></div>" for k in range(5))
    assert st.text_of(f"<h1>T</h1>{parts}<div class='elementor-widget login'>no</div>", set()).count("Part") == 5
    assert st.text_of(f"<h1>T</h1>{text}<form>find</form><div class='related'>more</div>", set()) == f"T\n{text[3:-4]}"


def test_template_is_removed_by_importance(spark):
    rows = [(k, f"http://h.example/{k}", page(k, f"<div class='body'><p>Text number {k} of its own, long enough to count</p><p>And more {k * k} words that differ here</p></div>")) for k in range(12)]
    rows += [(100, "http://other.example/1", page(1, "<p>single</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in st.main_text(pages).collect()}
    for k in range(12):
        assert got[k]["text"] == f"Text number {k} of its own, long enough to count\nAnd more {k * k} words that differ here"
    assert got[100]["text"] == "All about us on one line\nsingle\nMade by the same people"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_short_articles_under_long_templates(spark):
    menu = "<div>" + "".join(f"<div class='m'><p>Entry {k} of a long list that stands on all pages of the site</p></div>" for k in range(60)) + "</div>"
    rows = [(k, f"http://h.example/{k}", page(k, f"{menu}<section><p>Notice {k * k} is short</p></section>")) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in st.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Notice {k * k} is short" for k in range(12)}


def test_importance_by_hand(spark):
    found = spark.createDataFrame([("h", st.LAYOUT, 1, 7, 4), ("h", st.CONTENT, 1, 8, 4), ("h", st.BELOW, 1, 1, 4), ("h", st.LAYOUT, 2, 5, 3), ("h", st.LAYOUT, 2, 6, 1), ("h", st.CONTENT, 2, 9, 2), ("h", st.CONTENT, 2, 10, 1), ("h", st.BELOW, 2, 2, 4), ("h", st.BELOW, 2, 3, 4), ("h", st.BELOW, 1, 3, 4), ("h", st.LAYOUT, 3, 1, 4)], "host string, kind byte, node long, feature long, n long")
    got = {r["node"]: r["importance"] for r in st.importance(found, Scratch(spark, "t")).collect()}
    leaf = 1 - (math.log(2) / math.log(4)) / 2
    content = (2 * leaf + 0) / 3
    assert math.isclose(got[1], 0, abs_tol=1e-9) and math.isclose(got[2], leaf) and math.isclose(got[3], 0.9 * content)


def test_tables(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = st.main_text(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        lines = [x for x in (" ".join(x.split()) for x in docs[int(re.match(r"https?://[^/]+/\w+/(\d+)", r["url"])[1])].split("\n")) if x]
        assert r["text"].split("\n")[1:] == lines


def test_edges(spark):
    same = page(0, "<p>the same words on all of these pages, over and over</p>")
    rows = [(1, None, "<p>a</p>"), (2, "http://h/1", None), (3, "nonsense", ""), (None, "http://h/2", "<p>b</p>"), (4, "http://h/3", "<p>" + "word " * 200_000), (4, "http://h/3", "<<<>>>&&&#x;<p"), (5, "http://h/4", "<p><p><p></div></article>" * 2000)]
    rows += [(10 + k, "http://copies.example/", same) for k in range(8)] + [(30 + k, "http://near.example/", page(k, "<p>the same words on all of these pages</p>" + "<i>x</i>" * k)) for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("low", F.lit("x"))
    got = st.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "a" and by[2] == by[3] == "" and by[None] == "b" and by[5] == ""
    assert all("the same words" in by[10 + k] and "the same words" in by[30 + k] for k in range(8))
    assert st.main_text(pages.limit(0)).count() == 0


def brute_importance(pages):
    """Importance of each node of one host, from the formulas, with the number of its pages."""
    parsed = [st.parse(p)[:2] for p in sorted(set(pages))]
    layouts, texts, below = defaultdict(list), defaultdict(Counter), defaultdict(set)
    for blocks, ways in parsed:
        for node, seen in ways.items():
            layouts[node].append("|".join(sorted(set(seen))))
        for node, text in {(path[-1], text) for text, path, _, _ in blocks}:
            texts[node][text] += 1
        for _, path, _, _ in blocks:
            for up in path:
                below[up].add(path[-1])
    out = {}
    for node, leaves in below.items():
        worth = [1 - (math.log(n) / math.log(len(layouts[leaf])) if len(layouts[leaf]) > 1 else 0) for leaf in leaves for n in texts[leaf].values()]
        content, m = sum(worth) / len(worth), len(layouts[node])
        ways = Counter(layouts[node])
        entropy = -sum(n / m * math.log(n / m) for n in ways.values()) / math.log(m) if m > 1 else 1
        share = st.DECAY ** min(len(ways), 100)
        out[node] = (m, (1 - share) * entropy + share * content if leaves - {node} else content)
    return out


def test_importance_matches_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "html").filter("html is not null").distinct()
    hosts = defaultdict(list)
    for r in pages.collect():
        hosts[r["host"]].append(r["html"])
    got = defaultdict(dict)
    for r in st.importance(st.features(pages), Scratch(spark, "t")).collect():
        got[r["host"]][r["node"]] = (r["pages"], r["importance"])
    for host, some in hosts.items():
        want = brute_importance(some)
        assert want.keys() == got[host].keys()
        assert all(w[0] == got[host][n][0] and math.isclose(w[1], got[host][n][1], abs_tol=1e-9) for n, w in want.items())


def test_tree_decides(spark):
    """Without the tree nothing is taken from pages of a host that it has seen, not even what calls itself a menu."""
    rows = [(k, f"http://h.example/{k}", page(k, f"<nav>menu</nav><div class='body'><div class='post-share-prices'><p>Text number {k} of its own, long enough to count</p></div></div>")) for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    off = {r["page_id"]: r["text"].split("\n") for r in st.main_text(pages, least_importance=-1).collect()}
    on = {r["page_id"]: r["text"] for r in st.main_text(pages).collect()}
    for k in range(12):
        text = f"Text number {k} of its own, long enough to count"
        assert on[k] == text and off[k] == ["All about us on one line", "menu", text, "Made by the same people"]
