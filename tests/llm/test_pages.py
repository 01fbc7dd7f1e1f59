"""Main text: against plain reading of the given pages, a brute-force style tree, and sites whose markup declares nothing."""

import html as entities
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heritree.llm import main_text
from heritree.llm.pages import main_blocks, read

SCHEMA = "page_id long, url string, html string"
ARTICLE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><article>no</article>';</script></head><body class='has-sidebar'>{before}<article><h1>Head &amp; line</h1>{body}</article>{after}</body></html>"
PLAIN = "<html><body><div class='x1'><span>Our site</span> since 1999</div><div class='x2'>{body}</div><div class='x3'>All rights reserved</div></body></html>"


def text(page, noisy=()):
    return "\n".join(main_blocks(*read(page, "h"), frozenset(noisy)))


def plainly(page):
    """The article of a page whose markup is only p, h1, b and br."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(x for x in lines if x)


def test_the_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r for r in main_text.main_text_report(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["page_id"]]["text"] == plainly(r["html"]) and found[r["page_id"]]["n_chars"] == len(plainly(r["html"])) and found[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize(
    "page, wanted",
    [
        (ARTICLE.format(before="<nav><ul><li><a href=/a>A</a></ul></nav><!-- ad --><div class=ad>Buy</div>", body="<p><b>One<br>two <p>three</p>", after="<footer>&copy; x</footer>"), "Head & line\nOne two\nthree"),
        (ARTICLE.format(before="<header><h1>Site</h1></header>", body="<p>a<script>x<y</script>b &lt;i&gt; &eacute;&#233;&#xE9; &ampx &am</p>", after=""), "Head & line\nab <i> ééé &x &am"),
        (ARTICLE.format(before="", body="<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><th>c</table><blockquote>q</blockquote><pre> x \n\n y </pre>", after="<section id=comments><article>me too</article></section>"), "Head & line\none\ntwo\na b\nc\nq\nx y"),
        (ARTICLE.format(before="<aside><article>teaser</article></aside>", body="<p>in<aside>pulled</aside></p>tail<form><input>name</form><div class='share-bar'>tweet</div><footer>tags</footer>", after=""), "Head & line\nin\ntail"),
        (ARTICLE.format(before="", body="<p>a<noscript>on</noscript> b <button>press</button>c</p><p hidden>h</p><p style='display: none'>n</p><div class='no-comments'>kept</div><div class='entry-comments'>lost</div>", after=""), "Head & line\na b c\nkept"),
        ("<main><h1>M</h1><p>x &nbsp; y</p><div class=sidebar>s</div></main><p>out", "M\nx y"),
        ("<body><div id=header>h</div><div id=content><p>text <a href=x>link</a> more<p>end</div><div class='site-footer'>f</div>", "text link more\nend"),
        ("<ul><li><a>one</a><li><a>two</a></ul><p>words <i>it</i>alic</p> tail", "words italic\ntail"),
        ("just text & no markup < here", "just text & no markup < here"),
        ("<p>a <b>b<div>c</b> d</div>", "a b\nc d"),
        ("<article></article><p>outside", "outside"),
        ("<p>cut <a href='", "cut"),
        ("<script>never ends", ""), ("<!-- never ends", ""), ("", ""), (None, ""), ("   \n ", ""),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("</p></div></b>x<br/>y<hr>z", "x y\nz"),
    ],
)
def test_pages(page, wanted):
    assert text(page) == wanted


def test_long_pages_are_read_whole():
    body = "<p>" + "</p><p>".join(f"word{k} " * 40 for k in range(20_000)) + "</p>"
    out = text(ARTICLE.format(before="", body=body, after=""))
    assert out.count("\n") == 20_000 and out.endswith("word19999")
    assert text("<a '" * 50_000) == "" and text("<!" * 50_000) == ""


def site(n, host="site.example"):
    return [(k, f"https://{host.upper() if k % 2 else host}/{k}?x=1", PLAIN.format(body=f"<h2>Story {'abcdefghij'[k % 10]}{k}</h2><p>Body of {k} in word{k * 7} and so on</p>")) for k in range(n)]


def brute_noise(rows):
    """Noisy nodes by dictionaries, from the definition."""
    styles, texts, above = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(list)), {}
    for _, url, page in rows:
        elements, blocks = read(page, main_text._site(url, page))
        s, t = main_text.features(elements, blocks)
        for (node, v), _n in s.items():
            styles[node][v] += 1
        for (node, v), n in t.items():
            texts[node][v].append(n)
        for e in elements:
            above[e.key] = [a.key for a in e.chain()]
    m = {node: sum(v.values()) for node, v in styles.items()}
    weight, own = {}, {}
    for node in styles:
        each = []
        for counts in texts[node].values():
            h = -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
            each.append(1.0 if m[node] == 1 else 1 - h / math.log(m[node]))
        weight[node] = each
    for node, v in styles.items():
        if m[node] >= main_text.MIN_PAGES:
            below = [x for k, chain in above.items() if node in chain for x in weight[k]]
            presentation = -sum(c / m[node] * math.log(c / m[node]) for c in v.values()) / math.log(m[node])
            falls = main_text.G ** len(v)
            own[node] = (1 - falls) * presentation + falls * (sum(below) / len(below) if below else 0)
    return {n for n in own if all(own[k] < main_text.MIN_IMPORTANCE for k, chain in above.items() if n in chain and k in own)}, own


def test_style_trees_by_brute_force(spark, sf_dir):
    rows = site(12) + site(4, "small.example") + [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()] + [(1, None, PLAIN.format(body="x"))] * 6
    tree = main_text.style_tree(spark.createDataFrame(rows, SCHEMA).repartition(4)).cache()
    noisy, own = brute_noise(rows)
    found = {r["node"]: r["importance"] for r in main_text.importance(tree).collect()}
    assert found.keys() == own.keys() and all(found[k] == pytest.approx(own[k], abs=1e-9) for k in own)
    assert {r["node"] for r in main_text.noisy_nodes(tree).collect()} == noisy and noisy


def test_sites_that_declare_nothing(spark):
    rows = site(12) + [(100 + k, u, h) for k, u, h in site(4, "small.example")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["page_id"]: r["text"] for r in main_text.main_text_report(df).collect()}
    for k in range(12):
        assert found[k] == f"Story {'abcdefghij'[k % 10]}{k}\nBody of {k} in word{k * 7} and so on"
    # four pages say too little: nothing is taken from them
    assert found[101].startswith("Our site since 1999\n") and found[101].endswith("All rights reserved")
    joined = {r["page_id"]: r["text"] for r in main_text.with_main_text(df, broadcast_nodes=-1).collect()}
    assert joined == found


def test_copies_of_an_article_stay(spark):
    page = ARTICLE.format(before="<div>Bar</div>", body="<p>The same on every page</p>", after="")
    df = spark.createDataFrame([(k, f"http://copies.example/{k}", page) for k in range(9)], SCHEMA)
    assert {r["text"] for r in main_text.main_text_report(df).collect()} == {"Head & line\nThe same on every page"}


def test_odd_pages(spark):
    rows = [(1, None, None), (None, None, "<p>no id"), (2, "not a url", ""), (3, "http://[bad", "<p>x"), (4, "http://a.example/", "🙂 <p>é ü".encode("utf-16", "surrogatepass").decode("utf-16")), (4, "http://a.example/", "<p>x"), (4, "http://a.example/", "<p>x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("text", "row", "node", "nodes", "key", "n", "kind")})
    found = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in main_text.main_text_report(df).collect()), key=repr)
    assert found == sorted([(1, "", 0), (None, "no id", 5), (2, "", 0), (3, "x", 1), (4, "🙂\né ü", 5), (4, "x", 1), (4, "x", 1)], key=repr)
    for limit in (main_text.BROADCAST_NODES, -1):
        whole = main_text.with_main_text(df, broadcast_nodes=limit)
        assert set(whole.columns) == set(df.columns) and whole.where("node = 'own'").count() == 7
    none = main_text.main_text_report(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["page_id", "url", "text", "n_chars"] and not none.count()
