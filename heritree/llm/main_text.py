"""HTML extraction by site style trees: the text of pages without what their sites repeat around it.

The pages of a host are merged into one tree: a node is a place (tags, classes and ids from the page's top down), its
styles are the sequences of elements that stand in it, its features the texts that stand directly in it.
A node's importance is (1 - g^s) of its presentation's, the entropy of its s styles over its pages, and g^s of its
content's, the mean over all texts below it of 1 - H, where H is the entropy of the text's occurrences over the pages
(both to the base of the number of pages): texts that are everywhere weigh nothing, texts of one page one. A node is noisy
if it and all nodes below it are of low importance; noisy branches are removed from each page. A place that fewer than
MIN_PAGES pages have says nothing.

Sites with one page, and branches that vary without being text (menus, adverts), are judged by what markup declares
(see `pages`): tags, and words in class, id or role. Those branches go; a declared article is the whole of the text.

Pages are read twice: once for rows of (node, what, value), which are summed by key and never gathered by host, so a host
with a third of all pages is as good as any; then for the text. The noisy nodes' keys go to the tasks if they are few;
beyond `broadcast_nodes`, pages meet theirs in a join.

Defined results: null html and html without text give an empty text; a null url, or one without a host, is a site of
its own page; equal rows are separate rows; other columns are kept by `with_main_text` but for those that it adds; an
empty table gives no rows. Character references are decoded, white space in a block becomes one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, stored_rows
from .pages import Block, Element, digest, main_blocks, read

MIN_PAGES, MIN_IMPORTANCE, G = 5, 0.3, 0.9
BROADCAST_NODES = 1 << 21  # 16 MB of keys
STYLE, TEXT, ABOVE = 0, 1, 2
_KNOWN = 1 << 18  # nodes whose ancestors a task remembers to have told


def host(url: str | None) -> str:
    """The site of a url: its host in lower case; empty where there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _site(url: str | None, page: str | None) -> str:
    return host(url) or f"\0{digest(url, page)}"


def features(elements: list[Element], blocks: list[Block]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """A page's styles (node, style) and texts (node, text) with how often they occur."""
    styles: dict[tuple[int, int], int] = {}
    texts: dict[tuple[int, int], int] = {}
    for e in elements:
        k = (e.key, digest(*e.names))
        styles[k] = styles.get(k, 0) + 1
    for b in blocks:
        k = (b.at.key, digest(b.text))
        texts[k] = texts.get(k, 0) + 1
    return styles, texts


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """node, kind, value, pages, n, log_n: for each style and text of a node the pages that have it, its occurrences and sum of n ln n over the pages; for each node the nodes above it (kind ABOVE)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            for u, h in zip(b.column("url"), b.column("html")):
                elements, blocks = read(page := h.as_py(), _site(u.as_py(), page))
                styles, texts = features(elements, blocks)
                rows += [(node, STYLE, v, n) for (node, v), n in styles.items()] + [(node, TEXT, v, n) for (node, v), n in texts.items()]
                for e in elements:
                    if e.key not in told:
                        told.add(e.key)
                        rows += [(e.key, ABOVE, a.key, 1) for a in e.chain()]
            if len(told) > _KNOWN:
                told.clear()
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "kind", "value", "n"])

    rows = pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, "node long, kind long, value long, n long")
    return rows.groupBy("node", "kind", "value").agg(F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("log_n"))


def importance(tree: DataFrame) -> DataFrame:
    """node, importance of the nodes that MIN_PAGES pages have, by the tree's rows."""
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    text_entropy = F.greatest(F.lit(0.0), F.log("n") - F.col("log_n") / F.col("n"))
    nodes = tree.where(F.col("kind") != ABOVE).groupBy("node").agg(
        of(STYLE, F.col("pages")).alias("m"), of(STYLE, F.lit(1)).alias("styles"), of(STYLE, F.col("pages") * F.log("pages")).alias("p_log_p"),
        F.coalesce(of(TEXT, F.lit(1)), F.lit(0)).alias("texts"), F.coalesce(of(TEXT, text_entropy), F.lit(0.0)).alias("entropy"),
    )
    log_m = F.log("m")
    own = nodes.where("m > 1").select("node", "m", "styles", "texts", F.greatest(F.lit(0.0), (log_m - F.col("p_log_p") / F.col("m")) / log_m).alias("presentation"), (F.col("texts") - F.col("entropy") / log_m).alias("content"))
    # texts of nodes that one page has are that page's own
    alone = nodes.where("m = 1").select("node", "m", "styles", "texts", F.lit(1.0).alias("presentation"), F.col("texts").cast("double").alias("content"))
    above = tree.where(F.col("kind") == ABOVE).select("node", F.col("value").alias("above"))
    below = own.unionByName(alone).join(above, "node").groupBy("above").agg(F.sum("texts").alias("texts"), F.sum("content").alias("content"))
    falls = F.pow(F.lit(G), "styles")
    content = F.when(F.col("texts") > 0, F.col("content") / F.col("texts")).otherwise(0.0)
    joined = own.where(F.col("m") >= MIN_PAGES).drop("texts", "content").join(below, F.col("node") == F.col("above"))
    return joined.select("node", ((1 - falls) * F.col("presentation") + falls * content).alias("importance"))


def noisy_nodes(tree: DataFrame, least: float = MIN_IMPORTANCE) -> DataFrame:
    """node: those that are, with all nodes below them, of less importance."""
    above = tree.where(F.col("kind") == ABOVE).select("node", F.col("value").alias("above"))
    weighed = above.join(importance(tree), "node", "left")
    # a node below that few pages have says nothing against its place
    most = weighed.groupBy("above").agg(F.max("importance").alias("most"), F.max(F.when(F.col("node") == F.col("above"), F.col("importance"))).alias("own"))
    return most.where((F.col("own") < least) & (F.col("most") < least)).select(F.col("above").alias("node"))


def text_of(url: str | None, page: str | None, noisy) -> str:
    return "\n".join(main_blocks(*read(page, _site(url, page)), noisy))


def with_main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """pages with `out`, the text of the page's own content."""
    tree = stored(style_tree(pages, url, html), "style-tree")
    noisy, n = stored_rows(noisy_nodes(tree), "noisy-nodes")
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    rows = pages.select(row, F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    if n <= broadcast_nodes:
        keys = np.array(sorted(r["node"] for r in noisy.collect()), dtype=np.int64)  # n longs
        rows = rows.withColumn("nodes", F.lit(None).cast("array<long>"))
    else:
        keys = np.zeros(0, np.int64)
        rows = _with_nodes(rows, noisy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = frozenset(keys.tolist())
        for b in batches:
            texts = [text_of(u.as_py(), h.as_py(), few if (k := nodes.as_py()) is None else frozenset(k)) for u, h, nodes in zip(b.column("url"), b.column("html"), b.column("nodes"))]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return done.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c != out], F.col("text").alias(out))


def _with_nodes(rows: DataFrame, noisy: DataFrame) -> DataFrame:
    """rows with `nodes`, the noisy ones of each page: equal pages ask once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for key, u, h in zip(b.column("key"), b.column("url").to_pylist(), b.column("html").to_pylist()):
                found += [(key.as_py(), node) for node in {e.key for e in read(h, _site(u, h))[0]}]
            keys, nodes = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(nodes, pa.int64())], names=["key", "node"])

    keyed = rows.withColumn("key", F.unhex(F.sha2(F.to_json(F.struct("url", "html")), 256)))
    seen = keyed.select("key", "url", "html").mapInArrow(run, "key binary, node long").join(noisy, "node").groupBy("key").agg(F.collect_set("node").alias("nodes"))
    return keyed.join(seen, "key", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<long>"))).drop("key")


def main_text_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    done = with_main_text(pages.select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
