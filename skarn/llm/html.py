"""Main text of web pages: site templates found by recurring element subtrees, and what markup itself names.

Each page is parsed to a tree and every element subtree with text is hashed. Spark
counts on how many different pages of a host each hash occurs. Subtrees that recur
on many pages of their host are deleted from the whole page, wherever they stand;
for parts that change from page to page, elements that name themselves (nav, footer,
forms, classes like "ad" or "comments") go too. Pages that share their longest blocks
are copies and count once. Headings and text blocks of articles and main elements stay
even if they recur, as a passage is not a template. On hosts with too few pages to count,
the text is that of all articles and main elements, if there are any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html tbody tfoot thead tr caption legend dd dt li".split()) | frozenset(["li", "dd", "dt"])
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr table figcaption caption ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_TEXT = frozenset(
    "head script style noscript template svg math iframe object embed canvas audio video form button select option textarea input title "
    "nav footer aside menu dialog search xmp noembed noframes datalist map".split()
)
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended recommendations comment "
    "comments commentlist reply replies respond disqus widget widgets pagination pager skip".split()
)
#: Opening one of these ends an open one of the listed, up to the given boundary.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
TAG = re.compile(r"""<(?:!--(?:.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|[!?/][^>]*>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "hash", "article", "length")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children, self.hash, self.article, self.length = tag, attrs, [], 0, False, 0


def parse(html: str) -> Node:
    """A tree of elements and texts. Missing and stray end tags are mended as browsers do in the common cases."""
    root = Node("#root")
    stack = [root]
    at, low = 0, None
    while True:
        m = TAG.search(html, at)
        if m is None:
            if at < len(html):
                stack[-1].children.append(unescape(html[at:]))
            return root
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "table", "body") and tag not in BLOCK:
                    break
            continue
        ends, until = ENDS.get(tag, ((), ()))
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].tag
            if name in ends or (name == "p" and tag in CLOSES_P):
                del stack[k:]
                if name == "p":
                    break
            elif name in until or name in ("table", "button", "body", "article"):
                break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in VOID or (m[3].endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            if low is None:
                low = html.lower()
                if len(low) != len(html):  # a letter whose lower case is longer
                    low = re.sub(r"[A-Z]", lambda x: x[0].lower(), html)
            end = low.find("</" + tag, at)
            at = len(html) if end < 0 else end
            continue
        stack.append(node)


def post_order(root: Node) -> list[Node]:
    """Children before parents, without recursion, as trees can be very deep."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if type(c) is Node]
    out.reverse()
    return out


def measure(root: Node) -> list[Node]:
    """Sets each node's hash over tag, texts and children's hashes, its text length, and whether it holds an article."""
    nodes = post_order(root)
    for node in nodes:
        h = xxhash.xxh3_64(node.tag.encode("utf-8", "replace"))
        node.article = node.tag in ("article", "main", "body", "html", "#root")
        for c in node.children:
            if type(c) is Node:
                h.update(c.hash.to_bytes(8, "little"))
                node.length += c.length
                node.article |= c.article
            elif text := " ".join(c.split()):
                h.update(b"\1" + text.encode("utf-8", "surrogatepass"))
                node.length += len(text)
        node.hash = h.intdigest()
    return nodes


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attrs)} if node.attrs.strip() else {}


def names_itself(node: Node, inside: bool) -> bool:
    """Whether the element says that it is no part of the article."""
    if node.tag in NOT_TEXT:
        return True
    if node.tag == "header":
        return not inside
    if not node.attrs or node.tag in ("html", "body", "#root", "article", "main"):
        return False
    a = attributes(node)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if a.get("role", "").lower() in NOT_TEXT_ROLES:
        return True
    words = {w for k in ("class", "id") for w in WORD.findall(a.get(k, "").lower())}
    if not words & NOT_TEXT_WORDS:
        return False
    return not any(c.tag == "h1" for c in post_order(node)) if "header" in words or "masthead" in words else True


def main_roots(root: Node) -> list[Node]:
    """The outermost articles and main elements in page order; those within comments and the like don't count."""
    found = []
    todo = [root]
    while todo:
        node = todo.pop()
        if names_itself(node, False):
            continue
        if node.tag in ("article", "main") or "main" in node.attrs and attributes(node).get("role") == "main":
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if type(c) is Node]
    return found


def candidates(root: Node) -> tuple[set[int], list[int]]:
    """Hashes of the subtrees that could be a template's (blocks with text that hold no article, or are one), and of the blocks without blocks, longest first."""
    found, leaves = set(), {}
    holds = set()
    for n in measure(root):
        block = n.length and (n.tag in BLOCK or n.tag == "#root")
        inner = any(type(c) is Node and id(c) in holds for c in n.children)
        if block and (not n.article or n.tag == "article"):
            found.add(n.hash)
            if not inner:
                leaves[n.hash] = n.length
        if block or inner:
            holds.add(id(n))
    return found, sorted(leaves, key=lambda h: (-leaves[h], h))


def extract(html: str, templates: set[int] | frozenset[int], counted: bool | None = None) -> str:
    """Blocks in page order, one a line, of what neither recurs on the site nor names itself as something else.

    ``counted`` says whether the site has enough pages for its counts to decide;
    else only articles and main elements are read, if there are any.
    """
    root = parse(html)
    measure(root)
    tops = main_roots(root)
    own = {id(t) for t in tops if t.hash not in templates} or {id(t) for t in tops}
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    counted = bool(templates) if counted is None else counted
    todo: list[object] = [(t, None) for t in ([root] if counted or not tops else reversed(tops))]
    while todo:
        x = todo.pop()
        if type(x) is str:
            line.append(x)
        elif x is None:
            end_block()
        elif x is True:
            line.append(" ")
        else:
            x, top = x
            if id(x) in own:
                top = x
            elif x is not root:
                kept = top is not None and (x.tag in TEXT_BLOCKS or 2 * x.length >= top.length)
                if x.hash in templates and not kept and (not x.article or x.tag == "article") or names_itself(x, top is not None):
                    continue
            if x.tag == "br":
                end_block()
                continue
            if x.tag in ("td", "th"):
                todo.append(True)
            if x.tag in BLOCK:
                end_block()
                todo.append(None)
            todo += [c if type(c) is str else (c, top) for c in reversed(x.children)]
    end_block()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def site_templates(pages: DataFrame, scratch: Scratch, min_pages: int = 3, share: float = 0.02) -> DataFrame:
    """(page_id, templates): for each page of a host with enough pages the hashes of its subtrees that recur there.

    A subtree recurs if at least ``min_pages`` and ``share`` of its host's different
    pages hold it. Pages are the same if their whole trees are, or the two longest
    blocks of those that fewer than half of the host's pages hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            hosts, whole, lists, leaves = [], [], [], []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                root = parse(html or "")
                found, longest = candidates(root)
                hosts.append(host_of(url))
                whole.append(root.hash - (1 << 63))
                lists.append([h - (1 << 63) for h in found])
                leaves.append([h - (1 << 63) for h in longest])
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(lists, ints), pa.array(leaves, ints)],
                names=["page_id", "host", "whole", "hashes", "leaves"],
            )

    rows = scratch.write(pages.mapInArrow(run, "page_id long, host string, whole long, hashes array<long>, leaves array<long>"), "subtrees")
    first = rows.groupBy("host", "whole").agg(F.min_by(F.struct("hashes", "leaves"), F.coalesce("page_id", F.lit(-1))).alias("p")).select("host", "whole", "p.*")
    first = scratch.write(first, "different")
    total = scratch.write(first.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    each = first.select("host", "whole", F.posexplode("leaves").alias("at", "h"))
    common = each.groupBy("host", "h").agg(F.count("*").alias("n")).where("n >= 2").join(total, "host").where("2 * n >= pages").select("host", "h")
    longest = each.join(common, ["host", "h"], "left_anti").groupBy("host", "whole").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "h"))), 1, 2)["h"].alias("two"))
    same = longest.select("host", "whole", F.xxhash64("two").alias("copy"))
    named = scratch.write(first.join(same, ["host", "whole"], "left").select("host", F.coalesce("copy", "whole").alias("copy"), "hashes"), "copies")
    total = named.groupBy("host").agg(F.count_distinct("copy").alias("pages")).where(F.col("pages") >= min_pages)
    # a copy's own pages are counted once for each subtree
    counts = named.select("host", "copy", F.explode("hashes").alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    found = counts.join(total, "host").where(F.col("n") >= share * F.col("pages")).select("host", "h")
    found = scratch.write(found, "templates")
    marks = rows.select("page_id", "host", F.explode("hashes").alias("h")).join(found, ["host", "h"]).groupBy("page_id").agg(F.collect_set("h").alias("templates"))
    counted = rows.join(total, "host", "left_semi").select("page_id").distinct()
    return counted.join(marks.withColumnRenamed("page_id", "_id"), F.col("page_id").eqNullSafe(F.col("_id")), "left").select(
        "page_id", F.coalesce("templates", F.array().cast("array<bigint>")).alias("templates")
    )


def main_text(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    Null and empty pages give an empty text; a null url is a host of its own name;
    repeated rows give repeated results; rows with equal ids share what recurs.
    Other columns aren't read. Pages travel compressed to where their ids meet.
    """
    own = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    scratch = Scratch(pages.sparkSession, "html")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, 256):
            packed = [z.compress((h or "").encode("utf-8", "surrogatepass")) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["page_id", "url", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in slices(batches, 256):
            texts = []
            for packed, hashes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append(extract(z.decompress(packed).decode("utf-8", "surrogatepass"), frozenset(h + (1 << 63) for h in hashes or ()), hashes is not None))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    sent = own.mapInArrow(shrink, "page_id long, url string, packed binary")
    marks = site_templates(own, scratch).withColumnRenamed("page_id", "_page")
    both = sent.join(marks, sent["page_id"].eqNullSafe(marks["_page"]), "left").select("page_id", "url", "packed", "templates")
    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return main_text(table(spark, sf_dir, "pages"))
