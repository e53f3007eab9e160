"""Operator 6: main text of web pages, with site templates removed.

A page is parsed into elements, and every block element of the whole page, its
articles included, is hashed with its subtree (tags, classes and text). Spark
counts for each host the different contents that hold a hash: copies of a page or
of an article are one content, so that they aren't template. Subtrees outside
articles that at least ``PAGES`` contents of the host hold are deleted, however
much of the page they are. Below an article those are deleted that at least
``PAGES`` articles of the host hold and at least ``SHARE`` of all its articles, so
that a passage that some articles share stays. What is left of the article
(``<article>``, else ``<main>``), or of the body where there is none, is the text:
character references decoded, white space inside a block one space, blocks joined
by one space in page order.

What a site shows once can't be told by counting. Such menus, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments go by tag and role,
and outside articles by words of their class or id. Inside an article a class only
counts if one of its names as a whole is in ``NAMED``: what else stands in an
article (``class="side-effects"``, a label, a pull quote) is its text.

Shape: one pass parses a page and writes its text and the hashes; counts are
aggregated per (host, hash) before the shuffle, so a host with a third of all pages
is no hot task. Only pages that hold a template where their text is taken from are
parsed again; they are looked up by their key, broadcast while there are at most
``AGAIN`` of them. A task holds one page.

Defined cases: null or empty html gives an empty text; null url is the host ""; rows that
share a page_id are told apart by their html; broken markup is closed at the end
of its parent; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, sized_broadcast, table

PAGES, SHARE = 8, 0.1
#: Largest number of pages with templates that are looked up by a broadcast.
AGAIN = 100_000
#: Elements without content, elements that aren't text, elements that stand outside the main text, blocks, and elements that a new one of their kind closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video form button select option textarea input title datalist".split())
APART = frozenset("nav footer dialog menu".split())
BLOCK = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Class names and ids that name what isn't main text wherever they stand; words that do so outside an article, as a part of a name; those that do so only as a whole name; and roles.
NAMED = frozenset("ad ads advert advertisement advertising adsense sponsored sidebar breadcrumb breadcrumbs pagination comments comment-list disqus newsletter cookie-notice cookie-banner share-buttons social-share related-posts".split())
PARTS = frozenset("ad ads advert advertisement advertising adsense banner sponsor sponsored promo cookie cookies consent gdpr popup modal navbar nav navigation menu breadcrumb breadcrumbs sidebar comments disqus footer header masthead toolbar pagination pager newsletter signup login".split())
WHOLE = frozenset("promotion notice alert overlay side rail widget related recommended share sharing social comment respond replies subscribe skip copyright".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    __slots__ = ("tag", "parts", "attrs")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.parts = tag, attrs, []


class _Tree(HTMLParser):
    """Elements and texts of a page; an end tag without its start tag is left out, what is open at the end is closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        close = CLOSES.get(tag)
        if close:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in close:
                    del self.open[k:]
                    break
                if self.open[k].tag in BLOCK and self.open[k].tag not in ("td", "th"):
                    break
        node = Node(tag, {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break
            if self.open[k].tag in ("article", "main", "body") and tag not in ("html", "body", "article", "main"):
                break

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def unwanted(node: Node, within: bool) -> bool:
    """Whether tag, role, class or id say that the element isn't main text. within: it lies in the article, whose own header and asides are kept."""
    if node.tag in SILENT or node.tag in APART or node.tag in ("header", "aside") and not within:
        return True
    a = node.attrs
    if not a or node.tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES:
        return True
    names = [x for key in ("class", "id") for x in a.get(key, "").lower().split()]
    if any(x in NAMED for x in names):
        return True
    return not within and any(x in WHOLE or any(part in PARTS for part in _SPLIT.split(x)) for x in names)


def articles(root: Node) -> list[Node]:
    """The outermost <article> elements, else the outermost <main> elements, outside what is unwanted."""
    for tag in ("article", "main"):
        found: list[Node] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == tag:
                found.append(node)
            elif node is root or not unwanted(node, False):
                todo += [x for x in reversed(node.parts) if isinstance(x, Node)]
        if found:
            return found
    return []


def walk(node: Node) -> Iterator[tuple[str, object]]:
    """("open", node), ("text", str) and ("close", node) in page order, without recursion: nesting may be deep."""
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield "text", x
        elif isinstance(x, tuple):
            yield "close", x[0]
        else:
            yield "open", x
            todo.append((x,))
            todo += reversed(x.parts)


def subtree_hashes(root: Node, found: list[Node]) -> tuple[dict[int, int], dict[int, int], int, int]:
    """Hashes of the block elements below the articles ``found`` and of the others, by id of the node; elements without text have none. Then the hashes of the articles' content and of the page's."""
    at = {id(x) for x in found}
    inside: dict[int, int] = {}
    outside: dict[int, int] = {}
    content: list[int] = []
    h = 0
    stack: list[list] = []
    skip = depth = 0
    for what, x in walk(root):
        if skip:
            skip += (what == "open") - (what == "close")
        elif what == "open":
            if x.tag in SILENT:
                skip = 1
            else:
                depth += id(x) in at
                stack.append([x.tag, " ".join(sorted(x.attrs.get("class", "").split())), False])
        elif what == "text":
            words = " ".join(x.split())
            if words:
                stack[-1].append(words)
                for s in stack:
                    s[2] = True
        else:
            own = stack.pop()
            h = _hash(own)
            if stack:
                stack[-1].append(h)
            if id(x) in at:
                depth -= 1
                content.append(h)
            elif own[2] and x.tag in BLOCK and x.tag not in ("html", "body", "br", "hr"):
                (inside if depth else outside)[id(x)] = h
    return inside, outside, _hash(content), h


def _hash(x: list) -> int:
    return int.from_bytes(hashlib.blake2b(repr(x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _words(nodes: list[Node], gone: set[int], within: bool) -> str:
    blocks: list[list[str]] = [[]]
    skip = 0
    for node in nodes:
        blocks.append([])
        for what, x in walk(node):
            if skip:
                skip += (what == "open") - (what == "close")
            elif what == "text":
                blocks[-1].append(x)
            elif what == "open" and (id(x) in gone or unwanted(x, within) and x is not node):
                skip = 1
                if x.tag in BLOCK:
                    blocks.append([])
            elif x.tag in BLOCK:
                blocks.append([])
    return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def main_text(html: str | None, repeated: set[int] = frozenset()) -> str:
    """The main text; repeated: hashes of subtrees that are template of the page's host."""
    if not html:
        return ""
    root = parse(html)
    found = articles(root)
    hashes = subtree_hashes(root, found)[0 if found else 1] if repeated else {}
    return _words(found or [root], {k for k, h in hashes.items() if h in repeated}, bool(found))


def _keyed(pages: DataFrame) -> DataFrame:
    key = F.xxhash64(F.coalesce("html", F.lit("")))
    return pages.select("page_id", "url", "html", key.alias("pk"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host"))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, pk, host, text (no template removed yet), article (whether the text is taken from one), page and content (hashes that tell different pages and articles apart; null: none), outside and inside (distinct hashes of the subtrees)."""
    schema = pa.schema([("text", pa.string()), ("article", pa.bool_()), ("page", pa.int64()), ("content", pa.int64()), ("outside", pa.list_(pa.int64())), ("inside", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = []
        for html in batch.column("html"):
            html = html.as_py()
            if not html:
                made.append(("", False, None, None, [], []))
                continue
            root = parse(html)
            found = articles(root)
            inside, outside, content, whole = subtree_hashes(root, found)
            made.append((_words(found or [root], frozenset(), bool(found)), bool(found), whole, content if found else None, list(set(outside.values())), list(set(inside.values()))))
        columns = [batch.column(c) for c in ("page_id", "url", "pk", "host")]
        yield pa.RecordBatch.from_arrays(columns + [pa.array([m[k] for m in made], f.type) for k, f in enumerate(schema)], ["page_id", "url", "pk", "host", *schema.names])

    rows = _keyed(pages)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return map_arrow(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, pk long, host string, text string, article boolean, page long, content long, outside array<long>, inside array<long>")


def held(done: DataFrame) -> DataFrame:
    """host, inside, hash, content: which contents of a host hold a subtree; one row with hash null for each article."""
    outer = done.select("host", F.lit(False).alias("inside"), F.explode("outside").alias("hash"), F.col("page").alias("content"))
    inner = done.where("article").select("host", F.lit(True).alias("inside"), F.explode(F.concat("inside", F.array(F.lit(None).cast("long")))).alias("hash"), "content")
    return outer.unionByName(inner)


def templates(rows: DataFrame, least: int = PAGES) -> DataFrame:
    """host, inside and hash of the subtrees that are template of the host, from ``held``."""
    counted = rows.distinct().groupBy("host", "inside", "hash").agg(F.count("*").alias("n"))
    counted = counted.where((F.col("n") >= least) | F.col("hash").isNull())
    articles_of = counted.where("inside and hash is null").select(F.col("host").alias("h"), F.col("n").alias("articles"))
    often = counted.where(F.col("hash").isNotNull())
    return often.join(articles_of, F.col("host") == F.col("h"), "left").where(~F.col("inside") | (F.col("n") >= SHARE * F.col("articles"))).select("host", "inside", "hash")


def extract(pages: DataFrame, least: int = PAGES) -> DataFrame:
    """page_id, url, text of every page."""
    done = cut(parsed(pages), "pages-parsed")
    template = cut(templates(held(done), least), "templates")
    own = done.select("page_id", "pk", "host", F.col("article").alias("inside"), F.explode(F.when(F.col("article"), F.col("inside")).otherwise(F.col("outside"))).alias("hash"))
    hit = cut(own.join(template, ["host", "inside", "hash"]).groupBy("page_id", "pk").agg(F.collect_set("hash").alias("repeated")), "template-pages").withColumnsRenamed({"page_id": "r_id", "pk": "r_key"})
    few = hit.count()
    hit = sized_broadcast(hit, few, AGAIN)
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("pk") == F.col("r_key"))
    clean = done.select("page_id", "url", "pk", "text")
    if not few:
        return clean.drop("pk")

    def again(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = [main_text(x.as_py(), set(y)) for x, y in zip(batch.column("html"), batch.column("repeated").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    with_html = _keyed(pages).join(hit, same).select("page_id", "url", "html", "repeated")
    changed = map_arrow(with_html, again, clean.drop("pk").schema)
    return clean.join(hit, same, "left_anti").drop("pk").unionByName(changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
