"""HTML extraction: main text of pages, with removal of a site's templates.

A page becomes a tree of elements (the tag rules a browser uses for unclosed
paragraphs and list items). Every block element is hashed with all below it.
Spark counts, for each host, in how many distinct pages a subtree occurs;
subtrees in more than ``MAX_PAGES`` pages of a host are deleted. Pages that are
copies of each other count once (a page is the hash of its whole tree), so an
article copied over a site is no template. Elements whose role is plain
(menus, headers, footers, asides, forms, scripts, adverts, notices, reader
comments) are deleted on any page: by their tag or role, or by a class or id
that is one of these words or a usual compound of them as a whole (a wrapper
of class ``has-sidebar`` or ``nav-open`` is none). If the page names its
article, the text is taken from there, also from inside an element that would
be deleted by its class, if there is no other; paragraphs and headings inside
it are never templates.

Hashes are counted in two levels (host, hash and page, then host and hash), so
a host with a third of all pages is no hot key. The templates are sent to tasks
once, 8 bytes each, while they are at most ``HASHES_SENT``, and then no html is
shuffled. Beyond that, a host is dealt to shares of some ``PAGES_A_SHARE``
pages; a task reads a share's hashes (8 bytes each), then its pages.

Defined cases: null html or a page without text gives the empty string. White
space is what Unicode says. A null or odd url has the empty host. Every row
gives one row; an empty table gives an empty one. A page of any length is read
whole. Columns of the caller are carried, whatever their names; ``text`` and
``n_chars`` are replaced, ``html`` goes.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telarium.llm.common import cut, row_of, unpacked
from telarium.llm.url_filter import with_host_and_path

MAX_PAGES = 20
#: 8 bytes each.
HASHES_SENT, PAGES_A_SHARE = 2_000_000, 5_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|textarea|iframe|noembed|noframes|xmp)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul br".split())
_DROP = frozenset("head title nav aside footer form menu dialog button select option datalist fieldset input label search script style noscript template textarea iframe svg math object audio video canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Classes and ids that say what is deleted, each as a whole.
_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar menu navbar navigation nav breadcrumb breadcrumbs footer comments disqus replies share sharing social related recommended newsletter subscribe popup modal overlay widget widgets toolbar pagination pager".split())
_OUTSIDE = frozenset("header masthead".split())
_FIRST = "ad ads advert banner cookie cookies consent site page global main primary secondary top bottom left right nav sub reader user comment comments related social share sharing newsletter sidebar footer".split()
_LAST = "ad ads advert banner slot unit box bar notice notices sidebar menu nav navbar navigation footer comments list section form posts articles stories links buttons icons signup popup modal overlay widget widgets block".split()
#: Compounds as sites write them: the first word says what it is, or the last does.
_COMPOUND = re.compile(rf"(?:ads?|advert|banner|cookies?|consent|comments?|related|social|shar(?:e|ing)|newsletter)[-_](?:{'|'.join(_LAST)})|(?:{'|'.join(_FIRST)})[-_](?:ads?|advert|banner|notices?|sidebar|menu|nav|navbar|navigation|footer|comments)")
_COMPOUND_OUTSIDE = re.compile("(?:site|page|global|top|main)[-_](?:header|masthead)")
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "title", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
_FOREIGN = frozenset(("svg", "math"))
#: Tags that end an open drawing or formula, and elements inside one that hold HTML again.
_ENDS_FOREIGN = frozenset("article aside b big blockquote body br center code dd div dl dt em embed footer h1 h2 h3 h4 h5 h6 head header hr i img li listing main menu meta nav nobr ol p pre ruby s section small span strike strong sub sup table tt u ul var".split())
_HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_MAIN = frozenset(("article", "main"))
_ROOTS = frozenset(("html", "body", "article", "main", "#root"))


class Node:
    __slots__ = ("tag", "children", "drop", "block")

    def __init__(self, tag: str, drop: str = ""):
        self.tag, self.drop, self.block, self.children = tag, drop, tag in _BLOCK, []


def _named(value: str, in_main: bool) -> bool:
    """Whether a class or id attribute holds a word, whole, for what is deleted; an article has headers of its own."""
    return any(w in _WORDS or _COMPOUND.fullmatch(w) or not in_main and (w in _OUTSIDE or _COMPOUND_OUTSIDE.fullmatch(w)) for w in value.lower().split())


def _dropped(tag: str, attrs: str, in_main: bool) -> str:
    """Why an element is deleted; empty if it stays."""
    if tag in _DROP or (tag == "header" and not in_main):
        return "form" if tag in ("form", "fieldset") else "tag"
    if tag in _ROOTS or not attrs.strip():
        return ""
    why = ""
    for name, *values in _ATTR.findall(attrs):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return "hidden"
        if name == "role" and value.lower() in _ROLES or name in ("class", "id") and _named(value, in_main):
            why = "name"
    return why


def _unclosed(nodes: list[Node]) -> None:
    """An object without an end tag holds what follows it in its parent, which stays."""
    for node in nodes:
        if node.tag == "object":
            node.drop = ""


def parse(page: str) -> Node:
    root = Node("#root")
    stack, at, in_main, foreign = [root], 0, 0, False
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    in_main -= sum(x.tag in _MAIN for x in stack[i:])
                    _unclosed(stack[i + 1 :])
                    del stack[i:]
                    break
                if stack[i].tag in _MAIN and tag not in _ROOTS:
                    break
            continue
        if foreign and tag in _ENDS_FOREIGN:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _FOREIGN:
                    in_main -= sum(x.tag in _MAIN for x in stack[i:])
                    del stack[i:]
                    foreign = any(x.tag in _FOREIGN for x in stack)
                    break
                if stack[i].tag in _HTML_AGAIN:
                    break
        close = None
        for i in range(len(stack) - 1, 0, -1):
            open_tag = stack[i].tag
            if open_tag in _SAME.get(tag, ()) or open_tag == "p" and tag in _CLOSES_P:
                close = i
                break
            if open_tag in _STOPS.get(tag, ()) or open_tag in _ROOTS or open_tag in ("table", "td", "div") and tag not in _STOPS:
                break
        if close is not None:
            _unclosed(stack[close + 1 :])
            del stack[close:]
        node = Node(tag, _dropped(tag, m["attrs"], in_main > 0))
        stack[-1].children.append(node)
        if tag not in _VOID and not m["attrs"].rstrip().endswith("/"):
            stack.append(node)
            in_main += tag in _MAIN
            foreign = foreign or tag in _FOREIGN
    if at < len(page):
        stack[-1].children.append(html.unescape(page[at:]))
    _unclosed(stack)
    return root


def _walk(root: Node, hashes: dict[int, int]) -> int:
    """Hash of every block element with what is below it; no recursion, so depth is free. Gives the whole tree's."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    digests: dict[int, bytes] = {}
    for node in reversed(order):
        h = hashlib.blake2b(node.tag.encode(), digest_size=8)
        for c in node.children:
            h.update(digests[id(c)] if isinstance(c, Node) else " ".join(c.split()).encode("utf-8", "surrogatepass"))
        digests[id(node)] = h.digest()
        if node.block and node.tag not in _ROOTS and node.tag != "br":
            hashes[id(node)] = int.from_bytes(digests[id(node)], "little", signed=True)
    return int.from_bytes(digests[id(root)], "little", signed=True)


def subtree_hashes(page: str) -> tuple[int, list[int]]:
    """Hash of the whole page, which only copies share, and those of its subtrees."""
    hashes: dict[int, int] = {}
    whole = _walk(parse(page), hashes)
    return whole, sorted(set(hashes.values()))


def _mains(root: Node, through: tuple[str, ...] = ()) -> list[Node]:
    """The outermost named articles, in page order; ``through``: reasons to delete that don't count."""
    found: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.drop and node.drop not in through:
            continue
        if node.tag in _MAIN:
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def _recurring(root: Node, template: set[int] | np.ndarray) -> set[int]:
    """Ids of the block elements whose hashes are in ``template`` (a set, or a sorted array)."""
    if not len(template):
        return set()
    hashes: dict[int, int] = {}
    _walk(root, hashes)
    if isinstance(template, set):
        return {k for k, h in hashes.items() if h in template}
    values = np.fromiter(hashes.values(), np.int64, len(hashes))
    at = np.minimum(np.searchsorted(template, values), len(template) - 1)
    return {k for k, met in zip(hashes, (template[at] == values).tolist(), strict=True) if met}


def main_text(page: str, template: set[int] | np.ndarray) -> str:
    root = parse(page)
    recurs = _recurring(root, template)
    mains = _mains(root) or _mains(root, ("name", "form"))
    parts: list[str] = []
    for top in mains or [root]:
        todo: list = [top]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                parts.append(item)
                continue
            if item.drop and item is not top or id(item) in recurs and not (mains and item.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th")):
                parts.append(" ")
                continue
            if item.block:
                parts.append(" ")
                todo.append(" ")
            todo += reversed(item.children)
    return " ".join("".join(parts).split())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            hosts, page, hashes = [], [], []
            for host, text in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                whole, found = subtree_hashes(text or "")
                hosts += [host] * len(found)
                page += [whole] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(page, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "page", "hash"])


def templates(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(host, hash): subtrees in more than ``max_pages`` distinct pages of a host.

    There are at most as many as the pages' elements over ``max_pages``; sites
    have a few dozen.
    """
    rows = with_host_and_path(pages.select("url", F.col("html").cast("string").alias("html"))).select("host", "html")
    each = rows.mapInArrow(_pieces, "host string, page long, hash long")
    counts = each.groupBy("host", "hash", "page").agg(F.lit(1).alias("one")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > max_pages).select("host", "hash")


def _sorted_lists(hosts: pa.Array, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The sorted hashes of each host."""
    codes = hosts.combine_chunks().dictionary_encode() if isinstance(hosts, pa.ChunkedArray) else hosts.dictionary_encode()
    numbers = codes.indices.to_numpy()
    order = np.lexsort((hashes, numbers))
    ends = np.cumsum(np.bincount(numbers, minlength=len(codes.dictionary)))
    return {host: hashes[order[a:b]] for host, a, b in zip(codes.dictionary.to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False)}


_NONE = np.zeros(0, np.int64)


def _texts(part: pa.RecordBatch, lists: list[np.ndarray]) -> pa.RecordBatch:
    texts = [main_text(page or "", known).encode("utf-8", "replace").decode() for page, known in zip(part.column("html").to_pylist(), lists, strict=True)]
    return pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["row", "text", "n_chars"])


def _by_broadcast(rows: DataFrame, known: DataFrame, schema: str) -> DataFrame:
    table = known.toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(_sorted_lists(table.column("host"), table.column("hash").to_numpy()) if len(table) else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                yield _texts(part, [sent.value.get(h, _NONE) for h in part.column("host").to_pylist()])

    return rows.mapInArrow(run, schema)


def _by_shares(rows: DataFrame, known: DataFrame, schema: str) -> DataFrame:
    """A large host is many shares; each task reads a share's hashes before its pages.

    Hosts of more than one share are told to all tasks: at most one for every
    ``PAGES_A_SHARE`` pages.
    """
    large = rows.groupBy(F.col("host").alias("of")).agg(F.ceil(F.count("*") / PAGES_A_SHARE).cast("int").alias("n")).where("n > 1")
    large = F.broadcast(cut(large))
    share = F.pmod(F.xxhash64("html", F.monotonically_increasing_id()), F.coalesce("n", F.lit(1))).cast("int")
    pages = rows.join(large, F.col("host") == F.col("of"), "left").select("host", share.alias("share"), F.lit(None).cast("long").alias("hash"), "html", "row")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("share")
    lists = known.join(large, F.col("host") == F.col("of"), "left").select("host", copies, "hash", F.lit(None).cast("string").alias("html"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    both = lists.unionAll(pages).repartition("host", "share").sortWithinPartitions("host", "share", F.col("hash").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, known_here = None, [], _NONE
        for batch in batches:
            hosts, shares, hashes = batch.column("host").to_pylist(), batch.column("share").to_pylist(), batch.column("hash")
            page = np.asarray(hashes.is_null())
            firsts = [i for i in range(len(batch)) if not i or hosts[i] != hosts[i - 1] or shares[i] != shares[i - 1] or page[i] != page[i - 1] or i % 64 == 0]
            for a, b in zip(firsts, [*firsts[1:], len(batch)], strict=True):
                if (hosts[a], shares[a]) != key:
                    key, held, known_here = (hosts[a], shares[a]), [], _NONE
                if not page[a]:
                    held.append(hashes.slice(a, b - a).to_numpy())
                    continue
                if held:
                    known_here, held = np.sort(np.concatenate(held)), []
                part = batch.slice(a, b - a)
                yield _texts(part, [known_here] * (b - a))

    return both.mapInArrow(run, schema)


def extract(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``pages`` with text and n_chars in place of html."""
    known = cut(templates(pages, max_pages))
    rows = pages.select(row_of(pages, "html", "text", "n_chars").alias("row"), "url", F.col("html").cast("string").alias("html"))
    rows = with_host_and_path(rows).select("row", "host", "html")
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("text string, n_chars bigint").fields])
    found = _by_broadcast(rows, known, schema) if known.count() <= HASHES_SENT else _by_shares(rows, known, schema)
    return unpacked(found, text=F.col("text"), n_chars=F.col("n_chars"))
