"""Main text of web pages: subtrees that recur on a host's pages are its template and go, and so does what markup names as chrome.

Each page is parsed once into blocks of text and its element subtrees, each of them a run of blocks with a hash of its tags and text (mixed with the host).  Spark counts
for every hash the pages that hold it and the different contents among these.  A content is the least hash of a page's pairs of words outside chrome, which copies and
near copies of one article mostly share, so that a group of copies isn't taken for a template.  A subtree is a template if it stands beside
``MANY`` contents or more and these are at least a quarter of its pages; on a host of at most ``SMALL_HOST`` pages, ``FEW`` contents and half of the host's pages do.
A page counts for a subtree only where that is less than half of the page's text.  Containers (lists, divisions, tables and the like) are counted;
a paragraph or heading is so only outside an article and where it has a class or an id, so a passage that many articles share stays.

What markup names goes on every host: elements, roles and words of class and id for menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments, hidden elements, and lists outside an article that are nothing but links.  Of the rest the ``article`` elements are taken, else ``main``, else all.
A header inside an article or main, and a form that holds one, stay; of an element that is never closed what stands in an article within stays.

Defined cases: null html, and a page without text, give ''; null url, or no ``://``, is the host ''; cut-off markup is read to its end (a cut-off tag is dropped); repeated rows
each get a row; an empty table gives no rows; other columns stay, but ``html`` gives way to the text, and added columns take the place of ones of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from groundspark.llm.common import Scratch, bounded_batches, map_arrow, mix64, spread_join, table
from groundspark.llm.words import word_hashes

MANY, SHARE_OF_PAGES, FEW, SMALL_HOST = 10, 4, 3, 20
#: Hashes of templates that are sent to all tasks (8 bytes each); more are joined to their pages.
MOST_SENT = 1 << 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in "script style textarea title xmp noframes".split()}
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_CONTAINERS = frozenset("aside details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
_PROSE = frozenset("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre tr".split())
_ROOTS = {"article": 0, "main": 1}
_HIDDEN = frozenset("canvas head iframe noscript object script style svg template textarea title xmp noframes".split())
_CHROME_TAGS = frozenset("aside button datalist dialog footer form menu nav select".split())
_CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_CHROME_NAMES = frozenset(
    """ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header login menu menus modal
    nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion recommended related replies reply respond share sharing sidebar sidebars signup skip social
    sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split()
)
_COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
#: What a start tag closes, up to the nearest element that bounds it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = _BLOCKS - {"caption", "dd", "dt", "html", "head", "body", "legend", "li", "summary", "tbody", "tfoot", "thead", "tr"} | {"dd", "dt", "li"}


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def _names(attributes: dict[str, str]) -> set[str]:
    return {x.lower() for k in ("class", "id") for x in _NAME_PARTS.findall(attributes.get(k, ""))}


class _Element:
    __slots__ = ("tag", "chrome", "root", "events", "block", "chars", "links", "candidate", "holds_root", "n_links")

    def __init__(self, tag: str, chrome: bool, root: int, events: int, block: int, candidate: bool):
        self.tag, self.chrome, self.root, self.events, self.block, self.candidate = tag, chrome, root, events, block, candidate
        self.chars = self.links = self.n_links = 0
        self.holds_root = False


class Page:
    """``blocks``: [text, root (0: in an article, 1: in main, 2: elsewhere), is chrome]; ``subtrees``: (hash, first block, block after the last, characters)."""

    def __init__(self, html: str, host: str = ""):
        self.blocks: list[list] = []
        self.subtrees: list[tuple[int, int, int, int]] = []
        self._salt = host.encode("utf-8", "replace")
        self._piece: list[str] = []
        self._events: list[str] = []
        self._stack = [_Element("#", False, 2, 0, 0, False)]
        self._hidden = 0
        self._read(html)
        while len(self._stack) > 1:
            self._pop(False)
        self._flush()

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[4] is not None and not m[0].endswith(">"):
                return  # cut off
            if m[1] or m[4]:
                self._end(name)
                continue
            self._start(name, m[3] if m[2] else m[6])
            if name in _RAW:
                close = _RAW[name].search(html, at)
                at = close.start() if close else n

    def _text(self, raw: str) -> None:
        if self._hidden:
            return
        text = unescape(raw) if "&" in raw else raw
        self._piece.append(text)

    def _flush(self) -> None:
        if not self._piece:
            return
        text = " ".join("".join(self._piece).split())
        self._piece = []
        if text:
            top = self._stack[-1]
            self.blocks.append([text, top.root, top.chrome])
            self._events.append(text)
            top.chars += len(text)

    def _start(self, name: str, raw: str) -> None:
        stack = self._stack
        if name in _CLOSES:
            closed, bounds = _CLOSES[name]
            self._close_upto(closed, bounds)
        elif name in _ENDS_P:
            self._close_upto({"p"}, {"button", "td", "th", "caption", "table", "object"})
        if name in _BLOCKS:
            self._flush()
        elif name in ("br", "td", "th", "option", "img"):
            self._piece.append(" ")
        if name in _VOID:
            return
        attributes = _attributes(raw) if raw and "=" in raw or "hidden" in raw else {}
        top = stack[-1]
        hidden = name in _HIDDEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        own = self._is_chrome(name, attributes, top.root)
        chrome, root = top.chrome or own, top.root
        hidden = hidden or (own and name not in _BLOCKS)  # a run of text within a block
        if name in _ROOTS:
            root = min(root, _ROOTS[name])
            if not chrome:
                for e in stack:
                    e.holds_root = True
            elif not top.chrome or not self._said_comments(attributes):
                for e in stack:
                    if e.chrome:
                        e.holds_root = True
        candidate = name in _CONTAINERS or (name in _PROSE and root == 2 and bool(attributes.keys() & {"class", "id", "role"}))
        if name == "a":
            for e in stack:
                if e.candidate:
                    e.n_links += 1
        self._events.append("<" + name)
        stack.append(_Element(name, chrome, root, len(self._events) - 1, len(self.blocks), candidate))
        if hidden:
            self._hidden += 1
            stack[-1].links = -1  # marks a hidden element

    @staticmethod
    def _said_comments(attributes: dict[str, str]) -> bool:
        return bool(_names(attributes) & _COMMENT_NAMES)

    def _is_chrome(self, name: str, attributes: dict[str, str], root: int) -> bool:
        if name in ("html", "body"):
            return False
        if name in _ROOTS:
            return self._said_comments(attributes)
        if name in _CHROME_TAGS or attributes.get("role", "").lower() in _CHROME_ROLES:
            return True
        if name == "header":
            return root == 2
        found = _names(attributes) & _CHROME_NAMES if attributes else set()
        return bool(found - {"header"} if root < 2 or name in ("h1", "h2", "h3", "h4", "h5", "h6") else found)

    def _close_upto(self, closed: set[str], bounds: set[str]) -> None:
        """Close the nearest of some elements, unless one that bounds it is nearer."""
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[k].tag
            if tag in closed:
                while len(self._stack) > k:
                    self._pop(True)
                return
            if tag in bounds or (tag in _BLOCKS and "p" in closed and tag != "p"):
                return

    def _end(self, name: str) -> None:
        if name == "p" and not any(e.tag == "p" for e in self._stack):
            self._flush()
            return
        inline = name not in _BLOCKS and name not in ("td", "th", "option", "button", "select") and name not in _HIDDEN
        for k in range(len(self._stack) - 1, 0, -1):
            e = self._stack[k]
            if e.tag == name:
                while len(self._stack) > k + 1:
                    self._pop(self._stack[-1].tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "tbody", "thead", "tfoot") or not self._stack[-1].chrome)
                self._pop(True)
                return
            if inline and e.tag in _BLOCKS:
                return

    def _pop(self, closed: bool) -> None:
        """Close the innermost element; ``closed`` is false where nothing in the page says so."""
        e = self._stack[-1]
        if e.tag in _BLOCKS:
            self._flush()
        self._stack.pop()
        up = self._stack[-1]
        if e.links < 0:
            self._hidden -= 1
        up.chars += e.chars
        if e.chrome and not up.chrome and e.holds_root and (not closed or e.tag == "form"):
            for b in self.blocks[e.block :]:  # an article within an element that was never meant to hold it
                if b[1] < 2:
                    b[2] = False
        if e.candidate and len(self.blocks) > e.block:
            if not e.chrome and e.root == 2 and e.tag in ("ul", "ol", "menu", "div", "table") and e.n_links > 2 and self._only_links(e):
                for b in self.blocks[e.block :]:
                    b[2] = True
            digest = blake2b("\0".join(self._events[e.events :]).encode("utf-8", "replace"), digest_size=8, key=b"subtree").digest()
            key = int.from_bytes(blake2b(self._salt + digest, digest_size=8).digest(), "little", signed=True)
            del self._events[e.events :]
            self._events.append(digest.hex())
            self.subtrees.append((key, e.block, len(self.blocks), e.chars))

    def _only_links(self, e: _Element) -> bool:
        return e.n_links >= 3 and len(self.blocks) - e.block <= e.n_links and e.chars <= 40 * e.n_links

    def text(self, gone: set[int]) -> tuple[str, int]:
        return main_text([b[0] for b in self.blocks], [b[1] for b in self.blocks], [b[2] for b in self.blocks], [s[:3] for s in self.subtrees if s[0] in gone])


def main_text(texts: list[str], roots: list[int], chrome: list[bool], gone: list[tuple[int, int, int]]) -> tuple[str, int]:
    """(the text, number of blocks that stood in templates)."""
    kept = np.ones(len(texts), dtype=bool)
    for _, first, last in gone:
        kept[first:last] = False
    removed = int(len(kept) - kept.sum())
    kept &= ~np.asarray(chrome, dtype=bool)
    roots_ = np.asarray(roots, dtype=np.int64)
    left = np.flatnonzero(kept)
    if len(left):
        left = left[roots_[left] == roots_[left].min()]
    return "\n\n".join(texts[k] for k in left.tolist()), removed


def content_key(texts: list[list[str]]) -> np.ndarray:
    """The least hash of the pairs of words of each page's blocks (of its words, where it has one only; 0 without any)."""
    hashes, offsets = word_hashes([" ".join(t) for t in texts])
    out = np.zeros(len(texts), dtype=np.int64)
    if len(hashes):
        pairs = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + np.append(hashes[1:], np.uint64(0)))
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if b > a:
                out[k] = (pairs[a : b - 1] if b - a > 1 else hashes[a:b]).min().astype(np.int64)
    return out


_PAGE = "struct<host:string,content:bigint,blocks:array<struct<text:string,root:int,chrome:boolean>>,subtrees:array<struct<key:bigint,first:int,last:int,counted:boolean>>>"
_PAGE_ARROW = pa.struct(
    [("host", pa.string()), ("content", pa.int64()), ("blocks", pa.list_(pa.struct([("text", pa.string()), ("root", pa.int32()), ("chrome", pa.bool_())]))), ("subtrees", pa.list_(pa.struct([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("counted", pa.bool_())])))]
)
_HOST = re.compile(r"^.*?://([^/?#]*)", re.S)
_LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].translate(_LOWER) if found else ""


def parsed(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """All columns but ``html``, and ``__page``."""
    bounded_batches(pages.sparkSession)
    columns = [c for c in pages.columns if c not in (html, "__page")]
    at, url_at = len(columns), columns.index(url)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, address in zip(batch.column(at).to_pylist(), batch.column(url_at).to_pylist()):
            host = host_of(address)
            page = Page(text or "", host)
            whole = sum(len(b[0]) for b in page.blocks)
            rows.append({"host": host, "content": 0, "blocks": [{"text": t, "root": r, "chrome": c} for t, r, c in page.blocks], "subtrees": [{"key": k, "first": a, "last": b, "counted": 2 * n < whole} for k, a, b, n in page.subtrees]})
        for row, key in zip(rows, content_key([[b["text"] for b in row["blocks"] if not b["chrome"]] for row in rows]).tolist()):
            row["content"] = key
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(rows, _PAGE_ARROW)], names=[*columns, "__page"])

    schema = StructType([pages.schema[c] for c in columns]).add("__page", _parse_datatype_string(_PAGE))
    return map_arrow(pages.select(*columns, html), run, schema)


def templates(found: DataFrame) -> DataFrame:
    """The hashes (key) of subtrees that are templates of their host."""
    each = found.select(F.col("__page.host").alias("host"), F.col("__page.content").alias("content"), F.explode(F.array_distinct(F.transform(F.filter("__page.subtrees", lambda s: s["counted"]), lambda s: s["key"]))).alias("key"))
    # first by content, so that no task gets all pages of a hot template
    seen = each.groupBy("key", "content").agg(F.count("*").alias("n"), F.first("host").alias("host")).groupBy("key").agg(F.count("*").alias("contents"), F.sum("n").alias("pages"), F.first("host").alias("host"))
    common = seen.filter((F.col("contents") >= MANY) & (F.col("contents") * SHARE_OF_PAGES >= F.col("pages")))
    small = found.groupBy(F.col("__page.host").alias("host")).agg(F.count("*").alias("of_host")).filter(F.col("of_host") <= SMALL_HOST)
    few = seen.filter(F.col("contents") >= FEW).join(small, "host").filter(2 * F.col("pages") >= F.col("of_host"))
    return common.select("key").union(few.select("key")).distinct()


def extract(pages: DataFrame, scratch: Scratch, html: str = "html", url: str = "url", text: str = "text", removed: str = "n_template_blocks", most_sent: int = MOST_SENT) -> DataFrame:
    """All columns but ``html``, the main text, and the number of blocks that stood in templates."""
    spark = pages.sparkSession
    found = scratch.keep(parsed(pages, html, url), "parsed")
    known = scratch.keep(templates(found), "templates")
    columns = [c for c in found.columns if c not in ("__page", text, removed)]
    at = len(columns)
    sent = None
    if known.count() <= most_sent:
        sent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in known.collect()], dtype=np.int64)))
        rows = found.select(*columns, "__page")
    else:
        numbered = scratch.keep(found.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        each = scratch.keep(numbered.select("__row", F.explode("__page.subtrees").alias("s")).select("__row", F.col("s.key").alias("key")).distinct(), "each")
        gone = spread_join(each, known.withColumn("__known", F.lit(True)), "key", "inner").groupBy("__row").agg(F.collect_list("key").alias("__gone"))
        rows = numbered.join(gone, "__row", "left").select(*columns, "__page", "__gone")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        lists = batch.column(at + 1).to_pylist() if sent is None else None
        for k, page in enumerate(batch.column(at).to_pylist()):
            if sent is None:
                of_page = set(lists[k] or [])
                hits = [s["key"] in of_page for s in page["subtrees"]]
            else:
                keys = np.array([s["key"] for s in page["subtrees"]], dtype=np.int64)
                hits = (sent.value[np.minimum(np.searchsorted(sent.value, keys), len(sent.value) - 1)] == keys).tolist() if len(sent.value) else [False] * len(keys)
            blocks = page["blocks"]
            gone_here = [(s["key"], s["first"], s["last"]) for s, hit in zip(page["subtrees"], hits) if hit]
            out.append(main_text([b["text"] for b in blocks], [b["root"] for b in blocks], [b["chrome"] for b in blocks], gone_here))
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=[*columns, text, removed])

    schema = StructType([found.schema[c] for c in columns]).add(text, "string").add(removed, "long")
    return map_arrow(rows, run, schema)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, Scratch(spark, "op12")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template_blocks")
