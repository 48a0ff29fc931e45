"""Main text of web pages, by the difference to the nearest page of the same host and a check by markup.

Each page is paired with the page of its host whose URL path is nearest, all lines of both (menus and footers
too) are aligned by a longest common subsequence, and lines that both share are deleted.  Two pages whose text
outside of furniture is mostly shared are versions of one, which says nothing on templates; the next nearest is
taken then.  A check by markup follows: it gives back shared lines of articles, and takes furniture that the
nearest page does not have; on all other lines (pages without an article, and link lists inside one) the
difference stands.

Pages are ordered by host and path over all partitions, so a host of any size is many tasks.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.llm.common import join_small_or_large, materialize

# Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
HIDDEN = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "svg", "object", "canvas", "audio", "video", "map", "datalist"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source",
}
#: Opening one of these ends an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PARAGRAPH = {"p"}
#: Elements inside which those stay open.
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "main", "blockquote"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
# Words of class and id names that tell furniture from text.
FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion", "banner", "nav", "navbar", "navigation", "menu", "menus",
    "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "footer", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "comment", "comments", "disqus", "newsletter", "subscribe", "social",
    "share", "sharing", "related", "popup", "modal", "login", "signup", "search", "pagination", "pager", "widget", "widgets", "toolbar", "masthead", "topbar",
}
#: Words after which a furniture word says nothing: ``has-sidebar``, ``no-comments``.
BEFORE = {"no", "with", "has", "without", "is", "hide"}
READERS = {"comment", "comments", "reply", "replies"}

#: Share of the text that two pages have in common from which they are versions of one page.
SAME_PAGE = 0.5
#: Bits that one alignment holds at a time.
MOST_BITS = 1 << 28
#: Up to so many verdicts are broadcast.
FEW_VERDICTS = 100_000

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: A tag without quotes, or with whole ones, as nearly all are.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)([^>"']*(?:"[^">]*"[^>"']*)?)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Line:
    """One block of a page: its text, whether it is in an article (2), a main part (1) or neither (0), whether most of it is links, and whether markup calls it furniture."""

    text: str
    level: int
    linked: bool
    furniture: bool = False


@dataclass(slots=True)
class _Open:
    tag: str
    level: int
    hidden: bool
    link: bool


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is furniture by its tag and attributes, and the level that it opens."""
    names = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
    role, marks = names.get("role", "").lower(), [w.lower() for w in _WORDS.findall(f"{names.get('class', '')} {names.get('id', '')}")]
    furniture = {w for k, w in enumerate(marks) if w in FURNITURE and not (k and marks[k - 1] in BEFORE)}
    if tag in ("html", "body", "main"):
        furniture = set()
    elif tag == "article":
        furniture &= READERS
    level = 2 if tag == "article" or names.get("itemprop", "").lower() == "articlebody" else 1 if tag == "main" or role == "main" else 0
    return tag in HIDDEN or role in ROLES or "hidden" in names or bool(furniture), level


@dataclass
class _Reader:
    """The open elements, and the pieces of the block that is being read."""

    stack: list[_Open] = field(default_factory=list)
    count: defaultdict[str, int] = field(default_factory=lambda: defaultdict(int))
    lines: list[Line] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    hidden: list[str] = field(default_factory=list)

    def text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else None
        piece = html.unescape(raw) if "&" in raw else raw
        if top and top.hidden:
            self.hidden.append(piece)
            return
        self.pieces.append(piece)
        if top and top.link:
            self.linked += len(piece.strip())

    def end_block(self) -> None:
        level = self.stack[-1].level if self.stack else 0
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.lines.append(Line(text, level, 2 * self.linked > len(text)))
            self.pieces, self.linked = [], 0
        if self.hidden:  # furniture, inside a block too
            text = " ".join("".join(self.hidden).split())
            if text:
                self.lines.append(Line(text, level, False, True))
            self.hidden = []

    def open(self, tag: str, attributes: str) -> None:
        top = self.stack[-1] if self.stack else _Open("", 0, False, False)
        hidden, level = _kind(tag, attributes if _ATTRIBUTE.search(attributes) else "")
        self.stack.append(_Open(tag, max(top.level, level), top.hidden or hidden or (tag == "header" and top.level < 2), top.link or tag == "a"))
        self.count[tag] += 1

    def close(self, tag: str) -> None:
        if self.count[tag]:
            while True:
                gone = self.stack.pop()
                self.count[gone.tag] -= 1
                if gone.tag == tag:
                    return

    def implied(self, tag: str) -> None:
        ended = CLOSES.get(tag, _PARAGRAPH)
        for k in range(len(self.stack) - 1, max(-1, len(self.stack) - 9), -1):
            if self.stack[k].tag in SCOPES:
                return
            if self.stack[k].tag in ended:
                self.close(self.stack[k].tag)
                return


def _tag_end(page: str, at: int, closed: set[str]) -> int:
    """Where the tag that starts at ``at`` ends, quoted ``>`` passed over; ``closed`` collects quotes that do not occur again."""
    end = page.find(">", at)
    while end >= 0:
        inside, quote, k = page[at:end], "", 0
        while True:  # the first quote that is open at the end
            opened = min((p for q in "\"'" if (p := inside.find(q, k)) >= 0), default=-1)
            if opened < 0:
                return end
            quote = inside[opened]
            k = inside.find(quote, opened + 1) + 1
            if not k:
                break
        if quote in closed:
            return end
        until = page.find(quote, end)
        if until < 0:
            closed.add(quote)
            return end
        at, end = until + 1, page.find(">", until + 1)
    return len(page)


def lines_of(page: str) -> list[Line]:
    """The lines of a page that are not furniture by their markup, in order; only those of its articles if it has any, else of its main part."""
    return [line for line in all_lines(page) if not line.furniture]


def all_lines(page: str) -> list[Line]:
    """All lines of a page in order; those outside of its articles if it has any, else of its main part, are furniture."""
    reader, at, size, closed = _Reader(), 0, len(page), set()
    while at < size:
        start = page.find("<", at)
        if start < 0:
            reader.text(page[at:])
            break
        if start > at:
            reader.text(page[at:start])
        if whole := _TAG.match(page, start):
            slash, tag, attributes = whole.groups()
            tag, at = tag.lower(), whole.end()
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        elif name := _NAME.match(page, start + 1 + page.startswith("</", start)):
            slash, tag, end = page.startswith("</", start), name[0].lower(), _tag_end(page, name.end(), closed)
            attributes, at = page[name.end() : end], end + 1
        else:
            reader.text("<")
            at = start + 1
            continue
        if tag not in INLINE:
            reader.end_block()
        elif tag != "a" and not attributes:
            continue  # changes nothing
        if slash:
            reader.close(tag)
        elif tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = size if ending is None else page.find(">", ending.end()) + 1 or size
        elif tag not in EMPTY:
            if tag not in INLINE:
                reader.implied(tag)
            reader.open(tag, attributes)
    reader.end_block()
    top = max((line.level for line in reader.lines if not line.furniture), default=0)
    for line in reader.lines:
        line.furniture = line.furniture or line.level != top
    return reader.lines


def protected(line: Line) -> bool:
    """Whether the check by markup gives a line back that the nearest page shares: text of an article or a main part, no list of links."""
    return not line.furniture and line.level > 0 and not line.linked


def checked(lines: list[Line], shared_places: set[int]) -> tuple[list[str], int]:
    """The texts of the lines that stay, and how many of those that are no furniture the difference deleted."""
    left = [line for k, line in enumerate(lines) if k not in shared_places or protected(line)]
    stay = [line.text for line in left if not line.furniture]
    return stay, sum(not line.furniture for line in lines) - len(stay)


def _rows(a: list[int], where: dict[int, int], width: int) -> list[int]:
    """Bit rows of the longest common subsequence: a zero bit j in row i says that b[j] lengthens what a[: i + 1] shares with b."""
    row, full, rows = (1 << width) - 1, (1 << width) - 1, []
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    return rows


def _ends(b: list[int]) -> dict[int, int]:
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    return where


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length shared by all of ``a`` with each beginning of ``b``."""
    row = (1 << len(b)) - 1
    where, full = _ends(b), row
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list[int], b: list[int]) -> list[int]:
    """The places in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Rows of bits hold the whole table, one bit a cell; a table beyond ``MOST_BITS`` is halved where both halves'
    best lengths meet, so memory stays bounded.
    """
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    head, tail = list(range(first)), list(range(len(a) - last, len(a)))
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return head + tail
    if len(a) > 1 and len(a) * len(b) > MOST_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        middle = shared(a[:half], b[:cut]) + [half + k for k in shared(a[half:], b[cut:])]
    else:
        rows, middle, j = _rows(a, _ends(b), len(b)), [], len(b) - 1
        for i in range(len(a) - 1, -1, -1):
            while j >= 0 and rows[i] >> j & 1:
                j -= 1
            if j < 0:
                break
            if i and not rows[i - 1] >> j & 1:
                continue  # met without a[i] as well
            middle.append(i)
            j -= 1
        middle.reverse()
    return head + [first + k for k in middle] + tail


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a final dot; null without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _keyed(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html`` and a key that equal pages share."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return pages.select("page_id", "url", "html", F.md5(F.concat_ws("\n", text("page_id"), text("url"), text("html"))).alias("__key"))


def _outline(keyed: DataFrame) -> DataFrame:
    """Per distinct page: key, host, path, and of each line, furniture too, its hash and its characters (0 for furniture)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [all_lines(p or "") for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in ("__key", "host", "path")], pa.array([[xxhash.xxh3_64_intdigest(x.text) - (1 << 63) for x in p] for p in found], pa.list_(pa.int64())),
                        pa.array([[0 if x.furniture else len(x.text) for x in p] for p in found], pa.list_(pa.int32())),
                    ],
                    ["key", "host", "path", "hashes", "chars"],
                )

    named = keyed.select("__key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").filter("host is not null")
    return named.mapInArrow(run, "key string, host string, path string, hashes array<bigint>, chars array<int>").dropDuplicates(["key"])


def _near(outline: DataFrame) -> DataFrame:
    """Every page with the keys of the pages before and after it in order of host and path, the nearer first.

    The order is that of range partitions; the ends of partitions meet in a table of one row a partition.
    """
    placed = outline.select("key", "host", "path").repartitionByRange("host", "path", "key")
    placed = materialize(placed.withColumn("part", F.spark_partition_id()), "pages-in-order")
    place = F.struct("host", "path", "key")
    w = Window.partitionBy("part").orderBy("host", "path", "key")
    ends = placed.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    order = Window.orderBy("part")  # a row a partition
    ends = F.broadcast(ends.select("part", F.lag("last").over(order).alias("__before"), F.lead("first").over(order).alias("__after")))
    sides = placed.select("part", place.alias("here"), F.lag(place).over(w).alias("before"), F.lead(place).over(w).alias("after")).join(ends, "part")
    same = lambda c: F.when(c["host"] == F.col("here.host"), c)
    sides = sides.select("here", same(F.coalesce("before", "__before")).alias("before"), same(F.coalesce("after", "__after")).alias("after"))

    def common(c: Column) -> Column:
        """Leading path segments that both share; -1 without a page."""
        segments = lambda p: F.split(p, "/")
        pairs = F.zip_with(segments(F.col("here.path")), segments(c["path"]), lambda x, y: x.eqNullSafe(y))
        first = F.array_position(pairs, False)
        return F.coalesce(F.when(first == 0, F.size(pairs)).otherwise(first - 1), F.lit(-1))

    nearer = common(F.col("before")) >= common(F.col("after"))
    one, two = F.col("before.key"), F.col("after.key")
    return sides.select(F.col("here.key").alias("key"), F.when(nearer, one).otherwise(two).alias("near_1"), F.when(nearer, two).otherwise(one).alias("near_2"))


def _compared(asked: DataFrame) -> DataFrame:
    """Per page the places of the lines that it shares with the nearest page that is no version of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone = [], []
            for row in batch.to_pylist():
                chars = row["chars"]
                for other in (row["hashes_1"], row["hashes_2"]):
                    if other is None:
                        continue
                    places = shared(row["hashes"], other)
                    if sum(chars[k] for k in places) < SAME_PAGE * sum(chars):
                        if places:
                            keys.append(row["key"])
                            gone.append(places)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    return asked.mapInArrow(run, "key string, gone array<int>")


def deletions(pages: DataFrame) -> DataFrame:
    """Keys of pages with the places of the lines (as ``all_lines`` gives them) that their nearest page shares; written.

    Every page is compared, all of its lines; only hashes of lines move.
    """
    outline = materialize(_outline(_keyed(pages)), "page-lines")
    hashes = lambda k: outline.select(F.col("key").alias(f"near_{k}"), F.col("hashes").alias(f"hashes_{k}"))
    asked = outline.select("key", "hashes", "chars").join(_near(outline), "key")
    return materialize(_compared(asked.join(hashes(1), "near_1", "left").join(hashes(2), "near_2", "left")), "page-deletions")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_deleted``: the main text of every page, its code points, and the lines, furniture not counted, that the nearest page deleted.

    White space inside a block is one space, blocks are joined by one space, character references are
    decoded once.  A null page is empty; a null or odd URL has no host and is compared with nothing; repeated
    rows are one page when pages are paired and each get their text.  Only ``page_id``, ``url`` and ``html``
    are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts, deleted = [], []
                for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                    stay, n_gone = checked(all_lines(page or ""), set(gone or ()))
                    texts.append(" ".join(stay))
                    deleted.append(n_gone)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(deleted, pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_deleted"],
                )

    keyed = _keyed(pages)
    joined = join_small_or_large(keyed, deletions(pages).withColumnRenamed("key", "__key"), "__key", "left", FEW_VERDICTS)
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "gone").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, n_deleted bigint")
