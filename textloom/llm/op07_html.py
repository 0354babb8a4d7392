"""Main text of web pages by nearest-URL page differencing, with structure as a hint.

A page's html is cut into blocks of text, its lines, each marked as boilerplate (menus, headers, footers,
sidebars, notices, adverts, forms, comments), as main (inside article or main), or as neither. Every page
is paired with the nearest page by URL path within its host that is no copy of it, and both pages' lines
are aligned by longest common subsequence. Shared lines are deleted: of a page without an article
container all of them; of one with a container those that run across its edge, from outside to inside, as a
template's do. A line shared in the middle of an article is a quotation, and stays.

Pairing sees hashes of lines only, some hundred bytes a page. These rows are numbered in the order of
(host, path, content) and dealt to tasks by blocks of numbers, each with the rows just before and after
it, so the result depends on the order alone, not on partitions, and a large host is many tasks. A page
looks through its whole block; one whose rows there are all copies looks on in the other blocks of its host,
however far, but for blocks whose summary proves that they hold copies of it alone. Texts don't move
but for a join with the deleted lines, which is a broadcast while these are few.
"""

from __future__ import annotations

import html
import pickle
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch
from textloom.llm.lcs import shared
from textloom.sources.textdir import numbered

#: Rows of a block of the pairing; rows of its neighbours that it sees; what share of a page's text makes a copy of another page.
ROWS, REACH, COPY = 2048, 8, 0.8
#: A row joins a center that misses so small a share in it; a block of more centers has no summary, and is searched.
#: All summaries on the driver have at most so many bytes; beyond that blocks of long ones have none, and are searched.
NEAR, CENTERS, SUMMARIES = 0.15, 4, 32 << 20
#: Pages that visit a block together: those of so many blocks.
SPREAD = 16
#: Deleted lines are broadcast up to so many bytes on disk.
BROADCAST = 8 << 20
KINDS = {"boilerplate": 0, "other": 1, "main": 2}

# Element classes of HTML.
RAW = "script|style|noscript|template|iframe|svg|canvas|object|textarea|title|select|math"
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form menu dialog button fieldset head".split())
MAIN = frozenset(("article", "main"))
# Words of class, id and role names that mark an element as not the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal"
    " overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail widget widgets"
    " footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion share sharing social related recommended"
    " recommendations trending popular pagination pager copyright search searchbox form complementary contentinfo".split()
)

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
HEADING = re.compile("h[1-6]")


def _chrome(tag: str, attributes: str) -> bool:
    if tag in CHROME:
        return True
    if tag in ("html", "body", "main", "article") or not attributes or "=" not in attributes:
        return False
    if re.search(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attributes, re.I):
        return True
    return any(w.lower() in WORDS for m in NAMES.finditer(attributes) for w in SPLIT.split(m[2] or m[3] or m[4] or ""))


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of each block with text, in page order; kinds: main, boilerplate, other.

    Character references are decoded after markup is gone, and white space becomes one space.
    A header inside the article keeps its headings only. Unclosed elements end with their parent.
    """
    page = page or ""
    stack: list[tuple[str, bool, bool]] = []  # tag, boilerplate from here, main from here
    out: list[tuple[str, str]] = []
    held: list[str] = []
    at = 0

    def kind() -> str:
        bad = next((i for i, x in enumerate(stack) if x[1]), None)
        if bad is None:
            return "main" if any(x[2] for x in stack) else "other"
        inside = any(x[2] for x in stack[:bad])
        if inside and stack[bad][0] == "header" and any(HEADING.fullmatch(x[0]) for x in stack[bad:]) and not any(x[1] for x in stack[bad + 1 :]):
            return "main"
        return "boilerplate"

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((kind(), text))

    for m in TOKEN.finditer(page):
        held.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[0].startswith("<![CDATA["):
                held.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, ending = m[3].lower(), m[2] == "/"
        if tag in BLOCK or tag in CHROME:
            close()
        if not ending and tag not in VOID and not m[4].rstrip().endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((tag, _chrome(tag, m[4]), tag in MAIN or (tag != "body" and "main" in m[4] and bool(re.search(r"role\s*=\s*[\"']?main\b", m[4], re.I)))))
        elif ending:
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if where is not None:
                del stack[where:]
    tail = page[at:]
    if not re.match(r"<[a-zA-Z/!?][^<]*\Z", tail):  # a tag cut off by the end of the page is no text
        held.append(re.sub(r"<[a-zA-Z/!?][^<>]*\Z", "", tail))
    close()
    return out


def lines(page: str | None) -> tuple[list[int], list[int], list[int]]:
    """(hashes, kinds, sizes) of a page's blocks."""
    found = blocks(page)
    hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for _, t in found]
    return hashes, [KINDS[k] for k, _ in found], [len(t) for _, t in found]


def deleted(hashes: list[int], kinds: list[int], other: list[int]) -> list[int]:
    """The numbers of a page's lines that go, given the lines of its partner. Lines marked as boilerplate go anyway, and aren't listed."""
    main = [i for i, k in enumerate(kinds) if k == 2]
    gone = shared(hashes, other)
    if not main:
        return sorted(i for i in gone if kinds[i] == 1)
    out = []
    for edge, step in ((main[0], 1), (main[-1], -1)):
        at = edge if edge - step in gone and kinds[edge - step] == 1 else -1
        while at in gone and 0 <= at < len(kinds) and kinds[at] == 2:
            out.append(at)
            at += step
    return sorted(set(out))


def text_of(page: str | None, gone: list[int] | None) -> str:
    """The main text: the container's lines, or without one the unmarked lines, less those deleted."""
    found, gone = blocks(page), set(gone or ())
    want = "main" if any(k == "main" for k, _ in found) else "other"
    return " ".join(t for i, (k, t) in enumerate(found) if k == want and i not in gone)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [lines(x.as_py()) for x in b.column("html")]
        cols = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.int8(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("host", "path", "key")), *cols], ["host", "path", "key", "hashes", "kinds", "sizes"])


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def nearest(rows: list[tuple[str, str, list[int]]], i: int) -> list[list[int]]:
    """The lines of all rows (host, path, lines) of row i's host that have any, in the order in which its partner is sought: longest common path first,
    then the closest row, the one before first. As rows come in the order of their paths, that is the better of the first that is no copy on either side."""
    host, path, _ = rows[i]
    near = [j for d in range(1, len(rows)) for j in (i - d, i + d) if 0 <= j < len(rows) and rows[j][0] == host and rows[j][2]]
    return [rows[j][2] for j in sorted(near, key=lambda j: -_common(path, rows[j][1]))]


def _weights(hashes: Iterable[int], sizes: Iterable[int]) -> dict:
    """{line: size}; a line's later occurrences are lines of their own."""
    out: dict = {}
    seen: dict[int, int] = {}
    for h, n in zip(hashes, sizes, strict=True):
        k = seen[h] = seen.get(h, -1) + 1
        out[(h, k) if k else h] = n
    return out


def _missing(own: dict, other: dict) -> int:
    """The text of own lines that the other page lacks, in whatever order it has the rest. Never more than by way of a third page."""
    return sum(n for x, n in own.items() if x not in other)


def _copied(whole: int, missing: int) -> bool:
    return whole - missing > COPY * whole


class Page:
    """What is sought with: the page's text that isn't marked as boilerplate."""

    def __init__(self, hashes: list[int], kinds: list[int], sizes: list[int]):
        unmarked = [i for i, k in enumerate(kinds) if k]
        self.own = _weights([hashes[i] for i in unmarked], [sizes[i] for i in unmarked])
        self.whole = sum(self.own.values())

    def copied(self, other: dict) -> bool:
        return _copied(self.whole, _missing(self.own, other))

    def all_copied(self, centers: list[tuple[dict, int]]) -> bool:
        """Whether rows within these distances of these centers are copies for certain."""
        return all(_copied(self.whole, _missing(self.own, c) + far) for c, far in centers)


class Stretch:
    """Rows of one host in order, each with the center that it stands close to and what it lacks of its text. The first center is what most rows hold."""

    def __init__(self, rows: list[tuple[list[int], list[int]]]):
        self.lines = [_weights(h, n) if h else None for h, n in rows]
        self.centers: list[tuple[dict, int]] = []  # lines, distance of the farthest row
        self.places: list[tuple[int, int]] = []
        held = Counter(y for x in self.lines if x for y in x)
        sizes = {y: n for x in self.lines if x for y, n in x.items()}
        recent: list[int] = []
        if usual := {y: sizes[y] for y, n in held.items() if 2 * n > len(rows)}:
            recent = [self._center(usual)]
        for x in self.lines:
            if x is None:
                self.places.append((-1, 0))
                continue
            for c in recent:
                center, far = self.centers[c]
                lack = _missing(center, x)
                if lack <= NEAR * sum(center.values()):
                    self.centers[c] = (center, max(far, lack))
                    break
            else:
                c, lack = self._center(x), 0
            recent = [c, *(r for r in recent if r != c)][:CENTERS]
            self.places.append((c, lack))

    def _center(self, lines: dict) -> int:
        self.centers.append((lines, 0))
        return len(self.centers) - 1

    def find(self, page: Page, order: range) -> int | None:
        """The first row in this order that has lines and is no copy."""
        if len(self.centers) <= CENTERS and page.all_copied(self.centers):
            return None
        known: dict[int, int] = {}
        for j in order:
            c, lack = self.places[j]
            if c < 0:
                continue
            if c not in known:
                known[c] = _missing(page.own, self.centers[c][0])
            if not _copied(page.whole, known[c] + lack) and not page.copied(self.lines[j]):
                return j
        return None


def _grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], by: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows that agree in the first columns."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
    return groupby(rows, lambda r: r[:by])


PAGE = ("host", "path", "key", "hashes", "kinds", "sizes")
PAGE_TYPES = "host string, path string, key string, hashes array<long>, kinds array<tinyint>, sizes array<int>"
#: A partner's deletions, and how near it is: common path, rows between, 0 before and 1 after. Then the page itself if it must look on, from a block on.
FOUND = ("common", "away", "side", "gone")
SENT = ("look", "block", "common", "away", "n", "host", "path")
FOUND_TYPES = "common int, away long, side int, gone array<int>"
SEARCH_SCHEMA = pa.schema(
    [("common", pa.int32()), ("away", pa.int64()), ("side", pa.int32()), ("gone", pa.list_(pa.int32())), ("look", pa.int32()), ("block", pa.int64()), ("n", pa.int64())]
    + [("host", pa.string()), ("path", pa.string()), ("key", pa.string()), ("hashes", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int8())), ("sizes", pa.list_(pa.int32()))]
)
SEARCH_TYPES = f"{FOUND_TYPES}, look int, block long, n long, {PAGE_TYPES}"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h, strict=True)) for h in held], schema)
            held.clear()
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h, strict=True)) for h in held], schema)


def _searched(held: list[tuple], size: int) -> Iterator[tuple]:
    """What the pages of a block find in it and its borders, and the sides (look) on which they must look on beyond."""
    lines: list[dict | None] = [None] * len(held)
    first, last, stretch = 0, -1, None
    for i, (block, n, host, path, key, hashes, kinds, sizes) in enumerate(held):
        if i > last:  # the next host
            first, stretch = i, None
            last = next((j for j in range(i, len(held)) if held[j][2] != host), len(held)) - 1
        if n // size != block or not any(kinds):
            continue
        page = Page(hashes, kinds, sizes)
        found: list[tuple[int, int, int, int]] = []  # -common, away, side, row
        far = []
        for side, step in ((0, -1), (1, 1)):
            for j in range(i + step, i + step * (REACH + 1), step):
                if not first <= j <= last:
                    break
                if held[j][5]:
                    lines[j] = lines[j] or _weights(held[j][5], held[j][7])
                    if not page.copied(lines[j]):
                        found.append((-_common(path, held[j][3]), abs(j - i), side, j))
                        break
            else:
                far.append((side, step))
        look = []
        for side, step in far:  # rows beyond have no longer path in common than the last one seen
            if found and min(found)[:3] < (-_common(path, held[i + step * REACH][3]), REACH + 1, side):
                continue
            stretch = stretch or Stretch([(r[5], r[7]) for r in held[first : last + 1]])
            order = range(i - REACH - 1 - first, -1, -1) if step < 0 else range(i + REACH + 1 - first, last - first + 1)
            j = stretch.find(page, order)
            if j is not None:
                found.append((-_common(path, held[first + j][3]), abs(first + j - i), side, first + j))
        for side, edge, end in ((0, first, 0), (1, last, len(held) - 1)):
            if edge != end or held[end][1] // size == block or any(f[2] == side for f in found):
                continue  # the host ends here, or the table, as a block has rows of its neighbours
            if not found or min(found)[:3] > (-_common(path, held[edge][3]), abs(edge - i) + 1, side):
                look.append(side)
        best = min(found, default=None)
        gone = deleted(hashes, kinds, held[best[3]][5]) if best else None
        if gone or look:
            at = (-best[0], best[1], best[2], gone) if best else (None,) * 4
            for side in look or [None]:
                yield (*at, side, block, n, host, path, key, *((None,) * 3 if side is None else (hashes, kinds, sizes)))


def _paired(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks_of = _grouped(batches, ("block", "n", *PAGE), 1)
    yield from _batches((out for _, rows in blocks_of for out in _searched(list(rows), size)), SEARCH_SCHEMA)


SUMMARY_SCHEMA = pa.schema([("host", pa.string()), ("block", pa.int64()), ("ends", pa.binary()), ("centers", pa.binary())])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a host's rows in a block: number and path of the first and the last, and the centers, or null if these are many."""

    def found() -> Iterator[tuple]:
        for (block, host), rows in _grouped(batches, ("block", "host", "n", "path", "hashes", "sizes"), 2):
            held = list(rows)
            centers = Stretch([r[4:] for r in held]).centers
            yield host, block, pickle.dumps((held[0][2:4], held[-1][2:4])), pickle.dumps(centers) if len(centers) <= CENTERS else None

    yield from _batches(found(), SUMMARY_SCHEMA)


class Host:
    """The summaries of a host's blocks in order, and of 8, 64, ... of them together while these have few centers."""

    def __init__(self, blocks_of: list[tuple[int, bytes, bytes | None]]):
        self.blocks, self.ends = [b[0] for b in blocks_of], [b[1] for b in blocks_of]
        self.levels = [[b[2] for b in blocks_of]]
        while len(self.levels[-1]) >= 8:
            below = self.levels[-1]
            self.levels.append([self._merged(below[at : at + 8]) for at in range(0, len(below) - 7, 8)])

    @staticmethod
    def _merged(parts: list[bytes | None]) -> bytes | None:
        out: list[tuple[dict, int]] = []
        for part in parts:
            if part is None:
                return None
            for center, far in pickle.loads(part):
                for at, (known, reach) in enumerate(out):
                    lack = _missing(known, center)
                    if lack <= NEAR * sum(known.values()):
                        out[at] = (known, max(reach, lack + far))
                        break
                else:
                    out.append((center, far))
            if len(out) > CENTERS:
                return None
        return pickle.dumps(out)

    def possible(self, page: Page, look: int, block: int, read: dict) -> Iterator[int]:
        """The blocks before (look 0) or after this one that may hold a row that is no copy, nearest first, as places in the list."""
        at, step = (bisect_left(self.blocks, block) - 1, -1) if look == 0 else (bisect_right(self.blocks, block), 1)
        while 0 <= at < len(self.blocks):
            for level in range(len(self.levels) - 1, -1, -1):
                edge, size = at + (look == 0), 8**level
                node = at // size
                if edge % size or node >= len(self.levels[level]) or self.levels[level][node] is None:
                    continue
                packed = self.levels[level][node]
                if packed not in read:
                    if len(read) >= 256:
                        read.clear()
                    read[packed] = pickle.loads(packed)
                if page.all_copied(read[packed]):
                    at += step * size
                    break
            else:
                yield at
                at += step


def _sent(hosts, span: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001  a Broadcast
    """Pages that look on, with the next ``span`` blocks on their side that may hold a row that is no copy."""
    for b in batches:
        targets, read = [], {}
        for look, block, common, away, n, host, path, *lines_of in zip(*(b.column(c).to_pylist() for c in (*SENT, "hashes", "kinds", "sizes")), strict=True):
            page, out = Page(*lines_of), []
            there = hosts.value.get(host)
            for at in there.possible(page, look, block, read) if there else ():
                first, last = pickle.loads(there.ends[at])
                edge, name = first if look else last
                if common is not None and (-common, away, 1 - look) < (-_common(path, name), abs(edge - n), look):
                    break  # the partner on the other side is nearer
                out.append(there.blocks[at])
                if len(out) == span:
                    break
            targets.append(out)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(targets, pa.list_(pa.int64()))], [*b.schema.names, "targets"])


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partners that pages find in a block, and those that look on after the last block they were sent to. A block's rows come first, with no side to look."""

    def found() -> Iterator[tuple]:
        for (block, _), rows in _grouped(batches, ("target", "part", "look", "on", "common", "away", "n", *PAGE), 2):
            by_host: dict[str, list[tuple]] = {}
            ready: dict[str, Stretch] = {}
            for _, _, look, on, common, away, n, host, path, key, hashes, kinds, sizes in rows:
                if look < 0:
                    by_host.setdefault(host, []).append((n, path, hashes, sizes))
                    continue
                there = by_host[host]
                if host not in ready:
                    ready[host] = Stretch([r[2:] for r in there])
                j = ready[host].find(Page(hashes, kinds, sizes), range(len(there) - 1, -1, -1) if look == 0 else range(len(there)))
                if j is not None:
                    gone = deleted(hashes, kinds, there[j][2])
                    yield _common(path, there[j][1]), abs(n - there[j][0]), look, gone, None, block, n, host, path, key, None, None, None
                elif on:
                    yield common, away, None, None, look, block, n, host, path, key, hashes, kinds, sizes

    yield from _batches(found(), SEARCH_SCHEMA)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            gone = part.column("gone").to_pylist()
            texts = [text_of(x.as_py(), g) for x, g in zip(part.column("html"), gone, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )


def differences(pages: DataFrame, scratch: Scratch, size: int = ROWS) -> DataFrame:
    """(key, gone): the numbers of the lines that differencing deletes, for pages that lose any; key is the page's md5."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    slim = pages.select(host.alias("host"), path.alias("path"), _key().alias("key"), "html")
    slim = slim.mapInArrow(_parsed, PAGE_TYPES)
    rows = numbered(scratch.save(slim.dropDuplicates(["key"]), "lines"), ["host", "path", "key"], name="n")
    blocks_of = F.array_distinct(F.array(*[F.floor((F.col("n") + d) / size) for d in (-REACH, 0, REACH)]))
    dealt = rows.select(F.explode(blocks_of).alias("block"), "n", *PAGE)
    found = scratch.save(dealt.repartition("block").sortWithinPartitions("block", "n").mapInArrow(partial(_paired, size), SEARCH_TYPES), "found")
    looking = found.filter(F.col("look").isNotNull())
    if not looking.isEmpty():
        found = found.filter(F.col("gone").isNotNull()).select("key", *FOUND)
        for more in _beyond(rows, looking, scratch, size):
            found = found.unionByName(more.select("key", *FOUND))
        best = F.min_by("gone", F.struct(-F.col("common"), "away", "side"))
        found = found.groupBy("key").agg(best.alias("gone"))
    return found.filter(F.size("gone") > 0).select("key", "gone")


def _beyond(rows: DataFrame, looking: DataFrame, scratch: Scratch, size: int) -> Iterator[DataFrame]:
    """Partners in other blocks, for pages with a side on which all rows of their block are copies. Each round sends them to four times as
    many of the blocks that their summaries don't rule out, until each has found a partner or the end of its host.

    The driver holds the summaries of hosts that such pages belong to, SUMMARIES bytes at most beside the ends of each block.
    """
    sc = rows.sparkSession.sparkContext
    there = rows.join(looking.select("host").distinct(), "host", "left_semi").withColumn("target", F.floor(F.col("n") / size))
    there = scratch.save(there.select("target", "n", *PAGE), "hosts")
    made = there.withColumnRenamed("target", "block").filter(F.size("hashes") > 0).repartition("block").sortWithinPartitions("block", "n")
    kept: dict[str, list[tuple]] = {}
    made = scratch.save(made.mapInArrow(_summaries, "host string, block long, ends binary, centers binary"), "summaries")
    count, held = made.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("centers")), F.lit(0))).first()
    if held > SUMMARIES:
        made = made.withColumn("centers", F.when(F.length("centers") <= SUMMARIES // count, F.col("centers")))
    for r in made.collect():
        kept.setdefault(r["host"], []).append((r["block"], bytes(r["ends"]), bytes(r["centers"]) if r["centers"] else None))
    summaries = sc.broadcast({host: Host(sorted(x, key=lambda e: e[0])) for host, x in kept.items()})
    span = 1
    while True:
        sent = looking.select(*SENT[:5], *PAGE).mapInArrow(partial(_sent, summaries, span), f"look int, block long, common int, away long, n long, {PAGE_TYPES}, targets array<long>")
        sent = scratch.save(sent.filter(F.size("targets") > 0), "sent")
        if sent.isEmpty():
            return
        calls = sent.withColumn("target", F.explode("targets")).withColumn("part", F.floor(F.col("n") / (SPREAD * size)))
        calls = calls.withColumn("on", F.col("target") == F.element_at("targets", -1)).select("target", "part", "look", "on", "common", "away", "n", *PAGE)
        hosts = there.join(calls.select("target", "part", "host").distinct(), ["target", "host"])
        hosts = hosts.withColumns({"look": F.lit(-1), "on": F.lit(False), "common": F.lit(None).cast("int"), "away": F.lit(None).cast("long")})
        both = calls.unionByName(hosts.select(*calls.columns)).repartition("target", "part").sortWithinPartitions("target", "part", "look", "n")
        visited = scratch.save(both.mapInArrow(_visited, SEARCH_TYPES), "visited")
        found = visited.filter(F.col("gone").isNotNull())
        yield found
        named = found.select("n", F.col("side").alias("look")).distinct()
        looking = visited.filter(F.col("look").isNotNull()).join(named, ["n", "look"], "left_anti")
        span *= 4


def _key() -> Column:
    return F.md5(F.concat(F.coalesce("url", F.lit("")), F.lit("\0"), F.coalesce("html", F.lit(""))).cast("binary"))


def extract(pages: DataFrame, scratch: Scratch, size: int = ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null html gives an empty text, repeated rows equal texts.

    Pages without a URL form a host of their own. Pages equal in URL and html count once in the pairing. A page that has
    only copies on its host, or is alone there, loses only marked lines. The pairing goes by blocks of ``size`` rows, REACH at least.
    """
    gone = scratch.save(differences(pages, scratch, size), "gone")
    rows = pages.select("page_id", "url", "html", _key().alias("key"))
    if gone.isEmpty():
        rows = rows.withColumn("gone", F.lit(None).cast("array<int>"))
    else:
        rows = rows.join(F.broadcast(gone) if scratch.bytes_of(gone) <= BROADCAST else gone, "key", "left")
    return rows.select("page_id", "url", "html", "gone").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
