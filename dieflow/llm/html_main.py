"""Main text of web pages by differencing pages with nearby URLs.

Every page is cut into text lines.  Within each host the pages are put in the
order of their paths, each is aligned by the longest common subsequence of
lines with the pages 1, 2 and 4 places before and after it, and lines that most
of these have too go, as menus, notices and footers do.  Empty pages say
nothing and are left out, and pages of a host with the very same lines count as
one, so every neighbour differs.  A page that would be left with nothing is
among copies of itself; it is aligned with pages further off instead.

Differencing alone errs in two ways: adverts that rotate differ from page to
page, and passages that many articles quote agree.  A check of the markup
settles both: a line inside an article or main element goes only if all of at
least MANY neighbours have it, and lines in landmarks of other kinds go though
unshared.

Pages are parsed once, into a table of their lines.  Only hashes of lines
travel between pages: the table is range-sorted by host and path and numbered,
and runs of CHUNK numbers, with the few pages beside them, are aligned in a
group each, so a host with a third of all pages is spread like any other.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dieflow.llm.common import cut, map_batches
from dieflow.llm.urlfilter import host_of, path_of

#: Fixed values of HTML: elements without content, with raw content, and that never break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe canvas select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements and ARIA roles that hold something other than the main text, or hold it.
LANDMARKS = frozenset("nav header footer aside form dialog menu button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary form search dialog alert menu menubar".split())
MAIN = frozenset(("article", "main"))
#: Words of class and id names that mark what isn't main text, and words that may stand beside them.  A name marks an element if it has one of the first and no word of neither kind: "share-buttons" does, "share-prices" doesn't.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu sidebar aside header masthead topbar footer comment comments commentlist disqus replies notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar hidden".split()
)
BESIDE = frozenset(
    "a and bar block bottom box button buttons container desktop first form global group head holder icon icons id inner item items js last left link links list main message mobile module outer page panel policy posts primary reply row secondary section sidebar site slot small stories sticky text top unit user widgets wrap wrapper area right side skip tags the".split()
)
#: Places between a page and its neighbours; how many of them must all have a line inside an article for it to go; pages of a group.
PLACES, MANY, CHUNK = (1, 2, 4), 4, 1024
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[^a-z]+")
_ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _aside(tag: str, attributes: str) -> bool:
    """Whether an element holds something other than main text."""
    if tag in LANDMARKS:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if (m := _ROLE.search(attributes)) and m[1].lower() in ROLES or _HIDDEN.search(attributes):
        return True
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [w for w in _WORDS.split(name) if w]
            if any(w in MARKS for w in parts) and all(w in MARKS or w in BESIDE for w in parts):
                return True
    return False


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside the main text's element, inside something else) of every line, in page order.

    A line is what lies between block boundaries: references decoded, white
    space collapsed, ends trimmed; scripts, styles and comments have none.
    """
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, main, aside
    open_: Counter[str] = Counter()
    text: list[str] = []
    main = aside = strange = 0  # open elements of each kind; strange are those aside but for headers

    def flush(heading: bool = False) -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                # Inside an article, a header is the article's own: its headings belong to it.
                own = heading and main and not strange
                out.append((line, bool(main), bool(aside) and not own))

    def push(name: str, m: bool, a: bool) -> None:
        nonlocal main, aside, strange
        stack.append((name, m, a))
        open_[name] += 1
        main += m
        aside += a
        strange += a and name != "header"

    def pop() -> None:
        nonlocal main, aside, strange
        name, m, a = stack.pop()
        open_[name] -= 1
        main -= m
        aside -= a
        strange -= a and name != "header"

    at, n = 0, len(page)
    lower = None
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            text.append(page[at:])
            break
        m = _TOKEN.match(page, tag)
        if not m:
            text.append(page[at : tag + 1])
            at = tag + 1
            continue
        if tag > at:
            text.append(page[at:tag])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE and not open_[name]:
                continue
            flush(name in HEADINGS)
            if open_[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            lower = lower or page.lower()
            if len(lower) != n:  # lowering changed the length: look for the end as written
                end = re.compile(f"</{name}", re.I).search(page, at)
                at = end.start() if end else n
            else:
                end = lower.find(f"</{name}", at)
                at = end if end >= 0 else n
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        off = _aside(name, m[3])
        if name in INLINE:
            if off:
                flush()
                push(name, False, True)
            continue
        flush()
        if stack and stack[-1][0] in ("p", "li", "dt", "dd", "td", "th") and stack[-1][0] == name:
            pop()
        # Paragraphs and the like need no end tag; they are followed only where they matter.
        if off or name in MAIN or name in ("div", "section", "ul", "ol", "dl", "table", "body", "figure", "blockquote", "details"):
            push(name, name in MAIN, off)
    flush()
    return out


def _chain(a: list[int], b: list[int]) -> list[int]:
    """Places in a that a longest common subsequence with b takes, in time that follows the number of equal pairs."""
    where = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        where[b[j]].append(j)
    # A common subsequence is a chain of matches that rises in both; the last match of each length is kept.
    ends: list[int] = []
    last: list[tuple[int, object]] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[k], last[k] = j, link
    out, link = [], last[-1] if last else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of a with each beginning of b, a line of a at a time for all of b."""
    n = len(b)
    full = (1 << n) - 1
    bits = defaultdict(lambda: bytearray((n + 7) // 8))
    for j, x in enumerate(b):
        bits[x][j >> 3] |= 1 << (j & 7)
    at = {x: int.from_bytes(y, "little") for x, y in bits.items()}
    row = full  # a bit is 0 where the length rises
    for x in a:
        if m := at.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    rises = 1 - np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), dtype=np.uint8), bitorder="little", count=n)
    return np.concatenate([[0], np.cumsum(rises, dtype=np.int64)])


def _common(a: list[int], b: list[int]) -> list[int]:
    """Places in a that a longest common subsequence with b takes.

    Where many lines are equal, a is halved and b cut where the two halves'
    lengths add up to most, until few equal pairs are left.
    """
    seen = Counter(b)
    equal = sum(seen[x] for x in a)
    if not equal:
        return []
    if equal <= 64 * (len(a) + len(b)) or len(a) == 1:
        return _chain(a, b)
    half = len(a) // 2
    k = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return [*_common(a[:half], b[:k]), *(half + i for i in _common(a[half:], b[k:]))]


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's lines the longest common subsequence with b takes, as a mask (of equal ones, one choice)."""
    taken = np.zeros(len(a), dtype=bool)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    taken[:head] = True
    taken[len(a) - tail :] = True
    inner = _common(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist())
    taken[[head + i for i in inner]] = True
    return taken


def deleted(pages: list[tuple[np.ndarray, np.ndarray]], at: int, first: int, end: int) -> list[int]:
    """Which of a page's lines outside landmarks go, by their place among these.

    pages are the (lines, flags) of neighbouring pages in order, of which
    [first, end) are the page's own host's.
    """
    lines, flags = pages[at]
    inside, own = (flags & 1).astype(bool), ~(flags & 2).astype(bool)

    def against(places: Iterable[int]) -> np.ndarray:
        near = [at + o for p in places for o in (-p, p) if first <= at + o < end]
        votes = sum((shared_lines(lines, pages[k][0]).astype(int) for k in near), np.zeros(len(lines), dtype=int))
        return own & (votes > 0) & np.where(inside, (votes == len(near)) & (len(near) >= MANY), 2 * votes > len(near))

    gone = against(PLACES)
    if gone.any() and gone[own].all():
        further = [1 << k for k in range(3, CHUNK.bit_length()) if first <= at - (1 << k) or at + (1 << k) < end]
        gone = against(further) if further else gone
        if gone[own].all() and inside[own].any():
            gone &= ~inside
    return np.flatnonzero(gone[own]).tolist()


def parsed(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, host and path of pages with html, and each page's texts (of lines outside landmarks), and hashes and flags (1 inside an article, 2 in a landmark) of all its lines."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [lines(h or "") for h in batch.column(4).to_pylist()]
        texts = pa.array([[t for t, _, off in x if not off] for x in found], pa.list_(pa.string()))
        hashes = pa.array([[xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, _, _ in x] for x in found], pa.list_(pa.int64()))
        flags = pa.array([bytes(m + 2 * off for _, m, off in x) for x in found], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:4], texts, hashes, flags], names=["page_id", "url", "host", "path", "texts", "lines", "flags"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema[:4])
    return map_batches(pages, run, f"{kinds}, texts array<string>, lines array<bigint>, flags binary", rows=64)


def _numbered(pages: DataFrame) -> DataFrame:
    """pages in the order of host, path and row, with n, their gapless number in it."""
    part = F.spark_partition_id()
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    order = ("host", "path", "row")
    placed = cut(pages.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part.alias("part"), place.alias("place")), "pages")
    first, offsets = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):  # one row a partition
        offsets.append((r[0], first))
        first += r[1]
    start = pages.sparkSession.createDataFrame(offsets, "part int, first long")
    return placed.join(F.broadcast(start), "part").withColumn("n", F.col("first") + F.col("place")).drop("part", "place", "first")


def deletions(pages: DataFrame) -> DataFrame:
    """(row, gone) of rows (row, host, path, lines, flags) that lose lines outside landmarks: whether each of such lines goes.

    Pages of a host with the very same lines and flags are one page, at the
    first of their paths, before any are numbered; what goes goes in all of them.
    """
    least = pages.groupBy("host", "lines", "flags").agg(F.min(F.struct("path", "row")).alias("at"))
    near = _numbered(cut(least.select("at.row", "host", "at.path", "lines", "flags"), "distinct")).drop("path")
    halo = max(PLACES)
    own, place = F.floor(F.col("n") / CHUNK), F.pmod("n", F.lit(CHUNK))
    beside = F.when(place < halo, own - 1).when(place >= CHUNK - halo, own + 1)
    dealt = near.withColumn("chunk", own).unionAll(near.withColumn("chunk", beside).where("chunk >= 0"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        hosts, ns, chunk = group.column("host").to_pylist(), group.column("n").to_pylist(), group.column("chunk")[0].as_py()
        held = [(np.array(x, dtype=np.int64), np.frombuffer(f, dtype=np.uint8)) for x, f in zip(group.column("lines").to_pylist(), group.column("flags").to_pylist())]
        at, gone, start = [], [], 0
        while start < len(hosts):
            end = start
            while end < len(hosts) and hosts[end] == hosts[start]:
                end += 1
            for k in range(start, end):
                if ns[k] // CHUNK == chunk and (found := deleted(held, k, start, end)):
                    mask = np.zeros(int((held[k][1] & 2 == 0).sum()), dtype=bool)
                    mask[found] = True
                    at.append(k)
                    gone.append(mask)
            start = end
        few = group.take(pa.array(at, pa.int64()))
        return pa.table({"host": few.column("host"), "lines": few.column("lines"), "flags": few.column("flags"), "gone": pa.array(gone, pa.list_(pa.bool_()))})

    found = cut(dealt.groupBy("chunk").applyInArrow(run, "host string, lines array<bigint>, flags binary, gone array<boolean>"), "gone")
    return pages.join(found, ["host", "lines", "flags"]).select("row", "gone")


def main_text(page: str | None) -> str:
    """The main text of a page that has no neighbours."""
    return " ".join(t for t, _, off in lines(page or "") if not off)


def extract(pages: DataFrame, url: str = "url", page: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null and empty pages have an empty text.  Null urls and urls without ://
    share the empty host.  Repeated rows count as one page for pairing and all
    come out.  Other columns are ignored, so their names can't clash.  The cost
    grows with a page's length; pages of very many equal lines cost more, by a
    64th of the square of their number.
    """
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(page).cast("string").alias("html"))
    read = cut(parsed(given).withColumn("row", F.monotonically_increasing_id()), "lines", "zstd")
    # Written first, so that Spark knows its size when it chooses the join.
    gone = cut(deletions(read.where(F.size("lines") > 0).select("row", "host", "path", "lines", "flags")), "deletions")
    staying = F.transform(F.filter(F.arrays_zip("texts", "gone"), lambda x: ~x["gone"]), lambda x: x["texts"])
    kept = F.when(F.col("gone").isNull(), F.col("texts")).otherwise(staying)
    text = F.array_join(kept, " ")
    return read.select("page_id", "url", "row", "texts").join(gone, "row", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
