"""Main text of web pages, by nearest-URL page differencing.

A page's markup is read into lines, one for each block, each in a zone: chrome (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, as elements, roles or class and id words say so), declared (inside
``article`` or ``main``) or open (the rest). Every page is compared with its nearest page: within a host, pages are ordered by
URL path and id, neighbours are paired, the last of an odd number joining the pair before it; all their lines are aligned by
longest common subsequence, and shared lines go.

Zones mend what differencing alone gets wrong: paragraphs that two articles share are content, so shared lines in a declared zone stay; menus,
adverts and footers that change from page to page are chrome, so they go though nothing shares them. Inside ``article`` and ``main`` a class
or id word says so of containers only, not of paragraphs and headings. Every other line that differencing leaves stays.
A page whose open lines are all shared, as a copy's are, keeps them if nothing is declared.

Pages are ordered by thin rows of keys and line hashes, written once; a host's ranks come from a range-partitioned sort, so a host with a
third of all pages is spread over many tasks, and a pair is a group of two or three pages. Only line numbers that
differencing takes from open zones are joined back to the pages.

Cases: null and empty html gives an empty text, and so does a page of chrome alone. A null or malformed
URL has the empty host and path. Rows with a null id are kept; rows that repeat id, URL and html are one page in the order, and
each gets its row. An unclosed comment, script or tag ends with the page. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, shuffle_partitions, stored

# Elements that begin a block, elements that are never main text, and words of class and id that say so.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CHROME = frozenset("aside button datalist dialog footer form head menu nav select".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "object", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal"
    " nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar".split()
)
# Words that may stand beside one of these in a class or id without giving it another sense.
NEUTRAL = frozenset(
    "area article articles bar block body bottom box btn button buttons center col column container content footer form fixed global group header holder icons inner item items left level"
    " links list main media mobile outer page panel post posts primary right row secondary section site sticky stories sub thread top widget wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What a class word doesn't take out of an article: it names a style there.
TEXTS = HEADINGS | {"p"}
# A list item or cell ends an open one of its kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])[^>]*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[/a-z!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
OPEN, DECLARED, HEADER, FORM, OUT = range(5)
#: Pages with deleted lines up to which these are broadcast, and equal lines of two pages up to which each match is looked at.
FEW, MATCHES = 20_000, 1 << 16


def _chrome_words(value: str) -> bool:
    """Whether one of the names in a class or id consists of a word for chrome, perhaps with neutral ones."""
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if not WORDS.isdisjoint(parts) and all(p in WORDS or p in NEUTRAL for p in parts):
            return True
    return False


def _zone(name: str, rest: str, outer: int) -> int:
    """Zone of an element in a zone."""
    if outer == OUT and name != "main":
        return OUT
    if name in CHROME:
        return FORM if name == "form" and outer != OUT else OUT
    inner = DECLARED if name in ("article", "main") else outer
    if "=" in rest:
        for key, *value in _NAMED.findall(rest):
            value = "".join(value)
            if key.lower() == "role":
                if value.strip().lower() in ROLES:
                    return OUT
                if value.strip().lower() == "main":
                    inner = DECLARED
            elif name not in ("html", "body", "main") and not (outer == DECLARED and name in TEXTS) and _chrome_words(value):
                return OUT
    if name == "header":
        return HEADER if outer in (DECLARED, HEADER) else OUT
    if outer == HEADER and inner == HEADER:
        return DECLARED if name in HEADINGS else HEADER
    return inner


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """(lines, their zones) of a page, in page order, white space as single spaces."""
    lines: list[str] = []
    zones: list[int] = []
    stack: list[tuple[str, int]] = []
    zone, part, at = OPEN, [], 0

    def close() -> None:
        text = " ".join("".join(part).split())
        part.clear()
        if text:
            lines.append(text)
            zones.append(zone)

    for m in _MARKUP.finditer(html):
        if m.start() > at:
            text = html[at : m.start()]
            part.append(unescape(text) if "&" in text else text)
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name in VOID:
            if name == "br":
                part.append(" ")
            elif name == "hr":
                close()
            continue
        if m["end"]:
            if name in BLOCKS:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in BLOCKS and any(s in BLOCKS for s, _ in stack[k + 1 :]):
                        break  # an inline element's end doesn't close blocks
                    if stack[k][1] != zone:
                        close()
                    zone = stack[k][1]
                    del stack[k:]
                    break
            continue
        block = name in BLOCKS
        if block:
            close()
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(name, ())):
                zone = stack.pop()[1]
        inner = _zone(name, m["rest"] or "", zone)
        if inner != zone:
            close()
        if block or inner != zone:
            if not (m["rest"] or "").endswith("/") or block:
                stack.append((name, zone))
                zone = inner
    if at < len(html):
        text = html[at:]
        part.append(unescape(text) if "&" in text else text)
    close()
    return lines, zones


def main_text(lines: list[str], zones: list[int], gone: set[int] | frozenset[int] = frozenset()) -> str:
    """The lines of a page that are left, declared or open; gone: the numbers of open lines that differencing deletes."""
    return "\n".join(x for k, (x, z) in enumerate(zip(lines, zones, strict=True)) if z == DECLARED or (z == OPEN and k not in gone))


def shared_open(codes: list[np.ndarray], zones: list[list[int]]) -> list[list[int]]:
    """Of neighbouring pages, given as line hashes and zones, the numbers of the open lines that differencing deletes."""
    shared: list[set[int]] = [set() for _ in codes]
    for k in range(len(codes) - 1):
        i, j = shared_lines(codes[k], codes[k + 1])
        shared[k] |= set(i)
        shared[k + 1] |= set(j)
    out = []
    for gone, zone in zip(shared, zones, strict=True):
        open_ = {k for k, z in enumerate(zone) if z == OPEN}
        whole = open_ <= gone and DECLARED not in zone
        out.append([] if whole else sorted(gone & open_))
    return out


def _last_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each prefix of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def shared_lines(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Indices in a and in b of a longest common subsequence."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    i, j = list(range(start)), list(range(start))
    x, y = a[start : len(a) - stop], b[start : len(b) - stop]
    if len(x) and len(y):
        places: dict[int, list[int]] = {}
        for k, h in enumerate(y.tolist()):
            places.setdefault(h, []).append(k)
        if sum(len(places.get(h, ())) for h in x.tolist()) <= MATCHES:
            pairs = _by_matches(x.tolist(), places)
        elif len(x) == 1:
            pairs = [(0, places[int(x[0])][0])]
        else:
            # Very many equal lines: halve a and split b where both halves together have most in common.
            mid = len(x) // 2
            cut = int(np.argmax(_last_rows(x[:mid], y) + _last_rows(x[:mid - 1 if mid else None : -1], y[::-1])[::-1]))
            (i1, j1), (i2, j2) = shared_lines(x[:mid], y[:cut]), shared_lines(x[mid:], y[cut:])
            pairs = [*zip(i1, j1, strict=True), *((p + mid, q + cut) for p, q in zip(i2, j2, strict=True))]
        i += [start + p for p, _ in pairs]
        j += [start + q for _, q in pairs]
    i += range(len(a) - stop, len(a))
    j += range(len(b) - stop, len(b))
    return i, j


def _by_matches(a: list[int], places: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Longest increasing run of matching places: each match extends the best shorter run that ends before it."""
    ends: list[int] = []
    tops: list[int] = []
    matches: list[tuple[int, int, int]] = []
    for i, h in enumerate(a):
        for j in reversed(places.get(h, ())):
            k = bisect_left(ends, j)
            matches.append((i, j, tops[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                tops.append(len(matches) - 1)
            else:
                ends[k], tops[k] = j, len(matches) - 1
    out, at = [], tops[-1] if tops else -1
    while at >= 0:
        i, j, at = matches[at]
        out.append((i, j))
    return out[::-1]


def _pairs(pages: DataFrame) -> DataFrame:
    """pages (id, url, digest, ...) with ``host`` and ``pair``: neighbours by path share a pair's number."""
    n = shuffle_partitions(pages.sparkSession)
    url = F.coalesce("url", F.lit(""))
    keyed = pages.withColumn("host", F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))).withColumn(
        "path", F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    )
    order = ["host", "path", "id", "url", "digest"]
    # The id's upper bits number the partition, the lower 33 the row in it.
    ordered = stored(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "page-order")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.withColumn("part", part).withColumn("row", row)
    # One row for each partition that a host reaches into.
    reach = ordered.groupBy("host", "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    line = Window.partitionBy("host").orderBy("part")
    reach = reach.withColumn("before", F.sum("rows").over(line) - F.col("rows")).withColumn("all", F.sum("rows").over(Window.partitionBy("host")))
    ranked = ordered.join(reach, ["host", "part"]).withColumn("rank", F.col("before") + F.col("row") - F.col("first"))
    last = F.greatest(F.floor(F.col("all") / 2) - 1, F.lit(0))
    return ranked.withColumn("pair", F.least(F.floor(F.col("rank") / 2), last))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars."""
    from xxhash import xxh64_intdigest

    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.md5("html"))

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            codes, zones = [], []
            for html in batch.column("html"):
                lines, zone = page_lines(html.as_py())
                codes.append(np.array([xxh64_intdigest(x) for x in lines], np.uint64).view(np.int64))
                zones.append(bytes(zone))
            found = [pa.array(codes, pa.list_(pa.int64())), pa.array(zones, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url", "digest")), *found], ["id", "url", "digest", "codes", "zones"])

    thin = rows.mapInArrow(hashed, f"id {id_type}, url string, digest string, codes array<long>, zones binary")
    # Written once, as sorting by range would read the pages again to find its bounds.
    thin = stored(thin.groupBy("id", "url", "digest").agg(F.first("codes").alias("codes"), F.first("zones").alias("zones")), "page-lines")

    def difference(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            told: list[tuple] = []
            for members in batch.column("members").to_pylist():
                members.sort(key=lambda m: m["rank"])
                gone = shared_open([np.array(m["codes"], np.int64) for m in members], [list(m["zones"]) for m in members])
                told += [(m["id"], m["url"], m["digest"], g) for m, g in zip(members, gone, strict=True) if g]
            kind = batch.schema.field("members").type.value_type.field("id").type
            columns = zip(*told, strict=True) if told else ((), (), (), ())
            types = (kind, pa.string(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["own_id", "own_url", "own_digest", "gone"])

    # Two or three pages at most share a pair.
    pairs = _pairs(thin).groupBy("host", "pair").agg(F.collect_list(F.struct("rank", "id", "url", "digest", "codes", "zones")).alias("members"))
    told = checkpointed(pairs.select("members").mapInArrow(difference, f"own_id {id_type}, own_url string, own_digest string, gone array<int>"))
    same = F.col("id").eqNullSafe(F.col("own_id")) & F.col("url").eqNullSafe(F.col("own_url")) & (F.col("digest") == F.col("own_digest"))

    def left(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = [main_text(*page_lines(html.as_py()), set(gone.as_py() or ())) for html, gone in zip(batch.column("html"), batch.column("gone"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    # Mostly zones drop what is shared, too; then pages needn't move.
    few = told.limit(FEW + 1).count()
    joined = rows.join(F.broadcast(told) if few <= FEW else told, same, "left") if few else rows.withColumn("gone", F.lit(None).cast("array<int>"))
    compared = joined.select("id", "url", "html", "gone").mapInArrow(left, f"id {id_type}, url string, text string")
    return compared.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
