"""HTML extraction by nearest-URL page differencing.

A page is read into text lines (one for each block). Pages of a host are sorted by URL path; a page is compared with the pages before and
after it, the longest common subsequence of their lines is aligned, and shared lines are deleted as template. Menus, adverts and the
like that differ from page to page can't be found that way, so blocks inside elements that say what they are (nav, footer,
class "ad", ...) go first, and lines inside <article> stay even if a neighbour has them: there they are quotations and copies, not template.
Every other line, in <main> or outside, on a page with an <article> or without, stays unless a neighbour shares it.

Neighbours are found on light rows by a range partitioning of (host, path), never by gathering a host: each range looks
at its own rows, and only the ends of ranges are stitched. What is exchanged about neighbours are line hashes, not pages; each page's lines travel once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read, small_batches
from .url_filter import split_url

# Elements and names that mark what isn't main text.
RAW = frozenset("script style title textarea noscript template iframe svg math object select xmp noembed noframes".split())
ASIDE = frozenset("nav header footer aside form menu dialog button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar notice notices cookie cookies consent banner gdpr popup modal overlay newsletter subscribe subscription signup login "
    "comment comments reply replies respond disqus share sharing social form".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[^a-z0-9]+")

#: Kinds of lines: template by its element, plain, inside the article.
TEMPLATE, PLAIN, ARTICLE = 0, 1, 2


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Does the element say that it isn't main text?"""
    if tag in ASIDE:
        return True
    if tag in ("html", "body", "main") or (tag == "article" and not in_article) or not attributes:
        return False
    for name, a, b, c in _NAME.findall(attributes):
        words = set(_PART.split((a or b or c).lower()))
        if words & (ROLES if name.lower() == "role" else NAMES):
            return True
    return False


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The page's non-empty blocks in order, as (text, kind): character references decoded, white space made single blanks.

    Broken markup is taken as it comes: an end tag closes the nearest open element of its name, or nothing.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, template, article
    template = article = False

    def flush() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, TEMPLATE if template else ARTICLE if article else PLAIN))

    page = page or ""
    at, skip_to = 0, 0
    open_now: Counter[str] = Counter()
    for m in _TAG.finditer(page, 0, page.rfind(">") + 1):  # nothing after the last '>' is a tag
        if m.start() < skip_to:
            continue
        at = max(at, skip_to)
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):  # never closed
                skip_to = len(page)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            while open_now[tag]:  # closes the nearest open element of its name and those inside
                name = stack[-1][0]
                if name in BLOCKS:
                    flush()
                stack.pop()
                open_now[name] -= 1
                if name == tag:
                    _, template, article = stack[-1] if stack else ("", False, False)
                    break
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                skip_to = end.end() if end else len(page)
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
        else:
            if tag in BLOCKS:
                flush()
                if tag != "p" and stack and stack[-1][0] == "p" or tag == "p" and open_now["p"]:
                    while stack and stack[-1][0] != "p":  # an open paragraph ends where a block begins
                        if stack[-1][0] in BLOCKS:
                            break
                        open_now[stack.pop()[0]] -= 1
                    if stack and stack[-1][0] == "p":
                        open_now[stack.pop()[0]] -= 1
            _, template, article = stack[-1] if stack else ("", False, False)
            template = template or _marked(tag, m[3], article)
            article = article or tag == "article"
            stack.append((tag, template, article))
            open_now[tag] += 1
    at = max(at, skip_to)
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def shared_positions(mine: list[int], other: list[int]) -> list[int]:
    """Positions in ``mine`` of a longest common subsequence with ``other``.

    Common ends are taken first. Between them rows of the table of lengths are bit vectors (a clear bit where the length grows), one whole-number addition a line, so
    equal lines in any number cost no more than others. Every so many rows are kept and the ones between made again on the way back, so memory is a root of the table.
    """
    head = 0
    while head < min(len(mine), len(other)) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(mine), len(other)) - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    a, b = mine[head : len(mine) - tail], other[head : len(other) - tail]
    common = set(a) & set(b)
    kept = [i for i, x in enumerate(a) if x in common]  # lines that only one page has can't be shared
    b = [x for x in b if x in common]
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    step = isqrt(len(kept)) + 1

    def rows(row: int, part: list[int]) -> Iterator[int]:
        for i in part:
            met = row & places[a[i]]
            row = (row + met | row & ~places[a[i]]) & full
            yield row

    starts, row = [full], full
    for lo in range(0, len(kept), step):
        for row in rows(row, kept[lo : lo + step]):
            pass
        starts.append(row)
    found: list[int] = []
    grown = ~starts[-1] & full
    at = grown.bit_length() - 1  # the last line of ``other`` where the length grows
    for block in range(len(starts) - 2, -1, -1):
        part = kept[block * step : (block + 1) * step]
        made = [starts[block], *rows(starts[block], part)]
        for k in range(len(part), 0, -1):
            if at >= 0 and made[k - 1] >> at & 1:  # grows there from this row on: the lines match
                found.append(head + part[k - 1])
                at = (~made[k - 1] & ((1 << at) - 1)).bit_length() - 1
    return [*range(head), *reversed(found), *range(len(mine) - tail, len(mine))]


def neighbours(rows: DataFrame) -> DataFrame:
    """(host, path, key) rows with ``before`` and ``after``: the keys next to each in its host by path, or null.

    Ranges of the sort order are windows of their own; the last row of the range before and the first of the range after come from one row a range.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "path", "key").withColumn("__r", F.spark_partition_id())
    ranged = cut(ranged)
    order = W.partitionBy("__r").orderBy("host", "path", "key")
    one = lambda c: F.struct("host", "path", "key").alias(c)
    ends = ranged.groupBy("__r").agg(F.min(one("x")).alias("first"), F.max(one("x")).alias("last"))
    by_range = W.partitionBy(F.lit(0)).orderBy("__r")  # one row a range
    ends = ends.select("__r", F.lag("last").over(by_range).alias("__b"), F.lead("first").over(by_range).alias("__a"))
    near = ranged.withColumns({"__p": F.lag(one("x")).over(order), "__n": F.lead(one("x")).over(order)}).join(F.broadcast(ends), "__r")  # one row a range
    same = lambda c: F.when(c["host"].eqNullSafe(F.col("host")), c["key"])
    return near.select("host", "path", "key", same(F.coalesce("__p", "__b")).alias("before"), same(F.coalesce("__n", "__a")).alias("after"))


def _line_hashes(batches):
    for b in batches:
        found = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in lines_of(page)] for page in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int64()))], [*b.schema.names[:-1], "hashes"])


def _kept_lines(batches):
    """Lines that aren't template by their element, packed: the text is the only large thing that travels."""
    for b in batches:
        found = []
        for page in b.column("html").to_pylist():
            lines = [f"{i}\t{k}\t{t}" for i, (t, k) in enumerate(lines_of(page)) if k != TEMPLATE]
            found.append(zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], [*b.schema.names[:-1], "packed"])


def _texts(batches):
    for b in batches:
        found = []
        for packed, shared in zip(b.column("packed").to_pylist(), b.column("shared").to_pylist(), strict=True):
            rows = [x.split("\t", 2) for x in zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if x]
            gone = set(shared)
            found.append("\n".join(t for i, k, t in rows if k == str(ARTICLE) or int(i) not in gone))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])


def _shared(batches):
    for b in batches:
        found = []
        for mine, *others in zip(*(b.column(c).to_pylist() for c in ("hashes", "before", "after")), strict=True):
            found.append(sorted({i for other in others if other for i in shared_positions(mine, other)}))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.list_(pa.int32()))], ["key", "shared"])


def page_key(key: Column, url: Column, html: Column) -> Column:
    """Tells pages apart even if they repeat an id."""
    return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.xxhash64(url, html).cast("string"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of (page_id, url, html) rows: the lines that are left, joined by newlines.

    Null or empty pages have an empty text; a page alone in its host has no neighbour and loses only template elements;
    pages without host share the empty host. Repeated rows each get their row. Lines inside an <article> stay though a neighbour shares them.
    """
    small_batches(pages.sparkSession)
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", "url", "html").withColumn("key", page_key(F.col("page_id"), F.col("url"), F.col("html")))
    hashes = cut(pages.select("key", host.alias("host"), path.alias("path"), "html").mapInArrow(_line_hashes, "key string, host string, path string, hashes array<long>").dropDuplicates(["key"]))
    near = neighbours(hashes.select("host", "path", "key")).select("key", F.col("before").alias("b"), F.col("after").alias("a"))
    side = lambda k, name: hashes.select(F.col("key").alias(k), F.col("hashes").alias(name))
    near = near.join(side("b", "before"), "b", "left").join(side("a", "after"), "a", "left").join(hashes.select("key", "hashes"), "key")
    shared = near.select("key", "hashes", "before", "after").mapInArrow(_shared, "key string, shared array<int>")
    lines = pages.select(F.col("page_id").cast("long"), "url", "key", "html").mapInArrow(_kept_lines, "page_id long, url string, key string, packed binary")
    return lines.join(shared, "key").select("page_id", "url", "packed", "shared").mapInArrow(_texts, "page_id long, url string, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, repeated rows and null pages included; see :func:`extract`."""
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
