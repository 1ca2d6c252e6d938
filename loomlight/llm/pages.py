"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one per block. Pages with any text are put in order of host, path and page_id; a page's
partner is its predecessor or successor of the same host, whichever path shares more leading directories, then more
leading characters, and the predecessor if both do alike. No other page of the host shares more characters. The lines
of a pair are aligned by their longest common subsequence, and shared lines outside of article and main elements are
deleted: menus and footers that pages have in common go by that, whatever their markup.

Structure settles what differencing leaves: lines of an article or main element stay even if another page repeats
them, and lines of menus, headers, footers, sidebars, notices, adverts, forms and reader comments go even if each page
has its own. A page that differencing would leave empty (its pair is a copy) keeps its undecided lines. n_differenced
and n_structural count the lines that each of the two removed.

The order is cut into ranges, each of which also gets the last row before and the first row after it, so a host with a
third of all pages is never gathered, and a page is the partner of two others at most; pairs exchange 8-byte hashes of
lines, not texts.

Defined cases: null or empty html gives an empty text; a null url shares the empty host; a page alone in its host has
no partner and keeps its undecided lines; pages of any length are cut whole; of equally near pages the predecessor is
the partner, of several longest common subsequences one is taken, the same on each run; repeated rows are extracted alike and have one place, that of their smallest host and path; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, prepare, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|</?[a-z!][^>]*\Z""", re.S | re.I)
# HTML elements by role.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav footer aside form button dialog menu head fieldset".split())
MAIN = {"article", "main"}
#: Words in class, id or role that name boilerplate.
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|footer|masthead|menu|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|sidebar|site-header|sponsor\w*|subscribe|complementary|contentinfo)(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
UNDECIDED, CONTENT, DROPPED = 0, 1, 2


def lines(page: str | None) -> list[tuple[str, int]]:
    """Text lines of a page in order, each with what its structure says."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []

    def role() -> int:
        return stack[-1][1] if stack else UNDECIDED

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, role()))

    at = 0
    page = page or ""
    for m in TOKEN.finditer(page):
        held.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        named = attributes and not closing and any(NAMED.search(next(v for v in a if v)) for a in ATTRIBUTE.findall(attributes) if any(a))
        if name in INLINE and not named and (not closing or not any(n == name and r != UNDECIDED for n, r in stack)):
            continue
        flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == name and name in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):
            stack.pop()
        now = role()
        if now == DROPPED or name in BOILERPLATE or named or (name == "header" and now != CONTENT):
            now = DROPPED
        elif name in MAIN:
            now = CONTENT
        stack.append((name, now))
    held.append(page[at:])
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    chain: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    out, at = set(), chain[-1] if chain else None
    while at:
        out.add(at[0])
        at = at[1]
    return out


def decided(page: list[tuple[str, int]], own: list[int], partner: list[int] | None) -> tuple[str, int, int]:
    """A page's main text, and how many lines differencing and structure removed from it."""
    shared = common_lines(own, partner) if partner else set()
    outside = [i for i, (_, r) in enumerate(page) if r != CONTENT]
    differenced = [i for i in outside if i in shared]
    structural = [i for i in outside if i not in shared and page[i][1] == DROPPED]
    gone = {*differenced, *structural}
    if len(gone) == len(page):  # a copy: what only differencing speaks against comes back
        differenced = [i for i in differenced if page[i][1] == DROPPED]
        gone = {*differenced, *structural}
    return " ".join(t for i, (t, _) in enumerate(page) if i not in gone), len(differenced), len(structural)


def main_text(page: list[tuple[str, int]], own: list[int], partner: list[int] | None) -> str:
    return decided(page, own, partner)[0]


def _hashes(page: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in page]


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each page's lines: all that pairing needs."""
    for b in batches:
        hashes = [_hashes(lines(h)) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("page_id", "host", "path")), pa.array(hashes, pa.list_(pa.int64()))], ["page_id", "host", "path", "hashes"])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's lines, compressed for the way to their partner's hashes."""
    c = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [c.compress(json.dumps(lines(h), ensure_ascii=False).encode("utf-8", "surrogatepass")) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(packed, pa.binary())], ["page_id", "url", "packed"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for b in batches:
        made = []
        for packed, partner in zip(b.column("packed").to_pylist(), b.column("partner_hashes").to_pylist(), strict=True):
            page = [(t, r) for t, r in json.loads(d.decompress(packed).decode("utf-8", "surrogatepass"))]
            made.append(decided(page, _hashes(page), partner))
        texts = [t for t, _, _ in made]
        counts = {"n_chars": [len(t) for t in texts], "n_differenced": [n for _, n, _ in made], "n_structural": [n for _, _, n in made]}
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts.values())], ["page_id", "url", "text", *counts])


def _nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def shared(a: str, b: str | None) -> tuple[int, int]:
        if b is None:
            return -1, -1
        same = commonprefix((a, b))
        return same.count("/"), len(same)

    for b in batches:
        rows = zip(*(b.column(n).to_pylist() for n in ("path", "before", "before_path", "after", "after_path")), strict=True)
        mate = [after if shared(path, after_path) > shared(path, before_path) else before for path, before, before_path, after, after_path in rows]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(mate, pa.int64())], ["page_id", "mate"])


def _partners(light: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, mate) for the pages of light(host, path, page_id), page_id distinct, whose host has another page."""
    row = F.struct("host", "path", "page_id")
    ranges = scratch.keep(light.repartitionByRange("host", "path", "page_id").select(row.alias("row"), F.spark_partition_id().alias("part"), F.lit(True).alias("own")), "page-order")
    # one row a range, whose number is that of the shuffle's partitions
    bounds = ranges.groupBy("part").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    order = Window.orderBy("lo")
    bounds = bounds.select("part", F.array(F.lag("hi").over(order), F.lead("lo").over(order)).alias("rows")).select("part", F.explode("rows").alias("row")).where("row IS NOT NULL")
    order = Window.partitionBy("part").orderBy("row")
    beside = ranges.unionByName(bounds.withColumn("own", F.lit(False))).select("row", "own", F.lag("row").over(order).alias("p"), F.lead("row").over(order).alias("n")).where("own")
    sides = [F.when(F.col(f"{c}.host") == F.col("row.host"), F.col(f"{c}.{x}")).alias(name) for c, side in (("p", "before"), ("n", "after")) for x, name in (("page_id", side), ("path", f"{side}_path"))]
    return beside.select("row.page_id", "row.path", *sides).mapInArrow(_nearer, "page_id long, mate long").where("mate IS NOT NULL")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_differenced, n_structural) for every row of pages(page_id, url, html)."""
    prepare(pages.sparkSession)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    # pages are parsed twice: writing their lines in between would cost more disk than parsing costs time
    with Scratch(pages.sparkSession) as scratch:
        known = materialize(_known(parsed, scratch), "page-partners")
    packed = parsed.select("page_id", "url", "html").mapInArrow(_squeezed, "page_id long, url string, packed binary")
    return packed.join(known, "page_id", "left").mapInArrow(_difference, "page_id long, url string, text string, n_chars long, n_differenced long, n_structural long")


def _known(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, partner_hashes): the lines of each page's partner."""
    outlines = scratch.keep(parsed.select("page_id", "host", "path", "html").mapInArrow(_outlined, "page_id long, host string, path string, hashes array<long>"), "page-outlines")
    light = outlines.where("page_id IS NOT NULL AND size(hashes) > 0").groupBy("page_id").agg(F.min(F.struct("host", "path")).alias("at")).select("at.host", "at.path", "page_id")
    partner = _partners(light, scratch)
    mates = outlines.select(F.col("page_id").alias("mate"), F.col("hashes").alias("partner_hashes")).join(partner.select("mate").distinct(), "mate", "left_semi").groupBy("mate").agg(F.min("partner_hashes").alias("partner_hashes"))
    return partner.join(mates, "mate").select("page_id", "partner_hashes")


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
