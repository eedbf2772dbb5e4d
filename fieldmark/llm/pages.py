"""HTML extraction (operator 6): blocks of a page's main part, less the lines it shares with the page of the nearest URL."""

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import bounded, cut, shuffle_partitions

#: Fixed values. Elements whose content is no text of the page.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas")
#: Elements that are never of the article.
ASIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset", "head")
#: Words in a class, id or role that mark such a part.
MARKS = (
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notices alert comment comments disqus reply replies respond share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login search widget popup modal toolbar copyright skip complementary contentinfo"
).split()
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Start tags that close an open element of the same kind, and how far out they look for it.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr",), "th": ("tr",), "tr": ("table",), "option": ("select",)}

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_mark = frozenset(MARKS)


def _marked(attributes: str, within: bool) -> bool:
    """Whether a class, id or role says so; an article's own header holds its title and is none."""
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id", "role"):
            found = {w for x in value.lower().split() for w in (*re.split(r"[^a-z]+", x), re.sub(r"[^a-z]+", "", x))} & _mark
            if found - ({"header", "masthead", "banner"} if within else set()):
                return True
    return False


def blocks(page: str) -> list[tuple[str, bool]]:
    return [(text, main) for text, main, _ in parsed(page)]


def parsed(page: str) -> list[tuple[str, bool, bool]]:
    """(text, whether it is in an article or main element, whether it is the article's title) of each block of a page that is in no marked part.

    A forgiving reading: elements nest by name; an end tag closes up to the nearest open element of its name, if any;
    a block ends where an element that browsers show as a block starts or ends. White space becomes one space, and so
    does a line break; references are decoded once.
    """
    out: list[tuple[str, bool, bool]] = []
    title = TITLE.search(page)
    title = " ".join(html.unescape(title[1]).split()) if title else ""
    open_: list[tuple[str, bool, bool]] = []  # name, whether it or one around it is left out, whether in the main part
    piece: list[str] = []
    skip = main = False
    at = 0

    def end_block() -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        piece.clear()
        if text:
            out.append((text, main, main and any(x[0] == "h1" for x in open_) or title.startswith(text)))

    def text_to(stop: int) -> None:
        if not skip and stop > at:
            piece.append(page[at:stop])

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            text_to(len(page))
            break
        if not (tag := TAG.match(page, start)):
            text_to(start + 1)
            at = start + 1
            continue
        text_to(start)
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name in BLOCKS_SET:
            end_block()
        elif name == "br" and not skip:
            piece.append(" ")
        if tag[1]:  # an end tag
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if k is not None:
                del open_[k:]
                skip, main = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
            continue
        if name in RAW:
            if not tag[3].rstrip().endswith("/") or name not in ("svg", "math"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if name in VOID or tag[3].rstrip().endswith("/") and name not in BLOCKS_SET:
            continue
        if name == "p" or name in BLOCKS_SET and open_ and open_[-1][0] == "p":
            while open_ and any(x[0] == "p" for x in open_) and open_[-1][0] in ("p", *INLINE):
                closed = open_.pop()[0]
                if closed == "p":
                    break
        if name in SIBLINGS:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in SIBLINGS[name]:
                    break
                if open_[k][0] == name:
                    del open_[k:]
                    break
        around, within = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
        left_out = around or (name in ASIDE and not (name == "header" and within)) or (name not in ("html", "body", "article", "main") and _marked(tag[3], within))
        open_.append((name, left_out, within or name in ("article", "main")))
        skip, main = open_[-1][1], open_[-1][2]
    end_block()
    return out


BLOCKS_SET = frozenset(BLOCKS)
INLINE = "a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()


def shared(own: list, other: list) -> set[int]:
    """Places of own in a longest common subsequence of the two lists of lines (Hunt and Szymanski)."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(other):
        where.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(own):
        for j in reversed(where.get(line, ())):
            k = int(np.searchsorted(ends, j)) if len(ends) > 64 else next((k for k, e in enumerate(ends) if e >= j), len(ends))
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def sketch(line: str) -> int:
    """Eight bytes, one of each of eight min-hashes of the line's three-word runs: lines with many runs in common have equal bytes."""
    words = line.lower().split()
    runs = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))], np.uint64)
    least = (runs[:, None] * _ODD + _ADD).min(0)
    return int.from_bytes(((least >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes(), "little")


_ODD = np.array([xxhash.xxh64_intdigest(b"odd", k) | 1 for k in range(8)], np.uint64)
_ADD = np.array([xxhash.xxh64_intdigest(b"add", k) for k in range(8)], np.uint64)


def candidates(page: str) -> tuple[list[tuple[str, bool]], bool]:
    """((text, whether it is the article's title) of each block that may be the article's, whether they are of article or main elements).

    Those in an article or main element, or all if there are none.
    """
    found = parsed(page)
    main = [(text, title) for text, main, title in found if main]
    return main or [(text, title) for text, _, title in found], bool(main)


@dataclass(frozen=True)
class Lines:
    """What differencing needs of a page: a hash and a sketch of each line that may be the article's, and whether they are of its main part.

    The hash of an article's title holds the page's key too, so that no other page has it.
    """

    hashes: list[int]
    sketches: list[int]
    main: bool

    @staticmethod
    def of(page: str, key: int = 0) -> "Lines":
        own, main = candidates(page)
        return Lines([xxhash.xxh64_intdigest(f"{key} {t}" if title else t) - (1 << 63) for t, title in own], [sketch(t) - (1 << 63) for t, _ in own], main)


#: Equal bytes of two sketches from which their lines count as versions of one line (two unrelated lines have as many 1 time in 300,000).
ALIKE = 3


def copies(a: Lines, b: Lines) -> bool:
    """Whether two pages hold the same article: then one has no line of its own, or what they do not share are versions of the same lines.

    Only lines that may be the article's are judged, and however many lines are shared says nothing: a short article
    under a long template shares most of its lines with any page of the host. At least half of the own lines of the
    page that has fewer must have a version on the other.
    """
    own = [[x.sketches[i] for i in range(len(x.hashes)) if i not in same] for x, same in ((a, shared(a.hashes, b.hashes)), (b, shared(b.hashes, a.hashes)))]
    few, many = sorted(own, key=len)
    if not few:
        return True
    other = np.array(many, np.int64).view(np.uint8).reshape(-1, 8)
    alike = sum(bool(((other == one).sum(1) >= ALIKE).any()) for one in np.array(few, np.int64).view(np.uint8).reshape(-1, 8))
    return 2 * alike >= len(few)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path without a last slash or extension."""
    bare = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(bare, r"(?:\.[A-Za-z]{1,5})?/?$", "")


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


@dataclass(frozen=True)
class Page:
    """A page without its text: host, path, id and row key sort it."""

    h: str
    p: str
    page_id: int
    k1: int
    k2: int
    lines: Lines
    own: bool = True

    def row(self, r: int) -> tuple:
        return r, self.h, self.p, self.page_id, self.k1, self.k2, self.lines.hashes, self.lines.sketches, self.lines.main, False


KEYED = "h string, p string, page_id long, k1 long, k2 long, hashes array<long>, sketches array<long>, main boolean"
RANGED = f"r int, {KEYED}, own boolean"


def compared(pages: Iterable[Page]) -> Iterator[tuple[Page, Page | None, Page | None]]:
    """(page, the nearest before it, the nearest after it) of sorted pages: of its host, and no copies of it.

    The pages that wait for one after them are a run of copies. A repeated row comes once.
    """
    waiting: list[tuple[Page, Page | None]] = []

    def done(after: Page | None) -> Iterator[tuple[Page, Page | None, Page | None]]:
        for x, before in waiting:
            yield x, before, after if after and not copies(x.lines, after.lines) else None
        waiting.clear()

    for x in pages:
        before = None
        if waiting:
            last, further = waiting[-1]
            if last.h == x.h and (last.k1, last.k2) == (x.k1, x.k2):
                continue
            if last.h != x.h:
                yield from done(None)
            elif not copies(x.lines, last.lines):
                before = last
                yield from done(x)
            elif further and not copies(x.lines, further.lines):
                before = further
        waiting.append((x, before))
    yield from done(None)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Page]]:
    for b in batches:
        for x in b.to_pylist():  # no texts
            yield x["r"], Page(x["h"], x["p"], x["page_id"], x["k1"], x["k2"], Lines(x["hashes"], x["sketches"], x["main"]), x["own"])


def _ranges(rows: Iterator[tuple[int, Page]]) -> Iterator[tuple[int, Iterator[Page]]]:
    for r, group in groupby(rows, key=lambda x: x[0]):
        yield r, (x for _, x in group)


def _packed(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of up to 2000 rows, or as many as hold 16 MB of the last value's texts."""
    some, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema.names)

    for row in rows:
        some.append(row)
        size += sum(map(len, row[-1])) if row[-1] and isinstance(row[-1], list) and isinstance(row[-1][0], str) else 0
        if len(some) >= 2000 or size > 1 << 24:
            yield batch()
            some, size = [], 0
    if some:
        yield batch()


def keyed(pages: DataFrame) -> DataFrame:
    """pages with h, p, k1, k2 -> their lines as hashes and sketches, a sixteenth or so of the text."""
    schema = pa.schema([("h", pa.string()), ("p", pa.string()), ("page_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("hashes", pa.list_(pa.int64())), ("sketches", pa.list_(pa.int64())), ("main", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for k in range(b.num_rows):
                    *key, page = (c[k].as_py() for c in b.columns)
                    found = Lines.of(page or "", key[-1])
                    yield *key, found.hashes, found.sketches, found.main

        yield from _packed(rows(), schema)

    return pages.select("h", "p", F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"), "k1", "k2", "html").mapInArrow(run, KEYED)


#: Sampled pages for each range of pages, to choose its limits.
SAMPLED = 20
ORDER = ["r", "h", "p", "page_id", "k1", "k2"]


def ranged(found: DataFrame, ranges: int) -> DataFrame:
    """Rows of keyed() with the number of their range of (host, path, page_id)."""
    n = found.count()
    some = found.select("h", "p", "page_id").sample(min(1.0, SAMPLED * ranges / max(n, 1)), 42).collect() if n else []
    some = sorted(tuple(x) for x in some)
    limits = sorted({some[k * len(some) // ranges] for k in range(1, ranges)} if some else set())
    shared_ = found.sparkSession.sparkContext.broadcast(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
            r = pa.array([bisect_right(shared_.value, x) for x in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([r, *b.columns, pa.array([True] * b.num_rows)], ["r", *b.schema.names, "own"])

    return found.mapInArrow(run, RANGED)


def bordering(ends: list[tuple[Page, Page | None, Page, Page | None]]) -> Iterator[tuple[int, Page]]:
    """(range, page) of what a range has to know of others: the nearest page before and after it, and theirs that is no copy.

    ends has for each range in order: first page, nearest after it, last page, nearest before it, as found in the range.
    """
    for forward in (True, False):
        carried: tuple[Page, Page | None] | None = None
        for k in range(len(ends)) if forward else reversed(range(len(ends))):
            if carried:
                yield from ((k, x) for x in carried if x)
            first, after, last, before = ends[k]
            end, start, other = (last, first, before) if forward else (first, last, after)
            if not other and start.h == end.h and carried and carried[0].h == end.h:  # the whole range is of copies
                other = next((x for x in carried if x and not copies(end.lines, x.lines)), None)
            carried = (end, other)


def borders(rows: DataFrame) -> DataFrame:
    """rows (RANGED) -> up to four pages for each range, of the ranges beside it, not its own.

    The driver holds four pages' hashes for each range, whatever the table's size.
    """
    schema = pa.schema([("r", pa.int32()), ("part", pa.int32()), ("h", pa.string()), ("p", pa.string()), ("page_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("hashes", pa.list_(pa.int64())), ("sketches", pa.list_(pa.int64())), ("main", pa.bool_()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for r, pages in _ranges(_read(batches)):
                first = None
                for x, before, after in compared(pages):
                    first = first or (x, after)
                    last = x, before
                for part, x in enumerate((*first, *last)):
                    if x:
                        yield r, part, *x.row(r)[1:]

        yield from _packed(out(), schema)

    spark, found = rows.sparkSession, {}
    dealt = rows.repartition(shuffle_partitions(spark), "r").sortWithinPartitions(*ORDER)
    for x in dealt.mapInArrow(run, f"r int, part int, {KEYED}, own boolean").collect():
        found.setdefault(x.r, [None] * 4)[x.part] = Page(x.h, x.p, x.page_id, x.k1, x.k2, Lines(x.hashes, x.sketches, x.main), False)
    order = sorted(found)
    return spark.createDataFrame([x.row(order[k]) for k, x in bordering([found[r] for r in order])], RANGED)


def decided(rows: DataFrame) -> DataFrame:
    """rows (RANGED) -> (k1, k2, h, article, main, doubt, hashes) of each different row that is a range's own.

    doubt: the places of the lines that the nearest page has too (longest common subsequence), with their hashes. article: the least
    hash of the other lines, which copies of an article have in common.
    """
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("h", pa.string()), ("article", pa.int64()), ("main", pa.bool_()), ("doubt", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for _, pages in _ranges(_read(batches)):
                for x, before, after in compared(pages):
                    if x.own:
                        near = after if not before or after and _common(after.p, x.p) > _common(before.p, x.p) else before
                        own = x.lines.hashes
                        same = shared(own, near.lines.hashes) if near else set()
                        article = min((y for i, y in enumerate(own) if i not in same), default=min(own, default=0))
                        yield x.k1, x.k2, x.h, article, x.lines.main, sorted(same), [own[i] for i in sorted(same)]

        yield from _packed(out(), schema)

    kinds = "k1 long, k2 long, h string, article long, main boolean, doubt array<int>, hashes array<long>"
    return rows.repartition(shuffle_partitions(rows.sparkSession), "r").sortWithinPartitions(*ORDER).mapInArrow(run, kinds)


#: Articles of a host that have to share a line before it is furniture, if the host has as many.
LEAST_ARTICLES = 3


def furniture(found: DataFrame) -> DataFrame:
    """found (decided()) -> (k1, k2, gone: places of the lines that go) of the rows that lose any.

    A line in doubt goes only if it is in doubt on pages of several different articles of the host: three, or as many as there are;
    in an article or main element of more than half of the host's articles, and of three at least.
    """
    doubts = found.select("k1", "k2", "h", "article", "main", F.explode(F.arrays_zip("doubt", "hashes")).alias("d")).select("k1", "k2", "h", "article", "main", "d.doubt", F.col("d.hashes").alias("line"))
    seen = doubts.groupBy("h", "line").agg(F.count_distinct("article").alias("with"))
    hosts = found.groupBy("h").agg(F.count_distinct("article").alias("articles"))
    met = doubts.join(seen, ["h", "line"]).join(hosts, "h")
    goes = F.when(F.col("main"), (F.col("with") >= LEAST_ARTICLES) & (2 * F.col("with") > F.col("articles"))).otherwise(F.col("with") >= F.least(F.lit(LEAST_ARTICLES), F.col("articles")))
    return met.where(goes).groupBy("k1", "k2").agg(F.collect_list("doubt").alias("gone"))


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), a row for each row.

    A page is differenced with the page before or after it in (host, path, page_id) whose path shares the longer prefix
    (ties: the one before), copies passed over. A line that the two share goes if pages of other articles of the host show it to be
    furniture (see furniture()); an h1 of an article and the page's title never go. Lines are compared by 64-bit hashes, which are
    dealt out in ranges of that order, so that a large host takes many tasks; a range also gets the pages next to its edges, so that
    the result does not depend on how many ranges there are. Of pages that lose lines the places meet the texts: by broadcast if
    they are few, else both are shuffled. Null html is empty, a null url is a host of its own kind; empty pages give empty texts;
    repeated rows stay.
    """
    spark, row = pages.sparkSession, [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    keys = pages.select(*row, host(F.col("url")).alias("h"), path(F.col("url")).alias("p"), *(F.xxhash64(F.lit(k), *row, *[c.isNull() for c in row]).alias(f"k{k}") for k in (1, 2)))
    rows = ranged(cut(keyed(keys)), ranges or 4 * shuffle_partitions(spark))
    gone = cut(furniture(cut(decided(rows.unionByName(borders(rows))))))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("lines", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in batches:
                for k in range(b.num_rows):
                    *key, page = (c[k].as_py() for c in b.columns)
                    yield *key, [text for text, _ in candidates(page or "")[0]]

        yield from _packed(out(), schema)

    texts = keys.select("page_id", "url", "k1", "k2", "html").mapInArrow(run, "page_id long, url string, k1 long, k2 long, lines array<string>")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("gone", i)))
    met = texts.join(bounded(gone), ["k1", "k2"], "left").select("page_id", "url", F.array_join(left, "\n\n").alias("text"))
    return met.withColumn("n_chars", F.char_length("text").cast("long"))
