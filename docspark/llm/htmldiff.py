"""Main text of web pages by differencing each page against its nearest URLs.

A page's lines are its block elements' texts, in page order. Pages of one host are put in the order of their URL paths, so
a page is paired with the nearest path of other lines on each side; lines are aligned by longest common subsequence, and
shared lines are deleted. Scripts, styles, heads and forms give no lines at all.

What is shared isn't always template, and what is template isn't always shared; evidence of two more kinds breaks the ties.

- How often a line recurs on its host, copies of a page counted once. A pair that shares over half of its lines is the same
  article twice, or two short articles in a large template: it deletes only lines that recur (on ``RECURS_ON`` pages or
  more, and over ``RECURS_IN`` of them), so a pair alike only with each other is a copy and deletes nothing. Paragraphs and
  headings are deleted only if they recur so, as short ones repeat by chance; lines inside article or main only if they are
  shared with both sides (or the only one) and on over ``RECURS_INSIDE`` of the host's pages, paragraphs there only if they
  stand outside of article and main on some page of the host too, headings there never.
- What markup says of lines that no neighbour shares: those of elements named as something else than text (menus, headers,
  footers, asides, adverts, notices, comments; by element, role, or a whole class name or id) go, and, where a page has article
  or main elements with text, so do lines outside them. An element that is never closed says nothing, nor does one that
  holds an article or main element, nor a section of an article with headings and paragraphs whose id may be its topic.

Only hashes of lines are dealt out for pairing. Texts stay where they were read: a page is parsed once more when the
lines to delete are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import written

#: Tables of deletions and of recurring lines are broadcast up to this many bytes, else joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: A line recurs on a host if this many of its pages have it, copies counted once, and over this part of them.
RECURS_ON, RECURS_IN, RECURS_INSIDE = 3, 0.1, 0.5
#: Hashes of lines in a range of URLs.
RANGE_LINES = 8 << 20

# HTML elements by what they do here, and what names of classes, ids and roles say.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes template svg object canvas audio video".split())
TO_THE_END = set("script style title textarea iframe xmp noembed noframes".split())
IN_HEAD = set("title meta link base script style noscript template bgsound".split())
FORMS = set("form button select datalist".split())
DROPPED = set("nav footer aside header menu dialog".split()) | FORMS
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | set("p blockquote pre dd figcaption".split())
NAMED_INLINE = set("span a ins label small".split())
ENDS_BY_ITSELF = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form note".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar "
    "related recommended recommendations breadcrumb breadcrumbs comment comments respond disqus replies reply menu nav navbar navigation header footer masthead topbar toolbar widget widgets pagination pager paywall login search".split()
)
BESIDE = set("site page global main primary secondary top bottom left right box bar block list area wrapper wrap container section slot unit buttons links items form posts stories articles inner outer fixed sticky mobile desktop".split())
TEXT_NAMES = set("article content post entry story body text main".split())
TOPICS = set("search login notice notices alert banner consent cookie cookies menu navigation promotion sponsor sponsored subscription advertising toolbar widget widgets".split())

ARTICLE, NAMED, PARAGRAPH, HEADING = 1, 2, 4, 8

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z0-9]+")


def _says(name: str) -> bool:
    """Whether a whole class name or id names something else than text: all its parts do, or are beside one that does."""
    parts = _PART.findall(name)
    return not NAMES.isdisjoint(parts) and all(p in NAMES or p in BESIDE for p in parts)


def is_named(attrs: str) -> bool:
    """Whether a tag's attributes name a part that isn't article text."""
    names: list[str] = []
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names += value.split()
        elif key == "role" and value.strip() in ROLES:
            return True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return TEXT_NAMES.isdisjoint(names) and any(map(_says, names))


def is_topic(attrs: str) -> bool:
    """Whether all that names a part is an id that may as well be what a section of an article is about."""
    found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTR.finditer(attrs)]
    ids = [v for k, v in found if k == "id"]
    return all(k == "id" for k, _ in found) and all(TOPICS.issuperset(_PART.findall(v)) for v in ids)


def tokens(html: str) -> Iterator[tuple[str, bool, str]]:
    """Tags ``(name, closing, attributes)`` and texts ``("", False, text)`` of a page, in one pass over it.

    Quotes hold a tag open; a tag whose quotes never close ends at its first ``>``. What follows a quote that opens depends on
    its place alone, so places from which no tag ended are remembered, and nothing is read twice for the same end.
    """
    pos, text, n = 0, 0, len(html)
    unclosed: set[str] = set()
    endless: set[int] = set()  # quotes that open somewhere behind which no tag ends
    while True:
        a = html.find("<", pos)
        if a < 0:
            break
        pos, closing = a + 1, html.startswith("/", a + 1)
        name = _NAME.match(html, a + 1 + closing)
        if not name:
            if html.startswith(("!", "?"), a + 1):
                end = html.find("-->", a + 4) if html.startswith("!--", a + 1) else html.find(">", a)
                if a > text:
                    yield "", False, html[text:a]
                pos = text = n if end < 0 else end + (3 if html.startswith("!--", a + 1) else 1)
            continue
        end, at, opened = -1, name.end(), []
        while True:
            at = _PLAIN.match(html, at).end()
            if at < n and html[at] == ">":
                end = at
                break
            if at < n and at not in endless:
                opened.append(at)
                at = html.find(html[at], at + 1) + 1
            if not at or at >= n or at in endless:
                endless.update(opened)
                break
        if end < 0:
            end = html.find(">", name.end())
        if end < 0:
            break  # no tag ends any more: the rest is text
        if a > text:
            yield "", False, html[text:a]
        tag, attrs = name[0].lower(), html[name.end() : end]
        pos = text = end + 1
        if tag in RAW and not closing:
            if attrs.endswith("/") or tag in unclosed:
                continue
            e = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
            if e:
                close = html.find(">", e.end())
                pos = text = n if close < 0 else close + 1
            elif tag in TO_THE_END:
                pos = text = n
            else:
                unclosed.add(tag)  # is no element then
            continue
        if tag not in RAW:
            yield tag, closing, attrs
    if text < n:
        yield "", False, html[text:]


def _ends(found: list[tuple[str, bool, str]]) -> tuple[list[int], list[bool]]:
    """For each token that opens an element where it ends (0: nowhere), and whether it holds an article or main element."""
    ends, holds, open_, n_open = [0] * len(found), [False] * len(found), [], {}

    def close(at: int, own: bool) -> None:
        k = open_.pop()
        tag = found[k][0]
        n_open[tag] -= 1
        if own or tag in ENDS_BY_ITSELF:
            ends[k] = at
        if open_ and (holds[k] or tag in ("article", "main")):
            holds[open_[-1]] = True

    for i, (tag, closing, _) in enumerate(found):
        if not tag or tag in VOID or tag not in BLOCKS and tag not in DROPPED and tag not in NAMED_INLINE:
            continue
        if closing:
            if n_open.get(tag):
                while found[open_[-1]][0] != tag:
                    close(i, False)
                close(i, True)
            continue
        while open_ and tag in ENDS_BY_ITSELF.get(found[open_[-1]][0], ()):
            close(i, False)
        open_.append(i)
        n_open[tag] = n_open.get(tag, 0) + 1
    while open_:
        close(len(found), False)
    return ends, holds


def lines(html: str | None) -> tuple[list[str], list[int]]:
    """The text lines of a page, and for each what markup says of it: ARTICLE, NAMED, PARAGRAPH, HEADING, added up."""
    found = list(tokens(html or ""))
    ends, holds = _ends(found)
    out, flags, buffer = [], [], []
    inside = named = head_of = skip = -1  # where the outermost article, named element, header in an article, form ends
    head, block = False, ""

    def end_line() -> None:
        text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            heading = block in HEADINGS
            out.append(text)
            flags.append(ARTICLE * (i <= inside) + NAMED * (i <= named or i <= head_of and not heading) + PARAGRAPH * (block in PROSE) + HEADING * heading)

    has = lambda tags, a, b: any(found[k][0] in tags for k in range(a, b))
    i = 0
    for i, (tag, closing, attrs) in enumerate(found):
        if head:
            if tag and (closing and tag == "head" or not closing and tag not in IN_HEAD and tag != "head") or not tag and attrs.strip():
                head = False  # it also ends where something begins that isn't for it
            else:
                continue
        if i < skip:
            continue
        if not tag:
            buffer.append(attrs)
            continue
        if tag == "head":
            head = not closing
            continue
        is_block = tag in BLOCKS or tag in DROPPED
        if is_block:
            end_line()
            block = "" if closing else tag
        elif tag in ("br", "td", "th"):
            buffer.append(" ")
        if closing or not ends[i] or holds[i] and tag not in ("article", "main"):
            if not closing and tag in ("article", "main") and i >= named:
                inside = max(inside, ends[i] or len(found))
            continue
        says = bool(attrs) and tag not in ("html", "body", "main") and (is_block or tag in NAMED_INLINE) and is_named(attrs)
        if says and tag == "section" and named < i < inside and is_topic(attrs):
            says = not (has(HEADINGS, i + 1, ends[i]) and has({"p"}, i + 1, ends[i]))
        if tag in FORMS:
            skip = ends[i]
        elif tag in ("article", "main") and not (says and (i < inside or i < named or "comment" in attrs.lower())):
            inside = max(inside, ends[i] if i >= named else -1)
        elif tag == "header" and i < inside and not says:
            head_of = max(head_of, ends[i])
        elif says and not is_block:
            skip = ends[i]
        elif says or tag in DROPPED:
            named = max(named, ends[i])
    i = len(found)
    end_line()
    return out, flags


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel rows of the table of longest common subsequences: bit j is 0 where the length grows with ``b[j]``."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v = rows[-1]
        u = v & masks.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each prefix of ``b``."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int], most: int = 1 << 28) -> list[int]:
    """Which places of ``a`` are in a longest common subsequence with ``b``.

    The table is kept for the way back, as bits; one of more than ``most`` bits is halved until it isn't, so memory stays
    small however long the pages are.
    """
    either = set(a) & set(b)
    ia, ib = [i for i, x in enumerate(a) if x in either], [x for x in b if x in either]
    if len(ia) > 1 and len(ia) * len(ib) > most:
        half = len(ia) // 2
        x, y = [a[i] for i in ia[:half]], [a[i] for i in ia[half:]]
        cut = int((_lengths(x, ib) + _lengths(y[::-1], ib[::-1])[::-1]).argmax())
        return [ia[i] for i in common(x, ib[:cut], most)] + [ia[half + i] for i in common(y, ib[cut:], most)]
    rows = _rows([a[i] for i in ia], ib)
    out, i, j = [], len(ia), len(ib)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    while i and j:
        if length(i, j) == length(i - 1, j):
            i -= 1
            continue
        while rows[i] >> (j - 1) & 1:
            j -= 1
        out.append(ia[i - 1])
        i, j = i - 1, j - 1
    return out[::-1]


def shared_lines(own: list[int], flags: list[int], before: list[int] | None, after: list[int] | None, recurring: list[int], everywhere: list[int], outside: list[int]) -> list[int]:
    """Places of the lines to delete because they are shared; see the module's text. The last three: lines of the host that recur, on over RECURS_INSIDE of it, and of these the ones that stand outside of articles somewhere."""
    again, always, beside = set(recurring), set(everywhere), set(outside)
    shared: list[set[int]] = []
    for other in (before, after):
        if other is not None:
            got = common(own, other)
            alike = 2 * len(got) > max(len(own), len(other))
            shared.append({i for i in got if own[i] in again or not alike and not flags[i] & PARAGRAPH})
    if not shared:
        return []
    either, both = set.union(*shared), set.intersection(*shared)
    return [i for i in sorted(either) if not flags[i] & ARTICLE or flags[i] & NAMED or i in both and own[i] in (beside if flags[i] & PARAGRAPH else always) and not flags[i] & HEADING]


def kept_lines(flags: list[int], deleted: list[int]) -> list[int]:
    """Places of the lines that are the text: neither shared nor, where nothing shares them, ruled out by markup."""
    gone = set(deleted)
    keep = [i for i, f in enumerate(flags) if i not in gone and not f & NAMED]
    return [i for i in keep if flags[i] & ARTICLE] if any(flags[i] & ARTICLE for i in keep) else keep


def text_of(html: str | None, deleted: list[int]) -> str:
    found, flags = lines(html)
    return "\n\n".join(found[i] for i in kept_lines(flags, deleted))


def split_url(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").lower(), u.path + ("?" + u.query if u.query else "")
    except ValueError:
        return "", url or ""


def line_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in found), np.uint64, len(found)).view(np.int64)


def _light(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, url, html, key in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["html"], pdf["tkey"]):
            found, flags = lines(html)
            hashes, marks = line_hashes(found), np.array(flags, np.uint8)
            rows.append((page_id, *split_url(url), key, hashes, bytes(flags), hashes[marks & (ARTICLE | NAMED) != ARTICLE]))
        out = pd.DataFrame(rows, columns=["page_id", "host", "path", "tkey", "hashes", "flags", "outside"])
        yield out.astype({"page_id": "Int64"})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _deleted(own: pd.Series, flags: pd.Series, before: pd.Series, after: pd.Series, recurring: pd.Series, everywhere: pd.Series, outside: pd.Series) -> pd.Series:
    ints = lambda x: None if x is None else x.tolist()
    return pd.Series([shared_lines(h.tolist(), list(z), ints(b), ints(a), ints(r) or [], ints(e) or [], ints(o) or []) for h, z, b, a, r, e, o in zip(own, flags, before, after, recurring, everywhere, outside)])


def recurring_lines(light: DataFrame) -> DataFrame:
    """Rows ``(host, recurring, everywhere, outside)``: the line hashes that recur on a host, those over RECURS_INSIDE of it, and those of them that stand outside of articles on some page.

    A host has at most its mean lines a page / ``RECURS_IN`` of them.
    """
    pages = light.where("size(hashes) > 0").select("host", F.array_distinct("hashes").alias("hashes"), F.array_distinct("outside").alias("outside"), "copy").dropDuplicates(["host", "copy"])
    counts = pages.groupBy("host").agg(F.count("*").alias("n"))
    each = pages.select("host", F.explode("hashes").alias("line"), F.lit(1).alias("one")).unionByName(pages.select("host", F.explode("outside").alias("line"), F.lit(0).alias("one")))
    found = each.groupBy("host", "line").agg(F.sum("one").alias("on"), (F.min("one") == 0).alias("beside")).where(F.col("on") >= RECURS_ON)
    found = found.join(counts, "host").where(F.col("on") > RECURS_IN * F.col("n"))
    always = F.col("on") > RECURS_INSIDE * F.col("n")
    lists = {"recurring": F.col("line"), "everywhere": F.when(always, F.col("line")), "outside": F.when(always & F.col("beside"), F.col("line"))}
    return found.groupBy("host").agg(*[F.collect_list(x).alias(c) for c, x in lists.items()])


def _across(ends: list[tuple]) -> list[tuple[int, int, bool]]:
    """Which ranges lend which of their ends to which others: (from, to, whether the lent row is of other lines than its end).

    ``ends``, in order: pid, host and lines of the first row, host and lines of the last, whether the range has a row of the
    last one's host with other lines. A range gets the row before it and the nearest one before that with other lines.
    """
    out, near, other = [], None, None  # (range, second, host, copy)
    for pid, host, _, last_host, last_copy, has_other in ends:
        for x in (near, other):
            if x and x[2] == host:
                out.append((x[0], pid, x[1]))
        end = (pid, False, last_host, last_copy)
        if has_other:
            other = (pid, True, last_host, None)
        elif near and near[2] == last_host and near[3] != last_copy:
            other = near
        elif not (other and other[2] == last_host):
            other = None
        near = end
    return out


def _neighbours(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``before`` and ``after``: the lines of the nearest page with other lines on each side, on the same host.

    The driver holds a few numbers for each range.
    """
    spark, place = ranges.sparkSession, F.struct("path", F.coalesce("page_id", F.lit(-(2**63))), "tkey")
    one = F.struct("host", "path", "page_id", "tkey", "hashes", "copy")
    rows = ranges.withColumn("edge", F.lit(False))
    for name, pick, order in (("before", F.max_by, [F.col("path"), F.col("page_id").asc_nulls_first(), F.col("tkey")]), ("after", F.min_by, [F.col("path").desc(), F.col("page_id").desc_nulls_last(), F.col("tkey").desc()])):
        back = F.min_by if name == "before" else F.max_by
        whole = F.struct("host", place)
        ends = ranges.groupBy("pid").agg(back(F.struct("host", "copy"), whole).alias("first"), pick(one, whole).alias("last"))
        # the row of the last one's host, with other lines, that is nearest to it
        at = ends.select("pid", F.col("last.host").alias("last_host"), F.col("last.copy").alias("last_copy"))
        second = ranges.join(F.broadcast(at), "pid").where("host = last_host and copy <> last_copy").groupBy("pid").agg(pick(one, place).alias("second"))
        ends = written(ends.join(second, "pid", "left"), "range-ends")  # three rows for each range
        few = ends.select("pid", "first.host", "first.copy", F.col("last.host").alias("lh"), F.col("last.copy").alias("lc"), F.col("second").isNotNull().alias("o"))
        found = sorted(map(tuple, few.collect()), reverse=name == "after")
        to = spark.createDataFrame(_across(found), "pid int, dest int, other boolean")
        lent = ends.join(F.broadcast(to), "pid").select(F.col("dest").alias("pid"), F.when(F.col("other"), F.col("second")).otherwise(F.col("last")).alias("x"))
        lent = lent.select("pid", "x.*", F.lit(None).cast("binary").alias("flags"), F.lit(True).alias("edge"))
        for k in ("before", "after"):
            if k in rows.columns:
                lent = lent.withColumn(k, F.lit(None).cast("array<bigint>"))
        rows = rows.unionByName(lent)
        w = Window.partitionBy("pid", "host").orderBy(*order)
        rows = rows.withColumn("near", F.when(F.lag("copy").over(w) != F.col("copy"), F.lag("hashes").over(w)))
        rows = rows.withColumn(name, F.last("near", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("near").where("not edge")
    return rows.drop("edge")


def deletions(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows ``(page_id, tkey, deleted)`` of the pages that lose shared lines; tkey is the XXH64 of url and html."""
    spark = pages.sparkSession
    keyed = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("tkey"))
    light = keyed.mapInPandas(_light, "page_id long, host string, path string, tkey long, hashes array<long>, flags binary, outside array<long>")
    light = written(light.withColumn("copy", F.xxhash64("hashes")), "page-lines")
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(light.agg(F.sum(F.size("hashes"))).first()[0] or 0) // RANGE_LINES))
    # ranges of the order are numbered and written, so they are the same for all that follows
    ranges = written(light.drop("outside").repartitionByRange(n, "host", "path", F.col("page_id").asc_nulls_first(), "tkey").withColumn("pid", F.spark_partition_id()), "page-ranges")
    rows = _neighbours(ranges).where("before is not null or after is not null")
    again = written(recurring_lines(light), "recurring-lines")
    if 8 * (again.agg(F.sum(F.size("recurring") + F.size("everywhere") + F.size("outside") + 8)).first()[0] or 0) <= BROADCAST_BYTES:
        again = F.broadcast(again)
    lists = ("recurring", "everywhere", "outside")
    rows = rows.join(again, "host", "left").withColumns({c: F.array_intersect("hashes", c) for c in lists})
    rows = rows.withColumn("deleted", _deleted("hashes", "flags", "before", "after", *lists))
    return rows.where("size(deleted) > 0").groupBy("page_id", "tkey").agg(F.min("deleted").alias("deleted"))


def main_text(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows ``(page_id, url, text, n_chars)``, one for each row of ``pages(page_id, url, html)``.

    A null or empty html gives an empty text; a null or broken url is on a host of its own kind, without a name. Repeated
    rows are alike: they are copies, so they delete nothing from each other, and get the same text. Malformed pages are read
    as far as they can be, in time in proportion to their length; other columns are left out.
    """
    gone = written(deletions(pages, parts), "deletions")
    if (gone.agg(F.sum(F.size("deleted") * 4 + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    gone = gone.select(F.col("page_id").alias("_page"), F.col("tkey").alias("_tkey"), "deleted")
    on = F.col("page_id").eqNullSafe(F.col("_page")) & (F.xxhash64("url", "html") == F.col("_tkey"))

    @F.pandas_udf("string")
    def text(html: pd.Series, deleted: pd.Series) -> pd.Series:
        return pd.Series([text_of(h, [] if d is None else list(d)) for h, d in zip(html, deleted)])

    out = pages.select("page_id", "url", "html").join(gone, on, "left").select("page_id", "url", text("html", "deleted").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
