"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path; each is paired with whichever of its two neighbours has the more similar
path.  Their text lines are aligned by longest common subsequence and lines that both share are deleted as template.
That is done for every page; markup then checks the outcome where it is explicit.  Lines of menus, headers, footers and
the like go, also those that differ from page to page.  Of the article and main elements, or those so named, the ones
with a line of their own are the page's; deleted lines inside them come back, since passages are republished between
articles.  One that the neighbour has line by line stays deleted, unless it holds the headline or all are such.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r">|=\s*([\"'])")
ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)

#: Element names.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "option",
       "canvas", "object", "video", "audio", "head"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset"}
MAIN = {"article", "main"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
          "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Class names, ids, roles and labels that mark what is not the article, alone or with words of NEUTRAL.
NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "nav",
         "navbar", "navigation", "menu", "sidebar", "footer", "header", "masthead", "breadcrumb", "breadcrumbs", "cookie",
         "cookies", "consent", "notice", "gdpr", "popup", "modal", "newsletter", "subscribe", "subscription", "share",
         "sharing", "social", "related", "recommended", "comment", "comments", "reply", "replies", "disqus", "login",
         "signup", "search", "complementary", "contentinfo", "toolbar", "widget", "skip"}
NEUTRAL = {"site", "page", "global", "bar", "box", "links", "buttons", "list", "block", "wrapper", "container", "top", "bottom"}
#: Words that mark a name as noise wherever they stand in it, unless it begins with one of ABOUT.
STRONG = {"comment", "comments", "replies", "disqus", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "newsletter",
          "cookie", "cookies", "consent", "gdpr", "breadcrumb", "breadcrumbs", "promo", "promotion", "related", "recommended"}
ABOUT = {"has", "no", "with", "without", "show", "hide", "is", "not"}
UNMARKED = {"html", "body", "main", "article"}  # never noise, whatever they are named
#: Words of those attributes on a div or section that mark the article, where no element does.
HINTS = {"article", "main", "content", "post", "entry", "story"}
WORDS = re.compile(r"[a-z]+")
DROP, OTHER, HINT, KEEP = 0, 1, 2, 3
#: Bits of alignment rows that are held at once.
ROW_BITS = 1 << 26
#: Bytes of html in a range of pages, which one task sorts.
RANGE_BYTES = 1 << 27


def marked(element: str, attrs: str) -> int:
    """DROP, HINT or OTHER by an element's attributes."""
    names: list[str] = []
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if key in ("class", "id", "role"):
            names += value.lower().split()
        elif key == "aria-label":
            names.append(value.lower())
        elif element not in ("html", "body") and (key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true"
                                                  or key == "style" and HIDDEN.search(html.unescape(value))):
            return DROP
    hint = False
    for name in names:
        parts = WORDS.findall(name)
        words = set(parts)
        if not words & NOISE:
            hint = hint or bool(words & HINTS)
        elif element not in UNMARKED and (words <= NOISE | NEUTRAL or words & STRONG and parts[0] not in ABOUT):
            return DROP
    return HINT if hint else OTHER


class Tags:
    """The tags and texts of a page, each character looked at a bounded number of times.

    A quote opens a value only after ``=`` and only if it closes somewhere.  Where no tag can end any more, quotes no longer
    count; a ``<`` without a ``>`` after it is text."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.unclosed: set[str] = set()  # quotes that do not occur any more

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``; there is a ``>`` after it."""
        first = at
        while (m := QUOTE.search(self.page, at)) is not None:
            if m[1] is None:
                return m.start()
            at = m.end()
            if m[1] in self.unclosed:
                continue
            close = self.page.find(m[1], at)
            if close < 0:
                self.unclosed.add(m[1])
            else:
                at = close + 1
        self.unclosed |= {'"', "'"}
        return self.page.find(">", first)

    def __iter__(self) -> Iterator[tuple[str | None, bool, str]]:
        """(None, False, text), or (name, closing, attributes); ``skip`` moves on."""
        page, self.at = self.page, 0
        while self.at < len(page):
            start = page.find("<", self.at)
            if start != self.at:
                stop = start if start >= 0 else len(page)
                text, self.at = page[self.at:stop], stop
                yield None, False, text
                continue
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                self.at = close + 3 if close >= 0 else len(page)
            elif start > self.last:
                self.at = len(page)
                yield None, False, page[start:]
            elif page.startswith(("<!", "<?"), start):
                self.at = page.find(">", start) + 1
            elif (m := TAG.match(page, start)) is not None and m.end() <= self.last:
                stop = self.end(m.end())
                self.at = stop + 1
                yield m[2].lower(), bool(m[1]), page[m.end():stop]
            else:
                self.at = start + 1
                yield None, False, "<"

    def skip(self, name: str) -> None:
        """Past the end tag of ``name``, or the rest of the page."""
        close = re.compile(rf"</{name}\s*>", re.I).search(self.page, self.at)
        self.at = close.end() if close else len(self.page)


class Stack:
    """The open elements: name, state inside, raw, how many blocks there are up to each, and the number of the outermost
    element that gave the state; found by name at once."""

    def __init__(self):
        self.items: list[tuple[str, int, bool, int, int]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, state: int, raw: bool, owner: int) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        self.items.append((name, state, raw, (self.items[-1][3] if self.items else 0) + (name in BLOCKS), owner))

    def cut(self, at: int) -> None:
        while len(self.items) > at:
            self.places[self.items.pop()[0]].pop()

    def last(self, name: str) -> int | None:
        found = self.places.get(name)
        return found[-1] if found else None

    def any_after(self, names: tuple[str, ...], at: int) -> bool:
        return any((self.last(n) if self.last(n) is not None else -1) > at for n in names)

    def blocks_after(self, at: int) -> bool:
        return self.items[-1][3] > self.items[at][3]

    def top(self) -> tuple[int, bool, int]:
        return (self.items[-1][1], self.items[-1][2], self.items[-1][4]) if self.items else (OTHER, False, 0)


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, DROP, OTHER, HINT or KEEP) of every block with text, in page order."""
    return [(text, kind) for text, kind, _ in owned_blocks(page)[0]]


def owned_blocks(page: str) -> tuple[list[tuple[str, int, int]], set[int]]:
    """(text, kind, number of the element that names it main content, else 0) of every block with text, in page order, and
    the numbers of the elements that hold an h1.  Unclosed elements end with their parent; end tags without a start are
    ignored; what follows an unclosed raw element is not text."""
    out: list[tuple[str, int, int]] = []
    stack, tags = Stack(), Tags(page)
    held: list[tuple[str, int, int]] = []  # text, state and owner where it stood
    state, raw, owner = OTHER, False, 0
    owners, headed = 0, set()

    def flush():
        """Ends a block.  What inline elements in it drop is a block of its own after it and does not split it."""
        for dropped in (False, True):
            parts = [x for x in held if (x[1] == DROP) == dropped]
            text = " ".join(html.unescape("".join(t for t, _, _ in parts)).split())
            if text:
                out.append((text, *parts[0][1:]))
        held.clear()

    for name, closing, rest in tags:
        if name is None:
            if not raw:
                held.append((rest, state, owner))
            continue
        if name in BLOCKS:
            flush()
        if closing:
            at = stack.last(name)
            if at is not None and not (name not in BLOCKS and stack.blocks_after(at)):
                flush() if name in RAW else None
                stack.cut(at)
                state, raw, owner = stack.top()
            continue
        if name == "br":
            held.append((" ", state, owner))  # a line break inside a block is white space
        if name in VOID or rest.endswith("/"):
            continue
        if name in ("script", "style", "textarea", "title") and not raw:  # their content is no markup
            tags.skip(name)
            continue
        if name in ("p", "li", "td", "tr", "dt", "dd") and (at := stack.last(name)) is not None:
            limit = {"li": ("ul", "ol", "menu"), "td": ("table",), "tr": ("table",)}.get(name, ("div", "article", "main", "section"))
            if not stack.any_after(limit, at):
                stack.cut(at)
                state, raw, owner = stack.top()
        inside = state
        mark = marked(name, rest) if rest else OTHER
        if name in BOILERPLATE and not (name == "header" and state == KEEP) or mark == DROP:
            inside = DROP
        elif name in MAIN and state != DROP:
            inside = KEEP
        elif mark == HINT and name in ("div", "section") and state == OTHER:
            inside = HINT
        if name in RAW:
            flush()
        raw = raw or name in RAW
        if inside >= HINT and inside > state:
            owners += 1
            owner = owners
        if name == "h1" and inside >= HINT:
            headed.add(owner)
        stack.push(name, inside, raw, owner if inside >= HINT else 0)
        state = inside
    flush()
    return out, headed


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which lines of ``a`` are part of a longest common subsequence with ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    mid, other = a[start:len(a) - stop], b[start:len(b) - stop]
    both = set(mid) & set(other)  # lines of one page only are part of no common subsequence
    found = iter(aligned([x for x in mid if x in both], [x for x in other if x in both]))
    return [True] * start + [x in both and next(found) for x in mid] + [True] * stop


def bit_rows(mid: list[int], other: list[int]) -> Iterator[int]:
    """After each line of ``mid`` a big integer: a zero bit j says that the LCS with ``other`` grows at column j."""
    masks: dict[int, int] = {}
    for j, line in enumerate(other):
        masks[line] = masks.get(line, 0) | (1 << j)
    v = full = (1 << len(other)) - 1
    for line in mid:
        u = v & masks.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def prefix_lengths(mid: list[int], other: list[int]) -> np.ndarray:
    """LCS lengths of ``mid`` with every prefix of ``other``, holding one row at a time."""
    v = (1 << len(other)) - 1
    for v in bit_rows(mid, other):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(other)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def aligned(mid: list[int], other: list[int]) -> list[bool]:
    """The lines of ``mid`` in a longest common subsequence: by the stored rows where they are small, else halves of
    ``mid`` are aligned with the two parts of ``other`` that together share most."""
    if len(mid) > 1 and len(mid) * len(other) > ROW_BITS:
        half = len(mid) // 2
        ahead, back = prefix_lengths(mid[:half], other), prefix_lengths(mid[half:][::-1], other[::-1])
        cut = int((ahead + back[::-1]).argmax())
        return aligned(mid[:half], other[:cut]) + aligned(mid[half:], other[cut:])
    full = (1 << len(other)) - 1
    rows = list(bit_rows(mid, other))
    shared, j = [False] * len(mid), len(other)
    for i in range(len(mid) - 1, -1, -1):  # a zero bit j of row i: the LCS grows at column j
        before = rows[i - 1] if i else full
        length = lambda r, k: k - (r & ((1 << k) - 1)).bit_count()
        while j and length(rows[i], j) == length(rows[i], j - 1):
            j -= 1
        if j and length(before, j) < length(rows[i], j):
            shared[i] = True
            j -= 1
    return shared


def likeness(a: str, b: str) -> int:
    """Length of the paths' common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def chosen(kinds: list[int], shared: list[bool], owners: list[int], headed: set[int]) -> list[int]:
    """The lines of the main text, by number.  Where markup names main content (elements before hints): the whole of those
    elements that have a line which is not shared, or an h1; all of them if every line is shared.  Else the lines that are
    neither boilerplate nor shared, or, if there are none (two copies of a page tell nothing about their template), those
    that are not boilerplate."""
    best = max(kinds, default=DROP)
    if best >= HINT:
        named = [i for i, k in enumerate(kinds) if k == best]
        own = {owners[i] for i in named if not shared[i]}
        return [i for i in named if owners[i] in own or owners[i] in headed] if own else named
    other = [i for i, k in enumerate(kinds) if k == OTHER]
    return [i for i in other if not shared[i]] or other


def assemble(lines: list[str], kinds: list[int], shared: list[bool]) -> str:
    """The main text of lines whose named elements are not told apart."""
    return "\n".join(lines[i] for i in chosen(kinds, shared, [0] * len(kinds), set()))


def parse(page: str) -> dict:
    """The lines of a page with kinds, owners and hashes."""
    from xxhash import xxh64_intdigest

    found, headed = owned_blocks(page)
    lines, kinds, owners = ([x[k] for x in found] for k in range(3))
    return {"lines": lines, "kinds": kinds, "owners": owners, "headed": headed,
            "marks": [xxh64_intdigest(t.encode("utf-8", "replace")) for t in lines]}


def neighbours(rows, state=None):
    """For sorted rows (key..., marks): yields each with its previous and next row inside the stream."""
    before = None
    current = None
    for row in rows:
        if current is not None:
            yield current, before, row
            before = current
        current = row
    if current is not None:
        yield current, before, None


def shared_lines(row: dict, before: dict | None, after: dict | None) -> list[bool]:
    """Which lines of a page the neighbour with the more similar path has too; none where the host has no other page."""
    near = [x for x in (before, after) if x is not None and (x["rng"], x["host"]) == (row["rng"], row["host"])]
    if not near:
        return [False] * len(row["marks"])
    best = max(near, key=lambda x: likeness(x["path"], row["path"]))  # the earlier page on a tie
    return common_lines(row["marks"], best["marks"])


def page_ranges(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bounds that deal pages by ``key`` into ranges, as many as there are shuffle partitions or more where these would pass
    RANGE_BYTES of html: rng, its group, the first key of each range (low, null for the first), the last key of the range
    before and the first of the next one.  And the same of whole groups, so that a page is compared with the bounds of
    groups and of one group's ranges only.  Only these keys reach the driver."""
    spark = keyed.sparkSession
    size = keyed.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1)
    found = (keyed.select("key").repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part"))
             .agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("part").collect())
    lows, highs = [r["low"] for r in found], [r["high"] for r in found]
    width = math.isqrt(len(found)) + 1
    low, before, after = [None, *lows[1:]], [None, *highs], [*lows[1:], None]
    kind = keyed.schema["key"].dataType
    bounds = [T.StructField(n, kind) for n in ("low", "before", "next")]
    number = [T.StructField(n, T.IntegerType()) for n in ("group", "rng")]
    every = range(len(found))
    groups = [(i // width, low[i], before[i], after[min(i + width, len(found)) - 1]) for i in every[::width]]
    return (spark.createDataFrame(groups, T.StructType(number[:1] + bounds)),
            spark.createDataFrame([(i // width, i, low[i], before[i], after[i]) for i in every], T.StructType(number + bounds)))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_shared (lines that differencing deletes) and n_restored (those of them
    that stay because markup names them main content).

    Null and empty pages give an empty text, null URLs form one host. Pages are ordered by range over the whole table,
    so no task holds a host; the last page of a range and the first of the next one go to both, as neighbours only.  Pages
    are shuffled once, parsed in order and aligned as they come; a task holds three of them.  Repeated pages stay repeated
    (rows equal in all columns are one key and share a task). Extra columns are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    url = F.coalesce(F.col("url"), F.lit(""))
    keyed = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.col(html_col).cast("string").alias("html"))
             .withColumn("rest", F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(url))
             .withColumn("key", F.struct(F.lower(F.substring_index("rest", "/", 1)).alias("host"),
                                         F.when(F.instr("rest", "/") > 0, F.expr("substr(rest, instr(rest, '/') + 1)"))
                                         .otherwise(F.lit("")).alias("path"),
                                         "page_id", F.xxhash64("html").alias("content")))
             .select("key", "url", "html"))
    groups, ranges = page_ranges(keyed)
    near = ((F.col("low").isNull() | (F.col("key") >= F.col("low")) | (F.col("key") == F.col("before")))
            & (F.col("next").isNull() | (F.col("key") <= F.col("next"))))
    lent = F.coalesce(F.col("key") < F.col("low"), F.lit(False)) | F.coalesce(F.col("key") == F.col("next"), F.lit(False))
    ordered = (keyed.join(F.broadcast(groups), near).select("group", "key", "url", "html")
               .join(F.broadcast(ranges), "group").where(near).select("rng", lent.alias("lent"), "key", "url", "html")
               .repartitionById(max(ranges.count(), 1), "rng").sortWithinPartitions("rng", "key")
               .select("rng", "lent", "key.host", "key.path", "key.page_id", "url", "html"))
    kind = keyed.schema["key"].dataType["page_id"].dataType.simpleString()

    def stream(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield row | parse(row.pop("html") or "")

    def texts(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("page_id", first.schema.field("page_id").type), ("url", pa.string()), ("text", pa.string()),
                            ("n_shared", pa.int64()), ("n_restored", pa.int64())])
        out, size = [], 0
        for row, before, after in neighbours(stream(chain([first], batches))):
            if row["lent"]:
                continue
            shared = shared_lines(row, before, after)
            kept = chosen(row["kinds"], shared, row["owners"], row["headed"])
            text = "\n".join(row["lines"][i] for i in kept)
            out.append({"page_id": row["page_id"], "url": row["url"], "text": text, "n_shared": sum(shared),
                        "n_restored": sum(shared[i] for i in kept)})
            size += len(text)
            if len(out) >= 1000 or size >= 1 << 24:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    out = ordered.mapInArrow(texts, f"page_id {kind}, url string, text string, n_shared long, n_restored long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_restored")
