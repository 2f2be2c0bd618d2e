"""Operator 3: main text of web pages, by nearest-URL page differencing.

Each page is cut into text lines (its blocks). Within a host, pages are ordered by URL path, and a page is paired with the
neighbour whose path shares the longer prefix (the one before it if equal). The two pages' lines are aligned by longest common
subsequence, and lines that both share are deleted: that is what a site repeats on its pages. Where the articles of a page, or else its
main element with them, have at least half of the characters that aren't deleted, they are known to be its text: their lines stay, shared
or not, and lines outside go; but lines in parts of them whose class words (DOUBTFUL) may mark a box of the site's stay only if they aren't shared. Elsewhere (teasers as articles beside a text in a div) the alignment decides on every line. Menus, headers, footers, asides,
hidden parts and code are never lines, by their elements and roles. Forms and boxes by class name (adverts, notices, comments, sidebars) are none unless they hold a main
element or, adverts, consents and comments apart, over half of the text (see _opened): a form may be around a whole page. A name whose marking word isn't its end
(`share-price`) makes no box; in articles it makes its lines doubtful.

Copies (pages of a host with the same lines) are one page in this, at the least of their URLs, and all get its result. Of a page that shares
over `copy_share` of its lines with its neighbour, only lines that the next neighbour shares too go, as the neighbour may be a near
copy; if the host has no third page, all shared lines go, unless none would be left.

Pairing sorts only URLs and line hashes, by range, so a host of any size is spread; the lines travel once, compressed.

Defined results: null or empty html gives an empty text. A null or odd url belongs to the host "". Equal rows get equal results. Broken markup is read as far as it goes; an unclosed comment or script runs to the end. Pages of any length and depth are read whole, in linear time.
Extra columns are ignored, also those named as columns of this module. Of two neighbours with paths equally near, the one before is taken; of equal rows all get one result. An empty table
gives an empty table. Blocks are joined by \\n; white space inside a block, and <br>, become one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Elements of HTML by their part in a page, and words of class, id and role attributes that mark what isn't text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SKIP = {"nav", "footer", "aside", "head", "menu", "button", "select", "svg", "canvas", "object", "audio", "video", "template", "dialog", "search", "map", "math"}
SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "note"}
SKIP_WORDS = {"ad", "ads", "adsense", "advert", "advertisement", "advertising", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets"}
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
HOLDERS = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body", "td", "th", "blockquote", "nav", "aside", "footer", "header", "form"}

#: Class words that inside an article may mark the article's own text: there, lines go only if the paired page shares them.
DOUBTFUL = {"alert", "notification", "recommended", "related", "search", "widget", "widgets"}
#: Words that mark adverts, at any place in a class name; and words of boxes that aren't text even where they are most of a page.
AD_WORDS = {"ad", "ads", "adsense", "advert", "advertisement", "advertising", "adverts", "promoted", "sponsor", "sponsored"}
STRICT = AD_WORDS | {"comment", "comments", "consent", "cookie", "cookies", "disqus", "gdpr", "replies", "respond"}
#: Before a word: a state, not a box (`no-comments`); a part of the text (`post-header`). After it: the box (`share-buttons`).
STATES = {"has", "have", "hide", "hides", "no", "non", "not", "with", "without"}
TEXT_NOUNS = {"article", "content", "entry", "post", "story"}
BOX_NOUNS = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "icons", "inner", "item", "items", "left", "links", "list", "outer", "panel", "right", "section", "slot", "thread", "top", "unit", "wrap", "wrapper", "zone"}

_CLOSES = {tag: [t for t, by in CLOSED_BY.items() if tag in by] for tag in set().union(*CLOSED_BY.values())}
# a quote opens a value only straight after "="; nothing is matched twice
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|(?=>))|(?!\s*+=))|=)*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?+")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
# one white space, attribute or "=" of _TAG
_STEP = re.compile(r"[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|(?=>))|(?!\s*+=))|=")
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody")
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_COMMENT_END = re.compile(r"--!?>")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _marked(names: str) -> tuple[set[str], bool]:
    """Words of SKIP_WORDS that class names and ids are, or end in (alone or before words of BOX_NOUNS); and whether others of the names have one.

    So `user-comments` and `share-buttons` are boxes, `share-price` may be one, and `no-comments` is none."""
    firm: set[str] = set()
    soft = False
    for name in names.split():
        parts = [w.lower() for w in _WORDS.findall(name)]
        for i, w in enumerate(parts):
            before = parts[i - 1] if i else ""
            if w not in SKIP_WORDS or before in STATES or (w in ("header", "byline") and before in TEXT_NOUNS):
                continue
            if all(x in SKIP_WORDS or x in BOX_NOUNS or x.isdigit() for x in parts[i + 1 :]) or (w in AD_WORDS and parts[i + 1] != "free"):
                firm.add(w)
            else:
                soft = True
    return firm, soft


def _unwanted(tag: str, raw: str, inside: bool) -> tuple[str, bool]:
    """What an element, inside an article or main or not, is: "" text, "skip" never text, "box" if it isn't most of the text, "strict" a box in any case; and whether
    its class names make it doubtful."""
    if tag in SKIP or (tag == "header" and not inside):
        return "skip", False
    if tag in ("html", "body", "main"):
        return "", False
    kind = "box" if tag == "form" else ""
    a = _attributes(raw)
    if not a:
        return kind, False
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or (role in SKIP_ROLES and role != "form") or re.search(r"display\s*:\s*none", a.get("style", "")):
        return "skip", False
    firm, soft = _marked(f"{a.get('class', '')} {a.get('id', '')}")
    if inside:
        soft = soft or bool(firm & DOUBTFUL)
        firm -= DOUBTFUL | {"header", "byline"}
    if firm & STRICT:
        return "strict", False
    if firm or role == "form":
        kind = "box"
    return kind, inside and soft and not kind


def _opened(out: list[tuple[str, int, int]], boxes: list[tuple[int, bool, bool]], mains: set[int]) -> list[bool]:
    """Which boxes (parent, strict, in an article or main) are text after all: those that hold a main element, or over half of the text of the articles and main that
    they are in, or of the page, where articles and main outside of boxes have under a tenth of it."""
    size = [0] * len(boxes)
    total = held = clean = 0
    for text, kind, box in out:
        total += len(text)
        held += len(text) if kind & 3 else 0
        if box >= 0:
            size[box] += len(text)
        elif kind & 3:
            clean += len(text)
    for i in range(len(boxes) - 1, -1, -1):  # parents come first
        if boxes[i][0] >= 0:
            size[boxes[i][0]] += size[i]
    found: list[bool] = []
    for i, (parent, strict, inside) in enumerate(boxes):
        most = not strict and (2 * size[i] > held if inside else 10 * clean < total and 2 * size[i] > total)
        found.append((parent < 0 or found[parent]) and (i in mains or most))
    return found


def _long(html: str, at: int, dead: set[int]) -> int:
    """End of the tag at `at`, or -1 if the page ends in it. `dead` has places between attributes from which the page ends in the tag: a tag that comes to one of them
    isn't read further, so all tags together are read in linear time."""
    name = _NAME.match(html, at)
    here, passed = name.end() if name else -1, []
    while 0 <= here < len(html) and html[here] != ">" and here not in dead:
        passed.append(here)
        here = m.end() if (m := _STEP.match(html, here)) else -1
    if 0 <= here < len(html) and html[here] == ">":
        return here + 1
    dead.update(passed)
    return -1


def _tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag, comment (name "!--"), declaration and raw element such as a script (name "!"), in time linear in the page.

    A tag whose quote or end is missing ends at the next ">"."""
    at, dead, ends = html.find("<"), set(), {}
    while at >= 0:
        m = _TAG.match(html, at, at + 512)
        tag = (m.end(), m[1], m[2], m[3]) if m else None
        if m is None and html[at + 1 : at + 3].lstrip("/")[:1].isalpha() and (name := _NAME.match(html, at)):
            close = html.find(">", name.end())
            if close < 0:
                yield at, len(html), "", "!", ""
                return
            end = _long(html, at, dead)
            end = end if end > 0 else close + 1
            tag = end, name[1], name[2], html[name.end() : end - 1]
        if tag:
            end, slash, name, raw = tag
            if not slash and name.lower() in RAW:
                kind = name.lower()
                m = ends.setdefault(kind, re.compile(rf"</{kind}(?=[\s/>])[^>]*>?", re.I)).search(html, end)
                end = m.end() if m else len(html)
                yield at, end, "", "!", ""
            else:
                yield at, end, slash, name, raw
        elif html.startswith("<!--", at):
            end = at + 5 if html.startswith("<!-->", at) else at + 6 if html.startswith("<!--->", at) else (close.end() if (close := _COMMENT_END.search(html, at + 4)) else len(html))
            yield at, end, "", "!--", ""
        elif html[at + 1 : at + 2] in ("!", "?", "/") and html[at + 1 : at + 2]:
            end = html.find(">", at) + 1 or len(html)
            yield at, end, "", "!", ""
        else:
            end = at + 1  # a plain "<"
        at = html.find("<", end)


def lines(html: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page, without what isn't text: (text, kind): 1 inside an article, 2 inside main, else 0; 4 more where a class word makes it doubtful."""
    out: list[tuple[str, int, int]] = []  # text, kind, innermost box
    if not html:
        return []
    stack: list[tuple[str, bool, int, int]] = []  # tag, skipped, kind, innermost box
    closable: list[int] = []  # depths of holders and of elements that others close
    opened: dict[str, int] = {}
    boxes: list[tuple[int, bool, bool]] = []
    mains: set[int] = set()  # boxes that hold a main element
    parts: list[str] = []
    skipped, kind, box, at = False, 0, -1, 0

    def add(text: str) -> None:
        parts.append(unescape(text) if "&" in text else text)

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, kind, box))
            parts.clear()

    def close_to(depth: int) -> None:
        nonlocal skipped, kind, box
        if any(tag in BLOCK for tag, *_ in stack[depth:]):
            end_block()
        for tag, *_ in stack[depth:]:
            opened[tag] -= 1
        del stack[depth:]
        while closable and closable[-1] >= depth:
            closable.pop()
        skipped, kind, box = stack[-1][1:] if stack else (False, 0, -1)

    for start, end, slash, name, raw in _tags(html):
        if not skipped and start > at:
            add(html[at:start])
        at = end
        if name[0] == "!":
            continue
        tag = name.lower()
        if slash:
            if opened.get(tag):
                close_to(next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag))
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br" and not skipped:
                parts.append(" ")
            continue
        for depth in reversed(closable) if any(opened.get(t) for t in _CLOSES.get(tag, ())) else ():
            if tag in CLOSED_BY.get(stack[depth][0], ()):
                close_to(depth)
                break
            if stack[depth][0] in HOLDERS:
                break
        if tag in BLOCK:
            end_block()
        if raw.endswith("/") and tag not in BLOCK:
            continue
        what, doubtful = ("skip", False) if skipped else _unwanted(tag, raw, kind & 3 > 0)
        skip, own, inner = what == "skip", kind, box
        if what in ("box", "strict"):
            inner = len(boxes)
            boxes.append((box, what == "strict", kind & 3 > 0))
        if not skip:
            main = tag == "main" or bool(_MAIN.search(raw))
            held = 1 if tag == "article" else kind & 3 or (2 if main else 0)
            own = held | (4 if doubtful or kind & 4 else 0)
            up = inner if main else -1
            while up >= 0 and up not in mains:
                mains.add(up)
                up = boxes[up][0]
        if (skip and not skipped) or own != kind or inner != box:
            end_block()
        if tag in HOLDERS or tag in CLOSED_BY:
            closable.append(len(stack))
        stack.append((tag, skip, own, inner))
        opened[tag] = opened.get(tag, 0) + 1
        skipped, kind, box = skip, own, inner
    if not skipped and at < len(html):
        add(html[at:])
    end_block()
    text = _opened(out, boxes, mains)
    return [(t, k) for t, k, b in out if b < 0 or text[b]]


def _rows(own: list[int], places: dict[int, int], width: int) -> Iterator[int]:
    """After each element of `own`, in bits: 0 where the longest common subsequence with the first j elements of the other grows at j."""
    row = full = (1 << width) - 1
    for x in own:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _places(other: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for j, x in enumerate(other):
        out[x] = out.get(x, 0) | 1 << j
    return out


def _lengths(own: list[int], other: list[int]) -> np.ndarray:
    """Of `own` with each prefix of `other`: the longest common subsequence's length."""
    row = (1 << len(other)) - 1
    for row in _rows(own, _places(other), len(other)):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.append(0, np.cumsum(bits == 0))


#: Bits of stored rows (8 MB) up to which a common subsequence is read off directly.
_DIRECT = 1 << 26


def shared(own: list[int], other: list[int]) -> list[int]:
    """Positions in `own` of a longest common subsequence with `other`.

    Rows of its table are numbers whose bits stand for the columns. Tables beyond _DIRECT are halved (Hirschberg), so memory stays bounded."""
    a, z = 0, 0
    while a < min(len(own), len(other)) and own[a] == other[a]:
        a += 1
    while z < min(len(own), len(other)) - a and own[-1 - z] == other[-1 - z]:
        z += 1
    middle, rest = own[a : len(own) - z], other[a : len(other) - z]
    known = set(rest)
    at = [i for i, x in enumerate(middle) if x in known]  # others can't be shared
    found = [at[i] for i in _common([middle[i] for i in at], rest)] if at else []
    return [*range(a), *(a + i for i in found), *range(len(own) - z, len(own))]


def _common(own: list[int], other: list[int]) -> list[int]:
    if not own or not other:
        return []
    if len(own) > 1 and len(own) * len(other) > _DIRECT:
        half = len(own) // 2
        left, right = _lengths(own[:half], other), _lengths(own[half:][::-1], other[::-1])
        cut = int(np.argmax(left + right[::-1]))
        return _common(own[:half], other[:cut]) + [half + i for i in _common(own[half:], other[cut:])]
    rows = list(_rows(own, _places(other), len(other)))
    out, j = [], len(other)
    for i in range(len(own) - 1, -1, -1):
        # the row grows at its last 0 bit before j; it is own[i]'s work if the row above doesn't grow as much
        here = ((1 << j) - 1) & ~rows[i]
        if not here:
            break
        above = ((1 << j) - 1) & ~rows[i - 1] if i else 0
        if above.bit_count() < here.bit_count():
            out.append(i)
            j = here.bit_length() - 1
    return out[::-1]


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, lines (compressed), kinds and hashes of the lines, key (of the host and the lines, so copies have one key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in common.slices(batches, "html"):
            blobs, kinds, hashes = [], [], []
            for html in batch.column("html").to_pylist():
                found = lines(html)
                blobs.append(pack.compress("\n".join(t for t, _ in found).encode("utf-8", "surrogatepass")))
                kinds.append([k for _, k in found])
                hashes.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(blobs, pa.binary()), pa.array(kinds, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], names=["page_id", "url", "lines", "kinds", "hashes"])

    kind = pages.schema["page_id"].dataType.simpleString()
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, f"page_id {kind}, url string, lines binary, kinds array<int>, hashes array<long>").withColumn("key", F.xxhash64(_host(), "hashes"))


def _host():
    return F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def pairs(urls: DataFrame) -> DataFrame:
    """urls(key, url) -> key, other, second: each row's neighbour by URL path within its host, if the host has another row, and the one on
    the other side, or else the next but one on the same side, if the host has a third."""
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = urls.select("key", _host().alias("host"), path.alias("path")).distinct().repartitionByRange(n, "host", "path", "key").sortWithinPartitions("host", "path", "key")
    # written, as another evaluation might draw other bounds
    placed = common.cut(spread.select("*", F.spark_partition_id().alias("part")))
    row = F.struct("host", "path", "key")
    near = lambda w: {"_b": F.lag(row).over(w), "_b2": F.lag(row, 2).over(w), "_a": F.lead(row).over(w), "_a2": F.lead(row, 2).over(w)}
    around = placed.withColumns(near(Window.partitionBy("part").orderBy("host", "path", "key")))
    # the first two and last two rows of each partition find theirs among each other
    ends = around.filter("_b2 is null or _a2 is null").select("host", "path", "key").withColumns(near(Window.orderBy("host", "path", "key")))
    ends = ends.select(F.struct("host", "path", "key").alias("_row"), *[F.col(x).alias(f"_e{x}") for x in ("_b", "_b2", "_a", "_a2")])
    around = around.join(F.broadcast(ends), row == F.col("_row"), "left")
    around = around.withColumns({x: F.coalesce(x, f"_e{x}") for x in ("_b", "_b2", "_a", "_a2")})
    around = around.withColumns({x: F.when(F.col(x)["host"] == F.col("host"), F.col(x)) for x in ("_b", "_b2", "_a", "_a2")})
    common_length = lambda x: F.coalesce(_prefix(F.col(x)["path"], F.col("path")), F.lit(-1))
    around = around.withColumns({"_nb": F.when(F.col("_b").isNull(), -1).otherwise(common_length("_b")), "_na": F.when(F.col("_a").isNull(), -1).otherwise(common_length("_a"))})
    before = F.col("_nb") >= F.col("_na")
    other = F.when(before, F.col("_b")).otherwise(F.col("_a"))["key"]
    second = F.when(before, F.coalesce("_a", "_b2")).otherwise(F.coalesce("_b", "_a2"))["key"]
    return around.select("key", other.alias("other"), second.alias("second")).filter("other is not null")


def _prefix(a, b):
    """How many characters two strings share from the start."""
    both = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, both)


def repeated(own: list[int], other: list[int], second: list[int] | None, copy_share: float) -> tuple[list[int], set[int]]:
    """Positions in `own` that its neighbour shares, and those of them that are the site's."""
    same = shared(own, other)
    if len(same) <= copy_share * max(len(own), len(other)):
        return same, set(same)
    if second is not None:
        return same, set(same) & set(shared(own, second))
    return same, set(same) if len(same) < len(own) else set()


def holder(found: list[str], kinds: list[int], site: set[int]) -> set[int]:
    """Kinds of the lines that hold a page's text: of its articles, or of main and articles, if most of the text that isn't the site's is there; else none."""
    own = [0, 0, 0]
    for i, (text, kind) in enumerate(zip(found, kinds, strict=True)):
        if i not in site:
            own[kind & 3] += len(text)
    kinds = {k & 3 for k in kinds}
    if 1 in kinds and own[1] >= own[0] + own[2]:
        return {1}
    return {1, 2} if 2 in kinds and own[1] + own[2] >= own[0] else set()


def extract(pages: DataFrame, copy_share: float = 0.9) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_lines, n_shared (with the paired page), n_deleted (of these)."""
    parsed = _parsed(pages)
    # pages are parsed twice rather than written out: only URLs and line hashes are
    slim = common.cut(parsed.select("key", "url", "hashes"))
    one = slim.groupBy("key").agg(F.min("url").alias("url"), F.first("hashes").alias("hashes"))
    paired = pairs(slim.groupBy("key").agg(F.min("url").alias("url")))
    of = lambda c: one.select(F.col("key").alias(c), F.col("hashes").alias(f"{c}_hashes"))
    found = paired.join(of("other"), "other").join(of("second"), "second", "left").select(F.col("key").alias("_k"), "other_hashes", "second_hashes")
    both = parsed.join(found, F.col("key") == F.col("_k"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in common.slices(batches, "lines", 1 << 20):
            texts, n_lines, n_shared, n_deleted = [], [], [], []
            for blob, kinds, own, other, second in zip(*(batch.column(c).to_pylist() for c in ("lines", "kinds", "hashes", "other_hashes", "second_hashes")), strict=True):
                found = unpack.decompress(blob).decode("utf-8", "surrogatepass").split("\n") if kinds else []
                same, site = repeated(own, other, second, copy_share) if other else ([], set())
                held = holder(found, kinds, site)
                gone = {i for i in site if not held or (kinds[i] & 4 and kinds[i] & 3 in held)}
                texts.append("\n".join(t for i, (t, k) in enumerate(zip(found, kinds, strict=True)) if i not in gone and (not held or k & 3 in held)))
                n_lines.append(len(found))
                n_shared.append(len(same))
                n_deleted.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_shared, pa.int64()), pa.array(n_deleted, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_deleted"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return both.select("page_id", "url", "lines", "kinds", "hashes", "other_hashes", "second_hashes").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_lines long, n_shared long, n_deleted long")
