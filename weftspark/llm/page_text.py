"""Main text of web pages: page differencing between nearest URLs, and block structure.

A page is cut into text lines, one per block element. Pages of a host are put in the order of
their URL paths, and each is paired with the two neighbours of other lines whose paths are
nearest; what is in the longest common subsequence of its lines with either one is their
template, and those lines go. Copies of a page are one page to the pairing, and a passage that
only one of the two quotes is no template. In a host of two different pages the other one
decides alone.

Differencing alone is wrong in two ways on real pages: it deletes an article that two pages
hold, and keeps an advert that changes from page to page. So all pages are differenced, and
structure is the check that follows. Lines inside navigation, headers, footers, asides, forms,
notices, adverts and comments go anyway; paragraphs, headings, items and cells inside an article
or main container stay anyway. Differencing decides on the other lines: all of a page without
such a container; those inside one that are in no element for text (unless the two pages share
most of it: then it is one article twice); and the headings and paragraphs beside one.

Only line hashes, ids and paths move for the pairing. The order of a host's pages comes from a
range sort that numbers them, and neighbours meet by number, so a host with a third of all
pages is spread like any other.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftspark.llm.shared import written

# HTML elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark what is not the article, and what is.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer header menu modal nav navbar navigation newsletter notice popup promo promoted promotion related reply replies "
    "share sharing sidebar social sponsor sponsored subscribe toolbar widget masthead copyright alert contentinfo complementary search".split()
)
MAIN_WORDS = frozenset("article content post entry story main".split())
#: Of these, the ones that a paragraph, a heading or an inline element inside an article goes by.
AD_WORDS = frozenset("ad ads advert advertisement adverts advertising sponsored share sharing".split())
#: A token that starts so tells of the layout: no-sidebar, has-sidebar.
LAYOUT = frozenset("no has with without not".split())
#: Elements that hold text of their own, and those of them that can belong to an article they stand beside.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
TEXT = PROSE | frozenset("li dt dd td th caption figcaption".split())
# What an end tag may be left out for. A start tag ends the open elements of its row, up to
# the first element that holds them; what may stand in a head; what a token inside an article consists of
# that tells of links, such as related-posts.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split()
)
ENDED = {
    **dict.fromkeys(("li",), frozenset(["li"])), **dict.fromkeys(("dt", "dd"), frozenset(["dt", "dd"])), **dict.fromkeys(("option", "optgroup"), frozenset(["option"])),
    **dict.fromkeys(("td", "th"), frozenset(["td", "th"])), "tr": frozenset(["tr", "td", "th"]),
    **dict.fromkeys(("tbody", "thead", "tfoot"), frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"])),
}
HOLDS = {"p": BLOCKS, "li": BLOCKS - {"address", "div", "p"}, "dt": BLOCKS - {"address", "div", "p"}, "option": BLOCKS, "td": frozenset(["table"])}
LINK_WORDS = frozenset("posts articles stories links items pages box block list buttons button bar container wrapper form signup feed".split())
#: What structure says of a line. Differencing decides on OPEN (no container on the page), INSIDE
#: (in a container, but in no element for text) and BESIDE (prose of a page with a container).
KEEP, DROP, OPEN, INSIDE, BESIDE = 1, 0, 2, 3, 4
#: While a page is read: dropped by words alone; in an article or main element within such an
#: element; in another article or main element.
SOFT, SOFT_MAIN, MAIN_ELEMENT = 5, 6, 7
#: What stays where differencing has nothing to say.
STAYS = frozenset((KEEP, OPEN, INSIDE))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|([^<]+)|(<)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _by_words(name: str, tokens: list[tuple[str, str]], inside: bool) -> int | None:
    """What (attribute, token) pairs of class, id and role say: SOFT, KEEP, or nothing (None).

    Whole tokens have more weight than parts, and inside an article nothing else counts, but for
    tokens of blocks that name links alone. A paragraph marked as a notice inside an article is read
    as part of it; a block so marked goes. Ids of
    headings, paragraphs and inline elements are anchors, as are those of sections: they say
    nothing, but for a section outside an article by its whole id.
    """
    small = name in PROSE or name not in BLOCKS
    whole: set[str] = set()
    parts: set[int] = set()
    listed = False
    for key, token in tokens:
        if key == "id" and (small or (name == "section" and inside)):
            continue
        whole.add(token.lower())
        words = [w.lower() for w in _WORD.findall(token)]
        # A block of links: related-posts, share-buttons.
        listed = listed or (inside and not small and key != "id" and len(words) > 1 and words[0] in ASIDE_WORDS and all(w in LINK_WORDS | ASIDE_WORDS for w in words))
        if inside or not words or words[0] in LAYOUT or (key == "id" and name == "section"):
            continue
        aside, main = [w in ASIDE_WORDS for w in words], any(w in MAIN_WORDS for w in words)
        if any(aside) and (not main or aside[0] or aside[-1]):  # sidebar-content, post-comments; not content-sidebar-wrapper
            parts.add(SOFT)
        elif main and not any(aside):
            parts.add(KEEP)
    if listed or whole & (AD_WORDS if inside and small else ASIDE_WORDS):
        return SOFT
    if whole & MAIN_WORDS:
        return KEEP
    return SOFT if SOFT in parts else KEEP if KEEP in parts else None


def _role(name: str, attributes: str, inside: bool) -> int | None:
    """What an element says of its content: DROP, SOFT, KEEP, or nothing (None); ``inside``: an article."""
    if name == "html" or name == "body":
        return None
    if name in ASIDE:
        return SOFT if name == "form" else DROP  # a form can be about the whole page
    tokens: list[tuple[str, str]] = []
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = a or b or c
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return DROP
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return DROP
            continue
        if key in ("class", "id", "role"):
            tokens += [(key, t) for t in value.split()]
    if name in MAIN:
        words = {w.lower() for _, t in tokens for w in _WORD.findall(t)}
        return DROP if words & {"comment", "comments", "reply"} else KEEP
    return _by_words(name, tokens, inside) if tokens else None


def _settled(lines: list[tuple[str, int, str, int]], holders: set[int]) -> list[tuple[str, int, str]]:
    """(text, KEEP, DROP or OPEN, element): an element dropped by words that holds the page's article is none to drop."""
    real = any(s == MAIN_ELEMENT for _, s, _, _ in lines)
    out = []
    for text, s, e, soft in lines:
        if s == MAIN_ELEMENT or (s == SOFT_MAIN and not real):
            s = KEEP
        elif s == SOFT and not real and soft in holders:
            s = OPEN
        elif s in (SOFT, SOFT_MAIN):
            s = DROP
        out.append((text, s, e))
    return out


def _ended(stack: list[tuple], name: str) -> int | None:
    """Where the stack ends as a start tag comes whose predecessors need no end tag: the outermost
    element it ends, or None."""
    found = None
    kinds = [("p", frozenset(["p"]))] if name in ENDS_P else []
    if name in ENDED:
        kinds.append(("td" if name in ("td", "th", "tr", "tbody", "thead", "tfoot") else "dt" if name == "dd" else "option" if name == "optgroup" else name, ENDED[name]))
    for kind, ends in kinds:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                found = i if found is None else min(i, found)
            elif stack[i][0] in HOLDS[kind]:
                break
    if name not in HEAD:
        found = next((i for i, e in enumerate(stack) if e[0] == "head"), found)
    return found


def page_lines(page: str) -> list[tuple[str, int]]:
    """The lines of a page in order, each with what structure says of it."""
    lines: list[tuple[str, int, str, int]] = []  # text, state, block element, number of the SOFT element
    held: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []  # element, state inside, hidden inside, number of the SOFT element
    state, hidden = OPEN, False
    softs, holders = 0, set()

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                lines.append((text, state, next((e[0] for e in reversed(stack) if e[0] in BLOCKS), ""), stack[-1][3] if stack else 0))
            held.clear()

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.match(page, at)
        at = token.end()
        closing, name, attributes, text, lone = token.groups()
        if text is not None or lone is not None:
            if stack and stack[-1][0] == "head" and (text is None or text.strip()):  # text ends a head
                stack.pop()
                state, hidden = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
            if not hidden:
                held.append(entities.unescape(text if text is not None else lone))
            continue
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
        elif name == "br" and not hidden:
            held.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    state, hidden = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
                    break
            continue
        if name in VOID:
            continue
        ended = _ended(stack, name)
        if ended is not None:
            del stack[ended:]
            state, hidden = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
        inside = state in (KEEP, SOFT_MAIN, MAIN_ELEMENT)
        role = _role(name, attributes, inside)
        if role == DROP and inside and name == "header":
            role = None  # an article's own header holds its title
        inner, soft = state, stack[-1][3] if stack else 0
        if state == DROP or role == DROP:
            inner = DROP
        elif role == SOFT:
            softs += 1
            inner, soft = SOFT, softs
        elif role == KEEP and name in MAIN:
            inner = SOFT_MAIN if state in (SOFT, SOFT_MAIN) else MAIN_ELEMENT
            holders.update(e[3] for e in stack)
        elif role == KEEP and state == OPEN:
            inner = KEEP
        out_of_sight = hidden or name in HIDDEN
        if not attributes.rstrip().endswith("/"):
            stack.append((name, inner, out_of_sight, soft))
            if inner != state and name not in BLOCKS:
                flush()
            state, hidden = inner, out_of_sight
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close:
                if name == "textarea":
                    held.clear()
                at = close.start()
            else:
                at = end
    flush()
    settled = _settled(lines, holders)
    if not any(s == KEEP for _, s, _ in settled):
        return [(t, s) for t, s, _ in settled]
    inside, beside = (KEEP, INSIDE), (BESIDE, DROP)
    return [(t, s if s == DROP else inside[e not in TEXT] if s == KEEP else beside[e not in PROSE]) for t, s, e in settled]


def turned_lines(states: bytes, shared: set[int]) -> list[int]:
    """Places of lines that differencing turns: OPEN and INSIDE ones that go, BESIDE ones that stay."""
    inside = [i for i, s in enumerate(states) if s in (KEEP, INSIDE)]
    twice = 2 * sum(i in shared for i in inside) > len(inside)  # one article on both pages
    return [
        i for i, s in enumerate(states)
        if (s == OPEN and i in shared) or (s == INSIDE and i in shared and not twice) or (s == BESIDE and i not in shared)
    ]


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski, 1977)."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            elif tails[k] > j:
                tails[k] = j
                links[k] = link
    out: set[int] = set()
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    return pages.withColumns({
        "_pt_html": F.coalesce(F.col(html_col), F.lit("")),
        "_pt_host": F.lower(F.regexp_extract(rest, r"^//([^/?#]*)", 1)),
        "_pt_path": F.regexp_replace(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"[?#].*$", ""),
    }).withColumn("_pt_row", F.xxhash64(F.col(id_col).cast("string"), F.col(url_col), "_pt_html"))


def _lines_of(keyed: DataFrame) -> DataFrame:
    """(row, host, path, hashes, states): line hashes of each page, and what structure says of the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [page_lines(p.as_py()) for p in batch.column(3)]
            hashes = [[xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for t, _ in lines] for lines in parsed]
            states = [bytes(s for _, s in lines) for lines in parsed]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array(states, pa.binary())],
                names=["row", "host", "path", "hashes", "states"],
            )

    rows = keyed.select("_pt_row", "_pt_host", "_pt_path", "_pt_html")
    return rows.mapInArrow(run, "row long, host string, path string, hashes array<long>, states binary")


def _classes(lines: DataFrame) -> DataFrame:
    """``lines`` with ``copy``: equal for pages of a host whose lines and their states are equal."""
    return lines.withColumn("copy", F.xxhash64("hashes", "states"))


def nearest_pairs(lines: DataFrame) -> DataFrame:
    """(row, host, copy, other, second): of each class of copies one page, and its two nearest in its host.

    They are sought two places before and after in the order of (host, path, row), without those
    of equal lines. Nearest: the longer common beginning of the paths; the closer place, if equal;
    the page before, if equal. ``second`` is null where there is one only.
    """
    light = _classes(lines).groupBy("host", "copy", F.xxhash64("hashes").alias("same")).agg(F.min(F.struct("path", "row")).alias("s"))
    light = light.select("host", "copy", "same", "s.*")
    placed = written(light.repartitionByRange("host", "path", "row").withColumn("part", F.spark_partition_id()), "page-order")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    starts = written(counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start")), "page-starts")
    inside = placed.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("host", "path", "row")))
    numbered = inside.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("at")).drop("part", "start")
    numbered = written(numbered, "page-numbers")

    a, b = F.col("path"), F.col("path_")
    n = F.least(F.char_length(a), F.char_length(b))
    same = lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)
    alike = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), same)), F.lit(0))  # length of the common beginning
    steps = F.explode(F.array(*[F.lit(d) for d in (-2, -1, 1, 2)]))
    asking = numbered.select("host", "copy", "same", "path", "row", "at", steps.alias("step")).withColumn("at", F.col("at") + F.col("step"))
    asked = numbered.select("at", *[F.col(c).alias(f"{c}_") for c in ("host", "same", "path", "row")])
    met = asking.join(asked, "at").where("host = host_ and same <> same_")
    order = F.struct((-alike).alias("far"), F.abs("step").alias("steps"), "step", F.col("row_").alias("row"))
    near = met.groupBy("row", "host", "copy").agg(F.sort_array(F.collect_list(order)).alias("near"))
    return near.select("row", "host", "copy", F.get("near", F.lit(0))["row"].alias("other"), F.get("near", F.lit(1))["row"].alias("second"))


def template_lines(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, turned): each page differenced with its nearest ones; the places of lines that this turns."""
    unique = lines.select("row", "hashes", "states").dropDuplicates(["row"])
    of = lambda row, name: unique.select(F.col("row").alias(row), F.col("hashes").alias(name))
    all_ = unique.join(pairs, "row").join(of("other", "theirs"), "other").join(of("second", "others"), "second", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = []
            for x, s, y, z in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                shared = common_lines(x, y)
                turned.append(turned_lines(s, shared if z is None else shared & common_lines(x, z)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(turned, pa.list_(pa.int32()))], names=["host", "copy", "turned"])

    turned = all_.select("host", "copy", "hashes", "states", "theirs", "others").mapInArrow(run, "host string, copy long, turned array<int>")
    turned = written(turned.where(F.size("turned") > 0), "page-turned")
    return _classes(lines).select("row", "host", "copy").distinct().join(turned, ["host", "copy"]).select("row", "turned")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` in code points.

    Blocks are joined by a line feed; white space within one is a single space; character
    references are decoded.

    * A null or empty page has the text "". A null URL is of the host "" and path "".
    * Rows repeated whole are one page to the pairing and both get its text. Ids may be null.
    * A host's only page has no partner: open lines stay, lines beside a container go.
    * Columns named ``text`` or ``n_chars`` are replaced. An empty table gives an empty table.
    """
    keyed = _keyed(pages, id_col, url_col, html_col)
    lines = written(_lines_of(keyed), "page-lines")
    turned = written(template_lines(lines, nearest_pairs(lines)), "page-template")
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    joined = keyed.join(turned.withColumnsRenamed({"row": "_pt_row", "turned": "_pt_turned"}), "_pt_row", "left")
    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, turned in zip(batch.column(len(names)), batch.column(len(names) + 1).to_pylist(), strict=True):
                found, turned = page_lines(page.as_py()), set(turned or ())
                out.append("\n".join(t for i, (t, s) in enumerate(found) if (s in STAYS) != (i in turned)))
            columns = [*batch.columns[: len(names)], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    return joined.select(*names, "_pt_html", "_pt_turned").mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
