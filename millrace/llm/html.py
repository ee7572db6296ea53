"""Main text of web pages, with the site's template removed.

Pages are read twice.  The first pass hashes the element subtrees of every page;
Spark counts on how many different pages of a host each hash stands, and those
on a good share of them are that host's template.  The second pass drops
template subtrees, elements that are never article text by their tag, role or
class, and writes the rest block by block.  Inside an ``article`` only
containers (lists, sections, tables) can be template: paragraphs and headings
of articles are kept however often they recur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_small, stored

#: Share of a host's different pages, and least number of them, from which a subtree is template.
SHARE, LEAST = 0.2, 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br"
    " math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mspace semantics".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of the same kind, up to the container named.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROP_TAGS = frozenset("head nav footer aside form script style noscript template iframe object svg canvas audio video button select textarea menu dialog title input annotation annotation-xml".split())
#: Of these, those that stand in a line: they go without ending the block around them.
QUIET = frozenset("script style noscript template iframe object svg canvas audio video button select textarea input annotation annotation-xml".split())
#: A button in one of these is a word of its text.
LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: A class, id or role made of these words only marks what is not the article.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr newsletter subscribe subscription popup modal overlay"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies related recommended share sharing social"
    " notice notices alert toolbar pagination pager widget search login signup skip complementary contentinfo".split()
)
#: These count outside articles only: an article may have a header with its title.
DROP_OUTSIDE = frozenset("header top topbar".split())
#: Characters of a text from which an element with such a name counts in its parent's hash.
LONG = 200
CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center address".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")


class _Open:
    """An element that is not closed yet."""

    __slots__ = ("drop", "hashes", "large", "named", "region", "tag", "where")

    def __init__(self, tag: str, where: int, drop: bool, region: int, mark: str, named: bool = False):
        self.named, self.large = named, tag in ("article", "main")
        self.tag, self.where, self.drop, self.region, self.hashes = tag, where, drop, region, [f"<{mark}>".encode()]


def _only(token: str, words: frozenset[str]) -> bool:
    """Whether the token is made of these words and nothing else."""
    return words.issuperset(found := _WORD.findall(token)) and bool(found)


def _going(events: list[tuple[int, str | None]], named: list[tuple[int, int]], articles: list[tuple[int, int]]) -> bytearray:
    """A mark for each event that goes with an element of such a name.

    An element stays if it holds the page's largest text block and less than
    that stands outside all such elements, or if it holds the article or main
    with the most text and that is no less than the largest block.
    """
    size = [0]
    for _, x in events:
        size.append(size[-1] + (len(x.strip()) if x else 0))
    largest, at, start = 0, 0, 0
    for i, (_, x) in enumerate([*events, (0, None)]):
        if x is None:
            if size[i] - size[start] > largest:
                largest, at = size[i] - size[start], next(j for j in range(start, i) if size[j + 1] > size[j])
            start = i + 1
    out = bytearray(len(events))
    for a, b in named:
        out[a:b] = b"\1" * (b - a)
    kept = [at] if sum(size[i + 1] - size[i] for i, gone in enumerate(out) if not gone) < largest else []
    if articles:
        a, b = max(articles, key=lambda x: size[x[1]] - size[x[0]])
        if size[b] - size[a] >= largest:
            kept.append(next((i for i in range(a, b) if size[i + 1] > size[i]), a))
    if kept:
        out = bytearray(len(events))
        for a, b in named:
            if not any(a <= i < b for i in kept):
                out[a:b] = b"\1" * (b - a)
    return out


def _region(events: list[tuple[int, str | None]]) -> int:
    """From which region on text counts: articles (2), the main part (1) or all (0).

    Articles that are only teasers do not count for the page: where the text
    outside holds a long block and is twice as much, it counts too.
    """
    sizes, longest, run = [0, 0, 0], 0, 0
    for region, x in events:
        size = len(x.strip()) if x else 0
        sizes[region] += size
        run = 0 if x is None or region == 2 else run + size
        longest = max(longest, run)
    if sizes[2] and not (longest >= LONG and sizes[0] + sizes[1] >= 2 * sizes[2]):
        return 2
    return 1 if sizes[1] else 0


def read(page: str, template: frozenset[bytes] = frozenset()) -> tuple[str, set[bytes]]:
    """(main text, hashes of the subtrees that could be template).

    Unclosed, misnested and cut-off mark-up is taken as browsers would; a tag
    that the end of the page cuts is dropped.
    """
    events: list[tuple[int, str | None]] = []  # (region, text), or None for a break between blocks
    hashes: set[bytes] = set()
    root = _Open("", 0, False, 0, "")
    stack = [root]
    named: list[tuple[int, int]] = []  # events of elements that go by their name, unless they hold the main text
    articles: list[tuple[int, int]] = []
    places: dict[str, list[int]] = {}  # for each tag where it is open, the innermost last

    def cut(at: int) -> None:
        del events[at:]
        for ranges in (named, articles):
            while ranges and ranges[-1][1] > at:
                ranges.pop()

    def close() -> None:
        own = stack.pop()
        places[own.tag].pop()
        up = stack[-1]
        if own.drop:
            cut(own.where)
            return
        if own.named and len(events) > own.where:
            named.append((own.where, len(events)))
        if own.named and not own.large:
            return
        up.large = up.large or own.large
        if own.tag in ("article", "main") and not own.named and len(events) > own.where:
            articles.append((own.where, len(events)))
        name = hashlib.blake2b(b"\0".join(own.hashes), digest_size=8).digest()
        inside = own.region == 2
        if len(own.hashes) > 1 and (own.tag in CONTAINERS if inside else own.tag not in INLINE) and own.tag not in ("html", "body", "article", "main"):
            hashes.add(name)
            if name in template:
                cut(own.where)
                events.append((own.region, None))
                return
        if len(own.hashes) > 1:
            up.hashes.append(name)
        if own.tag not in INLINE and own.tag not in QUIET:
            events.append((own.region, None))

    def opened(*tags: str) -> int:
        """Where the innermost open element of these tags is; 0 for none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_from(i: int) -> None:
        while len(stack) > i:
            close()

    def in_line() -> bool:
        """Whether the innermost element that is no part of a line is a paragraph or heading."""
        return next((x.tag for x in reversed(stack) if x.tag not in INLINE), "") in LINES

    def text(raw: str) -> None:
        if raw:
            raw = unescape(raw)
            events.append((stack[-1].region, raw))
            if raw.strip():
                stack[-1].large = stack[-1].large or len(raw) >= LONG
                stack[-1].hashes.append(" ".join(raw.split()).encode("utf-8", "surrogatepass"))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            rest = page[at:]
            text(rest)
            break
        text(page[at : m.start()])
        at = m.end()
        closing, tag, attributes, end = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if tag is None or end == "":
            continue
        tag = tag.lower()
        if closing:
            if i := opened(tag):
                close_from(i)
            elif tag == "br":
                events.append((stack[-1].region, " "))
            continue
        if tag in ENDS_P and (i := opened("p")) and opened("button", "td", "th") < i:
            close_from(i)
        if tag in SIBLINGS:
            like = next((pair for pair in (("dt", "dd"), ("td", "th")) if tag in pair), (tag,))
            if (i := opened(*like)) > opened(*SIBLINGS[tag]):
                close_from(i)
        here = stack[-1]
        button = tag == "button" and not here.drop and in_line()
        if tag not in INLINE and tag not in QUIET:
            events.append((here.region, None))
        if tag in VOID:
            if tag in ("br", "wbr") and tag == "br":
                events.append((here.region, " "))
            continue
        mark, drop, region = tag, tag in DROP_TAGS and not button, here.region
        said: dict[str, str] = {}
        words: set[str] = set()
        tokens: set[str] = set()
        by_name = False
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                said.setdefault(name.lower(), a or b or c)
            for name in ("class", "id", "role"):
                value = said.get(name, "").lower()
                words.update(_WORD.findall(value))
                tokens.update(value.split())
            mark += " " + " ".join(sorted(words))
            drop = drop or "hidden" in said or said.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(said.get("style", "")))
        if tag not in ("html", "body", "main") and not (tag == "article" and tokens.isdisjoint(("comment", "comments"))):
            by_name = any(_only(t, DROP_WORDS) or region == 0 and _only(t, DROP_WORDS | DROP_OUTSIDE) for t in tokens) or (region == 0 and tag == "header")
        if tag == "article":
            region = 2
        elif region == 0 and (tag == "main" or said.get("role", "").lower() == "main"):
            region = 1
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, len(events), drop, region, mark, by_name))
        if tag in RAW:
            close_at = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            end_at = close_at.start() if close_at else n
            if tag not in DROP_TAGS:
                text(page[at:end_at])
            at = end_at
    while len(stack) > 1:
        close()

    if named:
        gone = _going(events, named, articles)
        events = [(region, None) if gone[i] else (region, x) for i, (region, x) in enumerate(events)]
    least = _region(events)
    blocks, run = [], []
    for region, x in [*events, (least, None)]:
        if x is None:
            if run:
                if block := " ".join("".join(run).split()):
                    blocks.append(block)
                run = []
        elif region >= least:
            run.append(x)
    return "\n".join(blocks), hashes


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, template): the hashes that stand on many different pages of a host.

    Pages of a host with the same text are one page.  A host's list is bounded:
    each hash in it stands on ``share`` of the pages.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, signs, names = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                body, found = read(page or "")
                sign = hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                found = [b"", *found]  # the empty name counts the host's pages
                hosts += [host] * len(found)
                signs += [sign] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(signs, pa.binary()), pa.array(names, pa.binary())], names=["host", "sign", "name"])

    seen = _pages(pages).where("host != ''").select("host", "html").mapInArrow(hashed, "host string, sign binary, name binary")
    counts = stored(seen.distinct().groupBy("host", "name").agg(F.count("*").alias("n")), "subtrees")
    totals = counts.where(F.octet_length("name") == 0).select(F.col("host"), F.greatest(F.lit(least), F.ceil(F.col("n") * share)).alias("bar"))
    often = counts.where((F.octet_length("name") > 0) & (F.col("n") >= least)).join(totals, "host").where("n >= bar")
    return often.groupBy("host").agg(F.collect_list("name").alias("template"))


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty html gives an empty text; a page without a host in its url
    has no template; repeated rows and ids keep a row each.
    """
    bound_batches(pages.sparkSession)
    found = stored(templates(pages, share, least), "templates")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[bytes]] = {}
        for batch in batches:
            texts = []
            for host, page, names in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("template").to_pylist()):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = frozenset(names or ())
                texts.append(read(page or "", known[host])[0])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = join_small(_pages(pages), found, ["host"], "left")
    return rows.mapInArrow(take, "page_id long, url string, text string, n_chars long")
