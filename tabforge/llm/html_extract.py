"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line weighs as many characters as
it has, or nothing when it belongs to page furniture (menus, headers, footers, forms,
adverts, comments and the like, told by element or by whole names in class, id and role) or
is mostly links. Article and main elements are evidence: each of their lines weighs as much
more as a surge needs, links or not, and where they hold most of the page's text the other
lines weigh nothing. Weights are summed over a sliding window of lines; text surges where
the sums leave zero and dives where they return to it, and the weighted lines between the
two are kept where the highest sum reaches the surge level.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import pieces

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
FURNITURE = frozenset(
    "head nav footer aside form menu dialog noscript template svg select button object audio video canvas map "
    "datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names in class, id and role values that mark page furniture, alone or beside each other and words of place.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices popup "
    "promo promoted promotion related search share sharing sidebar signup social sponsor sponsored subscribe "
    "complementary contentinfo alert alertdialog dialog".split()
)
PLACES = frozenset(
    "site page main global primary secondary sub top bottom left right mobile desktop sticky fixed block box list bar "
    "item items link links wrapper wrap container inner outer area slot unit widget widgets buttons button icons form "
    "user thread reply replies posts articles stories news and the".split()
)

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>?)",
    re.S,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_QUOTED = re.compile(r"(?:class|id|role|title|alt|href|src|content|data-[\w-]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')", re.I)


@dataclass(frozen=True)
class BlockParams:
    """``window``: lines summed up. A stretch must reach ``surge`` characters, or ``share`` of the page's highest sum
    where that is less: a short last paragraph does, a word between furniture does not.

    ``marked``: share of the characters that articles must hold for lines outside them to weigh nothing.
    """

    window: int = 3
    share: float = 0.2
    most_links: float = 0.5
    surge: int = 20
    marked: float = 0.5


def names_furniture(value: str) -> bool:
    """Whether a class, id or role names furniture as a whole: ``cookie-banner`` and ``site-header`` do, ``section-header``
    and ``share-price`` do not."""
    words = [w for w in re.split(r"[^a-z0-9]+", value) if w and not re.fullmatch(r"\d+(x\d+)?", w)]
    return any(w in NAMES for w in words) and all(w in NAMES or w in PLACES for w in words)


def is_furniture(name: str, attrs: str, in_article: bool) -> bool:
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if name in ("html", "body") or "=" not in attrs and "hidden" not in attrs:
        return False
    if name not in HEADINGS and name not in ("article", "main"):
        for m in _NAMED.finditer(attrs):
            for value in (m[1] or m[2] or m[3] or "").lower().split():
                if names_furniture(value) and not (in_article and value == "header"):
                    return True
    return bool(_HIDDEN.search(_QUOTED.sub("", attrs)))


@dataclass
class Line:
    text: str
    links: int  # characters of link text, cleaned like the text
    furniture: bool
    article: bool


def lines_of(page: str) -> list[Line]:
    """The page's lines of text in order, with what is known about each."""
    lines: list[Line] = []
    parts: list[str] = []
    linked: list[str] = []
    open_: list[tuple[str, bool]] = []  # (element, whether it starts furniture)
    zones = articles = anchors = 0

    def cleaned(pieces: list[str]) -> str:
        return " ".join(entities.unescape("".join(pieces)).split())

    def cut() -> None:
        if parts:
            if text := cleaned(parts):
                lines.append(Line(text, len(cleaned(linked)), zones > 0, articles > 0))
            parts.clear()
        linked.clear()

    def close(depth: int) -> None:
        nonlocal zones, articles, anchors
        for name, zone in open_[depth:]:
            zones -= zone
            articles -= name in ("article", "main")
            anchors -= name == "a"
        del open_[depth:]

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if anchors:
                linked.append(piece)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        block = name not in INLINE
        if m["end"]:
            if block:
                cut()
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] == name:
                    close(depth)
                    break
            continue
        if name == "br":
            parts.append(" ")
        if block:
            cut()
            # a block ends an open paragraph; an item ends the item before it
            for depth in range(len(open_) - 1, -1, -1):
                other = open_[depth][0]
                if other == "p" or other == name and name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    close(depth)
                    break
                if other not in INLINE:
                    break
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not (m["attrs"] or "").endswith("/>"):
            zone = is_furniture(name, m["attrs"] or "", articles > 0)
            if name in ("article", "main") and not zone and zones and not articles:
                # an article is no part of furniture that was never closed
                close(0)
            open_.append((name, zone))
            zones += zone
            articles += name in ("article", "main")
            anchors += name == "a"
    parts.append(page[at:])
    if anchors:
        linked.append(page[at:])
    cut()
    return lines


def main_text(page: str | None, p: BlockParams = BlockParams()) -> str:  # noqa: B008
    """The kept lines joined by newlines; empty for a null or empty page."""
    lines = lines_of(page or "")
    inside = [x.article and not x.furniture for x in lines]
    plain = [
        0 if x.furniture or not own and x.links > p.most_links * len(x.text) else len(x.text)
        for x, own in zip(lines, inside, strict=True)
    ]
    held = sum(w for w, own in zip(plain, inside, strict=True) if own)
    others = 0 if held and held >= p.marked * sum(plain) else 1
    weights = [w + p.surge if own else w * others for w, own in zip(plain, inside, strict=True)]
    sums = [sum(weights[i : i + p.window]) for i in range(len(weights))]
    least = min(p.surge, p.share * max(sums, default=0))
    kept: list[str] = []
    start = 0
    while start < len(sums):
        if not sums[start]:
            start += 1
            continue
        dive = start
        while dive < len(sums) and sums[dive]:
            dive += 1
        if max(sums[start:dive]) >= least:
            kept += [lines[i].text for i in range(start, dive) if weights[i]]
        start = dive
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, html: str = "html", params: BlockParams | None = None) -> DataFrame:
    """Adds ``text`` (empty if none) and ``n_chars`` (its code points) to every row of ``pages``.

    A null page is an empty one. Pages are read whole, whatever their length; repeated
    rows get equal texts and an empty table gives an empty result. Input columns named
    like an output are replaced.
    """
    p = params or BlockParams()

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces(batches):
            yield pa.array([main_text(t, p) for t in batch.to_pylist()], pa.string())

    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.select(*kept, extract(F.col(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
