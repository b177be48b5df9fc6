"""Main text of web pages by two-pass block rules (operator 5).

A page is cut into blocks.  Blocks within elements that never hold the article
(menus, forms, comments and the like, by tag, role or class) are set aside.
The first pass decides the others by length, stop-word density and link
density; what is too short to tell inherits, in the second pass, the label of
the nearest decided block of the same region.  Within an article a name that
prose goes by as well (form-of-government, legal-history, related-work) only
makes its element doubtful, a region of its own: long prose in it is main text.

Work is proportional to the page: the elements that a tag may close are found
by name, and both neighbours of every block in one sweep each.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import text_batches

#: Blocks up to this length are too short to decide; from LONG on, few stop words are enough.
SHORT, LONG = 70, 200
STOP_HIGH, STOP_LOW = 0.25, 0.08
LINK_HIGH = 0.5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can for from had has have he her his i if in is it its more not of on or our she so than that the their them there they this to was we were what when which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat ich ihr im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et été il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del donde el ella entre era es esta este están fue ha hay la las lo los más me mi muy no nos o para pero por que se sin sobre son su sus también te un una y ya".split()
)
# Element names.
_RAW = frozenset("script style noscript template iframe svg math canvas object textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("head nav footer aside form button select dialog menu datalist audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img picture source td th input".split())
_CLOSES_P = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure address header footer nav aside form hr fieldset details".split())
# Parts of class, id and role names of what surrounds an article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "sidebar sidenav menu menubar nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus "
    "widget widgets pagination pager copyright legal disclaimer login signup signin register search searchbox skip tagcloud contentinfo complementary form feedback paywall".split()
)
_HEADER = frozenset("header banner masthead".split())
# Those that, beside another word, may name a part of an article, too.
_DOUBTFUL = frozenset("foot form legal register related response search share social".split())

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")


class _Block:
    __slots__ = ("doubtful", "links", "region", "tag", "text")

    def __init__(self, tag: str, text: str, links: int, region: int, doubtful: bool = False):
        self.tag, self.text, self.links, self.region, self.doubtful = tag, text, links, region, doubtful


#: Whether an element holds the article: it may, it is doubtful, it doesn't.
_MAY, _DOUBT, _NEVER = 0, 1, 2


def _surrounds(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _ASIDE or (tag == "header" and not in_article):
        return _NEVER
    worst = _MAY
    if not attributes.strip():
        return worst
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return _NEVER
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                marks = [p for p in parts if p in _MARKS]
                if marks and in_article and name != "role" and len(marks) < len(parts) and all(p in _DOUBTFUL for p in marks):
                    worst = _DOUBT
                elif marks or (not in_article and parts[-1:] and parts[-1] in _HEADER):
                    return _NEVER
    return worst


def _is_article(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or bool(attributes and re.search(r"""(?:role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b)""", attributes))


def blocks(page: str) -> list[_Block]:
    """The page's blocks outside surrounding elements, in order.  region: 0 outside any article, else the number of the article."""
    out: list[_Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, set aside, region
    depths: dict[str, list[int]] = {}  # of the open elements of each tag
    text: list[str] = []
    links, articles, at, tag_now = 0, 0, 0, "body"
    aside, region, in_link = _MAY, 0, 0

    def cut():
        nonlocal links
        joined = " ".join(_html.unescape("".join(text)).split())
        if joined:
            out.append(_Block(tag_now, joined, min(links, len(joined)), region, aside == _DOUBT))
        text.clear()
        links = 0

    def add(part: str):
        nonlocal links
        if part and aside != _NEVER:
            text.append(part)
            if in_link:
                links += len(" ".join(_html.unescape(part).split()))

    def leave(depth: int):
        nonlocal aside, region, in_link
        for tag, _, _ in stack[depth:]:
            in_link -= tag == "a"
            depths[tag].pop()
        del stack[depth:]
        aside, region = (stack[-1][1], stack[-1][2]) if stack else (_MAY, 0)

    def innermost(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            depth = innermost((tag,))
            if depth >= 0:
                if tag not in _INLINE or any(t not in _INLINE for t, _, _ in stack[depth:]):
                    cut()
                elif tag in ("td", "th"):
                    add(" ")
                leave(depth)
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                add(" ")
            continue
        if tag in _CLOSES_P or tag in ("li", "dt", "dd", "tr"):
            closes = ("p",) if tag in _CLOSES_P else ("li",) if tag == "li" else ("tr",) if tag == "tr" else ("dt", "dd")
            stops = ("ul", "ol") if tag == "li" else ("table",) if tag == "tr" else ("dl",) if tag in ("dt", "dd") else ("div", "section", "article", "td", "th", "li", "blockquote", "body")
            depth = innermost(closes)
            if depth > innermost(stops):
                cut()
                leave(depth)
        if tag not in _INLINE:
            cut()
            tag_now = tag
        elif tag in ("td", "th"):
            add(" ")
        if attributes.endswith("/") and tag in _INLINE:
            continue
        hide = _NEVER if aside == _NEVER else max(aside, _surrounds(tag, attributes, region > 0))
        if (_is_article(tag, attributes) and not region) or (hide == _DOUBT and aside == _MAY):
            articles += 1
            stack.append((tag, hide, articles))
        else:
            stack.append((tag, hide, region))
        depths.setdefault(tag, []).append(len(stack) - 1)
        aside, region = hide, stack[-1][2]  # an inline element set aside leaves its block open
        in_link += tag == "a"
    cut()
    return out


def _decide(b: _Block, article: bool) -> bool | None:
    """First pass: main text, surroundings, or too short to tell."""
    n = len(b.text)
    linked, heading = b.links / n, b.tag[:1] == "h" and b.tag[1:].isdigit()
    if linked > LINK_HIGH:
        return None if article and (b.tag == "p" or heading) else False
    if article and n > SHORT:
        return True
    words = _WORD.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if not article and n <= 2 * SHORT and re.search(r"©|\bcopyright\b|all rights reserved", b.text, re.I):
        return False
    if n <= SHORT or heading:
        return None
    if b.doubtful:
        return n >= LONG and density >= STOP_HIGH
    if density >= STOP_HIGH or (n >= LONG and density >= STOP_LOW):
        return True
    return False if density < STOP_LOW and n < LONG else None


def classify(found: list[_Block]) -> list[bool]:
    """Whether each block is main text."""
    named = any(b.region for b in found)
    labels: list[bool | None] = [False if named and not b.region else _decide(b, b.region > 0 and not b.doubtful) for b in found]
    def decided(order) -> list[int | None]:
        """The last decided block of the same region before each, in that order."""
        last: dict[int, int] = {}
        near: list[int | None] = [None] * len(found)
        for i in order:
            near[i] = last.get(found[i].region)
            if labels[i] is not None:
                last[found[i].region] = i
        return near

    before, behind = decided(range(len(found))), decided(range(len(found) - 1, -1, -1))
    out = []
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        if label is None:
            p, q = before[i], behind[i]
            ways = [(i - p, 1, labels[p])] if p is not None else []
            ways += [(q - i, 0, labels[q])] if q is not None else []
            if not ways:
                label = (b.region > 0 and not b.doubtful) or not named
            elif len(ways) == 2 and ways[0][0] == ways[1][0] and (b.region or b.tag[:1] != "h"):
                label = bool(labels[p] or labels[q])
            else:  # the nearest; a heading goes with what follows
                label = bool(min(ways, key=lambda w: w[:2])[2])
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """Main text of a page; a null or empty one has none."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, main in zip(found, classify(found), strict=True) if main)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each page; no shuffle.

    Null or empty html: an empty text.  Whole pages are read, however long.  A
    null id or url stays null; repeated rows each give their row; an empty table
    gives none.  Other columns are not read, so their names cannot clash.
    """
    text_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
