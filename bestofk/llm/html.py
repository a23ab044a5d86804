"""Main text of web pages: two passes of block rules.

The first pass looks at each block alone: what stands in a menu, header, footer, sidebar, form, notice, advert or comment section is
boilerplate, as is a block of links; long blocks with many stop words are text, and so is every longer block of an article element that is not
made of links. Short blocks stay open. The second pass keeps the open blocks of an article, and gives one elsewhere the label of its nearest decided
neighbours on both sides; where those differ, stop words decide. A page that has no text by these rules (short paragraphs, another language) is judged by
length and links alone.

Pages are independent, so this is one narrow step over batches of rows.

Defined cases: a null or empty page has an empty text; broken markup is read as far as it makes sense (an article start ends an open menu, a
comment or script that never ends takes the rest); an article in an element that is hidden by a name like search-results only is inside again. Repeated rows are extracted each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?][^>]*>)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
RAW = frozenset("script style noscript template svg iframe object textarea title math canvas".split())
SKIPPED = frozenset("nav header footer aside form head button select menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
#: Of these, the ones that no article stands in: still open there, they were never closed.
UNCLOSED = frozenset("nav header head form button select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class and id values that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu navbar nav navigation breadcrumb breadcrumbs "
    "cookie cookies consent notice alert popup modal newsletter subscribe share sharing social related recommended comment comments disqus "
    "reply replies responses respond footer masthead toolbar pagination pager widget login signup search copyright".split()
)
#: Of these, the ones that no main article stands in, also as a part of a longer name.
CONTAINERS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent popup modal newsletter subscribe "
    "related recommended comment comments disqus reply replies responses respond".split()
)
#: Names that say what a page has or lacks, like has-sidebar or no-comments; they mark nothing.
STATE = re.compile(r"(?:has|no|not|with|without)[-_]")
#: Function words of the four languages, English, German, French, Spanish.
STOPS = frozenset(
    "the of and to in is a that it was for on with as by at from be are this an or not have he they his her "
    "der die das und zu den mit von ist ein eine nicht auf im dem des für sich als auch es an "
    "le la les de du des et un une est en que qui dans pour par sur pas au aux avec ce il "
    "el los las y del se no una por con para su al lo como más sus o".split()
)
LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.15, 0.25


@dataclass
class Block:
    outside: bool
    article: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


def _mark(attributes: str) -> int:
    """0: not marked; 1: by a longer name with a mark in it (search-results), which may go round a main article; 2: for certain."""
    if HIDDEN.search(attributes):
        return 2
    found = 0
    for groups in CLASS.findall(attributes):
        value = "".join(groups).lower()
        if value in ROLES:
            return 2
        for name in value.split():
            if not STATE.match(name) and (marks := MARKS & set(re.split(r"[^a-z]+", name))):
                found = max(found, 2 if name in MARKS or marks & CONTAINERS else 1)
    return found


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with what surrounds them."""
    found: list[Block] = []
    open_tags: list[tuple[str, int, bool]] = []  # each with: does it put its content outside the article (below 0: inside again), for certain
    outside = articles = inside = links = 0
    current: Block | None = None

    def put(text: str) -> None:
        nonlocal current
        if current is None:
            if not text.strip():
                return
            current = Block(outside > 0, articles if inside else 0)
            found.append(current)
        current.parts.append(text)
        if links:
            current.linked += len("".join(text.split()))

    def close(upto: int) -> None:
        nonlocal outside, inside, links
        while len(open_tags) > upto:
            name, hides, _ = open_tags.pop()
            outside -= hides
            inside -= name in ("article", "main")
            links -= name == "a"

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        put(references.unescape(page[at : m.start() if m else len(page)]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            k = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == name), None)
            if k is not None:
                close(k)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            put(" ")
        else:
            mark = _mark(m[3])
            if name in ("article", "main") and outside and not inside and mark < 2:
                first = next((i for i, t in enumerate(open_tags) if t[2]), None)
                if first is not None and open_tags[first][0] in UNCLOSED:
                    close(first)
            if name in ("p", "li", "a", "option"):  # these never nest: a new one ends the last, and what is open in it
                stop = {"li": ("ul", "ol")}.get(name, ("div", "article", "main", "section", "td", "body", "li") if name != "a" else BLOCKS)
                for i in range(len(open_tags) - 1, -1, -1):
                    if open_tags[i][0] == name:
                        close(i)
                        break
                    if open_tags[i][0] in stop:
                        break
            if name not in VOID and not m[3].endswith("/"):
                tag = name in SKIPPED and not (name == "header" and inside)
                hides = int(tag or (mark > 0 and name not in ("html", "body", "article", "main")))
                if name in ("article", "main"):
                    if mark == 2 or any(t[0] == "article" for t in open_tags):
                        hides = int(mark > 0 and inside > 0)
                    elif outside and not any(t[2] for t in open_tags):
                        hides = -outside  # only names like search-results hide it: inside again
                open_tags.append((name, hides, hides > 0 and (tag or mark == 2)))
                outside += hides
                if name in ("article", "main"):
                    articles += not inside
                    inside += 1
                links += name == "a"
        if name in BLOCKS:
            current = None
        elif name == "br":
            put(" ")
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text]


def classify(found: list[Block]) -> None:
    """Both passes; sets each block's label to text or other."""
    for b in found:
        letters = len(b.text.replace(" ", ""))
        tokens = [w.strip(".,;:!?()\"'").lower() for w in b.text.split()]
        stops = sum(w in STOPS for w in tokens) / max(1, len(tokens))
        linked = b.linked / max(1, letters)
        if b.outside or linked > LINKS:
            b.label = "other"
        elif len(b.text) < SHORT:
            b.label = "short"
        elif b.article or (stops >= STOP_HIGH and len(b.text) >= LONG):
            b.label = "text"
        elif stops >= STOP_LOW:
            b.label = "likely"
        else:
            b.label = "other"
    labels = [b.label for b in found]
    before, last = [], None
    for label in labels:
        before.append(last)
        last = label if label in ("text", "other") else last
    after, last = [], None
    for label in reversed(labels):
        after.append(last)
        last = label if label in ("text", "other") else last
    after.reverse()
    for i, b in enumerate(found):
        if labels[i] in ("text", "other"):
            continue
        if b.article:  # what is left of an article without adverts, share boxes and lists of links is its own
            b.label = "text"
            continue
        sides = {before[i], after[i]} - {None}
        b.label = "text" if sides == {"text"} or (labels[i] == "likely" and "text" in sides) else "other"
    if all(b.label == "other" for b in found):
        _without_stops(found)


def _without_stops(found: list[Block]) -> None:
    """A page with no text by stop words: what stands between boilerplate is text if it is long enough together, all of it if nothing is."""
    runs: list[list[Block]] = [[]]
    for b in found:
        if b.outside or b.linked > LINKS * len(b.text.replace(" ", "")):
            runs.append([])
        else:
            runs[-1].append(b)
    long = [run for run in runs if sum(len(b.text) for b in run) >= SHORT]
    for run in long or runs:
        for b in run:
            b.label = "text"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "text")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    rows = pages.select("page_id", "url", "html")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    out = rows.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
