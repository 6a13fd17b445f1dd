"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by link density, stop-word density and
length; short or middling blocks stay open. In the second pass each open block takes the label of its nearest decided
neighbour. What markup itself declares to be no article (menus, forms, scripts, hidden elements and so on) is no block
at all, and neither are reader comments, which their boxes' names tell. Boxes named as adverts and the like are left out as well, unless a long, dense block with few links in them
tells otherwise; then their blocks are judged as any others.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidied, with_code

# HTML vocabulary, and the most frequent function words of the languages covered.
RAW_TEXT = frozenset("script style textarea title xmp noframes noembed iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head nav footer aside form script style noscript template svg math button select option textarea iframe object canvas audio video dialog menu title datalist fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset dialog figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ZONES = frozenset(("article", "main"))
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations toc pagination pager login signup signin widget copyright legal disclaimer hidden search skip tags toolbar".split()
)
COMMENTS = frozenset("comment comments commentlist disqus".split())
COMMENT_PARTS = frozenset("area author body box container content count form group header inner item list main meta node reply replies respond section template text thread title view wrap wrapper".split())
# what ends a paragraph that is still open
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were all their one we can her has there been if more when will would who so no out up into do any your what than them some could time these two may then other "
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
        "le la les de des du un une et en à est que qui dans pour par sur pas au plus ne se ce il elle avec son sa ses ou mais nous vous leur été être a sont cette aux comme on tout deux "
        "el los las del y que en un una es por con no su para al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde"
    ).split()
)

SHORT, LONG = 70, 200
LOW_DENSITY, HIGH_DENSITY, LINKED, FEW_LINKED = 0.12, 0.25, 0.4, 0.1
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
# the end of a tag, or an attribute's name and its value in double quotes, single quotes or none
_ATTR = re.compile(r"""[ \t\n\f\r/]*+(?:(>)|([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r"'>][^ \t\n\f\r>]*+)?))?)""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W_]")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    zone: bool
    box: int = 0  # the innermost element around it whose names tell against it; 0: none
    label: bool | None = None


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of the tag whose name ends at ``at``, and the index of the > that ends it (-1: none does).

    Quotes open only after =, and a > within them is part of the value; a quote that is never closed is none.
    """
    found: dict[str, str] = {}
    while m := _ATTR.match(page, at):
        if m[1]:
            return found, m.end() - 1
        found.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")
        at = m.end()
    return found, -1


def _unwanted(name: str, attributes: dict[str, str]) -> bool:
    if name in SKIPPED or name not in ("html", "body", "main") and _comments(attributes):
        return True
    if name in ZONES or name in ("html", "body") or not attributes:
        return False
    for key, value in attributes.items():
        value = value.lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "hidden":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _parts(tokens: str) -> Iterator[list[str]]:
    return ([p.lower() for p in _NAME_PARTS.findall(t)] for t in tokens.split())


def _comments(attributes: dict[str, str]) -> bool:
    """Whether a class, the id or the item type of an element says that it holds reader comments."""
    if not attributes:
        return False
    if attributes.get("itemprop", "").lower() == "comment" or attributes.get("itemtype", "").lower().endswith("/comment"):
        return True
    named = _parts(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    return any(p and p[0] in COMMENTS and all(x in COMMENTS or x in COMMENT_PARTS or x.isdigit() for x in p) for p in named)


def _hinted(name: str, attributes: dict[str, str]) -> bool:
    """Whether a class or the id of an element consists of words that name no article, as ad or cookie-banner do."""
    if name in ZONES or name in ("html", "body"):
        return False
    named = _parts(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    return any(p and all(x in HINTS or x.isdigit() for x in p) and not all(map(str.isdigit, p)) for p in named)


def _density(text: str) -> float:
    """Share of stop words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without what its markup sets aside."""
    out: list[Block] = []
    stack: list[str] = []
    opened: Counter[str] = Counter()  # how many elements of each name are open
    skipped_at = -1  # depth of the element that is being skipped
    zones = links = headings = 0
    held: list[tuple[str, int, int]] = []  # text, how much of it is linked, its box
    boxes: list[tuple[int, int]] = []  # depth and number of the open elements whose names tell against them
    n_boxes = 0
    at = 0

    def text(raw: str) -> None:
        if raw and skipped_at < 0:
            held.append((raw, len(raw.strip()) if links else 0, boxes[-1][1] if boxes else 0))

    def flush() -> None:
        nonlocal held
        box = min((b for raw, _, b in held if raw.strip()), default=0)
        inner: dict[int, list[tuple[str, int, int]]] = {}  # parts of a line that are boxes of their own
        for h in held:
            if h[2] > box:
                inner.setdefault(h[2], []).append(h)
        for of, parts in inner.items():
            part = " ".join(html_lib.unescape("".join(h[0] for h in parts)).split())
            if len(part) > LONG and sum(h[1] for h in parts) <= FEW_LINKED * len(part) and (zones or _density(part) >= LOW_DENSITY):
                inner[of] = []
        held = [h for h in held if not inner.get(h[2])]
        if held:
            # references are decoded once a block is whole, so that none is cut
            line = " ".join(html_lib.unescape("".join(h[0] for h in held)).split())
            if line:
                out.append(Block(line, sum(h[1] for h in held), headings > 0, zones > 0, box))
        held = []

    def close() -> str:
        """Ends the innermost open element."""
        nonlocal zones, links, headings, skipped_at
        name = stack.pop()
        opened[name] -= 1
        if skipped_at >= 0:
            skipped_at = -1 if len(stack) == skipped_at else skipped_at
            return name
        while boxes and boxes[-1][0] >= len(stack):
            boxes.pop()
        zones -= name in ZONES
        links -= name == "a"
        headings -= len(name) == 2 and name[0] == "h" and name[1] in "123456"
        return name

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        attributes, end = ({}, page.find(">", m.end())) if m[2] else _attributes(page, m.end())
        if end < 0:
            at = len(page)
            break
        at = end + 1
        if m[2]:
            continue
        name = m[4].lower()
        if name == "br" or name == "hr":
            text(" ")
        if name in BLOCKS and skipped_at < 0:
            flush()
        if name in VOID:
            continue
        if m[3]:
            while opened[name] and close() != name:
                pass
            continue
        if stack and (stack[-1] == "p" and name in ENDS_PARAGRAPH or stack[-1] == name == "li"):
            close()
        in_article_header = name == "header" and zones > 0
        if skipped_at < 0 and (_unwanted(name, attributes) or name == "header" and not in_article_header):
            skipped_at = len(stack)
        if skipped_at < 0 and _hinted(name, attributes):
            n_boxes += 1
            boxes.append((len(stack), n_boxes))
        stack.append(name)
        opened[name] += 1
        if skipped_at < 0:
            zones += name in ZONES
            links += name == "a"
            headings += len(name) == 2 and name[0] == "h" and name[1] in "123456"
        if name in RAW_TEXT:
            last = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = last.start() if last else len(page)
    text(page[at:])
    flush()
    return out


def classify(found: list[Block]) -> None:
    """Labels each block: True is main text."""
    zoned = any(b.zone for b in found)
    densities = [_density(b.text) for b in found]
    listed = any(d >= LOW_DENSITY for d in densities)  # whether the lists have the page's language
    # boxes whose names are outweighed by a block in them
    fine = {0} | {b.box for b, d in zip(found, densities, strict=True) if len(b.text) > LONG and b.linked <= FEW_LINKED * len(b.text) and (d >= LOW_DENSITY or b.zone or not listed)}
    for b, density in zip(found, densities, strict=True):  # first pass
        n = len(b.text)
        if zoned and not b.zone or b.linked > LINKED * n or b.box not in fine:
            b.label = False
        elif n < SHORT or b.heading:
            b.label = None
        elif density >= HIGH_DENSITY or density >= LOW_DENSITY and n > LONG:
            b.label = True
        elif density >= LOW_DENSITY or b.zone:
            b.label = None
        else:
            b.label = False
    if not zoned and not any(b.label for b in found):  # a language without a list: length and links have to do
        for b in found:
            if len(b.text) > LONG and b.linked <= LINKED * len(b.text):
                b.label = True
    decided = [b.label for b in found]
    near: list[tuple[int, bool] | None] = [None] * len(found)
    last = None
    for i, x in enumerate(decided):
        last = (i, x) if x is not None else last
        near[i] = last
    following = None
    for i in range(len(found) - 1, -1, -1):  # second pass
        if decided[i] is not None:
            following = (i, decided[i])
            continue
        before = near[i]
        if found[i].heading and following:  # a heading belongs to what it stands above
            found[i].label = following[1]
        elif before and following:
            a, b = i - before[0], following[0] - i
            found[i].label = before[1] if a < b else following[1] if b < a else before[1] or following[1]
        elif before or following:
            found[i].label = (before or following)[1]
        else:
            found[i].label = found[i].zone or not zoned
        if found[i].zone and not found[i].label and not found[i].linked:
            # within an article only links tell against a block; its neighbours here were dropped for theirs
            found[i].label = True


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (the main text, empty if there is none), n_chars (its code points).

    Null html gives the empty text. Each page is handled alone and whole: no shuffle, no state, no limit on length.
    Rows that repeat are extracted each; other columns are not read.
    """
    with_code(pages.sparkSession)
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(tidied(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{url_col}` string, text string, n_chars long")
