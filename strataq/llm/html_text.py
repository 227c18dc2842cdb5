"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags; scripts, styles and comments are no text. The first pass decides
blocks by link density, length and the share of stop words, and by what an element says it is: blocks of menus,
side columns, forms, adverts, notices and comments are bad (by tag, role or the words of class and id). What is
short, or long with few stop words, stays ambiguous. The second pass gives ambiguous blocks the label of the
nearest decided neighbours. The borders of an article or main element count as decided: good inside, bad outside.

Pages are read in Arrow batches, each page by itself in one task; nothing is shuffled. Nulls, empty and long
pages: a null page is an empty one, with no text; long ones go whole. Broken markup: an unclosed script ends with
the page, unclosed elements end with those around them, stray end tags are skipped. A page without a good block
yields its ambiguous blocks. Repeated rows yield their text each. An empty table gives no rows. All columns of
the pages are kept but those named like the new ones.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .common import slices

#: Characters of a block below which it is short, and from which stop words alone make it good.
SHORT, LONG = 70, 200
MAX_LINKED, FEW_STOPS, MANY_STOPS = 0.33, 0.12, 0.2
#: A heading goes with a good block that begins at most so many characters later.
HEADING_REACH = 200

# Frequent short words of some languages, tags, and words of class and id attributes.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with be by this from or an at not have but they which
    der die das und ist nicht ein eine zu den von mit sich auf für dem des im auch als wie bei
    le la les des du et est un une que qui dans pour pas sur avec au aux ce par plus il elle
    el los las de y en es una por con para no se del lo su al más como
    il di che è per non sono della una del o os da do em um uma não com het een van niet dat""".split()
)
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp", "svg", "template", "select", "object", "canvas", "audio", "video", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
BAD_TAGS = frozenset("head nav footer aside form menu button dialog label fieldset".split())
BAD_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner werbung anzeige publicidad
    nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside rail widget widgets footer foot masthead topbar toolbar
    comment comments commentlist kommentare commentaires comentarios disqus respond reply replies discussion reviews
    cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer legal copyright
    newsletter subscribe subscription signup login register search share sharing social follow related recommended recommendations
    teaser teasers pager pagination paging tags taglist toc hidden""".split()
)
COMMENT_HEADING = re.compile(r"(?i)\s*(?:\d+\s+)?(?:(?:reader|user)\s+)?(?:comments?|kommentare?|commentaires?|comentarios?|responses?|replies|leave a (?:reply|comment))\b[\s\d():.]*$")

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_PARTS = re.compile(r"[A-Z]?[a-zà-ÿ]+|[A-Z]+|\d+")
_WORDS = re.compile(r"[^\W\d_]+")
#: An element's end that an opening tag of the kind implies.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_HOLDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_ARTICLE, _MAIN = 1, 2


@dataclass
class Block:
    text: str
    linked: float
    bad: bool
    heading: bool
    within: int  # _ARTICLE and _MAIN bits
    region: int
    label: bool | None = None


def _said_bad(name: str, attributes: str, inside: int) -> bool:
    """Whether an element says of itself that it is no main text."""
    if name in BAD_TAGS or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.lower() in BAD_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key in ("class", "id"):
            for item in value.split():
                parts = [p.lower() for p in _PARTS.findall(item)]
                # has-sidebar and the like speak of the page, not of the element
                if parts and parts[0] not in ("has", "with", "no", "without", "is", "page", "layout") and not BAD_WORDS.isdisjoint(parts):
                    return True
                if parts in (["header"], ["page", "header"], ["site", "header"]) and not inside:
                    return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with what their markup says of them."""
    found: list[Block] = []
    stack: list[list] = []  # name, bad, within, region
    opened: Counter = Counter()
    pieces: list[str] = []
    linked = breaks = regions = 0
    link_depth = -1  # height of the stack where a link was opened

    def flush() -> None:
        nonlocal linked, breaks
        breaks = 0
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                _, bad, within, region = stack[-1] if stack else ("", False, 0, 0)
                heading = any(s[0][0] == "h" and s[0][1:].isdigit() for s in stack[-2:])
                if heading and COMMENT_HEADING.match(text) and len(stack) > 1:
                    bad = stack[-2][1] = True  # what follows it in its parent are comments
                found.append(Block(text, min(1.0, linked / len(text)), bad, heading, within, region))
        linked = 0

    def close(names: tuple[str, ...], borders: tuple[str, ...] = ()) -> None:
        nonlocal link_depth
        if not any(opened[n] for n in names):
            return
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                for gone in stack[at:]:
                    opened[gone[0]] -= 1
                del stack[at:]
                if link_depth > at:
                    link_depth = -1
                return
            if stack[at][0] in borders:
                return

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        text = page[at : tag.start() if tag else size]
        if text:
            pieces.append(text)
            if link_depth >= 0:
                linked += len(text.strip())
            if not text.isspace():
                breaks = 0
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name == "a":
                link_depth = -1
            elif name in BLOCKS or opened[name]:
                if name in BLOCKS:
                    flush()
                close((name,), ("td", "th", "article", "main", "body") if name in ("p", "li", "b", "i", "span") else ())
            continue
        if name in _ENDS:
            if not tag[3].endswith("/") or name in ("script", "style", "textarea", "title"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else size
            pieces.append(" ")
            continue
        if name == "br":
            breaks += 1
            pieces.append(" ")
            if breaks > 1:
                flush()
            continue
        if name in BLOCKS:
            flush()
            if opened["p"] and name not in ("button", "label"):
                close(("p",), ("td", "th", "div", "section", "article", "main", "body", "li", "button"))
            if name in _CLOSES:
                close(_CLOSES[name], _HOLDERS[name])
        if name == "a":
            link_depth = len(stack)
        if name in VOID:
            continue
        top = stack[-1] if stack else ["", False, 0, 0]
        bad = _said_bad(name, tag[3], top[2])
        if name in BLOCKS or bad or opened[name]:
            within, region = top[2], top[3]
            inherited = top[1]
            if name in ("article", "main") and not bad:
                regions += 1
                region, within = regions, within | (_ARTICLE if name == "article" else _MAIN)
                inherited = inherited and not (top[0] == "form" or opened["form"])  # a form may wrap a whole page
            stack.append([name, bad or inherited, within, region])
            opened[name] += 1
    flush()
    return found


def _decide(block: Block) -> bool | None:
    """First pass: good, bad or (None) ambiguous."""
    size = len(block.text)
    if block.bad or block.linked > MAX_LINKED or (block.text.startswith("©") and size < LONG):
        return False
    if size < SHORT:
        return None
    words = _WORDS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    return True if stops >= (FEW_STOPS if size >= LONG else MANY_STOPS) else None


def _nearest(line: list[tuple[int, bool | None]]) -> list[tuple[int, bool] | None]:
    """For each item, place and label of the nearest decided one before it."""
    out: list[tuple[int, bool] | None] = []
    last = None
    for at, (_, x) in enumerate(line):
        out.append(last)
        last = last if x is None else (at, x)
    return out


def label_blocks(blocks: list[Block]) -> None:
    """Both passes: sets every block's label."""
    first = [_decide(b) for b in blocks]
    # Where articles (or else a main element) hold text of their own, the rest of the page is around them.
    inside = next((kind for kind in (_ARTICLE, _MAIN) if any(b.within & kind and x is not False for b, x in zip(blocks, first))), 0)
    if inside:
        first = [x if b.within & inside else False for b, x in zip(blocks, first)]
    line: list[tuple[int, bool | None]] = []  # blocks and borders of articles (-1, good) in order
    for i, (block, x) in enumerate(zip(blocks, first)):
        own = inside & block.within
        border = (-1, True)
        if own and (i == 0 or blocks[i - 1].region != block.region):
            line.append(border)
        line.append((i, x))
        if own and (i + 1 == len(blocks) or blocks[i + 1].region != block.region):
            line.append(border)
    before, after = _nearest(line), [None if x is None else (len(line) - 1 - x[0], x[1]) for x in reversed(_nearest(line[::-1]))]
    for at, (i, x) in enumerate(line):
        if i < 0:
            continue
        block, a, b = blocks[i], before[at], after[at]
        block.label = x
        if x is None:
            if a and b and a[1] != b[1] and at - a[0] == b[0] - at:
                block.label = len(block.text) >= SHORT
            elif a or b:
                block.label = a[1] if a and (not b or at - a[0] <= b[0] - at) else b[1]
            if block.heading and b and b[1] and not block.label:
                block.label = sum(len(blocks[j].text) for j, _ in line[at + 1 : b[0]] if j >= 0) <= HEADING_REACH
    if not any(b.label for b in blocks):
        for block, x in zip(blocks, first):
            block.label = x is None


def main_text(page: str | None) -> str:
    """A page's good blocks, one a line."""
    blocks = blocks_of(page or "")
    label_blocks(blocks)
    return "\n".join(b.text for b in blocks if b.label)


def _texts(batches: Iterator[pa.RecordBatch], column: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column):
        texts = [main_text(p) for p in batch.column(column).to_pylist()]
        kept = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages but html_col, with text (main text, empty if there is none) and n_chars (its code points)."""
    names = [n for n in pages.columns if n not in (html_col, "text", "n_chars")]
    schema = pages.select(*names).schema.add("text", StringType()).add("n_chars", LongType())
    return pages.select(*names, F.col(html_col).alias("__html")).mapInArrow(partial(_texts, column="__html", names=names), schema)
