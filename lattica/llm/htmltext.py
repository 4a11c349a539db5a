"""HTML extraction by two-pass block rules.

Pass 1 decides blocks: navigation and the like, and blocks that are mostly links, are out; long blocks with many stop words are text; all
others stay open. Pass 2 gives an open block the label of its nearest decided neighbour, where a neighbour in a deeper common element is the
nearer one. One pass over the pages, no state.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, in_python

#: Elements whose content is no text, that end a block, that hold boilerplate, and names that mark boilerplate.
SILENT = "script style noscript template textarea svg iframe object select option button canvas audio video map math head title"
BLOCKS = "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
BOILER = "nav header footer aside form menu dialog"
MARKS = r"ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|copyright|disclaimer|footer|header|legal|login|masthead|menu|meta|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|related|replies|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget"
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could do for from had has have he her his i if in into is it its just more my no not of on one only or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für haben hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes tu un une vos votre vous "
    "al como con cuando del desde donde el ella ellos era es esta este esto fue ha hay la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también te todo un una uno y ya".split()
)
SILENT_SET, BLOCK_SET, BOILER_SET = map(frozenset, (SILENT.split(), BLOCKS.split(), BOILER.split()))
CORE = frozenset(("article", "main"))
VOID = frozenset(("hr",))
NAMED = re.compile(rf"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
MARKED = re.compile(rf"(?:^|[\s_-])(?:{MARKS})(?:$|[\s_-])", re.I)
REST = r"<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)"
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>|{REST}""", re.S)
#: From the first tag on whose quotes leave no end, quotes mean nothing; so no tag looks through the rest of the page in vain again.
UNQUOTED = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|{REST}", re.S)
CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT_SET}
SPACE, BODY = re.compile(r"\s+"), re.compile(r"<body\b", re.I)

LINKED, LONG, STOPS = 0.5, 20, 0.2
LETTERS = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SECTIONS = frozenset(("article", "main", "section", "div", "td", "body"))


@dataclass
class Section:
    """An element that holds blocks: its depth, and whether it is named as the article or has a heading."""

    depth: int
    named: bool
    headed: bool = False


@dataclass
class Block:
    """low: the least depth of elements passed through since the block before; sections: of the elements around it the innermost one, and
    the outermost one that is named as the article."""

    text: str
    linked: float
    boiler: bool
    heading: bool
    low: int
    inner: Section
    core: Section | None


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order, with what the rules ask about them."""
    out: list[Block] = []
    root = Section(0, False)
    # of each open element: name, whether it marks boilerplate here or further out, innermost section, outermost core
    stack: list[tuple[str, bool, Section, Section | None]] = [("", False, root, None)]
    depths: dict[str, list[int]] = {}  # where in the stack each name is open
    ended: set[str] = set()  # names of which no closing tag follows, so that none is looked for again
    token = TOKEN
    links, heading, anchor, low, at, n = 0, False, 0, 0, 0, len(page)
    parts: list[str] = []

    def cut(k: int) -> None:
        """Closes the elements from the k-th on."""
        nonlocal low
        while len(stack) > k:
            depths[stack.pop()[0]].pop()
        low = min(low, len(stack) - 1)

    def found(name: str, pattern: re.Pattern) -> re.Match | None:
        m = None if name in ended else pattern.search(page, at)
        if not m:
            ended.add(name)
        return m

    def close() -> None:
        nonlocal links, heading, low
        if parts:
            raw = "".join(parts)
            text = SPACE.sub(" ", html.unescape(raw)).strip()
            if text:
                _, boiler, inner, core = stack[-1]
                inner.headed |= heading
                out.append(Block(text, min(1.0, links / max(1, len(raw.strip()))), boiler, heading, low, inner, core))
                low = len(stack) - 1
            parts.clear()
        links, heading = 0, False

    while at < n:
        m = token.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            links += len(text) * (anchor > 0)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if page[m.start() + 1 : m.start() + 3].lstrip("/")[:1].isalpha():
                token = UNQUOTED
            continue
        if name in SILENT_SET and not m[1]:
            if name == "head" or name in ("option", "select", "button", "object", "map", "math", "svg"):
                end = found(name, CLOSERS[name])
                body = found("body", BODY) if name == "head" and not end else None
                at = end.end() if end else body.start() if body else at
            else:
                end = found(name, CLOSERS[name])
                at = end.end() if end else n
            continue
        if name == "a":
            anchor = 0 if m[1] else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK_SET:
            close()
            if m[1]:
                if depths.get(name):
                    cut(depths[name][-1])
            elif name not in VOID:
                if name in ("p", "li", "td", "tr", "dd", "dt") and stack[-1][0] == name:
                    cut(len(stack) - 1)
                _, boiler, inner, core = stack[-1]
                marks = any(MARKED.search(x[0] or x[1] or x[2]) for x in NAMED.findall(m[3])) and name not in ("body", "html", *CORE)
                boiler = boiler or marks or name in BOILER_SET and not (name == "header" and core is not None)
                if name in SECTIONS:
                    inner = Section(len(stack), name in CORE)
                    core = core or (inner if inner.named else None)
                depths.setdefault(name, []).append(len(stack))
                stack.append((name, boiler, inner, core))
                heading = name in HEADINGS
    close()
    return out


def decided(block: Block) -> bool | None:
    """Pass 1. Long counts words, or six characters as one where words are not parted; stop words are counted among runs of letters."""
    if block.boiler or block.linked > LINKED:
        return False
    words = LETTERS.findall(block.text.lower())
    long = max(len(words), len(block.text) // 6) >= LONG
    return True if long and sum(w in STOP_WORDS for w in words) >= STOPS * len(words) else None


def neighbours(found: list[Block], first: list[bool | None]) -> list[list[tuple[int, int, bool]]]:
    """For each block the decided ones before and after it: (depth of the common element, blocks away, label). The
    page's edges count as decided against, outside of all elements."""
    n, out = len(found), []
    for forward in (True, False):
        near = [(0, 0, False)] * n
        depth, away, label = 0, 0, False
        for k in range(n) if forward else range(n - 1, -1, -1):
            if forward:
                depth = min(depth, found[k].low)
            away += 1
            near[k] = (depth, away, label)
            if first[k] is not None:
                depth, away, label = 1 << 30, 0, bool(first[k])
            if not forward:
                depth = min(depth, found[k].low)
        out.append(near)
    return out


def labels(found: list[Block]) -> list[bool]:
    """Both passes. Of an open block's decided neighbours before and after it, the one in the deeper common element counts; in equal
    depth the one fewer blocks away; in equal distance a heading follows the block after it, and others stay only if both do. Navigation and
    the like inside the named article says nothing about the blocks around it. Where a section has no decided block at all, it is text if the
    page names it as the article or it has a heading. A page without any block decided as text keeps its long open blocks."""
    first = [decided(b) for b in found]
    every = neighbours(found, first)
    inside = neighbours(found, [None if b.boiler else x for b, x in zip(found, first)])
    out, none = [], not any(first)
    for k, (block, label) in enumerate(zip(found, first)):
        if label is None:
            a, b = (near[k] for near in (inside if block.core else every))
            alone = block.core or block.inner
            if (alone.named or alone.headed) and max(a[0], b[0]) < alone.depth:
                label = True
            elif a[0] != b[0]:
                label = (a if a[0] > b[0] else b)[2]
            elif a[1] != b[1]:
                label = (a if a[1] < b[1] else b)[2]
            else:
                label = b[2] if block.heading else a[2] and b[2]
            label = label or none and len(block.text) // 6 >= LONG
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, one a line. Null, empty and article-free pages: the empty string."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, labels(found)) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (code points). Columns of these names in the input are replaced."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = "".join(f"{field(pages, c)}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    quoted = ["`" + c.replace("`", "``") + "`" for c in keep]
    return in_python(pages.select(*quoted, F.col(html_col)), run, f"{schema}text string, n_chars long")
