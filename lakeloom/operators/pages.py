"""Text of raw web pages: a tokenizer by states, and the main block by density of text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no markup: it ends at their own end tag alone. That of the first isn't shown, that of the second is text.
HIDDEN_RAW, TEXT_RAW = frozenset(["script", "style", "xmp", "iframe", "noembed", "noframes"]), frozenset(["title", "textarea"])
#: Elements whose content isn't shown either, though it is markup.
HIDDEN = frozenset(["template", "head"])
#: Elements that run on within a line of text; all others begin a new one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that stand beside a page's main text.
BESIDE = frozenset(["nav", "footer", "aside", "menu", "form", "dialog"])
#: What a block costs, in words outside links.
BLOCK_COST = 8
#: Bytes of pages that a task holds at a time, unless one has more.
HELD = 8 << 20

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")


@dataclass
class Token:
    """Text, or a start or end tag with its attributes."""

    kind: str
    value: str
    attributes: dict[str, str] = field(default_factory=dict)


def tokens_of(html: str) -> Iterator[Token]:
    """Text, ``start`` and ``end`` tokens in order; entities are characters, comments and declarations are passed over.

    ``>`` within a quoted attribute doesn't end a tag. A comment, a tag or a
    raw element that is never closed reaches to the end of the page. A ``<``
    that begins none of these is text.
    """
    at, n = 0, len(html)
    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            yield Token("text", unescape(html[at:begin]))
        if begin == n:
            return
        after = html[begin + 1 : begin + 3]
        if html.startswith("<!--", begin):
            # A comment may be empty: <!--> and <!---> are whole.
            close = begin + 4 if html.startswith(">", begin + 4) else begin + 5 if html.startswith("->", begin + 4) else html.find("-->", begin + 4)
            at = n if close < 0 else html.index(">", close) + 1
        elif after[:1] in ("!", "?") or after[:1] == "/" and len(after) > 1 and not after[1].isalpha():
            close = html.find(">", begin)
            at = n if close < 0 else close + 1
        elif after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isalpha():
            ends = after[0] == "/"
            name = _NAME.match(html, begin + 1 + ends)
            value, at, attributes = name.group().lower(), name.end(), {}
            while at < n and (found := _ATTRIBUTE.match(html, at)):
                at = found.end()
                attributes.setdefault(found.group(1).lower(), unescape(next((v for v in found.groups()[1:] if v is not None), "")))
            at = html.find(">", at)
            if at < 0:
                return
            at += 1
            yield Token("end" if ends else "start", value, attributes)
            if not ends and value in HIDDEN_RAW | TEXT_RAW:
                close = re.compile(rf"</{re.escape(value)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                stop = close.start() if close else n
                if stop > at:
                    yield Token("text", unescape(html[at:stop]) if value in TEXT_RAW else html[at:stop])
                at = stop
        else:
            yield Token("text", "<")
            at = begin + 1


@dataclass
class Block:
    """A run of text between elements that break lines."""

    text: str
    linked: str
    beside: bool = False

    @property
    def gain(self) -> int:
        """Words outside links, less those in links and what a block costs; beside the main text all words count against it."""
        inside = len(self.text.split()) if self.beside else len(self.linked.split())
        return len(self.text.split()) - 2 * inside - BLOCK_COST


def blocks_of(html: str) -> tuple[str, list[Block]]:
    """The page's title and its shown blocks, white space collapsed."""
    title: list[str] = []
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    hidden: list[str] = []
    beside: list[str] = []
    links, raw = 0, ""

    def flush() -> None:
        whole = _SPACE.sub(" ", "".join(text)).strip(" ")
        if whole:
            out.append(Block(whole, _SPACE.sub(" ", "".join(linked)).strip(" "), bool(beside)))
        text.clear()
        linked.clear()

    for token in tokens_of(html):
        name = token.value
        if token.kind == "text":
            if raw == "title":
                title.append(name)
            elif raw not in HIDDEN_RAW and not hidden:
                text.append(name)
                if links:
                    linked.append(name)
            continue
        raw = name if token.kind == "start" and name in HIDDEN_RAW | TEXT_RAW else ""
        if name == "body" and token.kind == "start":
            hidden.clear()  # a head without end
        if name not in INLINE:
            flush()
        for names, within in ((HIDDEN, hidden), (BESIDE, beside)):
            if name in names and token.kind == "start":
                within.append(name)
            elif name in within:
                del within[within.index(name) :]
        if name == "a":
            links = int(token.kind == "start")
        if name in INLINE:
            if name in ("img", "input") or links and token.kind == "end":
                linked.append(" ")
        elif token.kind == "end" and name not in ("p", "div"):
            links = 0  # a link without end stops where its block does
    flush()
    return _SPACE.sub(" ", "".join(title)).strip(" "), out


def main_of(blocks: list[Block]) -> list[Block]:
    """The blocks in a row whose gains have the greatest sum, the first of equals; none if no sum is positive."""
    best, start, low, total, least = 0, 0, (0, 0), 0, 0
    for k, b in enumerate(blocks, 1):
        total += b.gain
        if total - least > best:
            best, low = total - least, (start, k)
        if total < least:
            least, start = total, k
    return blocks[low[0] : low[1]]


def page_texts(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with ``title``, ``text`` and ``main_text`` in place of ``html_col``.

    ``text`` has a line for each shown block, ``main_text`` the lines of the
    main one: those in a row that hold most words outside links and outside
    elements that stand ``BESIDE`` it, each line costing ``BLOCK_COST`` words,
    so navigation, advertisements and footers stay out. It is empty where no line has that many. A null page has nulls,
    an empty one empty texts; columns of the three names are replaced. Pages
    are read whole, one after the other; nothing is exchanged.
    """
    own = pages.drop("title", "text", "main_text")
    kept = [c for c in own.columns if c != html_col]
    own = own.select(*kept, F.col(html_col).cast("string").alias(html_col))
    result = own.select(*kept, *[F.lit(None).cast("string").alias(c) for c in ("title", "text", "main_text")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * HELD / max(batch.nbytes, 1)))
            for k in range(0, batch.num_rows, step):
                part, found = batch.slice(k, step), []
                for html in part.column(len(kept)).to_pylist():
                    title, blocks = blocks_of(html or "")
                    lines = [[b.text for b in x] for x in (blocks, main_of(blocks))]
                    found.append((None,) * 3 if html is None else (title, *map("\n".join, lines)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([x[c] for x in found], pa.string()) for c in range(3))], [*kept, "title", "text", "main_text"])

    return own.mapInArrow(run, result)
