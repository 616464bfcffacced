"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Lines of menus, headers, footers, sidebars, notices,
adverts, forms, comments and the like count as empty, as do lines that are mostly links. Names of classes only add to
what elements say: outside of articles one such name is enough, within an article every name of the element must be one, so
no text of an article is lost to a word of a name. Over the lines' text lengths a window slides; crossing the edge of a region adds empty
lines, so regions are never taken for one text. Where the window's sum leaves zero a stretch of text begins, and where it returns
to zero it ends. Of the stretches, those inside an article (or the main element) are kept whole.

A page without either has its density to go by. Lines are dense that stand in a paragraph or heading, read as a sentence or
reach half of the page's mean dense length; the text surges with the first dense line and dives after the last one. What is
before the surge and behind the dive (menus and closing lines in plain elements) is cut; nothing in between is. What such a page has loose
behind its own footer must have a window of half the page's highest.

Defined cases: a null or empty page has an empty text; markup that is cut off at the end of a page is dropped,
elements left open end with the element around them; repeated rows give repeated results; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines of the sliding window.
WINDOW = 3
#: Share of the mean length of paragraphs and sentences from which any line is dense.
DENSE = 0.5
#: Share of a line's characters in links from which it counts as empty, outside of articles.
LINKS = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements by their part in a page.
RAW = frozenset("script style noscript template svg math iframe object textarea title select canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("td th".split())
#: Text in one of these is not loose in the body.
CONTAINERS = frozenset("div section center table ul ol dl blockquote pre figure details fieldset address hgroup".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption caption summary td th".split())
_SENTENCE = re.compile(r"\S\s.*[.!?:;…。！？][\"'”’»)]*\Z", re.S)
_CLOSING = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_BOILERPLATE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|nav|navbar|navigation|menu|"
    r"breadcrumbs?|sidebar|side|rail|widget|footer|masthead|header|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|"
    r"comments?|replies|respond|disqus|complementary|contentinfo|skip|pagination|pager|toolbar|tags?|meta|byline)(?:$|[\s_-])", re.I)


class _Line:
    __slots__ = ("parts", "chars", "links", "out", "main", "late", "prose")

    def __init__(self, out: bool, main: bool, late: bool, prose: bool = True):
        self.parts, self.chars, self.links, self.out, self.main, self.late, self.prose = [], 0, 0, out, main, late, prose

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def _outside(name: str, attributes: str, main: bool) -> bool:
    """Whether an element is no part of the main text; `main`: within an article or main element."""
    if name in BOILERPLATE:
        return True
    if name in ("html", "body", "main", "p", "a", "b", "i", "em", "strong", "span") and "comment" not in attributes:
        return False
    names = [n for m in _NAMES.finditer(attributes) for n in next(filter(None, m.groups()), "").split()]
    return bool(names) and (all if main else any)(_BOILERPLATE_NAME.search(n) for n in names)


def lines_of(html: str) -> list[_Line]:
    """The page as lines; a None stands where a region begins or ends."""
    lines: list[_Line | None] = []
    open_elements: list[tuple[str, bool, bool, bool, bool]] = []  # name, outside, main, link, in a container
    line = _Line(False, False, False)
    done, footer = 0, False
    tokens = _TOKEN.finditer(html)
    raw = None
    for m in tokens:
        if raw is not None:
            if (m[2] or m[5] or "").lower() == raw and (m[1] or m[4]):
                raw = None
                done = m.end()
            elif m.start() >= done and f"</{raw}" in m[0].lower():  # the end of raw text, inside what looks like another tag
                at = m.start() + m[0].lower().index(f"</{raw}")
                end = html.find(">", at)
                done, raw = (len(html) if end < 0 else end + 1), None
            continue
        if m.start() < done:
            continue
        if m.start() > done:
            piece = html[done:m.start()]
            line.parts.append(piece)
            if open_elements and open_elements[-1][3]:
                line.links += len(piece)
        done = m.end()
        closing, name = m[1] or m[4], (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                line.parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                raw = name
            continue
        if name in CELLS:
            line.parts.append(" ")
        before = open_elements[-1] if open_elements else ("", False, False, False, False)
        if closing:
            for k in range(len(open_elements) - 1, -1, -1):
                if open_elements[k][0] == name:
                    del open_elements[k:]
                    break
        elif name not in VOID and not attributes.endswith("/"):
            if name in ("body", "main") or name == "article" and not any(e[1] for e in open_elements if e[0] not in ("head", "nav", "header")):
                open_elements = [e for e in open_elements if e[0] not in ("head", "nav", "header")]
                before_out = bool(open_elements) and open_elements[-1][1]
            else:
                before_out = before[1]
            in_main = before[2] or name in ("article", "main") and not before_out
            out = before_out or _outside(name, attributes, before[2])
            around = [e[0] for e in open_elements if e[1]]
            if name in HEADINGS and in_main and around[:1] == ["header"] and {*around} <= {"header", "hgroup", "div"}:
                out = False  # the title that an article has in its own header
            footer = footer or name == "footer" and not before[4]
            open_elements.append((name, out, in_main, name == "a" or before[3] and name not in BLOCKS, before[4] or name in CONTAINERS))
        now = open_elements[-1] if open_elements else ("", False, False, False, False)
        if name in BLOCKS or now[1:3] != before[1:3]:
            lines.append(line)
            if now[1:3] != before[1:3]:
                lines.append(None)
            inner = next((e[0] for e in reversed(open_elements) if e[0] in BLOCKS or e[0] in CELLS), "")
            line = _Line(now[1], now[2], footer and not now[4], inner in PROSE or inner in ("", "body", "html"))
    if raw is None and done < len(html):
        line.parts.append(html[done:])
    return [*lines, line]


def main_text(html: str | None) -> str:
    """The text between surges and dives, one line per block."""
    texts: list[str] = []
    lengths: list[int] = []
    main: list[bool] = []
    late: list[bool] = []
    prose: list[bool] = []
    for line in lines_of(html or ""):
        if line is None:
            texts += [""] * WINDOW
            lengths += [0] * WINDOW
            main += [False] * WINDOW
            late += [True] * WINDOW
            prose += [False] * WINDOW
            continue
        text = "" if line.out else line.text()
        if not text and not line.out:
            continue
        if text and not line.main and line.links > LINKS * sum(map(len, line.parts)):
            text = ""
        texts.append(text)
        lengths.append(len(text))
        main.append(line.main)
        late.append(line.late or not text)
        prose.append(line.prose)
    sums = [sum(lengths[i:i + WINDOW]) for i in range(len(lengths))]
    stretches, start = [], None
    for i in range(len(sums) + 1):
        inside = i < len(sums) and sums[i] > 0
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            stretches.append((start, i))
            start = None
    if any(any(main[a:b]) for a, b in stretches):
        kept = [(a, b) for a, b in stretches if any(m and n for m, n in zip(main[a:b], lengths[a:b]))]
    else:
        most = max((max(sums[a:b]) for a, b in stretches), default=0)
        behind = [(a, b) for a, b in stretches if all(late[a:b])]
        drop = 2 * max((max(sums[a:b]) for a, b in behind), default=0) < most
        kept = [(a, b) for a, b in stretches if not (drop and all(late[a:b]))]
        sure = [i for a, b in kept for i in range(a, b) if texts[i] and not _CLOSING.match(texts[i]) and (prose[i] or _SENTENCE.search(texts[i]))]
        if sure:
            enough = DENSE * sum(lengths[i] for i in sure) / len(sure)
            dense = {*sure} | {i for a, b in kept for i in range(a, b) if lengths[i] >= enough}
            kept = [(max(a, min(dense)), min(b, max(dense) + 1)) for a, b in kept]
    return "\n".join(t for a, b in kept for t in texts[a:b] if t)


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per page: the named columns, text and n_chars (its code points)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*columns, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    return pages.select(*columns, html_col).mapInArrow(read, f"{schema}, text string, n_chars long")
