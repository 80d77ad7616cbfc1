"""Visible text of web pages by layout-aware rendering.

A page is read into a tree with the tags HTML implies (an open paragraph ends at the
next block, a list item at the next item, a cell at the next cell, rows outside a row
get one, head and body part by content).  The tree is rendered as a browser would
show its text: what is hidden stays out (scripts, styles, templates, the attribute
``hidden``, ``display: none`` and inherited ``visibility: hidden`` of the style
attribute, closed dialogs), white space collapses
except in preformatted text, paragraphs, headings, lists and tables stand apart by
blank lines, other blocks by line breaks, list items get bullets or their numbers
with nested indents, and table cells line up in columns.

Each page is read by itself in one task; Spark spreads the pages.

Defined results: a null page gives a null text, an empty one an empty text; broken
markup is read to its end; nesting of any depth is read and rendered by the same
rules, on a stack of its own; cells longer than MAX_ALIGN are whole but widen no
column; of SVG the text elements and foreign HTML are shown, of MathML the tokens in
their order; repeated rows each keep their row; an empty table gives an empty table; input columns named like an output column
are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Generator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import drop_clashes

MAX_ALIGN = 120

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HEAD = set("base link meta title script style template noscript".split())
UNSEEN = set("head title script style template noscript iframe noembed noframes object audio video "
             "canvas datalist input img map area col colgroup param source track".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset "
             "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
             "nav ol optgroup option p pre search section summary table ul xmp".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl dir menu pre xmp blockquote table figure hr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
LISTS = set("ul ol dir menu".split())
SCOPE = set("html table td th caption button object template".split())
# SVG and MathML: what is not drawn, MathML's tokens, where HTML goes on inside, and the
# HTML tags that end foreign content.
FOREIGN = {"svg", "math"}
UNDRAWN = set("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter "
              "annotation annotation-xml".split())
TOKENS = set("mi mo mn ms mtext".split())
HTML_AGAIN = {"foreignobject", "desc", "title", "annotation-xml"} | TOKENS
ENDS_FOREIGN = HEADINGS | set(
    "b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split())
# A start tag ends the open elements of the first set, up to one of the second.
ENDS = {
    "li": ({"li"}, LISTS | SCOPE),
    "dt": ({"dt", "dd"}, {"dl"} | SCOPE), "dd": ({"dt", "dd"}, {"dl"} | SCOPE),
    "option": ({"option"}, {"select", "datalist", "optgroup"} | SCOPE),
    "optgroup": ({"option", "optgroup"}, {"select"} | SCOPE),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}
ENDS_P = (BLOCKS - {"html", "body", "option", "optgroup"}) | {"plaintext"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
_COMMENT = re.compile(r"<!--(?:>|->|(?s:.*?)(?:--!?>|\Z))")
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_OTHER = re.compile(r"<[!?/][^>]*>")
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_NUMBER = re.compile(r"\s*(-?\d{1,6})")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"(?:\"[^\"]*\"|'[^']*'|\([^)]*\)|[^;])+")
_DISPLAY = re.compile(r"(?:(?:block|inline|run-in|flow|flow-root|table|flex|grid|ruby|list-item|contents|none|math|"
                      r"table-[a-z-]+|ruby-[a-z]+|inline-[a-z]+|-webkit-[a-z-]+|initial|inherit|unset)(?:\s+|$))+")
_VISIBILITY = {"visible": True, "initial": True, "hidden": False, "collapse": False,
               "inherit": None, "unset": None, "revert": None, "revert-layer": None}
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$|^[^=]*/\s*$")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


def attributes(text: str) -> dict[str, str]:
    """Names and values of a start tag's attributes; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text) if text else ():
        value = m[2] or ""
        if value[:1] in ("'", '"') and value[:1] == value[-1:]:
            value = value[1:-1]
        out.setdefault(m[1].lower(), unescape(value))
    return out


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attributes(attrs), []

    def number(self, name: str, default: int) -> int:
        m = _NUMBER.match(self.attrs.get(name, ""))
        return int(m[1]) if m else default


# --- tree ---------------------------------------------------------------------

class Tree:
    """Open elements of a page under construction, and the places of each tag among them."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}

    def nearest(self, tags: set[str]) -> int:
        """Place of the innermost open element of ``tags``; the root counts as none."""
        places = self.places
        return max((places[t][-1] for t in (tags if len(tags) < len(places) else places.keys() & tags)
                    if places.get(t)), default=0)

    def pop(self) -> None:
        self.places[self.open.pop().tag].pop()

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            self.pop()

    def close(self, tags: set[str], stop: set[str]) -> bool:
        """Ends the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        at = self.nearest(tags)
        if not at or self.nearest(stop - tags) > at:
            return False
        self.cut(at)
        return True

    def has_open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def foreign(self) -> bool:
        """Whether the open element is SVG's or MathML's own."""
        return self.nearest(FOREIGN) > self.nearest(HTML_AGAIN)

    def text(self, text: str) -> None:
        if self.open[-1].tag == "head" and text.strip():
            self.pop()
        self.open[-1].children.append(text)

    def start(self, tag: str, attrs: str) -> None:
        while self.foreign():
            if tag not in ENDS_FOREIGN:
                node = Node(tag, attrs)
                if _CLOSED.search(attrs):
                    self.open[-1].children.append(node)
                else:
                    self.push(node)
                return
            self.cut(self.nearest(FOREIGN))
        if tag in ("html", "body"):
            if tag == "body" and self.close({"head"}, set()) or tag == "html":
                return
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.pop()
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") and not self.has_open("table"):
            return                                    # parts of no table are ignored
        if tag in ENDS_P:
            self.close({"p"}, SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        if tag in ENDS:
            self.close(*ENDS[tag])
        if tag in ("td", "th") and not self.in_row():
            self.push(Node("tr"))
        node = Node(tag, attrs)
        if tag in VOID or tag in FOREIGN and _CLOSED.search(attrs):
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def in_row(self) -> bool:
        return self.nearest({"tr"}) > self.nearest({"table"})

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag == "p":
            if not self.close({"p"}, SCOPE):
                self.start("p", "")
                self.close({"p"}, SCOPE)
        elif tag in ("html", "body"):
            return
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        else:
            self.close({tag}, set() if tag == "table" else {"table"} if tag in SCOPE or tag == "tr"
                       else {"td", "th", "table"})


def parse(page: str) -> Node:
    tree, at, size = Tree(), 0, len(page)
    while at < size:
        less = page.find("<", at)
        if less < 0:
            less = size
        if less > at:
            tree.text(unescape(page[at:less]))
        if less == size:
            break
        if m := _TAG.match(page, less):
            tag, at = m[2].lower(), m.end()
            if m[1]:
                tree.end(tag)
                continue
            within = tree.foreign()
            tree.start(tag, m[3])
            if tag in RAW and not (within and (tag not in ("script", "style") or _CLOSED.search(m[3]))):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                stop = close.start() if close else size
                body = page[at:stop]
                tree.text(unescape(body) if tag in ("textarea", "title") else body)
                at = stop
        elif page.startswith("<![CDATA[", less) and tree.foreign():
            stop = page.find("]]>", less)
            tree.text(page[less + 9:stop if stop >= 0 else size])
            at = stop + 3 if stop >= 0 else size
        elif m := (_COMMENT.match(page, less) or _OTHER.match(page, less)):
            at = m.end()
        elif _OPENS.match(page, less):
            break                                     # a tag that never ends
        else:
            tree.text("<")
            at = less + 1
    return tree.root


# --- rendering ------------------------------------------------------------------

class Page:
    """Lines under construction: collapsed words, line breaks wanted, indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False            # a collapsed blank before the next word
        self.gap = 0                  # empty lines wanted before the next text
        self.indent = 0
        self.mark = ""                # a list item's bullet, before its first line

    def words(self, text: str) -> None:
        text = _BLANKS.sub(" ", text)
        if not text:
            return
        if text[0] == " ":
            self.blank = True
        body = text.strip(" ")
        if body:
            self.put((" " if self.blank and self.line else "") + body)
            self.blank = text[-1] == " "

    def put(self, text: str) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            lead, self.mark = self.mark, ""
            self.line.append(lead.rjust(self.indent) if lead else " " * self.indent)
        self.line.append(text)

    def end_line(self, gap: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.blank = False
        self.gap = max(self.gap, gap)

    def raw(self, text: str) -> None:
        """Preformatted lines."""
        for i, part in enumerate(text.split("\n")):
            if i:
                if not self.line:
                    self.put("")
                self.end_line()
            if part:
                self.put(part)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def styles(node: Node) -> tuple[str, str]:
    """The valid display and visibility of a style attribute; the last or important one counts."""
    found = {"display": "", "visibility": ""}
    important = set()
    for part in _DECLARATION.findall(_CSS_COMMENT.sub(" ", node.attrs["style"])):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        strong = value.endswith("important") and value[:-9].rstrip().endswith("!")
        if strong:
            value = value[:-9].rstrip()[:-1].rstrip()
        reset = value in ("revert", "revert-layer")
        valid = reset or (_DISPLAY.fullmatch(value) if name == "display" else value in _VISIBILITY)
        if name in found and valid and (strong or name not in important):
            found[name] = "" if reset else value
            important |= {name} if strong else set()
    return found["display"], found["visibility"]


def hidden(node: Node) -> bool:
    """Whether an element and all below it are not displayed."""
    attrs = node.attrs
    if node.tag in UNSEEN or attrs.get("hidden", "").lower() == "until-found":
        return True
    display = styles(node)[0] if "style" in attrs else ""
    if display:
        return display == "none"
    return "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs)


def visible(node: Node, inherited: bool) -> bool:
    """Whether an element's own text is visible: its own visibility or the inherited one."""
    own = _VISIBILITY.get(styles(node)[1]) if "style" in node.attrs else None
    return inherited if own is None else own


# A step yields the step it waits for and gets its value, so nesting needs no call stack.
Step = Generator["Step", object, object]


def run(step: Step):
    steps, value = [step], None
    while steps:
        try:
            steps.append(steps[-1].send(value))
            value = None
        except StopIteration as done:
            steps.pop()
            value = done.value
    return value


def foreign(node: Node, page: Page, shown: bool, drawn: bool = False) -> Step:
    """The text of SVG (text elements) and MathML (tokens), and the HTML inside them."""
    chosen = 0
    for i, child in enumerate(node.children):
        if isinstance(child, str):
            if node.tag in TOKENS:                    # blanks at a token's ends don't count
                child = child if i else child.lstrip()
                child = child if i < len(node.children) - 1 else child.rstrip()
            if drawn and shown:
                page.words(child)
            continue
        chosen += 1
        tag, seen = child.tag, visible(child, shown)
        if tag in UNDRAWN or hidden(child) or (child.attrs.get("display") or "").strip().lower() == "none" or (
                node.tag in ("maction", "semantics") and chosen > 1):
            continue
        own = _VISIBILITY.get((child.attrs.get("visibility") or "").strip().lower())
        if own is not None and not ("style" in child.attrs and styles(child)[1]):
            seen = own
        if tag == "foreignobject":
            page.end_line(1)
            yield render(child, page, shown=seen)
            page.end_line(1)
        elif node.tag in TOKENS and tag not in FOREIGN:
            html = Node(node.tag)
            html.children = [child]
            yield render(html, page, shown=shown)
        elif tag == "mtr":
            page.end_line(1)
            yield foreign(child, page, seen)
            page.end_line(1)
        else:
            apart = tag in ("text", "mtd")
            page.blank |= apart
            yield foreign(child, page, seen and tag != "mphantom", drawn or tag == "text" or tag in TOKENS)
            page.blank |= apart


def render(node: Node, page: Page, pre: bool = False, depth: int = 0, shown: bool = True) -> Step:
    number = node.number("start", 1) if node.tag == "ol" else 0
    for child in node.children:
        if isinstance(child, str):
            if shown:
                page.raw(child.replace("\r\n", "\n")) if pre else page.words(child)
            continue
        tag = child.tag
        if hidden(child):
            continue
        seen = visible(child, shown)
        if tag == "br":
            if not page.line and shown:
                page.gap += 1
            page.end_line(1)
            continue
        if tag == "table":
            page.end_line(2)
            for line in (yield table_lines(child, seen, shown)):
                page.put(line)
                page.end_line()
            page.end_line(2)
            continue
        if tag in FOREIGN:
            apart = tag == "math" and child.attrs.get("display", "").lower() == "block"
            if apart:
                page.end_line(1)
            yield foreign(child, page, seen)
            if apart:
                page.end_line(1)
            continue
        block = tag in BLOCKS
        nested = depth and tag in LISTS
        gap = (1 if nested else 2) if tag in SPACED else 1
        if block:
            page.end_line(gap)
        if tag == "li":
            if node.tag == "ol":
                number = child.number("value", number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            before, page.indent, page.mark = page.indent, page.indent + len(mark), mark if seen else ""
            yield render(child, page, pre, depth + 1, seen)
            page.end_line()
            page.indent, page.mark = before, ""
        elif tag in ("dd", "blockquote"):
            before, page.indent = page.indent, page.indent + 2
            yield render(child, page, pre, depth, seen)
            page.end_line()
            page.indent = before
        else:
            if tag in ("pre", "xmp", "textarea") and child.children and isinstance(child.children[0], str):
                child.children[0] = child.children[0].removeprefix("\r").removeprefix("\n")
            yield render(child, page, pre or tag in ("pre", "xmp", "textarea"), depth, seen)
        if block:
            page.end_line(gap)


def rows_of(node: Node, shown: bool) -> list[tuple[Node, bool]]:
    """The displayed rows of a table in the order shown, head, bodies, foot, captions first,
    each with its visibility."""
    parts: dict[str, list[tuple[Node, bool]]] = {"caption": [], "thead": [], "": [], "tfoot": []}
    for child in node.children:
        if isinstance(child, str) or hidden(child):
            continue
        seen = visible(child, shown)
        group = parts[child.tag if child.tag in parts else ""]
        if child.tag in ("thead", "tbody", "tfoot"):
            group += [(r, visible(r, seen)) for r in child.children if not isinstance(r, str) and not hidden(r)]
        else:
            group.append((child, seen))
    return [r for group in parts.values() for r in group]


def table_lines(table: Node, shown: bool = True, around: bool = True) -> Step:
    """The table as lines with aligned columns; other content of a table on lines of its own.

    Text directly in a table or its row groups stands before it, with the visibility of
    what is around."""
    rows: list[list[tuple[list[str], int]] | str] = []
    loose = "".join(text for c in table.children for text in (
        [c] if isinstance(c, str) else c.children if c.tag in ("thead", "tbody", "tfoot") else [])
        if isinstance(text, str))
    if loose.strip() and around:
        rows.append(_BLANKS.sub(" ", loose).strip())
    for row, seen in rows_of(table, shown):
        if row.tag != "tr":
            rows.append((yield inner_text(row, seen)))
            continue
        cells = [c for c in row.children if not isinstance(c, str) and c.tag in ("td", "th") and not hidden(c)]
        extra = [c for c in row.children if (c.strip() if isinstance(c, str) else
                                             c.tag not in ("td", "th") and not hidden(c))]
        if extra:
            other = Node("div")
            other.children = extra
            rows.append((yield inner_text(other, seen)))
        read = []
        for c in cells:
            text = yield inner_text(c, visible(c, seen))
            read.append((text.split("\n"), max(1, min(c.number("colspan", 1), 1000))))
        rows.append(read)
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row if isinstance(row, list) else []:
            width = max(map(len, lines))
            if span == 1 and width <= MAX_ALIGN:
                widths[at] = max(widths.get(at, 0), width)
            at += span
    out: list[str] = []
    for row in rows:
        if isinstance(row, str):
            out += row.split("\n") if row else []
            continue
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            at, line = 0, ""
            for lines, span in row:
                width = sum(widths.get(k, 0) for k in range(at, at + span)) + 2 * (span - 1)
                line += (lines[i] if i < len(lines) else "").ljust(width) + "  "
                at += span
            out.append(line.rstrip())
    return [x for x in out if x]


def inner_text(node: Node, shown: bool = True) -> Step:
    page = Page()
    yield render(node, page, depth=0, shown=shown)
    return page.text()


def visible_text(html: str) -> str:
    return run(inner_text(parse(html)))


# --- columns ----------------------------------------------------------------------

def visible_text_column(html: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else visible_text(x)).astype(object)

    return extract(html)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The input columns plus ``text``, the page's visible text."""
    df = drop_clashes(pages, "text") if "text" in {c.lower() for c in pages.columns} else pages
    return df.withColumn("text", visible_text_column(F.col(html)))


def op8_pages(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "html")).select(
        "page_id", "text", F.length("text").cast("long").alias("n_chars"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
