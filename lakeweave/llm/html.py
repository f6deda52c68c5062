"""Layout-aware text of HTML pages.

A tree builder with implied tags turns tag soup into a tree; visibility rules drop what a reader does not see: tags that
never show, hidden attributes, and what style attributes and style sheets (rules by tag, class and id) hide. A renderer
emits the rest as a browser would lay it out: one line for each block, blank lines around paragraphs and the like,
markers and indentation for lists, padded columns for tables, whose cells may have several lines, span columns and rows
and hold tables of their own, spaces kept in pre. Nothing here recurses, so nesting may be arbitrarily deep.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import col, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas svg math datalist link meta base area param source track col colgroup".split())
#: Blocks, and those that have a blank line before and after.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul dir menu xmp".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup li dd dt caption tbody td tfoot th thead tr legend".split()) | {"li", "dd", "dt"}
#: Opening a tag ends an open element of these, unless one of the second kind lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "table"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
SECTIONS = frozenset(["tbody", "thead", "tfoot"])

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_COMPOUND = re.compile(r"(?:\*|[a-zA-Z][\w-]*)?(?:[.#]-?[\w-]+)*")
_DECLARED = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


def build(html: str) -> Node:
    """The tree of a page; children are nodes and strings. Unknown end tags are dropped, open elements end with the page."""
    root = Node("html", {}, None)
    here, depth, at, n = root, {"html": 1}, 0, len(html)

    def leave(node: Node) -> Node:
        """Ends all elements from the innermost to `node`."""
        nonlocal here
        while True:
            done, here = here, here.parent
            depth[done.tag] -= 1
            if done is node:
                return here

    def enter(tag: str, attrs: dict[str, str]) -> None:
        nonlocal here
        child = Node(tag, attrs, here)
        here.children.append(child)
        here = child
        depth[tag] = depth.get(tag, 0) + 1

    def end_open(tags: frozenset, walls: frozenset) -> None:
        if not any(depth.get(t) for t in tags):
            return
        outer, node = None, here
        while node is not root and node.tag not in walls:
            if node.tag in tags:
                outer = node
            node = node.parent
        if outer is not None:
            leave(outer)

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            here.children.append(unescape(html[at:]))
            break
        if m.start() > at:
            here.children.append(unescape(html[at : m.start()]))
        at = m.end()
        if close := m[1]:
            close = close.lower()
            if close == "br":
                here.children.append(Node("br", {}, here))
            elif close == "p" and not depth.get("p"):
                here.children.append(Node("p", {}, here))
            elif close not in ("html", "body") and depth.get(close):
                walls = frozenset(["table"]) if close not in ("table",) else frozenset()
                node = here
                while node is not root and node.tag != close and node.tag not in walls:
                    node = node.parent
                if node is not root and node.tag == close:
                    leave(node)
        elif tag := m[2]:
            tag, inside = tag.lower(), m[3] or ""
            attrs: dict[str, str] = {}
            if inside.strip("/ \n\t\r\f"):
                for a in _ATTR.finditer(inside):
                    attrs.setdefault(a[1].lower(), unescape(next((x for x in a.groups()[1:] if x is not None), "")))
            if tag in ("html", "body"):
                if tag == "body" and depth.get("head"):
                    end_open(frozenset(["head"]), frozenset())
                if tag == "body" and not depth.get("body"):
                    enter(tag, attrs)
                continue
            if depth.get("head") and tag not in HIDDEN:
                end_open(frozenset(["head"]), frozenset())  # a visible element ends the head
            if tag in CLOSES_P and depth.get("p"):
                end_open(frozenset(["p"]), frozenset(["table", "td", "th", "button", "caption"]))
            if tag in ENDS:
                end_open(*ENDS[tag])
            if tag in ("td", "th") and here.tag in SECTIONS | {"table"}:
                enter("tr", {})
            if tag == "a" and depth.get("a"):
                end_open(frozenset(["a"]), frozenset(["table", "td", "th"]))
            if tag in VOID:
                here.children.append(Node(tag, attrs, here))
                continue
            enter(tag, attrs)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                raw = html[at : stop.start() if stop else n]
                here.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
                at = stop.start() if stop else n
                leave(here)
                if stop:
                    at = html.find(">", at) + 1 or n
    return root


class Sheet:
    """What a page's style sheets and attributes say of display and visibility. Selectors are a tag, classes and ids in
    one; those with combinators, attributes or states are not followed. Of @media only rules for screen or all count."""

    def __init__(self, root: Node):
        #: by what its selector names last: (specificity, order), tag or "", ids, classes, property, value
        self.rules: dict[str, list[tuple]] = {}
        order, stack = 0, [root]
        while stack:
            node = stack.pop()
            if node.tag == "style":
                css = "".join(c for c in node.children if isinstance(c, str))
                if re.search(r"none|hidden|collapse", css, re.I):
                    for selectors, declared in self._blocks(_COMMENT.sub(" ", css)):
                        order += 1
                        self._add(selectors, declared, order)
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    @staticmethod
    def _blocks(css: str) -> Iterator[tuple[str, str]]:
        at, n, inside = 0, len(css), 0
        while at < n:
            brace = css.find("{", at)
            close = css.find("}", at)
            if inside and 0 <= close and (close < brace or brace < 0):  # the end of a @media block
                inside, at = inside - 1, close + 1
                continue
            if brace < 0:
                return
            head = css[at:brace].rsplit(";", 1)[-1].strip()
            if head.startswith("@"):
                media = [m.strip().lower() for m in head[6:].split(",")] if head.lower().startswith("@media") else []
                if "screen" in media or "all" in media or media == [""]:
                    inside, at = inside + 1, brace + 1
                    continue
                depth, at = 1, brace + 1
                while at < n and depth:
                    depth += (css[at] == "{") - (css[at] == "}")
                    at += 1
                continue
            end = css.find("}", brace)
            end = n if end < 0 else end
            yield head, css[brace + 1 : end]
            at = end + 1

    def _add(self, selectors: str, declared: str, order: int) -> None:
        found = [(name.lower(), value.lower(), bool(force)) for name, value, force in _DECLARED.findall(declared)]
        for selector in selectors.split(",") if found else ():
            selector = selector.strip()
            if not selector or not _COMPOUND.fullmatch(selector):
                continue
            tag = re.match(r"[^.#]*", selector)[0].lower().replace("*", "")
            ids, classes = frozenset(re.findall(r"#([\w-]+)", selector)), frozenset(re.findall(r"\.([\w-]+)", selector))
            key = "#" + min(ids) if ids else "." + min(classes) if classes else tag
            for name, value, force in found:
                self.rules.setdefault(key, []).append(((force, len(ids), len(classes), bool(tag), order), tag, ids, classes, name, value))

    def look(self, node: Node) -> tuple[bool, str]:
        """Whether an element is laid out at all, and its own visibility, empty where it takes its parent's."""
        a = node.attrs
        if node.tag in HIDDEN or node.tag == "input" and a.get("type", "").lower() == "hidden":
            return False, ""
        best = {"display": ((False, -1), "none" if "hidden" in a or node.tag == "dialog" and "open" not in a else ""), "visibility": ((False, -1), "")}
        if self.rules:
            own = a.get("class", "").split()
            for key in ("", node.tag, *("." + c for c in own), *(("#" + a["id"],) if "id" in a else ())):
                for rank, tag, ids, classes, name, value in self.rules.get(key, ()):
                    if (not tag or tag == node.tag) and ids <= {a.get("id")} and classes <= set(own) and rank > best[name][0]:
                        best[name] = rank, value
        if "style" in a:
            for name, value, force in _DECLARED.findall(a["style"]):
                name, rank = name.lower(), (bool(force), 1_000_000)
                if rank >= best[name][0]:
                    best[name] = rank, value.lower()
        return best["display"][1] != "none", best["visibility"][1]


def width(s: str) -> int:
    """Columns that a string takes: wide characters two, combining ones none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Frame:
    """Lines of a region: the page, a list item, a quotation or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.blank = False  # a blank line goes before the next line
        self.ends_in_space = True

    def text(self, s: str, keep: bool) -> None:
        if keep:
            parts = s.replace("\r\n", "\n").split("\n")
            for k, part in enumerate(parts):
                if k:
                    self.flush(keep=True)
                self.inline.append(part)
            self.ends_in_space = False
            return
        s = _SPACE.sub(" ", s)
        if self.ends_in_space:
            s = s.lstrip(" ")
        if s:
            self.inline.append(s)
            self.ends_in_space = s[-1] == " "

    def flush(self, keep: bool = False, force: bool = False) -> None:
        line = "".join(self.inline)
        line = line.rstrip() if keep else line.strip(" ")
        self.inline, self.ends_in_space = [], True
        if line or keep or force:
            self.put(line)

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(line)

    def block(self, spaced: bool) -> None:
        self.flush()
        self.blank |= spaced and bool(self.lines)


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines of a cell, columns and rows it spans): cells of one column start at the same place, two spaces
    apart, and cells of one row on the same line."""
    placed, taken = [], {}  # taken: column -> first row in which it is free again
    for r, row in enumerate(rows):
        at = 0
        for lines, across, down in row:
            while taken.get(at, 0) > r:
                at += 1
            down = min(down, len(rows) - r)
            placed.append((r, at, lines, across, down))
            if down > 1:
                for k in range(at, at + across):
                    taken[k] = r + down
            at += across
    widths: dict[int, int] = {}
    heights = [1] * len(rows)
    for r, at, lines, across, down in placed:
        if across == 1:
            widths[at] = max(widths.get(at, 0), *map(width, lines), 0)
        if down == 1:
            heights[r] = max(heights[r], len(lines))
    for r, at, lines, across, down in placed:  # what spans several widens the last of them
        if across > 1:
            room = sum(widths.get(k, 0) for k in range(at, at + across)) + 2 * (across - 1)
            widths[at + across - 1] = widths.get(at + across - 1, 0) + max(0, max(map(width, lines), default=0) - room)
        if down > 1:
            heights[r + down - 1] += max(0, len(lines) - sum(heights[r : r + down]))
    start, top = {}, [0]
    for k in range(max(widths, default=0) + 1):
        start[k] = start[k - 1] + widths.get(k - 1, 0) + 2 if k else 0
    for height in heights:
        top.append(top[-1] + height)
    out: list[list[tuple[int, str]]] = [[] for _ in range(top[-1])]
    for r, at, lines, _, _ in placed:
        for k, line in enumerate(lines):
            if line:
                out[top[r] + k].append((start[at], line))
    text = []
    for cells in out:
        line, used = [], 0
        for at, cell in sorted(cells):
            line.append(" " * (at - used) + cell)
            used = at + width(cell)
        text.append("".join(line).rstrip())
    return text


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(most, int(value)) if value.isascii() and value.isdigit() and len(value) < 10 and int(value) else 1


def render(html: str | None) -> str:
    """All visible text of a page. Null or empty: an empty string."""
    if not html:
        return ""
    root = build(html)
    frames, tables, lists = [Frame()], [], []
    pre = 0
    sheet = Sheet(root)
    # node, whether it is being left, whether its parent's text shows
    stack: list[tuple[Node | str, bool, bool]] = [(root, False, True)]
    while stack:
        node, leaving, shows = stack.pop()
        frame = frames[-1]
        if isinstance(node, str):
            if not shows or tables and frame is tables[-1][1] and not node.strip():
                continue  # space between rows and cells
            frame.text(node, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            laid_out, own = sheet.look(node)
            if not laid_out:
                continue
            shows = own == "visible" if own in ("visible", "hidden", "collapse") else shows
            if tag == "br":
                frame.flush(force=True)
                continue
            if tag in ("input", "img"):
                shown = node.attrs.get("value" if tag == "input" else "alt", "")
                if shows and shown and node.attrs.get("type", "").lower() not in ("checkbox", "radio", "password", "image", "file"):
                    frame.text(shown, False)
                continue
            if tag == "wbr":
                continue
            if tag == "hr":
                frame.block(True)
                if shows:
                    frame.put("---")
                frame.blank = True
                continue
            if tag in VOID:
                continue
            stack.append((node, True, shows))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag == "table":
                frame.block(True)
                tables.append(([], frame))
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in ("td", "th") and tables:
                frames.append(Frame())
            elif tag in ("ul", "ol", "menu", "dir"):
                frame.block(not lists)
                start = node.attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag in ("li", "blockquote", "dd"):
                frame.block(tag == "blockquote")
                frames.append(Frame())
            elif tag in BLOCK:
                frame.block(tag in SPACED)
            if tag in ("pre", "xmp", "textarea"):
                pre += 1
                if children and isinstance(children[0], str) and children[0].startswith("\n"):
                    children = [children[0][1:], *children[1:]]
            elif tag == "q" and shows:
                frame.text('"', False)
            stack.extend((c, False, shows) for c in reversed(children))
            continue
        if tag in ("pre", "xmp", "textarea"):
            pre -= 1
            if frame.inline:
                frame.flush(keep=True)
        if tag == "q":
            if shows:
                frame.text('"', False)
        elif tag == "table" and tables:
            rows, _ = tables.pop()
            frame.flush()
            for line in aligned([r for r in rows if r]):
                frame.put(line)
            frame.blank |= bool(frame.lines)
        elif tag in ("td", "th") and tables and len(frames) > 1:
            frame.flush()
            frames.pop()
            if not tables[-1][0]:
                tables[-1][0].append([])
            lines = [x.rstrip() for x in frame.lines]
            while lines and not lines[-1]:
                lines.pop()
            tables[-1][0][-1].append((lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag in ("ul", "ol", "menu", "dir") and lists:
            frame.block(False)
            lists.pop()
            frame.blank |= not lists
        elif tag in ("li", "blockquote", "dd") and len(frames) > 1:
            frame.flush()
            frames.pop()
            outer = frames[-1]
            mark = {"blockquote": "> ", "dd": "  "}.get(tag, "- ")
            if tag == "li" and lists and lists[-1][0]:
                value = node.attrs.get("value", "")
                if re.fullmatch(r"-?\d{1,9}", value):
                    lists[-1][1] = int(value)
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            rest = mark if tag == "blockquote" else " " * len(mark)
            for k, line in enumerate(frame.lines):
                outer.put(((rest if k else mark) + line).rstrip())
            outer.blank |= tag == "blockquote"
        elif tag in BLOCK:
            frame.block(tag in SPACED)
    while len(frames) > 1:
        done = frames.pop()
        done.flush()
        for line in done.lines:
            frames[-1].put(line)
    frames[0].flush()
    return "\n".join(frames[0].lines).strip("\n")


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Adds the visible text of each page, however long or deeply nested it is. Null and empty pages give an empty text,
    repeated rows equal texts, an empty table an empty one. A column of the new name is replaced, all others stay
    whatever their names."""

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(column):
        return column.map(render)

    return pages.withColumn(into, run(col(html).cast("string")))
