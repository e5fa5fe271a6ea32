"""Block structure: one pass over lines with a stack of open blocks."""

from __future__ import annotations

import re
from collections.abc import Callable

from .inlines import Inliner, label_key, parse_definition
from .model import Node, Options, ParseError

# tag names that start an HTML block of the sixth kind (fixed values)
_BLOCK_TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|"
    "summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_HTML_START = [
    re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I),
    re.compile(r"<!--"),
    re.compile(r"<\?"),
    re.compile(r"<![A-Za-z]"),
    re.compile(r"<!\[CDATA\["),
    re.compile(rf"</?(?:{_BLOCK_TAGS})(?:\s|/?>|$)", re.I),
    re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"),
]
# tags that start a block of the seventh kind only below a blank line (fixed values)
_INLINE_TAGS = frozenset("a em strong span code s del ins mark small sub sup b i u q samp kbd var abbr cite dfn time data bdo bdi wbr".split())
_TAG_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)")
_HTML_END = [re.compile(r"</(?:script|pre|style|textarea)>", re.I), re.compile(r"-->"), re.compile(r"\?>"), re.compile(r">"), re.compile(r"\]\]>")]
_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*)")
_ATX_TAIL = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
_RULE = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_BULLET = re.compile(r"[-*+](?=[ \t]|$)")
_ORDERED = re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
_TASK = re.compile(r"\[([ xX])\](?=[ \t])[ \t]")
_EXPLICIT_ID = re.compile(r"(?:^|[ \t])\{#([^\W\d_][\w-]*)\}$")
_DIRECTIVE = re.compile(r"(:{3,})\{(/?)([\w-]+)\}[ \t]*(.*)$")
_DIRECTIVE_END = re.compile(r"(:{3,})[ \t]*$")
_DIRECTIVE_OPTION = re.compile(r":([\w-]+):[ \t]*(.*)$")
_FOOTNOTE = re.compile(r"\[\^([\w-]+)\]:[ \t]*(.*)$")
_DELIMITER_ROW = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_PIPE = re.compile(r"(?<!\\)\|")

_CONTAINERS = frozenset(("Document", "BlockQuote", "List", "ListItem", "Directive"))


class _Open:
    """A block that still takes lines."""

    __slots__ = ("node", "lines", "at", "info")

    def __init__(self, node: Node, at: int = 0, **info):
        self.node, self.at, self.info = node, at, info
        self.lines: list[str] = []


def split_row(line: str) -> list[str]:
    """Cells of a table row; escaped pipes are text."""
    line = line.strip()
    if line.startswith("|"):
        line = line[1:]
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in _PIPE.split(line)]


class BlockParser:
    """Parses one source into a Document."""

    def __init__(self, options: Options, text: Callable[[str], str] | None = None):
        self.options, self.text = options, text
        self.refs: dict[str, tuple[str, str | None]] = {}

    # -- line cursor -----------------------------------------------------

    def _measure(self) -> None:
        """Find the next non-blank and its indent in columns."""
        line, i, col = self.line, self.pos, self.column
        while i < len(line):
            c = line[i]
            if c == " ":
                col += 1
            elif c == "\t":
                col += 4 - col % 4
            else:
                break
            i += 1
        if line[i:] == "\r":
            i = len(line)
        self.next, self.next_column = i, col
        self.indent = col - self.column
        self.blank = i >= len(line)

    def _skip(self, columns: int) -> None:
        """Pass so many columns of white space; a tab may be passed in part."""
        line = self.line
        while columns > 0 and self.pos < len(line):
            if line[self.pos] == "\t":
                width = 4 - self.column % 4
                if width > columns:
                    self.column += columns
                    self.partial = True
                    break
                self.column += width
                columns -= width
            else:
                self.column += 1
                columns -= 1
            self.partial = False
            self.pos += 1
        self._measure()

    def _to_next(self) -> None:
        self.pos, self.column, self.partial = self.next, self.next_column, False
        self._measure()

    def _rest(self) -> str:
        if self.partial:  # what is left of a tab stands for its columns
            return " " * (4 - self.column % 4) + self.line[self.pos + 1 :]
        return self.line[self.pos :]

    # -- tree ------------------------------------------------------------

    def _add(self, kind: str, **data) -> Node:
        """A new node under the innermost container that may hold it."""
        while self.stack[-1].node.type not in _CONTAINERS or (self.stack[-1].node.type == "List" and kind != "ListItem"):
            self._close()
        if len(self.stack) > self.options.max_nesting_depth:
            raise ParseError(f"nesting exceeds {self.options.max_nesting_depth} levels", self.lineno)
        node = Node(kind, data=data, line=self.lineno, col=self.next + 1, start=self.offset + self.next, end=self.offset + len(self.line), last_line=self.lineno)
        self.stack[-1].node.children.append(node)
        self.stack[-1].node.last_line = self.lineno
        return node

    def _push(self, node: Node, at: int = 0, **info) -> _Open:
        self.stack.append(_Open(node, at, **info))
        return self.stack[-1]

    def _close(self) -> None:
        top = self.stack.pop()
        node, lines = top.node, top.lines
        kind = node.type
        if kind == "Paragraph":
            self._close_paragraph(top)
        elif kind == "FencedCode":
            node.data["code"] = "".join(x + "\n" for x in lines)
            node.data.setdefault("source_end", min(self.offset, len(self.source)))
        elif kind == "IndentedCode":
            while lines and not lines[-1].strip(" \t"):
                lines.pop()
            node.data["code"] = "".join(x + "\n" for x in lines)
        elif kind == "HtmlBlock":
            while lines and not lines[-1].strip():
                lines.pop()
            node.data["html"] = "".join(x + "\n" for x in lines)
        elif kind == "List":
            node.data["tight"] = not self._is_loose(node)
        elif kind == "Table":
            node.data["rows"] = lines
        if self.stack:
            up = self.stack[-1].node
            up.last_line = max(up.last_line, node.last_line)

    def _is_loose(self, lst: Node) -> bool:
        def gaps(nodes):
            return any(b.line - a.last_line > 1 for a, b in zip(nodes, nodes[1:]))

        return gaps(lst.children) or any(id(item) in self.apart or gaps(item.children) for item in lst.children)

    def _close_paragraph(self, top: _Open) -> None:
        text = "\n".join(top.lines)
        if not top.info.get("plain"):
            gone = 0
            while text.startswith("["):
                got = parse_definition(text)
                if not got:
                    break
                label, url, title, used = got
                key = label_key(label)
                if key:
                    self.refs.setdefault(key, (url, title))
                gone += text[:used].count("\n") + (0 if text[:used].endswith("\n") else 1)
                text = text[used:].lstrip("\n")
            if gone:
                node = top.node
                if not text.strip():
                    above = self.stack[-1].node.children
                    if len(above) > 1 and node.line - above[-2].last_line > 1:  # a blank line parts them though nothing is left
                        self.apart.add(id(self.stack[-1].node))
                    above.remove(node)
                    self.stack[-1].node.last_line = max(self.stack[-1].node.last_line, node.last_line)
                    return
                node.line += gone
        top.node.data["raw"] = text.rstrip(" \t")

    # -- lines -----------------------------------------------------------

    def parse(self, source: str) -> Node:
        """The document tree of ``source``, inlines included."""
        self.source = source
        doc = Node("Document", end=len(source))
        self.stack: list[_Open] = [_Open(doc)]
        self.offset, self.lineno, self.below_blank = 0, 0, True
        self.apart: set[int] = set()  # list items with a blank line above definitions
        lines = source.split("\n")
        if lines and not lines[-1]:
            lines.pop()
        for line in lines:
            self.lineno += 1
            self.line, self.pos, self.column, self.partial = line, 0, 0, False
            self._measure()
            if self.text and self.stack[-1].node.type not in ("FencedCode", "HtmlBlock"):
                self.line = line[: self.next] + self.text(line[self.next :])
                self._measure()
            empty = self.blank
            self._take()
            self.below_blank = empty
            self.offset += len(line) + 1
        while self.stack:
            self._close()
        Inliner(self.options, self.refs).fill(doc)
        return doc

    def _continue(self) -> int:
        """How many of the open blocks go on in this line."""
        for k in range(1, len(self.stack)):
            block = self.stack[k]
            node, kind = block.node, block.node.type
            if kind == "BlockQuote":
                if self.indent > 3 or self.blank or self.line[self.next] != ">":
                    return k
                self._to_next()
                self._skip_marker(1)
                node.last_line = self.lineno
            elif kind == "ListItem":
                if self.blank:
                    if not node.children:
                        return k
                    self._to_next()
                elif self.indent >= block.at:
                    self._skip(block.at)
                else:
                    return k
            elif kind == "Paragraph":
                if self.blank:
                    return k
            elif kind == "Table":
                if self.blank:
                    return k
            elif kind == "IndentedCode":
                if self.indent >= 4:
                    self._skip(4)
                elif self.blank:
                    self._skip(4)
                else:
                    return k
            elif kind == "HtmlBlock":
                if self.blank and block.at >= 5:
                    return k
            elif kind in ("Heading", "ThematicBreak", "FootnoteDef"):
                return k
        return len(self.stack)

    def _skip_marker(self, width: int) -> None:
        """Pass a marker and one following column of white space."""
        self.pos += width
        self.column += width
        self._measure()
        if self.indent >= 1:
            self._skip(1)

    def _take(self) -> None:
        matched = self._continue()
        inner = self.stack[matched - 1]
        kind = inner.node.type if matched == len(self.stack) else None
        if kind == "FencedCode" and self._in_fence(inner):
            return
        if kind == "HtmlBlock":
            self._in_html(inner)
            return
        if kind == "IndentedCode":
            inner.lines.append(self._rest())
            if not self.blank:
                inner.node.last_line = self.lineno
            return
        if self.blank:
            while len(self.stack) > matched:
                self._close()
            return
        was = self.stack[-1]
        lazy = was.node.type == "Paragraph" and matched < len(self.stack)
        if self._starts(matched, lazy):
            return
        if lazy and self.stack[-1] is was:  # a paragraph goes on without its containers' marks
            was.lines.append(self._rest().lstrip(" \t"))
            was.info["lazy"] = True
            self._grow(was)
            return
        top = self.stack[-1]
        if top.node.type == "Paragraph":
            top.lines.append(self._rest().lstrip(" \t"))
            self._grow(top)
        elif top.node.type == "Table":
            top.lines.append(self._rest())
            self._grow(top)
        elif not self.blank:
            node = self._add("Paragraph")
            self._push(node, plain=self._in_directive()).lines.append(self._rest().lstrip(" \t"))

    def _grow(self, block: _Open) -> None:
        block.node.last_line = self.lineno
        block.node.end = self.offset + len(self.line)

    def _in_directive(self) -> bool:
        return any(b.node.type == "Directive" for b in self.stack)

    def _in_fence(self, block: _Open) -> bool:
        rest = self.line[self.next :] if self.indent <= 3 else ""
        mark = block.info["mark"]
        body = rest.rstrip(" \t")
        block.node.last_line = self.lineno
        if len(body) >= len(mark) and not body.strip(mark[0]):
            block.node.data["source_end"] = self.offset
            block.node.end = self.offset + len(self.line)
            self._close()
            return True
        self._skip(min(block.at, self.indent))
        block.lines.append(self._rest())
        return True

    def _in_html(self, block: _Open) -> None:
        block.lines.append(self._rest())
        self._grow(block)
        if block.at < 5 and _HTML_END[block.at].search(block.lines[-1]):
            self._close()

    # -- starts ----------------------------------------------------------

    def _starts(self, matched: int, lazy: bool) -> bool:
        """Open the blocks that start here; True if the line is used up.

        The unmatched blocks stay open until something starts, so that a paragraph
        may go on lazily.
        """
        closed = False
        tip = self.stack[-1] if self.stack[-1].node.type == "Paragraph" else None

        def drop() -> None:
            nonlocal closed
            while not closed and len(self.stack) > matched:
                self._close()
            closed = True

        while True:
            text = self.line[self.next :]
            if self.blank:
                return closed
            inside = self._in_directive()
            if self.indent >= 4:
                if inside or not closed and (tip or self.stack[-1].node.type == "Table" and matched == len(self.stack)):
                    break
                drop()
                self._skip(4)
                self._push(self._add("IndentedCode")).lines.append(self._rest())
                return True
            first = text[0]
            here = tip if not closed and matched == len(self.stack) else None
            if here and first in "=-" and self._setext(here, text):
                return True
            if here and self.options.table and self._table(here, text):
                return True
            if first == ">":
                drop()
                node = self._add("BlockQuote")
                self._to_next()
                self._skip_marker(1)
                self._push(node)
                continue
            if first == "#" and (m := _ATX.match(text)):
                drop()
                node = self._add("Heading", level=len(m[1]), style="atx")
                self._heading_text(node, _ATX_TAIL.sub("", m[2].rstrip(" \t")).strip(" \t"))
                return True
            if first in "`~" and (m := _FENCE.match(text)):
                drop()
                mark, info = (m[1], m[2]) if m[1] else (m[3], m[4])
                body = min(self.offset + len(self.line) + 1, len(self.source))
                node = self._add("FencedCode", marker=mark[0], fence_indent=self.indent, info=info.strip() or None, source_start=body)
                self._push(node, self.indent, mark=mark)
                return True
            if first == "<" and not inside and self._html(text, drop):
                return True
            if first in "-*_" and _RULE.match(text):
                drop()
                self._add("ThematicBreak")
                return True
            if self._list_item(text, drop, here):
                continue
            if first == "[" and not inside and not here and not lazy and (m := _FOOTNOTE.match(text)):
                drop()
                self._footnote(m[1], m[2].strip())
                return True
            if first == ":" and self.options.directives and self._directive(text, drop):
                return True
            break
        if not closed and not lazy:
            drop()
        return False

    def _footnote(self, name: str, text: str) -> None:
        node = self._add("FootnoteDef", identifier=name)
        para = Node("Paragraph", line=self.lineno, col=node.col, start=node.start, end=node.end, last_line=self.lineno)
        node.children.append(para)
        para.data["raw"] = text
        if not text:  # the paragraph below is the note
            self._push(node)
            self._push(para, plain=True)

    def _heading_text(self, node: Node, content: str) -> None:
        if m := _EXPLICIT_ID.search(content):
            node.data["explicit_id"] = m[1]
            content = content[: m.start()].rstrip(" \t")
        node.data["raw"] = content

    def _setext(self, block: _Open, text: str) -> bool:
        m = _SETEXT.match(text)
        if not m or block.info.get("lazy"):
            return False
        body = "\n".join(block.lines)
        while body.startswith("[") and not block.info.get("plain") and (got := parse_definition(body)):
            if key := label_key(got[0]):
                self.refs.setdefault(key, (got[1], got[2]))
            body = body[got[3] :].lstrip("\n")
        if not body.strip():
            return False
        node = block.node
        node.type, node.last_line = "Heading", self.lineno
        node.data.update(level=1 if m[1][0] == "=" else 2, style="setext")
        self._heading_text(node, body.strip(" \t"))
        self.stack.pop()
        self.stack[-1].node.last_line = self.lineno
        return True

    def _table(self, block: _Open, text: str) -> bool:
        last = block.lines[-1]
        if not _DELIMITER_ROW.match(text) or "|" not in last and "|" not in text:
            return False
        marks, head = split_row(text), split_row(last)
        if len(marks) != len(head):
            return False
        block.lines.pop()
        node = block.node
        if block.lines:
            node.last_line -= 1
            self._close()
            node = self._add("Table")
        else:
            self.stack.pop()
            node.type = "Table"
        node.line, node.last_line = self.lineno - 1, self.lineno
        sides = {(True, True): "center", (True, False): "left", (False, True): "right"}
        node.data.update(alignments=[sides.get((x.startswith(":"), x.endswith(":"))) for x in marks], head=last)
        self._push(node)
        return True

    def _html(self, text: str, drop) -> bool:
        for k, start in enumerate(_HTML_START):
            if start.match(text):
                if k == 6 and ("://" in text or "@" in text or not self.below_blank and _TAG_NAME.match(text)[1].lower() in _INLINE_TAGS):
                    return False
                drop()
                block = self._push(self._add("HtmlBlock"), k)
                block.lines.append(self._rest())
                if k < 5 and _HTML_END[k].search(text):
                    self._close()
                return True
        return False

    def _list_item(self, text: str, drop, here) -> bool:
        m = _BULLET.match(text)
        ordered = None if m else _ORDERED.match(text)
        if not m and not ordered:
            return False
        width = len((m or ordered)[0])
        if here is not None and (not text[width:].strip(" \t") or ordered and int(ordered[1]) != 1):
            return False
        drop()
        mark = text[0] if m else ordered[2]
        while self.stack[-1].node.type not in _CONTAINERS:
            self._close()
        top = self.stack[-1]
        if not (top.node.type == "List" and top.info["mark"] == mark):
            self._push(self._add("List", ordered=bool(ordered), start=int(ordered[1]) if ordered else 1), mark=mark)
        item = self._add("ListItem", checked=None)
        need = self.indent + width
        self._to_next()
        self.pos += width
        self.column += width
        self._measure()
        if self.blank:
            need += 1
            self._to_next()
        else:
            pad = self.indent if self.indent <= 4 else 1
            need += pad
            self._skip(pad)
        self._push(item, need)
        if not self.blank and self.indent == 0 and (t := _TASK.match(self.line, self.next)):
            item.data["checked"] = t[1] in "xX"
            self.column += t.end() - self.pos
            self.pos = t.end()
            self._measure()
        return True

    def _directive(self, text: str, drop) -> bool:
        opened = [k for k, b in enumerate(self.stack) if b.node.type == "Directive"]
        if m := _DIRECTIVE_END.match(text):
            return bool(opened) and len(m[1]) >= self.stack[opened[-1]].at and self._end_directive(opened[-1])
        if m := _DIRECTIVE.match(text):
            if m[2]:
                same = [k for k in opened if self.stack[k].node.data["name"] == m[3]]
                return bool(same) and self._end_directive(same[-1])
            drop()
            node = self._add("Directive", name=m[3], title=m[4].strip() or None, options={})
            self._push(node, len(m[1]))
            return True
        m = _DIRECTIVE_OPTION.match(text)
        top = self.stack[-1].node
        if m and top.type == "Directive" and not top.children:
            top.data["options"][m[1]] = m[2].strip()
            return True
        return False

    def _end_directive(self, at: int) -> bool:
        self.stack[at].node.last_line = self.lineno
        while len(self.stack) > at:
            self._close()
        return True
