"""Inline structure: a scan for marks, then delimiter matching on a stack."""

from __future__ import annotations

import html
import re
import unicodedata

from .model import Node, Options, ParseError

_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_HTML = re.compile(
    rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!---?>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S
)
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9.+-]{1,31}:[^\s<>\x00-\x20]*)>")
_EMAIL = re.compile(
    r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>"
)
_ROLE = re.compile(r"\{([A-Za-z][\w-]*)\}`([^`\n]+)`")
_MATH = re.compile(r"\$(?!\$)([^$\n]+)\$(?!\$)")
_NOTE = re.compile(r"\[\^([\w-]+)\](?!:)")
_BARE_URL = re.compile(r"https?://[^\s<`]+|www\.[^\s<`]+", re.I)
_BARE_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+_-]{0,63}@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")
_BARE_HINT = re.compile(r"https?://|www\.|@", re.I)
_BARE_START = re.compile(r"(?<![^ \t\n*_~(])(?=https?://|www\.|[A-Z0-9][A-Z0-9.+_-]{0,63}@)", re.I)
_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.){1,999})\]", re.S)
_BLANKS = re.compile(r"[ \t\n]*")
_LINE_END = re.compile(r"[ \t]*(?:\n|$)")
_SPACE = re.compile(r"[ \t]*\n?[ \t]*")
_TITLE = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)", re.S)
_ANGLE = re.compile(r"<((?:[^<>\n\\]|\\.)*)>")


def unescape(text: str) -> str:
    """Backslash escapes resolved; entities are left to the renderer."""
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def entity(text: str) -> str | None:
    """The characters of one reference, or None for an unknown name."""
    if text[1] == "#":
        number = int(text[3:-1], 16) if text[2] in "xX" else int(text[2:-1])
        return chr(number) if 0 < number <= 0x10FFFF and not 0xD800 <= number <= 0xDFFF else "\ufffd"
    got = html.unescape(text)
    return got if got != text and not got.endswith(";") else ("&" if text == "&amp;" else None)


def label_key(label: str) -> str:
    """The form in which labels are compared."""
    return " ".join(label.split()).casefold()


def _destination(text: str, at: int) -> tuple[str, int] | None:
    if at < len(text) and text[at] == "<":
        m = _ANGLE.match(text, at)
        return (unescape(m[1]), m.end()) if m else None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in _PUNCT:
            i += 2
            continue
        if c == "(":
            depth += 1
            if depth > 32:
                return None
        elif c == ")":
            if not depth:
                break
            depth -= 1
        elif c <= " " or c == "\x7f":
            break
        i += 1
    return None if depth else (unescape(text[at:i]), i)


def _title(text: str, at: int) -> tuple[str, int] | None:
    m = _TITLE.match(text, at)
    if not m:
        return None
    body = next(g for g in m.groups() if g is not None)
    return None if re.search(r"\n[ \t]*\n", body) else (unescape(body), m.end())


def parse_definition(text: str) -> tuple[str, str, str | None, int] | None:
    """(label, url, title, length) of a link reference definition at the start."""
    m = _LABEL.match(text)
    if not m or not m[1].strip() or text[m.end() : m.end() + 1] != ":":
        return None
    at = _SPACE.match(text, m.end() + 1).end()
    if at >= len(text):
        return None
    got = _destination(text, at)
    if not got or (not got[0] and text[at] != "<"):
        return None
    url, end = got
    blank = _SPACE.match(text, end).end()
    title, after = None, end
    if blank > end and (t := _title(text, blank)):
        rest = _LINE_END.match(text, t[1])
        if rest:
            title, after = t
            return m[1], url, title or None, rest.end()
    rest = _LINE_END.match(text, after)
    return (m[1], url, None, rest.end()) if rest else None


def _is_punct(c: str) -> bool:
    return c in _PUNCT or unicodedata.category(c)[0] in "PS"


def _is_space(c: str) -> bool:
    return c in "\t\n\x0c\r" or unicodedata.category(c) == "Zs"


class _Mark:
    """A run of delimiters among the inline nodes."""

    __slots__ = ("at", "char", "left", "length", "node", "opens", "closes", "active")

    def __init__(self, at: int, char: str, length: int, node: Node, opens: bool, closes: bool):
        self.at, self.char, self.length, self.left, self.node = at, char, length, length, node
        self.opens, self.closes, self.active = opens, closes, True


class Inliner:
    """Fills the inline children of a tree."""

    def __init__(self, options: Options, refs: dict):
        self.options, self.refs = options, refs
        special = "\\`*_[]!<&\n" + ("{" if options.roles else "") + ("~" if options.strikethrough else "") + ("$" if options.math else "")
        self.special = special
        self.run = re.compile(f"[^{re.escape(special)}]+")
        self.any = re.compile(f"[{re.escape(special)}]")
        self.bare = options.autolinks

    def fill(self, root: Node) -> None:
        """Parse the raw text of every leaf below ``root``."""
        for node in list(root.walk()):
            if node.type == "Table":
                self._table(node)
            elif "raw" in node.data:
                node.children = self.parse(node.data.pop("raw"), node)

    def _table(self, node: Node) -> None:
        from .blocks import split_row

        align = node.data["alignments"]
        head = node.data.pop("head")
        for k, line in enumerate([head, *node.data.pop("rows", ())]):
            row = Node("TableRow", data={"is_header": k == 0}, line=node.line + k + (k > 0), col=1, start=node.start, end=node.end)
            cells = split_row(line)
            cells = cells[: len(align)] + [""] * (len(align) - len(cells))
            for side, cell in zip(align, cells):
                c = Node("TableCell", data={"is_header": k == 0, "align": side}, line=row.line, col=1, start=node.start, end=node.end)
                c.children = self.parse(cell, c)
                row.children.append(c)
            node.children.append(row)

    def parse(self, text: str, at: Node) -> list[Node]:
        """The inline nodes of one text."""
        self.where = at
        starts = [m.start() for m in _BARE_START.finditer(text)] if self.bare and _BARE_HINT.search(text) else []
        if not starts and not self.any.search(text):
            return [self._node("Text", content=text)] if text else []
        return self._scan(text, starts)

    def _node(self, kind: str, children: list[Node] | None = None, **data) -> Node:
        w = self.where
        return Node(kind, children or [], data, w.line, w.col, w.start, w.end, w.last_line)

    # -- scan ------------------------------------------------------------

    def _scan(self, text: str, starts: list[int]) -> list[Node]:
        out: list[Node] = []
        marks: list[_Mark] = []
        brackets: list[tuple[int, int, bool, int]] = []  # place among nodes, place in text, image, marks below
        add = out.append
        i, n, o = 0, len(text), self.options
        dead = 0  # openers before this place in ``brackets`` may not make links
        ticks: dict = {}  # runs and ends that are known not to come any more
        while i < n:
            c = text[i]
            if starts:
                while starts and starts[0] < i:
                    del starts[0]
                if starts and starts[0] == i and (got := self._bare(text, i)):
                    add(got[0])
                    i = got[1]
                    continue
            if c not in self.special:
                end = self.run.match(text, i).end()
                if starts:  # a bare link may start inside
                    end = min(end, next((k for k in starts if k > i), end))
                add(self._node("Text", content=text[i:end]))
                i = end
            elif c == "\n":
                self._break(out, text, i)
                i += 1
                while i < n and text[i] in " \t":
                    i += 1
            elif c == "\\":
                if i + 1 < n and text[i + 1] == "\n":
                    add(self._node("LineBreak"))
                    i += 2
                    while i < n and text[i] in " \t":
                        i += 1
                elif i + 1 < n and text[i + 1] in _PUNCT:
                    add(self._node("Text", content=text[i + 1]))
                    i += 2
                else:
                    add(self._node("Text", content="\\"))
                    i += 1
            elif c == "`":
                run = len(text) - len(text[i:].lstrip("`")) - i
                end = self._close_ticks(text, i + run, run, ticks)
                if end < 0:
                    add(self._node("Text", content="`" * run))
                    i += run
                else:
                    code = text[i + run : end].replace("\n", " ")
                    if code[:1] == code[-1:] == " " and code.strip(" "):
                        code = code[1:-1]
                    add(self._node("CodeSpan", code=code))
                    i = end + run
            elif c in "*_" or c == "~" and o.strikethrough:
                run = len(text) - len(text[i:].lstrip(c)) - i
                before, after = text[i - 1] if i else "\n", text[i + run] if i + run < n else "\n"
                left = not _is_space(after) and (not _is_punct(after) or _is_space(before) or _is_punct(before))
                right = not _is_space(before) and (not _is_punct(before) or _is_space(after) or _is_punct(after))
                opens, closes = left, right
                if c == "_":
                    opens, closes = left and (not right or _is_punct(before)), right and (not left or _is_punct(after))
                node = self._node("Text", content=c * run)
                add(node)
                if c != "~" or run == 2:
                    marks.append(_Mark(len(out) - 1, c, run, node, opens, closes))
                i += run
            elif c == "!" and i + 1 < n and text[i + 1] == "[":
                brackets.append((len(out), i + 2, True, len(marks)))
                add(self._node("Text", content="!["))
                i += 2
            elif c == "[":
                if o.footnotes and (m := _NOTE.match(text, i)):
                    add(self._node("FootnoteRef", identifier=m[1]))
                    i = m.end()
                else:
                    brackets.append((len(out), i + 1, False, len(marks)))
                    add(self._node("Text", content="["))
                    i += 1
            elif c == "]":
                if brackets:
                    at, inner, image, below = brackets.pop()
                    got = None if not image and len(brackets) < dead else self._target(text, inner, i)
                    if got:
                        url, title, i = got
                        kids = self._emphasis(out[at + 1 :], [m for m in marks[below:]], at + 1)
                        del out[at:], marks[below:]
                        if image:
                            alt = "".join(self._alt(k) for k in kids)
                            add(self._node("Image", url=url, title=title, alt=alt))
                        else:
                            add(self._node("Link", kids, url=url, title=title))
                            dead = sum(1 for b in brackets if not b[2]) and len(brackets)
                        continue
                add(self._node("Text", content="]"))
                i += 1
                dead = min(dead, len(brackets))
            elif c == "<":
                m = None
                if m := _URI.match(text, i):
                    url = m[1]
                    add(self._node("Link", [self._node("Text", content=url)], url=url.replace("\\", "%5C").replace("[", "%5B").replace("]", "%5D")))
                elif m := _EMAIL.match(text, i):
                    add(self._node("Link", [self._node("Text", content=m[1])], url="mailto:" + m[1]))
                elif self._may_close(text, i, ticks) and (m := _HTML.match(text, i)):
                    add(self._node("HtmlInline", html=m[0]))
                else:
                    add(self._node("Text", content="<"))
                i = m.end() if m else i + 1
            elif c == "&":
                m = _ENTITY.match(text, i)
                got = entity(m[0]) if m else None
                add(self._node("Text", content="&" if got is None else got))
                i = i + 1 if got is None else m.end()
            elif c == "{" and (m := _ROLE.match(text, i)):
                add(self._node("Role", name=m[1], content=m[2]))
                i = m.end()
            elif c == "$" and (m := _MATH.match(text, i)) and not (m[1][0] == " " and m[1][-1] == " "):
                add(self._node("Math", content=m[1]))
                i = m.end()
            else:
                add(self._node("Text", content=c))
                i += 1
        return self._emphasis(out, marks, 0)

    @staticmethod
    def _may_close(text: str, i: int, none: dict) -> bool:
        """False if a comment, instruction or section that starts here has no end; that is remembered."""
        for start, end in (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>")):
            if text.startswith(start, i):
                if end not in none and text.find(end, i) < 0:
                    none[end] = i
                return end not in none
        return True

    def _close_ticks(self, text: str, at: int, run: int, none: dict[int, int]) -> int:
        """Where a run of exactly so many backticks starts, or -1; misses are remembered."""
        if none.get(run, len(text) + 1) <= at:
            return -1
        i = text.find("`", at)
        while i >= 0:
            end = i
            while end < len(text) and text[end] == "`":
                end += 1
            if end - i == run:
                return i
            i = text.find("`", end)
        none[run] = min(none.get(run, at), at)
        return -1

    def _break(self, out: list[Node], text: str, i: int) -> None:
        hard = i >= 2 and text[i - 2 : i] == "  "
        if out and out[-1].type == "Text":
            out[-1].data["content"] = out[-1].data["content"].rstrip(" \t")
            if not out[-1].data["content"]:
                out[-1].data["content"] = ""
        out.append(self._node("LineBreak" if hard else "SoftBreak"))

    def _target(self, text: str, inner: int, close: int) -> tuple[str, str | None, int] | None:
        """(url, title, place after) of a link whose text stands between the brackets."""
        i = close + 1
        if text[i : i + 1] == "(":
            at = _BLANKS.match(text, i + 1).end()
            if text[at : at + 1] == ")":
                return "", None, at + 1
            got = _destination(text, at)
            if got:
                url, end = got
                blank = _BLANKS.match(text, end).end()
                title = None
                if blank > end and (t := _title(text, blank)):
                    title, end = t
                    blank = _BLANKS.match(text, end).end()
                if text[blank : blank + 1] == ")":
                    return url, title, blank + 1
        m = _LABEL.match(text, i)
        if m and m[1].strip():
            hit = self.refs.get(label_key(m[1]))
            return (*hit, m.end()) if hit else None
        end = i + 2 if text[i : i + 2] == "[]" else i
        label = text[inner:close]
        if len(label) > 999 or not _LABEL.fullmatch(f"[{label}]"):
            return None
        hit = self.refs.get(label_key(label)) if label.strip() else None
        return (*hit, end) if hit else None

    def _alt(self, node: Node) -> str:
        d = node.data
        if node.type in ("LineBreak", "SoftBreak"):
            return " " if node.type == "LineBreak" else "\n"
        own = d.get("content") or d.get("code") or d.get("alt") or ""
        return own + "".join(self._alt(k) for k in node.children)

    # -- emphasis --------------------------------------------------------

    def _emphasis(self, nodes: list[Node], marks: list[_Mark], base: int) -> list[Node]:
        """Match delimiter runs and nest what they enclose."""
        if not marks:
            return nodes
        for m in marks:
            m.at -= base
        slots: list[list[Node]] = [[n] for n in nodes]
        depth = [0] * len(nodes)
        floor: dict[tuple[str, bool, int], int] = {}
        stack: list[_Mark] = []
        for closer in marks:
            if closer.closes:
                while closer.left:
                    key = (closer.char, closer.opens, closer.length % 3)
                    k = len(stack) - 1
                    low = floor.get(key, 0)
                    while k >= low:
                        m = stack[k]
                        odd = (m.closes or closer.opens) and (m.length + closer.length) % 3 == 0 and (m.length % 3 or closer.length % 3)
                        if m.char == closer.char and m.opens and not (odd and closer.char != "~"):
                            break
                        k -= 1
                    if k < low:
                        floor[key] = len(stack)
                        break
                    opener = stack[k]
                    del stack[k + 1 :]
                    use = 2 if opener.left >= 2 and closer.left >= 2 else 1
                    kind = "Strikethrough" if closer.char == "~" else ("Strong" if use == 2 else "Emphasis")
                    inside = [n for s in slots[opener.at + 1 : closer.at] for n in s]
                    deep = 1 + max(depth[opener.at + 1 : closer.at], default=0)
                    if deep > self.options.max_nesting_depth:
                        raise ParseError(f"nesting exceeds {self.options.max_nesting_depth} levels", self.where.line)
                    for j in range(opener.at + 1, closer.at):
                        slots[j] = []
                    spot = opener.at + 1 if opener.at + 1 < closer.at else None
                    made = self._node(kind, inside)
                    for m in (opener, closer):
                        m.left -= use
                        m.node.data["content"] = m.char * m.left
                    if spot is None:
                        slots[opener.at].append(made)
                    else:
                        slots[spot] = [made]
                        depth[spot] = deep
                    if not opener.left:
                        stack.pop()
                    for key2 in [q for q, v in floor.items() if v > len(stack)]:
                        floor[key2] = len(stack)
            if closer.opens and closer.left:
                stack.append(closer)
        return [n for s in slots for n in s if not (n.type == "Text" and n.data["content"] == "")]

    # -- bare links ------------------------------------------------------

    def _bare(self, text: str, i: int) -> tuple[Node, int] | None:
        if m := _BARE_URL.match(text, i):
            body = self._trim(m[0])
            host = re.split(r"[/?#]", re.sub(r"^https?://", "", body, flags=re.I))[0]
            if "." in host.strip(".") and not host.startswith("."):
                url = body if "://" in body else "http://" + body
                return self._node("Link", [self._node("Text", content=body)], url=url), i + len(body)
        elif m := _BARE_EMAIL.match(text, i):
            body = m[0].rstrip(".")
            if body[-1] not in "-_" and "." in body.split("@")[1]:
                return self._node("Link", [self._node("Text", content=body)], url="mailto:" + body), i + len(body)
        return None

    @staticmethod
    def _trim(body: str) -> str:
        """Without punctuation, unbalanced parentheses and entities at the end."""
        while body:
            if body[-1] in "?!.,:*_~'\"":
                body = body[:-1]
            elif body[-1] == ")" and body.count(")") > body.count("("):
                body = body[:-1]
            elif m := re.search(r"&[A-Za-z0-9]+;$", body):
                body = body[: m.start()]
            else:
                break
        return body
