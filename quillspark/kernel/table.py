"""Trees as node tables: pre-order rows with interval ids, and back; Arrow columns of both."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable

import pyarrow as pa

from .blocks import BlockParser
from .model import Node, Options, ParseError

#: the columns of a node row: name, Spark type, Arrow type
COLUMNS = (
    ("id", "int", pa.int32()), ("parent", "int", pa.int32()), ("ord", "int", pa.int32()), ("slot", "string", pa.string()),
    ("depth", "int", pa.int32()), ("last", "int", pa.int32()), ("path", "array<int>", pa.list_(pa.int32())), ("type", "string", pa.string()),
    ("level", "int", pa.int32()), ("style", "string", pa.string()), ("explicit_id", "string", pa.string()), ("text", "string", pa.string()),
    ("url", "string", pa.string()), ("scheme", "string", pa.string()), ("title", "string", pa.string()), ("name", "string", pa.string()),
    ("identifier", "string", pa.string()), ("info", "string", pa.string()), ("marker", "string", pa.string()), ("fence_indent", "int", pa.int32()),
    ("source_start", "int", pa.int32()), ("source_end", "int", pa.int32()), ("ordered", "boolean", pa.bool_()), ("start", "int", pa.int32()),
    ("tight", "boolean", pa.bool_()), ("checked", "boolean", pa.bool_()), ("is_header", "boolean", pa.bool_()), ("align", "string", pa.string()),
    ("alignments", "array<string>", pa.list_(pa.string())), ("options", "map<string,string>", pa.map_(pa.string(), pa.string())),
    ("lineno", "int", pa.int32()), ("col", "int", pa.int32()), ("offset", "int", pa.int32()), ("end_offset", "int", pa.int32()), ("end_lineno", "int", pa.int32()),
    ("boxes", "int", pa.int32()),
)
NAMES = tuple(c[0] for c in COLUMNS)
SPARK_TYPE = "array<struct<" + ",".join(f"`{n}`:{t}" for n, t, _ in COLUMNS) + ">>"

# the payload field that stands in the text column, by node type
_TEXT_OF = {"Text": "content", "Role": "content", "Math": "content", "MathBlock": "content", "CodeSpan": "code", "FencedCode": "code", "IndentedCode": "code", "HtmlInline": "html", "HtmlBlock": "html", "Image": "alt"}
_SAME = ("level", "style", "explicit_id", "url", "title", "name", "identifier", "info", "marker", "fence_indent", "source_start", "source_end", "ordered", "start", "tight", "checked", "is_header", "align", "alignments")
_DENSE = ("id", "parent", "ord", "slot", "depth", "last", "path", "type", "lineno", "col", "offset", "end_offset", "end_lineno", "boxes")
_SLOTS = {"List": "items", "TableRow": "cells"}
_SCHEME = re.compile(r"([a-z][a-z0-9+.-]*):")
#: characters that browsers pass over in a scheme
_UNSEEN = dict.fromkeys((*range(0x21), 0x7F))


def url_scheme(url: str) -> str | None:
    """The scheme that a browser would see, or None: entities decoded, blanks and controls removed."""
    found = _SCHEME.match(html.unescape(url).translate(_UNSEEN).lower())
    return found and found[1]


class _Columns:
    """Node rows of many trees, gathered column by column; payload columns hold only the rows that have a value."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.n = names, 0
        self.dense: dict[str, list] = {n: [] for n in _DENSE}
        self.sparse: dict[str, dict[int, object]] = {n: {} for n in names if n not in _DENSE}
        self.paths = "path" in names

    def add(self, doc: Node) -> None:
        """The tree's rows in pre-order."""
        first, dense, sparse = self.n, self.dense, self.sparse
        nodes: list[Node] = []
        ids, parents, ords, slots, depths, paths, boxes = ([] for _ in range(7))
        todo = [(doc, -1, 0, "root", 0, (), 0)]
        while todo:
            node, parent, nth, slot, depth, path, box = todo.pop()
            me, kind = len(nodes), node.type
            nodes.append(node)
            ids.append(me)
            parents.append(parent)
            ords.append(nth)
            slots.append(slot)
            depths.append(depth)
            boxes.append(box if box > 0 else 0)
            if self.paths:
                paths.append(list(path))
            kids = node.children
            if kids:
                # quotes and directives above a node; below a list they do not count, nor are they limited
                if kind == "List":
                    box = -1 << 20
                elif kind == "BlockQuote" or kind == "Directive":
                    box += 1
                inner = _SLOTS.get(kind, "children")
                for k in range(len(kids) - 1, -1, -1):
                    c = kids[k]
                    where = inner if kind != "Table" else ("head" if c.data["is_header"] else "body")
                    todo.append((c, me, k, where, depth + 1, (*path, k) if self.paths else path, box))
        last = list(ids)
        for k in range(len(nodes) - 1, 0, -1):
            if last[k] > last[p := parents[k]]:
                last[p] = last[k]
        for name, values in (
            ("id", ids), ("parent", parents), ("ord", ords), ("slot", slots), ("depth", depths), ("last", last), ("path", paths), ("boxes", boxes), ("type", [x.type for x in nodes]),
            ("lineno", [x.line for x in nodes]), ("col", [x.col for x in nodes]), ("offset", [x.start for x in nodes]), ("end_offset", [x.end for x in nodes]),
            ("end_lineno", [x.last_line for x in nodes]),
        ):
            dense[name] += values
        if sparse:
            for k, x in enumerate(nodes, first):
                if x.data:
                    for name, value in x.data.items():
                        if name in sparse and value is not None:
                            sparse[name][k] = list(value.items()) if name == "options" else value
                    if "text" in sparse and (name := _TEXT_OF.get(x.type)) is not None:
                        sparse["text"][k] = x.data.get(name)
                    if "scheme" in sparse and "url" in x.data:
                        sparse["scheme"][k] = url_scheme(x.data["url"])
        self.n += len(nodes)

    def column(self, name: str) -> list:
        """All values of a column."""
        if name in self.dense:
            return self.dense[name]
        out = [None] * self.n
        for k, v in self.sparse[name].items():
            out[k] = v
        return out


def flatten(doc: Node) -> dict[str, list]:
    """Columns of the tree's rows in pre-order."""
    rows = _Columns(NAMES)
    rows.add(doc)
    return {n: rows.column(n) for n in NAMES}


def unflatten(rows: list[dict]) -> Node:
    """The tree of the rows; a row whose parent is gone is gone with it."""
    by_id: dict[int, Node] = {}
    root = Node("Document")
    for r in sorted(rows, key=lambda r: r["id"]):
        data = {k: r[k] for k in _SAME if r.get(k) is not None}
        kind = r["type"]
        if kind in _TEXT_OF:
            data[_TEXT_OF[kind]] = r["text"] or ""
        if kind == "ListItem":
            data["checked"] = r.get("checked")
        if kind in ("Link", "Image"):
            data["title"] = r.get("title")
        if kind == "Directive":
            data["options"] = dict(r.get("options") or {})
        node = Node(kind, [], data, r["lineno"], r["col"], r["offset"], r["end_offset"], r["end_lineno"])
        if r["parent"] < 0:
            root = node
        elif r["parent"] in by_id:
            by_id[r["parent"]].children.append(node)
        else:
            continue
        by_id[r["id"]] = node
    return root


_PAYLOAD = {
    "Heading": ("level", "style", "explicit_id"), "Link": ("url", "title"), "Image": ("url", "title"), "Role": ("name",), "FootnoteRef": ("identifier",),
    "FootnoteDef": ("identifier",), "FencedCode": ("info", "marker", "fence_indent", "source_start", "source_end"), "List": ("ordered", "start", "tight"),
    "ListItem": ("checked",), "Directive": ("name", "title", "options"), "Table": ("alignments",), "TableRow": ("is_header",), "TableCell": ("is_header", "align"),
}
_NEEDED = ("id", "parent", "type", "text", "lineno", "col", "offset", "end_offset", "end_lineno")


def trees_of(ast: pa.Array) -> list[Node | None]:
    """The trees of a list array of node rows, read column by column."""
    if isinstance(ast, pa.ChunkedArray):
        ast = ast.combine_chunks()
    rows = ast.flatten()
    col = {n: rows.field(n).to_pylist() for n in _NEEDED}
    kinds = set(col["type"])
    wanted = {f for k in kinds for f in _PAYLOAD.get(k, ())}
    col |= {n: rows.field(n).to_pylist() for n in wanted}
    out, at = [], 0
    for size in ast.value_lengths().to_pylist():
        if size is None:
            out.append(None)
            continue
        by_id: dict[int, Node] = {}
        root = None
        for i in range(at, at + size):
            kind, parent = col["type"][i], col["parent"][i]
            above = by_id.get(parent)
            if parent >= 0 and above is None:
                continue
            data = {f: col[f][i] for f in _PAYLOAD.get(kind, ())}
            if kind in _TEXT_OF:
                data[_TEXT_OF[kind]] = col["text"][i] or ""
            if kind == "Directive":
                data["options"] = dict(data["options"] or ())
            by_id[col["id"][i]] = node = Node(kind, [], data, col["lineno"][i], col["col"][i], col["offset"][i], col["end_offset"][i], col["end_lineno"][i])
            if above is None:
                root = node
            else:
                above.children.append(node)
        out.append(root or Node("Document"))
        at += size
    return out


def parse(source: str, options: Options, text: Callable[[str], str] | None = None) -> Node:
    """The tree of one source; ``text`` changes every line outside code blocks and raw HTML before it is read."""
    try:
        return BlockParser(options, text).parse(source)
    except RecursionError:
        raise ParseError("nesting exceeds what can be represented") from None


def arrow_rows(trees: list[Node | None], names: tuple[str, ...] = NAMES) -> pa.Array:
    """A list array of node rows, a list for each tree and null for None; ``names`` are its columns."""
    rows, offsets, mask = _Columns(names), [0], []
    for t in trees:
        if t is not None:
            rows.add(t)
        offsets.append(rows.n)
        mask.append(t is None)
    kinds = {n: t for n, _, t in COLUMNS}
    cols = [pa.nulls(rows.n, kinds[n]) if n in rows.sparse and not rows.sparse[n] else pa.array(rows.column(n), kinds[n]) for n in names]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cols, fields=[pa.field(n, kinds[n]) for n in names]), mask=pa.array(mask))


# -- JSON -----------------------------------------------------------------

_FIELDS = {
    "Text": ("content",), "Link": ("url", "title"), "Image": ("url", "alt", "title"), "CodeSpan": ("code",), "HtmlInline": ("html",),
    "Role": ("name", "content", "target"), "Math": ("content",), "FootnoteRef": ("identifier",), "Heading": ("level", "style", "explicit_id"),
    "FencedCode": ("source_start", "source_end", "info", "marker", "fence_indent", "content_override"), "IndentedCode": ("code",),
    "List": ("ordered", "start", "tight"), "ListItem": ("checked",), "HtmlBlock": ("html",), "Directive": ("name", "title", "options", "raw_content"),
    "Table": ("alignments",), "TableRow": ("is_header",), "TableCell": ("is_header", "align"), "MathBlock": ("content",), "FootnoteDef": ("identifier",),
}
_LEAVES = frozenset("Text Image CodeSpan LineBreak SoftBreak HtmlInline Role Math FootnoteRef FencedCode IndentedCode ThematicBreak HtmlBlock MathBlock".split())


def to_dict(node: Node) -> dict:
    """A dict with ``_type``, the location and the payload of each node."""
    place = {"_type": "SourceLocation", "lineno": node.line, "col_offset": node.col, "offset": node.start, "end_offset": node.end, "end_lineno": node.last_line, "end_col_offset": None, "source_file": None}
    out = {"_type": node.type, "location": place} | {k: node.data.get(k) for k in _FIELDS.get(node.type, ())}
    kids = [to_dict(c) for c in node.children]
    if node.type == "FencedCode":
        out["code"] = node.data["code"]
    if node.type == "List":
        out["items"] = kids
    elif node.type == "TableRow":
        out["cells"] = kids
    elif node.type == "Table":
        out["head"] = [k for k in kids if k["is_header"]]
        out["body"] = [k for k in kids if not k["is_header"]]
    elif node.type not in _LEAVES:
        out["children"] = kids
    return out


def to_json(node: Node, indent: int | None = None) -> str:
    """Deterministic JSON: sorted keys, ASCII."""
    return json.dumps(to_dict(node), sort_keys=True, indent=indent)


def from_dict(data: dict) -> Node:
    """The node of a dict made by ``to_dict``."""
    kind = data.get("_type")
    if kind != "Document" and kind not in _FIELDS and kind not in ("Emphasis", "Strong", "Strikethrough", "LineBreak", "SoftBreak", "Paragraph", "BlockQuote", "ThematicBreak"):
        raise ValueError(f"unknown node type: {kind!r}")
    kids = [from_dict(k) for slot in ("children", "items", "head", "body", "cells") for k in data.get(slot, ())]
    payload = {k: data.get(k) for k in _FIELDS.get(kind, ()) if k in data}
    if kind == "FencedCode":
        payload["code"] = data.get("code") or ""
    place = data.get("location") or {}
    return Node(kind, kids, payload, place.get("lineno", 0), place.get("col_offset", 0), place.get("offset", 0), place.get("end_offset", 0), place.get("end_lineno") or 0)


def from_json(text: str) -> Node:
    """The Document of a JSON text."""
    node = from_dict(json.loads(text))
    if node.type != "Document":
        raise ValueError("the root is not a Document")
    return node
