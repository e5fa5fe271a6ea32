"""Differences of two trees by position."""

from __future__ import annotations

from itertools import zip_longest

from .model import Node


class Comparer:
    """Numbers subtrees so that equal ones (content and places) have equal numbers."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.number: dict[int, int] = {}

    def of(self, node: Node) -> int:
        """The number of a subtree."""
        got = self.number.get(id(node))
        if got is None:
            data = tuple(sorted((k, repr(v)) for k, v in node.data.items()))
            key = (node.type, data, node.line, node.col, node.start, node.end, tuple(map(self.of, node.children)))
            got = self.number[id(node)] = self.known.setdefault(key, len(self.known))
        return got


def changes(old: Node, new: Node, recursive: bool = True) -> list[tuple[str, tuple[int, ...], str]]:
    """(kind, path, type) of the nodes that were added, removed or modified.

    Children meet by position. Of a modified pair the children follow, unless it is a table.
    """
    same, out, todo = Comparer(), [], [(old, new, ())]
    while todo:
        a, b, path = todo.pop()
        if path and a and b and same.of(a) == same.of(b):
            continue
        if path:
            if a and b and a.type == b.type:
                out.append(("modified", path, a.type))
            else:
                out += [(kind, path, n.type) for kind, n in (("removed", a), ("added", b)) if n]
                continue
            if not recursive or a.type == "Table":
                continue
        pairs = [(x, y, (*path, k)) for k, (x, y) in enumerate(zip_longest(a.children, b.children))]
        todo += reversed(pairs)
    return out
