"""Node model and options of the parse kernel."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, fields

PLUGINS = ("table", "strikethrough", "task_lists", "footnotes", "math", "autolinks")


log = logging.getLogger("quillspark")


class Error(Exception):
    """Any error of this library."""


class ParseError(Error, ValueError):
    """The source cannot be parsed within the limits."""

    def __init__(self, message: str, lineno: int | None = None, col: int | None = None, source_file: str | None = None):
        self.message, self.lineno, self.col, self.source_file = message, lineno, col, source_file
        place = ":".join(str(x) for x in (source_file, lineno, col if lineno else None) if x)
        super().__init__(f"{place}: {message}" if place else message)


class ContractError(Error):
    """A directive stands where its contract does not let it."""

    def __init__(self, directive: str, message: str, lineno: int | None = None):
        self.directive, self.lineno = directive, lineno
        super().__init__(f"directive '{directive}'{f' (line {lineno})' if lineno else ''}: {message}")


class RenderError(Error):
    """A tree cannot be rendered."""


class PluginError(Error, ValueError):
    """A plugin is unknown or fails."""

    def __init__(self, plugin: str, message: str):
        self.plugin = plugin
        super().__init__(f"plugin '{plugin}': {message}")


@dataclass(frozen=True)
class Options:
    """What a parse and a rendering depend on."""

    table: bool = False
    strikethrough: bool = False
    task_lists: bool = False
    footnotes: bool = False
    math: bool = False
    autolinks: bool = False
    directives: bool = True
    roles: bool = True
    max_nesting_depth: int = 100

    @classmethod
    def of(cls, *plugins: str, **more) -> Options:
        """Options with the named plugins; ``all`` means every one."""
        names = PLUGINS if "all" in plugins else plugins
        if unknown := set(names) - set(PLUGINS):
            raise PluginError(", ".join(sorted(unknown)), "unknown")
        return cls(**dict.fromkeys(names, True), **more)

    @classmethod
    def from_dict(cls, values: dict) -> Options:
        """Options from a dict; keys that are no option are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def key(self) -> str:
        """A text that is equal for equal options."""
        return "|".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self))


@dataclass(slots=True, eq=False)
class Node:
    """A node of the document tree; payload fields are in ``data``."""

    type: str
    children: list[Node] = field(default_factory=list)
    data: dict = field(default_factory=dict)
    line: int = 1
    col: int = 1
    start: int = 0
    end: int = 0
    last_line: int = 1

    def walk(self):
        """This node and its descendants in pre-order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def transform(self, change: Callable[[Node], Node | None]) -> Node:
        """This tree with every node changed, children before what holds them; None removes a node, but not the root."""
        todo, done = [(self, False)], {}
        while todo:
            n, ready = todo.pop()
            if not ready:
                todo.append((n, True))
                todo += [(c, False) for c in n.children]
                continue
            kept = [x for c in n.children if (x := done.pop(id(c))) is not None]
            done[id(n)] = change(Node(n.type, kept, dict(n.data), n.line, n.col, n.start, n.end, n.last_line))
        if (root := done[id(self)]) is None or root.type != self.type:
            raise TypeError("the root cannot be removed or replaced by another type")
        return root


class Visitor:
    """Calls ``visit_<type>`` (``visit_Heading``), else ``default``, for each node in pre-order; ``result`` is what the walk gives."""

    def default(self, node: Node) -> None:
        """Any node without a method of its own."""

    def result(self) -> object:
        """The value of a finished walk."""
        return None

    def run(self, tree: Node) -> object:
        """Walk a tree."""
        for n in tree.walk():
            getattr(self, "visit_" + n.type, self.default)(n)
        return self.result()

