"""User handlers for directives, roles, icons and code, as registries and a column function."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quillspark.kernel import render
from quillspark.kernel.model import ContractError, Node, Options, ParseError, Visitor
from quillspark.kernel.table import SPARK_TYPE, arrow_rows, parse, trees_of
from quillspark.operators.trees import CONTRACTS, Contract

from .columns import DEFAULT

Directive = Callable[[render.HtmlRenderer, Node, str], str]
Role = Callable[[render.HtmlRenderer, Node], str]


@dataclass(frozen=True)
class Registry:
    """An immutable lookup of handlers by name; a second handler of one name is refused."""

    handlers: Mapping[str, Callable] = field(default_factory=dict)

    def register(self, *names: str, handler: Callable) -> Registry:
        """This registry and one more handler."""
        if not names or not callable(handler):
            raise TypeError("a handler needs a name and must be callable")
        if taken := [n for n in names if n in self.handlers]:
            raise ValueError(f"handlers are registered already: {', '.join(taken)}")
        return Registry({**self.handlers, **dict.fromkeys(names, handler)})

    def __contains__(self, name: str) -> bool:
        return name in self.handlers

    def __len__(self) -> int:
        return len(self.handlers)

    def get(self, name: str) -> Callable | None:
        """The handler of this name, if there is one."""
        return self.handlers.get(name)

    @property
    def names(self) -> list[str]:
        """The names, sorted."""
        return sorted(self.handlers)


DEFAULT_DIRECTIVES = Registry(render.DIRECTIVES)
DEFAULT_ROLES = Registry(render.ROLES)


def directive(*names: str) -> Callable[[Directive], Directive]:
    """Mark a function as the handler of these directives; ``registry_of`` collects such functions."""

    def mark(fn: Directive) -> Directive:
        fn.directive_names = names
        return fn

    return mark


def registry_of(*functions: Directive, base: Registry = DEFAULT_DIRECTIVES) -> Registry:
    """The base registry and the marked functions."""
    for fn in functions:
        base = base.register(*getattr(fn, "directive_names", ()), handler=fn)
    return base


@dataclass(frozen=True)
class DirectiveHandler:
    """A directive of one's own; each part that is None leaves the usual behaviour.

    ``parse(node, content)`` gives the node that takes the directive's place in
    the tree, with ``content`` its raw body; ``render(renderer, node, body)`` gives
    its HTML. ``options`` turns the raw options into values for ``node.data``
    (under ``typed``), ``contract`` is checked by ``contract_violations`` and, with
    ``strict``, while parsing. ``preserves_raw_content`` keeps the body under ``raw``.
    """

    names: tuple[str, ...]
    parse: Callable[[Node, str], Node] | None = None
    render: Directive | None = None
    options: Callable[[dict[str, str]], object] | None = None
    contract: Contract | None = None
    preserves_raw_content: bool = False


@dataclass(frozen=True)
class RoleHandler:
    """A role of one's own: ``parse(node)`` gives the node that takes its place, ``render(renderer, node)`` its HTML."""

    names: tuple[str, ...]
    parse: Callable[[Node], Node] | None = None
    render: Role | None = None


def raw_content(source: str, node: Node) -> str:
    """A directive's body as it stands in the source, without option lines and closing marks."""
    lines = source.split("\n")[node.line : node.last_line]
    colons = len(m[0]) if (m := re.match(r":+", source[node.start :])) else 0
    if lines and re.fullmatch(rf"\s*:{{{colons},}}(\{{/.*\}})?\s*", lines[-1]):
        lines.pop()
    while lines and (m := re.match(r"\s*:([\w-]+):", lines[0])) and m[1] in node.data["options"]:
        lines.pop(0)
    return "\n".join(lines)


@dataclass(frozen=True)
class Handlers:
    """What parsing and rendering call; sent to the executors with the query."""

    directives: Registry = DEFAULT_DIRECTIVES
    roles: Registry = DEFAULT_ROLES
    icons: Callable[[str], str | None] | None = None
    highlight: Callable[[str, str], str] | None = None
    text: Callable[[str], str] | None = None
    custom: tuple[DirectiveHandler, ...] = ()
    custom_roles: tuple[RoleHandler, ...] = ()
    strict: bool = False

    @property
    def names(self) -> list[str]:
        """Names of all directives, sorted."""
        return sorted({*self.directives.names, *(n for h in self.custom for n in h.names)})

    def contracts(self) -> dict[str, Contract]:
        """The usual contracts and those of the custom directives."""
        return CONTRACTS | {n: h.contract for h in self.custom if h.contract for n in h.names}

    def parse(self, source: str, options: Options = DEFAULT) -> Node:
        """The tree of a source: lines changed before they are read, directives built by their handlers."""
        tree = parse(source, options, self.text)
        by_name = {n: h for h in self.custom for n in h.names}
        roles = {n: h.parse for h in self.custom_roles if h.parse for n in h.names}
        if self.strict:
            self._check(tree)
        if not by_name and not roles:
            return tree

        def build(node: Node) -> Node:
            if node.type == "Role" and node.data["name"] in roles:
                return roles[node.data["name"]](node)
            handler = by_name.get(node.data["name"]) if node.type == "Directive" else None
            if handler is None:
                return node
            raw = raw_content(source, node)
            if handler.preserves_raw_content:
                node.data["raw"] = raw
            if handler.options:
                node.data["typed"] = handler.options(dict(node.data["options"]))
            return handler.parse(node, raw) if handler.parse else node

        return tree.transform(build)

    def _check(self, tree: Node) -> None:
        rules, todo = self.contracts(), [(tree, None)]
        while todo:
            node, around = todo.pop()
            if node.type == "Directive":
                name = node.data["name"]
                rule = rules.get(name)
                if rule and rule.requires_parent and around not in rule.requires_parent:
                    raise ContractError(name, f"must be inside: {', '.join(rule.requires_parent)}", node.line)
                around = name
            todo += [(c, around) for c in node.children]

    def render(self, tree: Node, options: Options = DEFAULT) -> str:
        """The HTML of a tree."""
        own, roles = ({n: h.render for h in hs if h.render for n in h.names} for hs in (self.custom, self.custom_roles))
        return render.HtmlRenderer(options, dict(self.directives.handlers) | own, dict(self.roles.handlers) | roles, self.icons, self.highlight).render(tree)

    def tree(self, source: str | None, options: Options) -> Node | None:
        """The tree of a source; None where it has none or breaks a limit or contract."""
        try:
            return None if source is None else self.parse(source, options)
        except (ParseError, ContractError):
            return None


def md_html_with(source: Column | str, handlers: Handlers, options: Options = DEFAULT) -> Column:
    """Parse and render with the given handlers; an error in a directive's handler fails the query."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        trees = (handlers.tree(s, options) for s in column.to_pylist())
        return pa.array([None if t is None else handlers.render(t, options) for t in trees], pa.string())

    return run(source)


def md_parse_with(source: Column | str, handlers: Handlers, options: Options = DEFAULT) -> Column:
    """The node table of each source, read with the given handlers; values that a handler adds to a node are not columns."""

    @F.arrow_udf(SPARK_TYPE)
    def run(column: pa.Array) -> pa.Array:
        return arrow_rows([handlers.tree(s, options) for s in column.to_pylist()])

    return run(source)


def transform_nodes(ast: Column | str, change: Callable[[Node], Node | None]) -> Column:
    """Nodes after ``change`` was applied to every one, children first: it may return another node, with a subtree of its own, or None."""

    @F.arrow_udf(SPARK_TYPE)
    def run(column: pa.Array) -> pa.Array:
        return arrow_rows([None if t is None else t.transform(change) for t in trees_of(column)])

    return run(ast)


def visit_nodes(ast: Column | str, visitor: Callable[[], Visitor], kind: str) -> Column:
    """What a fresh visitor gives for each document, as a column of the Spark type ``kind``."""
    arrow = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else visitor().run(t) for t in trees_of(column)], arrow)

    return run(ast)
