"""Re-parsing after edits: per row, and as a stateful stream keyed by document.

An edit replaces ``edit_start`` to ``edit_end`` of the previous source by
``new_length`` characters of the new one. Top-level blocks that the edit overlaps
(else its neighbours) and the next ones up to a blank line are parsed again;
blocks before stay, blocks after move by the difference. Whatever makes that
doubtful - bad bounds, definitions, footnotes or open fences in the region, a
result whose last block reaches the region's end unfinished - leads to a full
parse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions.columns import DEFAULT
from quillspark.kernel.model import Node, Options, ParseError
from quillspark.kernel.render import HtmlRenderer
from quillspark.kernel.table import SPARK_TYPE, arrow_rows, parse

#: trees that a worker keeps between micro-batches
TREES = 256
_LAST: dict[int, tuple[tuple[int, str], Node, Options]] = {}
_SAFE = frozenset(("Paragraph", "Heading", "ThematicBreak"))


def shift(node: Node, chars: int, lines: int) -> None:
    """Move a subtree's places."""
    for n in node.walk():
        n.start, n.end = n.start + chars, n.end + chars
        n.line, n.last_line = n.line + lines, n.last_line + lines
        for k in ("source_start", "source_end"):
            if n.data.get(k) is not None:
                n.data[k] += chars


def affected(blocks: list[Node], start: int, end: int) -> tuple[int, int]:
    """First and last block that an edit touches; its neighbours if it touches none."""
    hit = [k for k, b in enumerate(blocks) if b.start <= end and b.end >= start]
    if hit:
        return hit[0], hit[-1]
    before = max((k for k, b in enumerate(blocks) if b.end < start), default=0)
    return before, min(before + 1, len(blocks) - 1)


@dataclass
class Region:
    """What takes the place of blocks ``first`` to ``last``, and how far the nodes in and after it move."""

    first: int
    last: int
    middle: Node
    chars: int
    lines: int
    tail_chars: int
    tail_lines: int


def reparsed(source: str, blocks: list[Node], edit_start: int, edit_end: int, new_length: int, options: Options = DEFAULT) -> Region | None:
    """The region around an edit, parsed; None where only a full parse is sure. Of the blocks type and place count, not what is in them."""
    delta = new_length - (edit_end - edit_start)
    old_length = len(source) - delta
    if not blocks or not 0 <= edit_start <= edit_end <= old_length or "]:" in source:
        return None
    a, b = affected(blocks, edit_start, edit_end)
    a, b = max(a - 1, 0), min(b + 1, len(blocks) - 1)
    while b < len(blocks) - 1 and blocks[b].type not in _SAFE:
        b += 1
    while a > 0 and blocks[a].type not in _SAFE:
        a -= 1
    if any(n.type not in _SAFE for n in (blocks[a], blocks[b])) and (a, b) != (0, len(blocks) - 1):
        return None
    start = blocks[a].start - (blocks[a].col - 1) if a else 0
    end = blocks[b + 1].start - (blocks[b + 1].col - 1) + delta if b + 1 < len(blocks) else len(source)
    if start > edit_start or end < edit_start + new_length or not 0 <= start <= end <= len(source):
        return None
    region = source[start:end]
    middle = parse(region, options)
    last = middle.children[-1] if middle.children else None
    if b + 1 < len(blocks) and (not region.endswith("\n\n") or last is None or last.type not in _SAFE):
        return None
    after = blocks[b + 1] if b + 1 < len(blocks) else None
    moved = source.count("\n", 0, after.start + delta) + 1 - after.line if after else 0
    return Region(a, b, middle, start, source.count("\n", 0, start), delta, moved)


def reparse(source: str, previous: Node, edit_start: int, edit_end: int, new_length: int, options: Options = DEFAULT) -> tuple[Node, bool]:
    """The new tree, and whether only a region was parsed."""
    blocks = previous.children
    r = reparsed(source, blocks, edit_start, edit_end, new_length, options)
    if r is None:
        return parse(source, options), False
    middle, tail = r.middle.children, blocks[r.last + 1 :]
    for n in middle:
        shift(n, r.chars, r.lines)
    for n in tail:
        shift(n, r.tail_chars, r.tail_lines)
    return Node("Document", [*blocks[: r.first], *middle, *tail], {}, 1, 1, 0, len(source), max([1, *(n.last_line for n in (*middle, *tail))])), True


_PLACES = ("first", "last", "chars", "lines", "tail_chars", "tail_lines")
_REGION = f"struct<whole:{SPARK_TYPE},middle:{SPARK_TYPE},{','.join(f'{c}:int' for c in _PLACES)}>"


@lru_cache(None)
def _regions(options: Options):
    @F.arrow_udf(_REGION)
    def run(source: pa.Array, kinds: pa.Array, starts: pa.Array, ends: pa.Array, cols: pa.Array, lines: pa.Array, edit_start: pa.Array, edit_end: pa.Array, length: pa.Array) -> pa.Array:
        whole, regions = [], []
        for s, *blocks, a, b, n in zip(*(c.to_pylist() for c in (source, kinds, starts, ends, cols, lines, edit_start, edit_end, length))):
            r = tree = None
            try:
                if s is not None and blocks[0] is not None and None not in (a, b, n):
                    r = reparsed(s, [Node(k, line=ln, col=c, start=x, end=y) for k, x, y, c, ln in zip(*blocks)], a, b, n, options)
                tree = parse(s, options) if s is not None and r is None else None
            except ParseError:
                r = tree = None
            whole.append(tree)
            regions.append(r)
        columns = [arrow_rows(whole), arrow_rows([r and r.middle for r in regions])]
        columns += [pa.array([getattr(r, c) if r else None for r in regions], pa.int32()) for c in _PLACES]
        return pa.StructArray.from_arrays(columns, names=["whole", "middle", *_PLACES])

    return run


def _moved(nodes: Column, **by: Column) -> Column:
    """Rows after so many more ids, top-level blocks, characters and lines before them.

    (The amounts stand beside every row: a lambda may not use what a Python function
    gives, and one in another may not use the outer's variable, if a Python function follows.)
    """

    def row(n: Column, m: Column) -> Column:
        places = {c: n[c] + m["chars"] for c in ("offset", "end_offset", "source_start", "source_end")} | {c: n[c] + m["lines"] for c in ("lineno", "end_lineno")}
        places |= {"id": n["id"] + m["ids"], "last": n["last"] + m["ids"], "parent": F.when(n["parent"] > 0, n["parent"] + m["ids"]).otherwise(n["parent"])}
        places |= {"ord": F.when(n["depth"] == 1, n["ord"] + m["blocks"]).otherwise(n["ord"]), "path": F.concat(F.array(F.get(n["path"], F.lit(0)) + m["blocks"]), F.slice(n["path"], F.lit(2), F.size(n["path"]) - 1))}
        for c, v in places.items():
            n = n.withField(c, v)
        return n

    return F.zip_with(nodes, F.array_repeat(F.struct(*[v.alias(k) for k, v in by.items()]), F.size(nodes)), row)


def parse_incremental(source: Column | str, previous: Column | str, edit_start: Column | str, edit_end: Column | str, new_length: Column | str, options: Options = DEFAULT) -> Column:
    """Nodes after an edit, from the new source and the nodes before it.

    Only the places of the top-level blocks go to Python and only the parsed region
    comes back; the other nodes are kept or moved by array functions.
    """
    source, previous = (F.col(c) if isinstance(c, str) else c for c in (source, previous))
    top = F.filter(previous, lambda n: n["depth"] == 1)
    field = lambda c: F.transform(top, lambda n: n[c])
    r = _regions(options)(source, field("type"), field("offset"), field("end_offset"), field("col"), field("lineno"), edit_start, edit_end, new_length)
    ids, tops = F.transform(previous, lambda n: n["id"]), field("id")
    begin, end, after = F.get(tops, r["first"]), F.get(field("last"), r["last"]), F.get(tops, r["last"] + 1)
    at, size = F.array_position(ids, begin).cast("int"), F.size(previous)
    rest = F.coalesce(F.array_position(ids, after).cast("int"), size + 1)
    fresh = F.filter(r["middle"], lambda n: n["depth"] > 0)
    more = F.size(fresh) - (end - begin + 1)
    blocks = F.size(F.filter(fresh, lambda n: n["depth"] == 1)) - (r["last"] - r["first"] + 1)
    middle = _moved(fresh, ids=begin - 1, blocks=r["first"], chars=r["chars"], lines=r["lines"])
    tail = _moved(F.slice(previous, rest, size - rest + 1), ids=more, blocks=blocks, chars=r["tail_chars"], lines=r["tail_lines"])
    lines = F.array_max(F.transform(F.filter(F.concat(middle, tail), lambda n: n["depth"] == 1), lambda n: n["end_lineno"]))
    root = F.element_at(previous, 1).withField("last", size - 1 + more).withField("end_offset", F.length(source)).withField("end_lineno", F.greatest(F.lit(1), lines))
    return F.when(r["first"].isNull(), r["whole"]).otherwise(F.concat(F.array(root), F.slice(previous, F.lit(2), at - 2), middle, tail))


def _edited(key: int, source: str, version: int, edits: pd.DataFrame, options: Options) -> tuple[str, int, str | None]:
    """Source, version and HTML of a document after newer edits, through the worker's tree of it if there is one."""
    held = _LAST.pop(key, None)
    tree = held[1] if held and held[0] == (version, source) and held[2] == options else None
    for r in edits.itertuples():
        if r.version > version:
            a, b = (min(max(int(x), 0), len(source)) for x in (r.edit_start, r.edit_end))
            b, more = max(a, b), r.inserted or ""
            source, version = source[:a] + more + source[b:], int(r.version)
            try:
                tree = tree and reparse(source, tree, a, b, len(more), options)[0]
            except ParseError:
                tree = None
    try:
        tree = tree or parse(source, options)
    except ParseError:
        return source, version, None
    _LAST[key] = ((version, source), tree, options)
    while len(_LAST) > TREES:
        del _LAST[next(iter(_LAST))]
    return source, version, HtmlRenderer(options).render(tree)


def apply_edits(edits: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """A stream of (doc_id, version, edit_start, edit_end, inserted) to (doc_id, version, source, html).

    State is a document's source; an edit of a document not seen before starts
    from the empty text. Edits of one micro-batch apply in order of version, and
    versions that are not newer than the state are ignored, so replays are safe.
    A worker keeps the trees of ``TREES`` documents that it saw last: an edit of one
    of them parses only the region around it. Elsewhere, as after the loss of an
    executor, the source in the state is parsed once.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source, version = state.get if state.exists else ("", -1)
        edits = pd.concat(list(frames)).sort_values("version")
        source, version, html = _edited(key[0], source, version, edits, options)
        state.update((source, version))
        yield pd.DataFrame({"doc_id": [key[0]], "version": [version], "source": [source], "html": [html]})

    return edits.groupBy("doc_id").applyInPandasWithState(
        step, "doc_id bigint, version bigint, source string, html string", "source string, version bigint", "update", GroupStateTimeout.NoTimeout
    )


def stream_unique(docs: DataFrame, event_time: str, delay: str = "1 hour", source: str = "source") -> DataFrame:
    """A stream without repeats of one content within the watermark: the parse cache of a stream."""
    return docs.withColumn("content_hash", F.sha2(F.col(source), 256)).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_hash"])
