"""Questions about intervals of nodes that native array functions answer only in quadratic time.

Each function is one Arrow-batched pass, linear in the nodes: a document's nodes
come in pre-order, so the answer is a running maximum, a search in a sorted array
or a stack.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Values of all lists, the row that each is in, and the offsets of the lists."""
    lists = lists.cast(pa.list_(lists.type.value_type))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes), np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)


def _lists(offsets: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=like.is_null() if like.null_count else None)


@lru_cache(None)
def _outside():
    @F.arrow_udf("array<boolean>")
    def run(ids: pa.Array, last: pa.Array, picked: pa.Array) -> pa.Array:
        i, row, offsets = _rows(ids)
        end, flag = _rows(last)[0], _rows(picked)[0].astype(bool)
        base = row * (int(end.max(initial=0)) + 2)  # a row starts above all of the rows before it
        covered = np.maximum.accumulate(np.where(flag, end + 1, 0) + base) if len(i) else base
        return _lists(offsets, pa.array(i + base >= covered), ids)

    return run


def outside(ast: Column, picked: Column) -> Column:
    """For each node whether it and all above it are not ``picked``, an array of booleans."""
    return _outside()(F.transform(ast, lambda n: n["id"]), F.transform(ast, lambda n: n["last"]), picked)


@lru_cache(None)
def _sizes():
    @F.arrow_udf("array<int>")
    def run(ids: pa.Array, last: pa.Array) -> pa.Array:
        i, row, offsets = _rows(ids)
        end = _rows(last)[0]
        base = row * (int(end.max(initial=0)) + 2)
        upto = np.searchsorted(i + base, end + base, "right")
        return _lists(offsets, pa.array((upto - np.arange(len(i))).astype(np.int32)), ids)

    return run


def sizes(ast: Column) -> Column:
    """For each node how many places of the array its subtree takes."""
    return _sizes()(F.transform(ast, lambda n: n["id"]), F.transform(ast, lambda n: n["last"]))


_BLANK_END = "array<struct<line:int,kept:int,length:int,offset:int>>"
_BLANK_TYPE = pa.list_(pa.struct([(c, pa.int32()) for c in ("line", "kept", "length", "offset")]))


@lru_cache(None)
def _blank_ends():
    @F.arrow_udf(_BLANK_END)
    def run(source: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        def of(text: str | None, starts: list[int] | None, ends: list[int] | None) -> list[dict] | None:
            if text is None:
                return None
            out, at, spans, k = [], 0, sorted(zip(starts or (), ends or ())), 0
            reach = 0  # the last line of the code blocks that begin so far
            for number, line in enumerate(text.split("\n"), 1):
                while k < len(spans) and spans[k][0] <= number:
                    reach, k = max(reach, spans[k][1]), k + 1
                body = line.removesuffix("\r")
                kept = body.rstrip(" \t")
                if len(kept) < len(body) and number > reach:
                    out.append({"line": number, "kept": len(kept), "length": len(body), "offset": at})
                at += len(line) + 1
            return out

        return pa.array([of(*x) for x in zip(source.to_pylist(), first.to_pylist(), last.to_pylist())], _BLANK_TYPE)

    return run


def blank_ends(source: Column, code: Column) -> Column:
    """Lines that end in blanks and stand in none of the ``code`` nodes: number, length without and with them, offset."""
    return _blank_ends()(source, F.transform(code, lambda n: n["lineno"]), F.transform(code, lambda n: n["end_lineno"]))


_NEST = "array<struct<around:string,kids:array<string>>>"
_NEST_TYPE = pa.list_(pa.struct([("around", pa.string()), ("kids", pa.list_(pa.string()))]))


@lru_cache(None)
def _nesting():
    @F.arrow_udf(_NEST)
    def run(ids: pa.Array, last: pa.Array, parent: pa.Array, names: pa.Array) -> pa.Array:
        def of(i, e, p, n):
            if i is None:
                return None
            out, open_, at = [], [], {x: k for k, x in enumerate(i)}
            for k, x in enumerate(i):
                while open_ and e[open_[-1]] < x:
                    open_.pop()
                out.append({"around": n[open_[-1]] if open_ else None, "kids": []})
                open_.append(k)
                if p[k] in at:
                    out[at[p[k]]]["kids"].append(n[k])
            return out

        return pa.array([of(*x) for x in zip(ids.to_pylist(), last.to_pylist(), parent.to_pylist(), names.to_pylist())], _NEST_TYPE)

    return run


def nesting(nodes: Column) -> Column:
    """For each of these nodes (in pre-order) the name of the innermost of them around it, and the names of its direct children among them."""
    field = lambda c: F.transform(nodes, lambda n: n[c])
    return _nesting()(*map(field, ("id", "last", "parent", "name")))
