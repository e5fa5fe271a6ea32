"""Operator 1: cost-balanced packing of token sequences.

A piece of ``n`` ids costs ``linear * n + quadratic * n * n`` (feed-forward work
and attention inside the piece). Documents longer than a sequence give full
sequences first; the rests and the short documents of a block are taken in
descending order of cost and go to the sequence of lowest cost that has room. A
piece that no sequence can hold whole is cut over those with room left. A block
is as many neighbouring documents of one input partition as hold
``block_tokens`` ids, so there is no shuffle, a task holds one block, and less
than one sequence per block is padding.

Defined results: a null text counts as empty and gives the single end id; a null
``doc_id`` stays null; equal rows are packed each on their own; an empty table
gives no rows; columns other than ``doc_id`` and ``text`` are ignored. A text of
any length is encoded whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.runtime import ship

from .tokens import encoder

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, cost double"
)


def pack_block(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Place documents of these lengths; (document, start, length, sequence, offset) per piece."""
    out, rest, seq = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((d, k * capacity, capacity, seq, 0))
            seq += 1
        if n % capacity:
            rest.append((n % capacity, d, full * capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    bins = -(-sum(r[0] for r in rest) // capacity)
    used = [0] * bins
    heap = [(0.0, b) for b in range(bins)]

    def put(d: int, start: int, n: int, cost: float, b: int) -> None:
        out.append((d, start, n, seq + b, used[b]))
        used[b] += n
        if used[b] < capacity:
            heapq.heappush(heap, (cost + linear * n + quadratic * n * n, b))

    for n, d, start in rest:
        passed = []
        while heap and capacity - used[heap[0][1]] < n:
            passed.append(heapq.heappop(heap))
        if heap:
            cost, b = heapq.heappop(heap)
            put(d, start, n, cost, b)
        else:  # no room for it whole: the passed sequences, cheapest first, take what they can
            while n:
                cost, b = passed.pop(0)
                m = min(n, capacity - used[b])
                put(d, start, m, cost, b)
                start, n = start + m, n - m
        for p in passed:
            heapq.heappush(heap, p)
    return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
    block_tokens: int = 2_000_000,
    special_as_text: bool = False,
) -> DataFrame:
    """Pack ``docs(doc_id, text)``; ``vocabulary`` is the path of the tokenizer's file.

    Its special tokens have their own ids where a text spells them, unless ``special_as_text``.
    """
    ship(docs.sparkSession)
    arrow = pa.schema([(c, pa.float64() if c == "cost" else pa.int64()) for c in SCHEMA.replace(",", "").split()[::2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, seq = encoder(vocabulary, special_as_text), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        raws: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            placed = pack_block([len(r) // 4 for r in raws], capacity, linear, quadratic)
            cols = [
                [ids[d] for d, *_ in placed],
                [s for _, s, *_ in placed],
                [n for _, _, n, *_ in placed],
                [zlib.crc32(memoryview(raws[d])[4 * s : 4 * (s + n)]) for d, s, n, *_ in placed],
                [len(raws[d]) // 4 for d, *_ in placed],
                [seq + q for *_, q, _ in placed],
                [o for *_, o in placed],
                [linear * n + quadratic * n * n for _, _, n, *_ in placed],
            ]
            seq += 1 + max((p[3] for p in placed), default=-1)
            ids.clear()
            raws.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = [t or "" for t in texts[at : at + 256].to_pylist()]
                for i, raw in zip(names[at : at + 256].to_pylist(), enc.encode(part)):
                    ids.append(i)
                    raws.append(raw)
                    held += len(raw) // 4
                    if held >= block_tokens:
                        yield flush()
        if ids:
            yield flush()

    cols = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return cols.mapInArrow(run, SCHEMA)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    import public_tokenizers

    from quillspark.runtime import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
