"""Operator 5: quality scores learned from preference pairs (Bradley-Terry).

A document is a vector of shares and averages of its whole text. Of two labelled
documents the one marked 1 is preferred; the chance that ``a`` is preferred to
``b`` is the logistic of ``w . (f(a) - f(b))``, and ``w`` minimises the logistic
loss over pairs. The threshold is a quantile of the training scores, the one that
parts the labels best; scores are shifted so that it falls on ``THRESHOLD`` of
the logistic curve.

The fit uses every labelled id, with one row for each, that of the smallest text
hash. Rows are dealt by hash to blocks of ``BLOCK`` on average, and within its block each row
meets ``OPPONENTS`` drawn opponents; a label that is too rare for that stands in several
blocks. Newton steps sum gradients and curvatures over all blocks, scales, the threshold
and the slope come from all rows, and only sums, counts and a few scores come to the
driver. A fit of one block is that of ``fit``. Scoring is a single pass without a shuffle.

Defined results: a null or empty text has a zero vector and is scored like any
other; repeated rows get equal scores; a document labelled more than once counts
with the mean, and a mean of 0.5 or a null label not at all; without labels of
both kinds every score is 1 (nothing is rejected); an empty table gives no rows;
other columns pass through ``score_quality`` untouched.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.runtime import discard, ship, stash, table

from .tokens import release

THRESHOLD = 0.7
#: labelled rows of a block of comparisons on average, and rows of the rarer label at least
BLOCK, RARE = 4096, 256
#: opponents drawn for each row of the larger label of a block; the bound is beyond any block's pairs
OPPONENTS = 32
MAX_PAIRS = 200_000
#: pairs whose differences are held at once, and texts that are read from a batch at once
PART, TEXTS = 8192, 256
#: bits of the labelled ids' bitmap, as a power of two
BITS = 24
#: ids that a task remembers at most
HELD = 100_000
#: scores that come to the driver at once at most
SCORES = 20_000
HELD_OUT = 2

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:'\"-()", b"!", b"?", b"|", b"*#$%&@~^_=+<>/\\[]{}`", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _k
_KINDS = 12


def features(text: str | None) -> np.ndarray:
    """Shares of character kinds, lengths of words, sentences and lines, and repetition."""
    out = np.zeros(_KINDS + 14)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=_KINDS)
    out[:_KINDS] = np.sqrt(kinds / len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count, seen = Counter(words), Counter(lines)
    n = len(words)
    out[_KINDS:] = (
        1.0,
        np.log1p(n) / 10,
        len(raw) / n / 10,
        len(count) / n,
        count.most_common(1)[0][1] / n,
        sum(len(x) for x in count) / len(count) / 10,
        len(lines) / n,
        sum(len(k) * (v - 1) for k, v in seen.items()) / len(raw),
        max(map(len, lines)) / len(raw),
        (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / n,
        sum(x.isupper() for x in count) / len(count),
        sum(x[:1].isupper() for x in count) / len(count),
        sum(len(x) == 1 for x in words) / n,
        sum(not x[-1:].isalnum() and x[-1] < 128 for x in count) / len(count),
    )
    return out


def _features(texts: pa.Array) -> np.ndarray:
    """``features`` of a column, a row each; few of its texts are held as Python strings at a time."""
    out = np.zeros((len(texts), _KINDS + 14))
    for at in range(0, len(texts), TEXTS):
        for k, t in enumerate(texts.slice(at, TEXTS).to_pylist(), at):
            out[k] = features(t)
    return out


def _duels(x: np.ndarray, y: np.ndarray, scale: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """Differences of the drawn pairs of a block, ``PART`` at a time."""
    good, bad = x[y == 1], x[y == 0]
    rng = np.random.default_rng(seed)
    pairs = min(MAX_PAIRS, OPPONENTS * max(len(good), len(bad)))
    a, b = rng.integers(len(good), size=pairs), rng.integers(len(bad), size=pairs)
    for k in range(0, pairs, PART):
        yield (good[a[k : k + PART]] - bad[b[k : k + PART]]) / scale


def _slope(parts: Iterator[np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of the logistic loss's gradient and curvature over pairs, and how many there are."""
    grad, hess, n = np.zeros(len(w)), np.zeros((len(w), len(w))), 0
    for diff in parts:
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        grad -= (diff * p[:, None]).sum(0)
        hess += (diff * (p * (1 - p))[:, None]).T @ diff
        n += len(diff)
    return grad, hess, n


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]], size: int, ridge: float, steps: int) -> np.ndarray:
    """Weights of the least mean loss, by its sums at given weights."""
    w = np.zeros(size)
    for _ in range(steps):
        grad, hess, n = sums(w)
        step = np.linalg.solve(hess / n + ridge * np.eye(size), grad / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights, scales, threshold and slope of a Bradley-Terry fit of ``x`` by labels ``y``, as one block."""
    scale = np.maximum(x.std(0), 1e-9)
    w = _newton(lambda w: _slope(_duels(x, y, scale, seed), w), x.shape[1], ridge, steps)
    s = x @ (w / scale)
    # the quantile of the scores that parts the labels best, classes weighing the same
    order = np.argsort(s, kind="stable")
    s, y = s[order], y[order]
    hit = np.cumsum(y == 0) / (y == 0).sum() - np.cumsum(y == 1) / (y == 1).sum()
    best = np.flatnonzero(hit >= hit.max() - 1e-12)
    k = int(best[len(best) // 2])
    cut = (s[k] + s[min(k + 1, len(s) - 1)]) / 2
    spread = np.median(np.abs(s - cut))
    return w, scale, float(cut), float(2.0 / max(spread, 1e-9))


def _marked(docs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, x, y) of each labelled id that is not held out.

    Texts are not shuffled: a bitmap of the ids' hashes, of ``2 ** BITS`` bits, goes to the tasks, which
    make features of the rows that it marks; those few that it marks wrongly end in the join by id.
    """
    marked = labels.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("y")).where("y is not null and y != 0.5")
    marked = marked.where(F.crc32(F.col(key).cast("string").cast("binary")) % 4 != HELD_OUT).select(F.col(key).alias("id"), F.when(F.col("y") > 0.5, 1.0).otherwise(0.0).alias("y"))
    bit = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << BITS)).cast("int").alias("bit")
    known = np.zeros(1 << BITS, bool)
    known[marked.select(bit).distinct().toArrow().column(0).to_numpy()] = True
    known = np.packbits(known)
    rows = docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text")).select("id", bit, F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features; rows of an id that the task has met with a smaller text hash, or the same one, are passed over."""
        release()
        best: dict = {}
        for b in batches:
            bits, hashes, keep = b.column(1).to_numpy(), b.column(2).to_numpy(), []
            some = np.flatnonzero(known[bits >> 3] >> (7 - (bits & 7)) & 1)
            for k, i, h in zip(some.tolist(), b.column(0).take(pa.array(some)).to_pylist(), hashes[some].tolist()):
                if i not in best or h < best[i]:
                    if len(best) >= HELD:
                        best.clear()  # later rows may repeat an id; the smallest hash is taken below
                    best[i] = h
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            x = _features(b.column(3).take(at))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), x], names=["id", "h", "x"])

    schema = T.StructType([rows.schema["id"], T.StructField("h", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    one = rows.mapInArrow(run, schema).groupBy("id").agg(F.min(F.struct("h", "x")).alias("r"))
    return one.join(marked, "id").select("id", "r.x", "y")


def _arrays(rows: list | DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = sorted((tuple(r["x"]), r["y"]) for r in (rows.collect() if isinstance(rows, DataFrame) else rows))
    return np.array([r[0] for r in got]).reshape(len(got), _KINDS + 14), np.array([float(r[1]) for r in got])


def _train(docs: DataFrame, labels: DataFrame, key: str, label: str, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The labelled rows themselves, for tables that fit in memory; ``most`` must be as many as there are."""
    x, y = _arrays(_marked(docs, labels, key, label))
    if most is not None and len(y) > most:
        raise ValueError(f"{len(y)} labelled rows; score_quality fits any number")
    return x, y


def _kth(values: DataFrame, ranks: list[int]) -> list[float]:
    """The values of these ranks (from 0, near each other) of a column ``s``, ``n`` rows each, exactly: counts of ever smaller ranges, then a sort of what is left."""
    low, high, n = values.agg(F.min("s"), F.max("s"), F.count("s")).first()
    ranks, inside = list(ranks), values
    while n > SCORES and low < high:
        width = (high - low) / 1024
        bin = F.least(F.floor((F.col("s") - F.lit(low)) / F.lit(width)), F.lit(1023)).alias("b")
        got = sorted(tuple(r) for r in inside.groupBy(bin).agg(F.sum("n"), F.min("s"), F.max("s"), F.count("s")).collect())
        ends = np.cumsum([g[1] for g in got])
        a, b = (int(np.searchsorted(ends, r, "right")) for r in (min(ranks), max(ranks)))
        if b - a == len(got) - 1:
            break  # nothing is left out: few distinct values
        before = int(ends[a] - got[a][1])
        ranks = [r - before for r in ranks]
        low, high, n = got[a][2], got[b][3], sum(g[4] for g in got[a : b + 1])
        inside = values.where(F.col("s").between(low, high))
    counts = sorted((r["s"], r["n"]) for r in inside.groupBy("s").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([c[1] for c in counts])
    return [counts[int(np.searchsorted(ends, r, "right"))][0] for r in ranks]


def _cut(scores: DataFrame, goods: int, bads: int) -> tuple[float, float]:
    """Threshold and slope as in ``fit``, from all ``scores(s, y)``."""
    n = goods + bads
    # equal ones are one row; ranges of scores in order, a partition each; counts before a range make its places in the whole order
    parts = max(1, -(-n // 100_000))
    runs = scores.groupBy("s", "y").agg(F.count(F.lit(1)).alias("n"))
    ranged = stash(runs.repartitionByRange(parts, "s", "y").select(F.spark_partition_id().alias("p"), "s", "y", "n"), "scores")
    sizes = {r["p"]: (r["n"], int(r["g"])) for r in ranged.groupBy("p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("g")).collect()}
    before, at = {}, (0, 0)
    for p in sorted(sizes):
        before[p] = at
        at = (at[0] + sizes[p][0], at[1] + sizes[p][1])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the last rows of equal ones, the only ones where the best can be, and how well they part the labels."""
        rows = [b for b in batches if b.num_rows]
        if rows:
            p, s, y, n = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in range(4))
            for q in np.unique(p):
                mine = np.flatnonzero(p == q)
                mine = mine[np.lexsort((y[mine], s[mine]))]
                first, good = before[int(q)]
                upto, good = first + np.cumsum(n[mine]), good + np.cumsum(n[mine] * y[mine])
                yield upto - 1, (upto - good) / bads - good / goods

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hit in hits(batches):
            yield pa.RecordBatch.from_arrays([pa.array([hit.max()])], names=["hit"])

    one = ranged.repartition(parts, "p")
    most = one.mapInArrow(top, "hit double").agg(F.max("hit")).first()[0]

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, hit in hits(batches):
            yield pa.RecordBatch.from_arrays([pa.array(place[hit >= most - 1e-12], pa.int64())], names=["k"])

    best = sorted(r["k"] for r in one.mapInArrow(among, "k bigint").collect())
    k = best[len(best) // 2]
    cut = sum(_kth(ranged.select("s", "n"), [k, min(k + 1, n - 1)])) / 2
    spread = sum(_kth(ranged.select(F.abs(F.col("s") - F.lit(cut)).alias("s"), "n"), [(n - 1) // 2, n // 2])) / 2
    discard(ranged)
    return float(cut), float(2.0 / max(spread, 1e-9))


def fit_all(rows: DataFrame, seed: int = 7, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, float, float] | None:
    """``fit`` over any number of rows of ``rows(id, x, y)``; None without both labels."""
    rows = stash(rows, "labelled")
    got = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, goods = got[0], int(got[1] or 0)
    if not 0 < goods < n:
        discard(rows)
        return None
    blocks = -(-n // BLOCK)
    if blocks == 1:
        model = fit(*_arrays(rows), seed, ridge, steps)
        discard(rows)
        return model
    rare = int(goods < n - goods)
    copies = min(blocks, -(-RARE * blocks // min(goods, n - goods)))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count, mean and sum of squares about it, of each batch."""
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.mean(0).tolist()]), pa.array([((x - x.mean(0)) ** 2).sum(0).tolist()])], names=["n", "m", "q"])

    total, mean, square = 0, 0.0, 0.0
    for r in rows.select("x").mapInArrow(moments, "n bigint, m array<double>, q array<double>").collect():
        d = np.array(r["m"]) - mean
        mean, square = mean + d * r["n"] / (total + r["n"]), square + np.array(r["q"]) + d * d * total * r["n"] / (total + r["n"])
        total += r["n"]
    scale = np.maximum(np.sqrt(square / total), 1e-9)

    times = F.when(F.col("y") == rare, F.lit(copies)).otherwise(F.lit(1))
    place = F.pmod(F.xxhash64("id") + F.col("c"), F.lit(blocks)).cast("int").alias("block")
    dealt = rows.select("id", "x", "y", F.explode(F.sequence(F.lit(0), times - 1)).alias("c")).select(place, "x", "y")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per block; rows come sorted."""
        def flush() -> pa.RecordBatch:
            x, y = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.column_stack((y, x)).tobytes()], pa.binary())], names=["block", "rows"])

        at, held = None, []
        for b in batches:
            block = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(block)]):
                if at != block[lo]:
                    if held:
                        yield flush()
                    at, held = int(block[lo]), []
                part = b.slice(lo, hi - lo)
                held.append((part.column(1).flatten().to_numpy().reshape(hi - lo, -1), part.column(2).to_numpy()))
        if held:
            yield flush()

    packed = stash(dealt.repartitionByRange(blocks, "block").sortWithinPartitions("block", "y", "x").mapInArrow(pack, "block int, rows binary"), "duels")

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, blob in zip(b.column(0).to_pylist(), b.column(1)):
                    got = np.frombuffer(blob.as_buffer()).reshape(-1, len(w) + 1)
                    if 0 < got[:, 0].sum() < len(got):
                        grad, hess, n = _slope(_duels(got[:, 1:], got[:, 0], scale, seed + at), w)
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([grad.tolist()]), pa.array([hess.ravel().tolist()]), pa.array([n])], names=["block", "g", "h", "n"])

        got = sorted(tuple(r) for r in packed.mapInArrow(run, "block int, g array<double>, h array<double>, n bigint").collect())
        return sum(np.array(r[1]) for r in got), sum(np.array(r[2]) for r in got).reshape(len(w), -1), sum(r[3] for r in got)

    w = _newton(sums, len(scale), ridge, steps)
    weights = w / scale

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array((x * weights).sum(1)), b.column(1)], names=["s", "y"])

    cut, slope = _cut(rows.select("x", "y").mapInArrow(score, "s double, y double"), goods, n - goods)
    discard(packed)
    discard(rows)
    return w, scale, cut, slope


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``docs`` with ``quality_score`` in [0, 1] and ``quality_keep``; columns of those names are replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("quality_score", "quality_keep")
    model = fit_all(_marked(docs, labels, key, label))
    if model is not None:
        w, scale, cut, slope = model
        model = (w / scale, cut, slope)
    at, shift = docs.columns.index("text"), np.log(THRESHOLD / (1 - THRESHOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            if model is None:
                score = np.ones(b.num_rows)
            else:
                # a sum per row, so that equal texts have equal scores wherever they stand
                raw = (_features(b.column(at)) * model[0]).sum(1)
                score = 1 / (1 + np.exp(-np.clip((raw - model[1]) * model[2] + shift, -30, 30)))
            cols = [*b.columns, pa.array(score), pa.array(score >= THRESHOLD)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "quality_score", "quality_keep"])

    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_keep", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """A score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_quality(docs, table(spark, sf_dir, "labels"))
    return got.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_keep").cast("int").alias("predicted"),
    )
