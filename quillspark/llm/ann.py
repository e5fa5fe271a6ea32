"""Operator 6: approximate nearest neighbours with learned partitions.

Fit, on a sample of vectors chosen by hashed id (a ``FIT_SHARE``-th of the table,
``SAMPLE`` at least and ``SAMPLE_MOST`` at most): a graph of each vector's
``GRAPH_K`` nearest neighbours is cut into balanced parts (growing from spread
seeds, then moving vertices to the part most of their neighbours are in while it
has room), and a softmax classifier with one hidden layer learns the parts from
the vectors. There is a part for every ``SLAB`` rows of the table, ``PARTS`` at
least and one for ``PART_SAMPLE`` sampled vectors at most, so a part does not grow
with the table until the sample's bound is reached.

Index: every vector goes to the classifier's most probable part. A part with more
than ``SLAB`` rows is dealt to slabs, so one part that holds a third of all
vectors is many tasks. Queries go to the most probable parts that reach
``probes`` and to all slabs there; each slab reranks by exact inner product in
double precision and returns its best; the best of all slabs are the result.

``probes`` is the smallest number of parts that finds ``RECALL`` of the true
neighbours of ``AUDIT`` queries among all rows of the table, by a full scan for
these queries; the audit can choose all parts, and ``Index.recall`` is what it
found. Equal vectors share a product to the last bit, since every
product is summed in the same order; of equal products smaller ids come first.

Defined results: vectors that are null, zero, of another length than the most
common one, or hold null or non-finite components, and rows without id, take no part as
query or candidate; with fewer candidates than asked all are returned; repeated rows are
candidates each, but an id is one query: of several vectors the smallest in array order
asks, and no row of its id is a candidate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import ship, stash, table

#: vectors of a fit (on the driver; with 64 components 4 MB at least, 17 MB at most)
SAMPLE, SAMPLE_MOST, FIT_SHARE = 8_192, 32_768, 64
#: queries of the audit
AUDIT = 256
GRAPH_K = 10
PARTS, PART_SAMPLE = 16, 32
HIDDEN = 64
SLAB = 8192
RECALL = 0.95


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with double components, of usable vectors of the most common length."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (size["size"] if size else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest product with each row, in blocks."""
    out = np.empty((len(x), min(k, max(len(x) - 1, 1))), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size that cut few edges of the graph."""
    n = len(x)
    room = int(np.ceil(slack * n / parts))
    seeds = [0]
    near = x @ x[0]
    for _ in range(parts - 1):  # seeds far from each other
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    want = x @ x[seeds].T
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    for v in np.argsort(-np.sort(want, 1)[:, -1], kind="stable"):
        for p in np.argsort(-want[v], kind="stable"):
            if size[p] < room:
                part[v], size[p] = p, size[p] + 1
                break
    both = np.concatenate([np.stack((np.repeat(np.arange(n), graph.shape[1]), graph.ravel()), 1), np.stack((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])), 1)])
    for _ in range(rounds):
        votes = np.bincount(both[:, 0] * parts + part[both[:, 1]], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < room:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v], moved = best[v], moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A softmax classifier with one hidden layer over unit vectors."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of the parts, a row for each row of x."""
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(u @ self.a + self.b, 0) @ self.c + self.d

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = HIDDEN, epochs: int = 30, seed: int = 3) -> Router:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(rows)), part[rows]] -= 1
                z /= len(rows)
                back = (z @ w[2].T) * (h > 0)
                t += 1
                for p, g, mm, vv in zip(w, (x[rows].T @ back, back.sum(0), h.T @ z, z.sum(0)), m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    p -= 0.01 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        return cls(*w)


def fit_router(x: np.ndarray, parts: int) -> Router:
    """The classifier of at most ``parts`` balanced parts of these vectors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = max(1, min(parts, len(x) // PART_SAMPLE))
    return Router.fit(x, balanced_parts(unit, neighbour_graph(unit, GRAPH_K), parts), parts)


def _distinct(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without equal vectors that cannot be among the k best: the smallest ids go first, one more for a query itself."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]).any(1)))
    nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return ids[nth <= k], x[nth <= k]


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """Exact k best of a slab for each query: (query, id, score) arrays."""
    out = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        own = q_ids[a : a + 256, None] == ids[None, :]
        s[own] = -np.inf
        m = min(k, len(ids))
        edge = np.partition(s, len(ids) - m, axis=1)[:, len(ids) - m]
        size = np.abs(edge[np.isfinite(edge)]).max(initial=1.0)
        row, col = np.nonzero((s >= (edge - 1e-9 * size)[:, None]) & np.isfinite(s))
        exact = (q[a : a + 256][row] * x[col]).sum(1)
        rank = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[rank], col[rank], exact[rank]
        start = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(s)))))
        top = np.arange(len(row)) - start[row] < k
        out.append((q_ids[a : a + 256][row[top]], ids[col[top]], exact[top]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Index:
    """Every vector with its part, and how many parts a query must probe for ``recall``."""

    router: Router
    rows: DataFrame
    parts: int
    probes: int
    recall: float


def _audit(router: Router, rows: DataFrame, asked: DataFrame, parts: int, k: int, recall: float) -> tuple[int, float]:
    """The probes that find ``recall`` of the true neighbours of some queries among all rows, and the share found."""
    # at most AUDIT vectors
    got = asked.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(AUDIT).collect()
    q_ids, q = np.array([r["id"] for r in got]), np.array([r["v"] for r in got])
    if not len(q):
        return parts, 1.0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)]
        for b in batches:
            if not b.num_rows:
                continue
            s = q @ _matrix(b.column(1)).T
            s[q_ids[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            row = np.repeat(np.arange(len(q)), top.shape[1])
            score = np.take_along_axis(s, top, 1).ravel()
            new = [row, b.column(0).to_numpy()[top.ravel()], score, b.column(2).to_numpy()[top.ravel()]]
            best = [np.concatenate(c) for c in zip(best, ([c[np.isfinite(score)] for c in new]))]
            order = np.lexsort((best[1], -best[2], best[0]))
            best = [c[order] for c in best]
            first = np.searchsorted(best[0], np.arange(len(q)))
            keep = np.arange(len(best[0])) - first[best[0]] < k
            best = [c[keep] for c in best]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["q", "id", "score", "part"])

    near = rows.mapInArrow(scan, "q bigint, id bigint, score double, part int")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    # at most AUDIT * k rows
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("q", "part").collect()
    if not near:
        return parts, 1.0
    rank = np.argsort(np.argsort(-router.scores(q), axis=1, kind="stable"), axis=1)  # when each part is probed
    needed = np.array([rank[r["q"], r["part"]] for r in near])
    probes = next((p for p in range(1, parts) if (needed < p).mean() >= recall), parts)
    return probes, float((needed < probes).mean())


def build(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", parts: int | None = None, sample: int | None = None, recall: float = RECALL) -> Index | None:
    """The index of all usable vectors; None if there are none."""
    ship(vectors.sparkSession)
    rows = stash(clean(vectors, key, vector).where("id is not null"), "vectors")
    n = rows.count()
    sample = sample or min(SAMPLE_MOST, max(SAMPLE, n // FIT_SHARE))
    if not n:
        return None
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    router = fit_router(_matrix(got.column(0).combine_chunks()), parts or max(PARTS, -(-n // SLAB)))
    parts = len(router.d)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.scores(_matrix(b.column(1))).argmax(1) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], names=["id", "v", "part"])

    rows = stash(rows.mapInArrow(place, "id bigint, v array<double>, part int"), "routed")
    probes, found = _audit(router, rows, rows.where(is_query), parts, k, recall)
    return Index(router, rows, parts, probes, found)


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    parts: int | None = None, slab: int = SLAB, sample: int | None = None, recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, key, score): the k nearest of each row that ``is_query``, a condition on ``id``."""
    spark = vectors.sparkSession
    index = build(vectors, is_query, k, key, vector, parts, sample, recall)
    if index is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, {key} bigint, score double")
    router, probes, rows = index.router, index.probes, index.rows

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = np.argsort(-router.scores(_matrix(b.column(1))), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "v", "probe"])

    sizes = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(slab))).cast("int").alias("slabs"))
    # one row per part: as many as the fit's sample allows at most
    sizes = F.broadcast(sizes)
    members = rows.join(sizes, "part").select("part", F.pmod(F.xxhash64("id"), F.col("slabs")).cast("int").alias("slab"), F.lit(0).alias("role"), "id", "v")
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(route, "id bigint, v array<double>, probe array<int>")
    queries = queries.select("id", "v", F.explode("probe").alias("part")).join(sizes, "part")
    queries = queries.select("part", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"), F.lit(1).alias("role"), "id", "v")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slab, members before queries; a slab's members and a batch of queries are held."""
        at, ids, xs, whole = None, [], [], None
        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
            cuts = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(1)))) if len(place) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(place)]):
                if at != (here := tuple(place[lo, :2])):
                    at, ids, xs, whole = here, [], [], None
                part = b.slice(lo, hi - lo)
                if place[lo, 2] == 0:
                    ids.append(part.column(3).to_numpy())
                    xs.append(_matrix(part.column(4)))
                elif ids:
                    whole = whole or _distinct(np.concatenate(ids), np.concatenate(xs), k)
                    found = _best(part.column(3).to_numpy(), _matrix(part.column(4)), *whole, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", key, "score"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (
        members.unionByName(queries).repartition(n, "part", "slab").sortWithinPartitions("part", "slab", "role", "id")
        .mapInArrow(rerank, f"query_id bigint, {key} bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
