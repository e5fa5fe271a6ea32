"""Operator 7: n-gram Jaccard self-join by token-combination prefixes.

Sets are 5-word shingles; two documents link when 100 * |A & B| >= 80 * |A | B|.
The method is exact (up to 64-bit hashes):

1. One pass gives each document the size and hash of its set (equal sets are one
   node from here on) and, per task, a summary of shingles that several sets
   hold. The merged summary names the frequent shingles.
2. Shingles are ordered: the others by hash, then the frequent ones. Of two
   similar sets of n and m shingles, the prefixes of n - ceil(.8 n) + k share at
   least k shingles. Sets send their extended prefixes to buckets; a bucket joins
   rare shingles singly and counts how many a pair shares, so a pair needs its
   whole combination of k to become a candidate. A shingle of more than
   ``RARE`` sets makes no pairs: it goes back to the sets' lists of common
   shingles; no combination is a key there: sets that share a leading one of those
   singly become a star (see ``_candidates``).
3. Components of candidates are the units of verification; a component of more
   than ``block`` sets is cut into classes of like size and those into blocks, and
   every two blocks of one class or of neighbouring ones are one unit: sets that
   link differ in size by a quarter at most. A unit indexes prefixes anew by its own frequencies: one shared rare shingle, or
   enough frequent ones, counted singly, makes a candidate, whose overlap is
   then counted. Sets already connected are not compared. Units give a spanning
   forest of the links, never all pairs.
4. Components of the forest are the classes.

Frequent shingles only steer the order, which may be any order; so the bound on
how many are sent to the tasks (``FREQUENT``) loses nothing.

Defined results: null and empty texts and texts of white space have size 0 and
are their own component; a null ``doc_id`` is carried, and is never a component's
smallest unless all are null; repeated rows fall into one class; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import ship, stash, table

from .components import components
from .shingles import set_hash, shingles
from .tokens import release

#: shingles of more sets than this are no longer joined singly
RARE = 16
#: at most so many frequent shingles are broadcast (2 MB)
FREQUENT = 1 << 18
#: bits of the broadcast filter of candidate sets: eight for each of them within these bounds (32 MB at most;
#: a filter that is too small lets more texts pass to the join that follows, and loses none)
FILTER_LEAST, FILTER_MOST = 1 << 20, 1 << 28
BLOCK = 512
#: a set that more than one row in so many holds is named by a broadcast
SHARE = 1024
#: sizes of a class span this factor, a little more than linked sets may differ by
CLASS = 1.2501
COMBINE = 3
#: shingles a task holds before it hands them on
_HELD = 500_000


def _ceil80(n):
    return (4 * n + 4) // 5


def _extra(n):
    """How far a prefix of a set of n is extended: the size of the combination."""
    return np.maximum(COMBINE, n // 20)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    release()
    for b in batches:
        for at in range(0, b.num_rows, 128):
            part = b.slice(at, 128)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                yield i, shingles(t)


def _repeated(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    tokens, count = np.unique(np.concatenate(held), return_counts=True)
    return tokens[count >= least], count[count >= least]


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: doc_id, size, set hash) and (kind 1: shingle, sets that hold it)."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64())])

    def rows(kind, ids, n, sig):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), kind, np.int32)), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.int64())],
            schema=schema,
        )

    def heavy(held):
        t, c = _repeated(held, 4)
        return rows(1, t.view(np.int64), c, np.zeros(len(t), np.int64))

    seen: set[int] = set()
    ids, ns, sigs, held, size = [], [], [], [], 0
    for i, s in _texts(batches):
        sig = set_hash(s)
        ids.append(i)
        ns.append(len(s))
        sigs.append(sig)
        if sig not in seen:
            seen.add(sig)
            held.append(s)
            size += len(s)
        if len(ids) >= 4096:
            yield rows(0, ids, ns, sigs)
            ids, ns, sigs = [], [], []
        if size >= 4 * _HELD:
            yield heavy(held)
            held, size = [], 0
            seen.clear()
    if ids:
        yield rows(0, ids, ns, sigs)
    yield heavy(held)


_ENTRIES = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("token", "row", "sig", "n", "hot")])


def _prefixes(frequent, buckets: int):
    """Tasks' prefix entries by bucket.

    A row holds a bucket's shingles, the set each belongs to as a number into the
    row's table of set hashes and sizes, and how many sets of the task hold a
    shingle that is hot there. Of a hot shingle one entry goes to its bucket, so
    that the bucket learns of it; all leave, for their sets, in rows of bucket -1.
    """

    def flush(tokens, lengths, sigs, ns):
        tok, who = np.concatenate(tokens), np.repeat(np.arange(len(lengths)), lengths)
        sig, n = np.array(sigs, np.int64), np.array(ns, np.int32)
        order = np.argsort(tok, kind="stable")
        tok, who = tok[order], who[order]
        first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        count = np.diff(np.append(first, len(tok)))
        each = np.repeat(count, count)
        hot = each > RARE
        none = b""
        if hot.any():
            yield -1, tok[hot].tobytes(), none, sig[who[hot]].tobytes(), n[who[hot]].tobytes(), none
        keep = ~hot
        keep[first] = True
        tok, who, each = tok[keep], who[keep], each[keep]
        to = ((tok * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        tok, who, each, to = tok[order], who[order], each[order], to[order].astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        for a, b in zip(cut, np.append(cut[1:], len(to))):
            own, row = np.unique(who[a:b], return_inverse=True)
            pos = np.flatnonzero(each[a:b] > RARE)
            marks = np.stack((pos, each[a:b][pos])).astype(np.int64)
            yield int(to[a]), tok[a:b].tobytes(), row.astype(np.uint16).tobytes(), sig[own].tobytes(), n[own].tobytes(), marks.tobytes()

    def batch(parts):
        cols = zip(*parts)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENTRIES)], schema=_ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(frequent.value, np.uint64)
        seen: set[int] = set()
        tokens, lengths, sigs, ns, size = [], [], [], [], 0
        for _, s in _texts(batches):
            n = len(s)
            if not n or (sig := set_hash(s)) in seen:
                continue
            seen.add(sig)
            length = min(n, n - _ceil80(n) + int(_extra(n)))
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                late = common[at] == s
                if late.any():
                    s = np.concatenate((s[~late], s[late]))
            tokens.append(s[:length].copy())
            lengths.append(length)
            sigs.append(sig)
            ns.append(n)
            size += length
            if size >= _HELD or len(sigs) >= 1 << 16:
                yield batch(list(flush(tokens, lengths, sigs, ns)))
                tokens, lengths, sigs, ns, size = [], [], [], [], 0
                seen.clear()
        if tokens:
            yield batch(list(flush(tokens, lengths, sigs, ns)))

    return run


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("shared", pa.int64()), ("need", pa.int64())])


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share rare shingles of these buckets; with need -1, the others as (set, shingle, size)."""

    def emit(a, b, shared, need):
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, shared, need)], schema=_PAIRS)

    def common(sig, tok, n):
        return emit(sig, tok.view(np.int64), n, np.full(len(sig), -1))

    got: list[list[np.ndarray]] = [[], [], [], []]
    for b in batches:
        for row in b.to_pylist():
            sig, n = np.frombuffer(row["sig"], np.int64), row["n"]
            if row["bucket"] < 0:
                yield common(sig, np.frombuffer(row["token"], np.uint64), np.frombuffer(n, np.int32))
                continue
            at = np.frombuffer(row["row"], np.uint16)
            sets = np.ones(len(at), np.int64)
            pos, times = np.frombuffer(row["hot"], np.int64).reshape(2, -1)
            sets[pos] = times
            for into, x in zip(got, (np.frombuffer(row["token"], np.uint64), sig[at], np.frombuffer(n, np.int32)[at], sets)):
                into.append(x)
    if not got[0]:
        return
    tok, sig, n, sets = (np.concatenate(x) for x in got)
    got.clear()
    order = np.lexsort((-sets, sig, tok))
    tok, sig, n, sets = tok[order], sig[order], n[order], sets[order]
    keep = np.concatenate(([True], (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])))
    tok, sig, n, sets = tok[keep], sig[keep], n[keep], sets[keep]
    first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
    count = np.diff(np.append(first, len(tok)))
    total = np.add.reduceat(sets, first)
    many = np.repeat(total > RARE, count) & (sets == 1)
    if many.any():
        yield common(sig[many], tok[many], n[many])
    left, right = [], []
    for size in range(2, RARE + 1):
        at = first[(count == size) & (total <= RARE)]
        if len(at):
            i, j = np.triu_indices(size, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        fits = 5 * low >= 4 * high
        a, b, low, high = a[fits], b[fits], low[fits], high[fits]
        if len(a):
            need = np.minimum(_extra(low), _ceil80(high))
            rows, shared = np.unique(np.stack((sig[a], sig[b], need), 1), axis=0, return_counts=True)
            for k in range(0, len(rows), 100_000):
                r = rows[k : k + 100_000]
                yield emit(r[:, 0], r[:, 1], shared[k : k + 100_000], r[:, 2])


def link_unit(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between these sets (positions), all compared exactly."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    by_size = np.argsort(size, kind="stable")
    who = np.repeat(np.arange(m), size[by_size])
    tok = np.concatenate([sets[i] for i in by_size])
    size = size[by_size]
    uniq, inv, df = np.unique(tok, return_inverse=True, return_counts=True)
    rank = np.empty(len(uniq), np.int64)
    rank[np.lexsort((uniq, df))] = np.arange(len(uniq))
    by_rank = np.sort(df)
    ranks = rank[inv]
    order = np.lexsort((ranks, who))
    ranks = ranks[order]
    start = np.concatenate(([0], np.cumsum(size)))
    length = np.minimum(size, size - _ceil80(size) + _extra(size))
    pos = np.arange(len(ranks)) - np.repeat(start[:-1], size)
    inside = (pos < np.repeat(length, size)) & (by_rank[ranks] > 1)
    p_rank, p_who = ranks[inside], who[inside]
    by_token = np.argsort(p_rank, kind="stable")
    posting, t_rank = p_who[by_token], p_rank[by_token]
    label, out = np.arange(m), []
    bounds = np.searchsorted(p_who, np.arange(m + 1))
    lo = np.searchsorted(t_rank, p_rank, "left")
    # entries of a posting ascend by set: those before the own entry are smaller sets
    own = np.empty(len(by_token), np.int64)
    own[by_token] = np.arange(len(by_token))
    common = by_rank[p_rank] > RARE
    for i in range(m):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            continue
        votes = np.zeros(m, np.int64)
        for is_common, weight in ((True, 1), (False, 1 << 20)):
            pick = np.flatnonzero(common[a:b] == is_common) + a
            spans = [posting[lo[k] : own[k]] for k in pick.tolist() if own[k] > lo[k]]
            if spans:
                votes += weight * np.bincount(np.concatenate(spans), minlength=m)
        need = np.minimum(np.minimum(_extra(size), _extra(size[i])), _ceil80(size[i]))
        cand = np.flatnonzero((votes >= need) & (5 * size >= 4 * size[i]) & (label != label[i]))
        mine = ranks[start[i] : start[i + 1]]
        for j in cand[np.argsort(-votes[cand], kind="stable")].tolist():
            if label[j] == label[i]:
                continue
            other = ranks[start[j] : start[j + 1]]
            at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
            both = int((mine[at] == other).sum())
            if 100 * both >= 80 * (len(mine) + len(other) - both):
                out.append((int(by_size[j]), int(by_size[i])))
                label[label == label[j]] = label[i]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the units in this partition, whose rows come sorted by unit."""
    from zstandard import ZstdDecompressor

    schema, unpack = pa.schema([("u", pa.int64()), ("v", pa.int64())]), ZstdDecompressor()
    unit, sigs, sets = None, [], []

    def flush():
        links = link_unit(sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([sigs[a] for a, _ in links], pa.int64()), pa.array([sigs[b] for _, b in links], pa.int64())], schema=schema
        )

    for b in batches:
        for at in range(b.num_rows):
            key = tuple(b.column(k)[at].as_py() for k in range(3))
            if key != unit:
                if sets:
                    yield flush()
                unit, sigs, sets = key, [], []
            sigs.append(b.column(3)[at].as_py())
            sets.append(shingles(unpack.decompress(b.column(4)[at].as_py()).decode("utf-8", "surrogatepass")))
    if sets:
        yield flush()


def _filter_of(sigs: DataFrame, size: int) -> bytes:
    """A bit per hashed set of ``sigs``; ``size`` bits, a power of two."""

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            x = b.column(0).to_numpy().astype(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(bits, (x >> np.uint64(3)).astype(np.int64), (1 << (x & np.uint64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in sigs.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def _texts_of(wanted):
    """Packed texts whose set passes the filter, once per set and task.

    A packed text is a third of the size of its shingles' hashes.
    """

    def run(batches):
        from zstandard import ZstdCompressor

        bits, seen, pack = np.frombuffer(wanted.value, np.uint8), set(), ZstdCompressor(level=1)
        mask = 8 * len(bits) - 1
        for b in batches:
            sigs, blobs = [], []
            for at in range(0, b.num_rows, 128):
                for t in b.column(0).slice(at, 128).to_pylist():
                    s = shingles(t)
                    if not len(s) or (sig := set_hash(s)) in seen or not bits[(sig & mask) >> 3] >> (sig & 7) & 1:
                        continue
                    seen.add(sig)
                    sigs.append(sig)
                    blobs.append(pack.compress(t.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(blobs, pa.binary())], names=["sig", "packed"])

    return run


def _candidates(found: DataFrame) -> DataFrame:
    """Edges (u, v) that connect every two sets with a whole combination in common.

    ``found`` has the pairs by rare shingles and the sets' common shingles. A pair
    counts with its rare shingles plus as many common ones as both sets could
    share. Of sets that share common shingles only, the lists of those must have
    a combination in common; by the prefix rule once more, they share one of the
    first ``length - need + 1``, and those make stars. The centres are written
    before they are joined, so that Spark can split the rows of a shingle that very
    many sets lead with.
    """
    pairs = found.where("need >= 0").groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
    lists = found.where("need < 0").groupBy(F.col("u").alias("sig")).agg(F.collect_set("v").alias("tokens"), F.max("shared").alias("n"))
    lists = stash(lists, "common")
    low = F.ceil(F.col("n") * F.lit(4) / F.lit(5)).cast("bigint")  # the smallest size a partner can have
    need = F.least(F.greatest(F.lit(COMBINE), F.floor(low / F.lit(20))), low)
    keys = lists.withColumn("more", F.size("tokens") - need + 1).where("more >= 1")
    keys = keys.select("sig", F.explode(F.slice(F.array_sort("tokens"), F.lit(1), F.col("more").cast("int"))).alias("token"))
    lead = stash(keys.groupBy("token").agg(F.min("sig").alias("lead")), "leads")
    stars = keys.join(lead, "token").where("sig != lead").select(F.col("sig").alias("u"), F.col("lead").alias("v")).distinct()
    count = lists.select("sig", F.size("tokens").alias("more"))
    mixed = (
        pairs.where("shared < need")
        .join(count.select(F.col("sig").alias("u"), F.col("more").alias("mu")), "u")
        .join(count.select(F.col("sig").alias("v"), F.col("more").alias("mv")), "v")
        .where(F.col("shared") + F.least("mu", "mv") >= F.col("need"))
    )
    return pairs.where("shared >= need").select("u", "v").unionByName(mixed.select("u", "v")).unionByName(stars)


def _units(near: DataFrame, block: int) -> DataFrame:
    """(sig, unit, a, b): the units that verify each set of ``near(sig, unit, like)``; (0, 0) is a whole component."""
    # only groups of more than a block need cutting: few rows, written first so that the joins know their size
    large = near.groupBy("unit").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > block).select("unit")
    cells = near.join(stash(large, "large"), "unit").groupBy("unit", "like").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("blocks"))
    cells = stash(cells, "cells")
    around = cells.select("unit", F.explode(F.array(F.col("like") - 1, "like", F.col("like") + 1)).alias("like"), F.struct(F.col("like").alias("c"), "blocks").alias("cell"))
    around = around.groupBy("unit", "like").agg(F.collect_list("cell").alias("cells"))
    cells = stash(cells.join(around, ["unit", "like"]), "cells")
    code = lambda c, h: (c + 1).cast("bigint") * F.lit(1 << 32) + h
    rows = near.join(cells, ["unit", "like"], "left").withColumn("own", F.when(F.col("blocks").isNotNull(), code(F.col("like"), F.pmod(F.xxhash64("sig"), F.col("blocks")))).otherwise(F.lit(0).cast("bigint")))
    reach = F.flatten(F.transform("cells", lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda h: code(x["c"], h))))
    other = F.filter(reach, lambda x: x != F.col("own"))
    rows = rows.withColumn("other", F.explode(F.when(F.size(other) > 0, other).otherwise(F.array("own"))))
    return rows.select("sig", "unit", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    census = stash(source.mapInArrow(_census, "kind int, id bigint, n bigint, sig bigint"), "census")
    nodes = census.where("kind = 0").select("id", "n", "sig")
    heavy = (
        census.where("kind = 1").groupBy("id").agg(F.sum("n").alias("sets")).where(F.col("sets") > RARE)
        .orderBy(F.desc("sets"), "id").limit(FREQUENT).select("id")
    )
    common = np.array([r[0] for r in heavy.toLocalIterator()], np.int64).view(np.uint64)
    common.sort()
    entries = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // (4 * _HELD) + 1)
    to_tasks = sc.broadcast(common.tobytes())
    parts = source.mapInArrow(_prefixes(to_tasks, buckets), "bucket int, token binary, row binary, sig binary, n binary, hot binary")
    found = (
        parts.repartition(buckets, F.when(F.col("bucket") < 0, F.hash("sig")).otherwise(F.col("bucket")))
        .mapInArrow(_bucket_pairs, "u bigint, v bigint, shared bigint, need bigint")
    )
    near = components(_candidates(stash(found, "shared")), "candidates")
    size = nodes.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"))
    near = near.select(F.col("node").alias("sig"), F.col("component").alias("unit")).join(size, "sig")
    like = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(CLASS))).cast("int")
    near = stash(near.select("sig", "unit", like.alias("like")), "near")
    placed = _units(near, block)
    bits = 1 << max(FILTER_LEAST, min(FILTER_MOST, 8 * near.count())).bit_length() - 1
    wanted = sc.broadcast(_filter_of(near.select("sig"), bits))
    texts = source.select("text").mapInArrow(_texts_of(wanted), "sig bigint, packed binary")
    texts = texts.groupBy("sig").agg(F.first("packed").alias("packed"))
    units = placed.join(texts, "sig").select("unit", "a", "b", "sig", "packed")
    parts_of = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = (
        units.repartition(parts_of, "unit", "a", "b").sortWithinPartitions("unit", "a", "b", "sig").mapInArrow(_verify, "u bigint, v bigint")
    )
    found = components(links, "links")
    least = nodes.where("n > 0").groupBy("sig").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"))
    least = least.join(found.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    # written first: so the join is one of two plain shuffles, of which Spark can split a large class
    low = stash(least.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    named = stash(least.join(low, "component").select("sig", "rows", "component_id"), "named")
    # sets of more than a SHARE-th of all rows: fewer than SHARE of them, so their rows need not meet in one task
    hot = named.where(F.col("rows") * SHARE > F.lit(nodes.count())).select("sig", "component_id")
    some = nodes.where("n > 0")
    by_name = lambda df, component: df.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return (
        by_name(nodes.where("n = 0"), F.col("id"))
        .unionByName(by_name(some.join(F.broadcast(hot), "sig"), F.col("component_id")))
        .unionByName(by_name(some.join(F.broadcast(hot), "sig", "left_anti").join(named.select("sig", "component_id"), "sig"), F.col("component_id")))
    )


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """Classes of all documents that link at a Jaccard similarity of 0.8."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""with recursive w as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
    s as materialized (
        select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) end s from w),
    t as materialized (select doc_id, len(s) n, unnest(s) t from s),
    links as materialized (
        select a.doc_id a, b.doc_id b from t a join t b on a.t = b.t and a.doc_id <> b.doc_id
        group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach as (select doc_id a, doc_id b from documents union select r.a, l.b from reach r join links l on r.b = l.a),
    low as (select a, min(b) component_id from reach group by a)
    select doc_id, len(s)::bigint n_shingles, component_id from s join low on low.a = doc_id"""
