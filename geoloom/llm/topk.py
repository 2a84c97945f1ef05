"""Exact top-k inner products by pivot-table elimination.

Vectors are lifted by one coordinate to a common norm, which turns the largest
inner product into the smallest distance.  A table of distances to pivots then
gives every candidate a lower bound, the maximum over pivots of
``|d(query, pivot) - d(candidate, pivot)|``; candidates are evaluated in the
order of their bounds until the next bound cannot reach the k-th score, so the
result is exact whatever the pivots.

Pivots come from a bounded sample, farthest first.  Queries go out in chunks of
bounded size; candidates stay where they lie and are read once a chunk.  A
first k-th score of every query comes from the sample, then from growing parts
of the table, so that a task starts with bounds that prune and hands on few
rows; within a task they tighten with every batch.

Cases: null vectors, and those with a null, NaN or infinite component, take no
part, nor do rows with a null id and vectors whose squared length is beyond
2**62, as their scores fit no long; vectors of unequal length are compared as
if the shorter ended in zeros; rows of the query's own id are its own; equal
rows of a query are one query, unlike rows of one id are queries of their own;
repeated candidates rank side by side; fewer candidates than k give what there
is; ties go to the smaller vec_id; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.common import materialize
from geoloom.llm.words import giving_back

K = 20
PIVOTS = 16
#: Vectors that pivots and the first bounds come from.
PIVOT_SAMPLE = 1000
#: Bytes of the queries that go out at once, four a component.
QUERY_BYTES = 16 << 20
#: Each pass over the candidates reads so many times the rows of the one before it; the last reads all.
GROWTH = 64
#: Components of a batch of candidates that are worked on at once.
BATCH_COMPONENTS = 1 << 19
MOST = 2.0**62


def scaled(embedding: Column, by: int = 64) -> Column:
    """floor(by * x) of every component as long; null where any is null or not finite, or the squares add up beyond a long."""
    wide = F.transform(embedding.cast("array<double>"), lambda x: x * F.lit(float(by)))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= F.lit(2.0**31)))
    whole = F.when(~bad, F.transform(wide, lambda x: F.floor(x).cast("long")))
    return F.when(square(whole) < MOST, whole)


def square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest first from the mean."""
    if not len(sample):
        return sample
    picked, gap = [], ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    for _ in range(min(n, len(sample))):
        i = int(gap.argmax())
        picked.append(i)
        gap = np.minimum(gap, ((sample - sample[i]) ** 2).sum(axis=1))
    return sample[picked]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, the shorter ones as if they ended in zeros."""
    n = min(a.shape[1], b.shape[1])
    return a[:, :n] @ b[:, :n].T


def lifted_distances(x: np.ndarray, pivots: np.ndarray, norm: float, lift: bool) -> np.ndarray:
    """Distances of vectors to pivots in the lifted space; pivots and queries lie at lift 0."""
    own = (x * x).sum(axis=1)[:, None]
    gap = own - 2 * products(x, pivots) + (pivots * pivots).sum(axis=1)[None, :]
    if lift:
        gap = gap + (norm - own)
    return np.sqrt(np.maximum(gap, 0))


def exact_kind(norm: float) -> type:
    """The type whose sums of products are exact up to ``norm`` (the largest squared length)."""
    return np.float32 if norm < 1 << 23 else np.float64 if norm < 1 << 52 else np.int64


def best_k(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best, in order of row, score descending, id."""
    order = np.lexsort((ids, -score, row))
    r = row[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[place < k]


def block_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, norm: float, k: int, floor: np.ndarray | None = None, together: int = 64, slab: int = 1024):
    """(query place, id, score) of each query's k best among the candidates that reach its ``floor``.

    ``together`` queries share the order of candidates: slabs go by the best
    bound that any of them has.  A pair whose bound is below its query's k-th
    score is out; when that holds for all pairs to come, the rest is skipped.
    """
    kind = exact_kind(norm)
    table = lifted_distances(x.astype(np.float64), pivots, norm, True).astype(np.float32).T
    xs, out = x.astype(kind), []
    for a in range(0, len(q), together):
        mine = q[a : a + together].astype(np.float64)
        to_pivots = lifted_distances(mine, pivots, norm, False).astype(np.float32)
        bound = np.zeros((len(mine), len(x)), np.float32)
        gap = np.empty_like(bound)
        for p in range(len(pivots)):
            np.subtract(table[p][None, :], to_pivots[:, p][:, None], out=gap)
            np.maximum(bound, np.abs(gap, out=gap), out=bound)
        # distance >= bound  <=>  score <= (|q|^2 + norm - bound^2) / 2; slack for rounding
        np.multiply(bound, bound, out=bound)
        reach = (((mine * mine).sum(axis=1) + norm) / 2 * (1 + 1e-5) + 0.5).astype(np.float32)[:, None] - bound / 2
        reach[ids[None, :] == q_ids[a : a + together][:, None]] = -np.inf
        top = reach.max(axis=0)
        order = np.argsort(-top, kind="stable")
        kth = np.full(len(mine), -np.inf) if floor is None else floor[a : a + together].copy()
        row, got_ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        for at in range(0, len(order), slab):
            part = order[at : at + slab]
            if top[part[0]] < kth.min() or top[part[0]] == -np.inf:
                break
            alive = reach[:, part] >= kth[:, None]
            alive &= reach[:, part] > -np.inf
            if not alive.any():
                continue
            s = products(q[a : a + together].astype(kind), xs[part])
            if at == 0 and len(part) > k:
                known = np.where(alive, s.astype(np.float64), -np.inf)
                kth = np.maximum(kth, np.partition(known, len(part) - k, axis=1)[:, len(part) - k])
            r, c = np.nonzero((s >= kth[:, None]) & alive)
            row, got_ids, score = np.concatenate([row, r]), np.concatenate([got_ids, ids[part[c]]]), np.concatenate([score, s[r, c]])
            keep = best_k(row, got_ids, score, k)
            row, got_ids, score = row[keep], got_ids[keep], score[keep]
            kth = np.maximum(kth, kth_of(row, score, k, len(mine)))
        out.append((row + a, got_ids, score))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def kth_of(row: np.ndarray, score: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th score of each of n rows, -inf where there are fewer; rows are in order, scores descend."""
    out = np.full(n, -np.inf)
    full = np.flatnonzero(np.bincount(row, minlength=n) >= k)
    out[full] = score[np.searchsorted(row, full) + k - 1]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of longs as rows of ``dim`` components, padded with zeros."""
    at = column.offsets.to_numpy()
    size = np.diff(at)
    flat = column.values.to_numpy()[at[0] : at[-1]]
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = flat
    return out


def _pieces(column: pa.Array):
    """(rows, matrix) of candidates of like length, few components at a time."""
    size = np.diff(column.offsets.to_numpy())
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        step = max(1, BATCH_COMPONENTS // max(int(dim), 1))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            yield some, _matrix(column if len(some) == len(column) else column.take(pa.array(some)), max(int(dim), 1))


def _scan(shared, k: int):
    """Best candidates of a task for a chunk of queries; bounds tighten from batch to batch."""

    def run(batches):
        q_ids, q, points, norm, floor = shared.value
        floor = floor.copy()
        row, got, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, exact_kind(norm))
        for batch in giving_back(batches):
            ids = batch.column(0).to_numpy()
            for some, x in _pieces(batch.column(1)):
                r, g, s = block_top(q_ids, q, ids[some], x, points, norm, k, floor)
                if not len(r):
                    continue
                row, got, score = np.concatenate([row, r]), np.concatenate([got, g]), np.concatenate([score, s])
                keep = best_k(row, got, score, k)
                row, got, score = row[keep], got[keep], score[keep]
                floor = np.maximum(floor, kth_of(row, score, k, len(q)))
        for a in range(0, len(row), 1 << 18):
            b = a + (1 << 18)
            yield pa.RecordBatch.from_arrays([pa.array(row[a:b]), pa.array(q_ids[row[a:b]]), pa.array(got[a:b]), pa.array(score[a:b].astype(np.int64))], names=["place", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, query_bytes: int = QUERY_BYTES, sample_rows: int = PIVOT_SAMPLE, growth: int = GROWTH) -> DataFrame:
    """(vec_id long, v array<long>) -> query_id, rank, vec_id, score: each query's k largest inner products."""
    spark = vectors.sparkSession
    ours = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    marked = vectors.where(ours).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
    marked = marked.where(square(F.col("v")) < MOST)
    rows = marked.select("vec_id", "v")
    facts = marked.agg(
        F.max(square(F.col("v"))).alias("norm"), F.max(F.size("v")).alias("dim"), F.max(F.when(F.col("asks"), F.size("v"))).alias("q_dim"), F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asking")
    ).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not facts["asking"]:
        return spark.createDataFrame([], result)
    q_dim, norm = max(facts["q_dim"], 1), facts["norm"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow().combine_chunks()
    some_ids, some = sample["vec_id"].to_numpy(), _matrix(_lists(sample["v"]), max(facts["dim"], 1))
    points = choose_pivots(some.astype(np.float64), pivots)
    chunks = -(-facts["asking"] * q_dim * 4 // query_bytes)
    asking = marked.where("asks").select("vec_id", "v").distinct() if chunks == 1 else marked.where("asks").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)))
    out = None
    for chunk in range(chunks):
        mine = asking if chunks == 1 else asking.where(F.col("chunk") == chunk).select("vec_id", "v").distinct()
        got = mine.toArrow().sort_by("vec_id").combine_chunks()  # about query_bytes at four bytes a component
        if not got.num_rows:
            continue
        q_ids, q = got["vec_id"].to_numpy(), _matrix(_lists(got["v"]), q_dim).astype(exact_kind(norm))
        r, _, s = block_top(q_ids, q, some_ids, some, points, norm, k)
        floor = kth_of(r, s, k, len(q))
        part = growth ** 3
        while part > 1:  # bounds from parts of the table that hold at least as much as the sample
            if facts["n"] // part >= sample_rows:
                shared = spark.sparkContext.broadcast((q_ids, q, points, norm, floor))
                best = _ranked(rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id", "v"), F.lit(part)) == 0).mapInArrow(_scan(shared, k), _FOUND), k)
                known = best.where(F.col("rank") == k).select("place", "score").toArrow()  # a row a query of the chunk
                at = known["place"].to_numpy()
                floor[at] = np.maximum(floor[at], known["score"].to_numpy())
                shared.unpersist()
            part //= growth
        shared = spark.sparkContext.broadcast((q_ids, q, points, norm, floor))
        best = _ranked(rows.mapInArrow(_scan(shared, k), _FOUND), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if chunks > 1:
            best = materialize(best, "topk")
            shared.unpersist()
        out = best if out is None else out.unionByName(best)
    return out


_FOUND = "place long, query_id long, vec_id long, score long"


def _lists(column: pa.ChunkedArray) -> pa.ListArray:
    whole = column.combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
