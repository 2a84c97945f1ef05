"""Classes of signature sets whose Jaccard similarity reaches a threshold.

Equal sets are one set first.  Lengths are parted so that only equal or
neighbouring partitions can hold a pair, and two sets can only be similar if
they share one of the rarest signatures of either (``n - ceil(t n) + 1`` of
them), so sets meet by (signature, length partition).  Which sets meet is
worked out on numbers of sets alone: what hangs together goes, each set once,
to one task, where sets are compared in order of length, pruned by lengths and
by misses, and sets that are in one class already are not compared.  Groups of
more than ``tile`` sets are cut into tiles, every two of which meet in a task
of their own, so a hot group is spread and no link is lost.

Signatures are compared as 32-bit tokens: a collision can only add likeness, a
two hundredth part of it with a chance of about 1 in 100,000 for a pair of sets
of a few hundred.  How rare a token is comes from ``CELLS`` counters.

Cases: the empty set is similar to itself only; a null id counts only where a
class has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.common import attach, free_shuffles, materialize, release
from geoloom.llm.components import components
from geoloom.llm.spotsigs import length_bounds, likeness
from geoloom.llm.words import giving_back, mix

CELLS = 1 << 20
TILE = 2048
LONGEST = 1 << 30


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].view(np.uint32), at - at[0]


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens.astype(np.uint64)) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def count_cells(nodes: DataFrame) -> np.ndarray:
    """Sets by cell of their tokens; what reaches the driver is at most CELLS sums."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            counts += np.bincount(_cell(_lists(batch.column(0))[0]), minlength=CELLS)
        used = np.flatnonzero(counts)
        for k in range(0, len(used), 1 << 16):
            ids = used[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts[ids])], names=["cell", "n"])

    got = nodes.select("tokens").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)


def prefix_size(n: int, threshold: float) -> int:
    """Of so many rarest tokens of a set of n, one is shared with any set that is similar."""
    return n - math.ceil(threshold * n - 1e-9) + 1 if n else 0


def routes_of(tokens: np.ndarray, counts: np.ndarray, threshold: float, bounds: list[int]) -> np.ndarray:
    """Hashes of (token, length partition) at which a set meets others; tokens that no other set has are left out."""
    n = len(tokens)
    seen = counts[_cell(tokens)]
    rare = np.lexsort((tokens, seen))[: prefix_size(n, threshold)]
    some = tokens[rare[seen[rare] > 1]].astype(np.uint64)
    part = bisect_right(bounds, n)
    return np.concatenate([mix((some << np.uint64(20)) ^ np.uint64(p)) for p in (part + 1, part)]).view(np.int64)


def links_of(sets: list[frozenset], reps: list[int], threshold: float) -> list[tuple[int, int]]:
    """Spanning links of the similar sets; each set meets those before it that share one of its rarest tokens here."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), reps[i]))
    seen: dict[int, int] = {}
    for s in sets:
        for x in s:
            seen[x] = seen.get(x, 0) + 1
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index: dict[int, dict[int, list[int]]] = {}  # token -> class when entered -> sets
    out = []
    for i in order:
        mine = sets[i]
        prefix = [x for x in sorted(mine, key=lambda x: (seen[x], x))[: prefix_size(len(mine), threshold)] if seen[x] > 1]
        least = threshold * len(mine) - 1e-9
        met: set[int] = set()
        for x in prefix:
            for head, members in index.get(x, {}).items():
                if find(head) == find(i):
                    continue
                for j in reversed(members):  # the longest first
                    if len(sets[j]) < least:
                        break
                    if j in met:
                        continue
                    met.add(j)
                    if likeness(sets[j], mine, threshold) > 0:
                        root[max(find(i), find(j))] = min(find(i), find(j))
                        out.append((reps[j], reps[i]))
                        break
        for x in prefix:
            index.setdefault(x, {}).setdefault(find(i), []).append(i)
    return out


def _linked(threshold: float):
    def run(batches):
        at, sets, reps = None, [], []

        def flush():
            found = links_of(sets, reps, threshold) if len(sets) > 1 else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in giving_back(batches):
            tokens, ends = _lists(batch.column(2))
            for k, (route, rep) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if route != at and sets:
                    yield flush()
                    sets, reps = [], []
                at = route
                sets.append(frozenset(tokens[ends[k] : ends[k + 1]].tolist()))
                reps.append(rep)
        if sets:
            yield flush()

    return run


def set_classes(sets: DataFrame, threshold: float = 0.8, tile: int = TILE) -> DataFrame:
    """(doc_id, signatures array<long>) -> h1, h2 (hashes of a set), class_id (smallest doc_id reachable over similar sets), class_sets."""
    spark = sets.sparkSession
    h1, h2 = set_keys("signatures")
    low = F.transform("signatures", lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.when(x.bitwiseAND(F.lit(0x80000000)) != 0, F.lit(1 << 32)).otherwise(F.lit(0))).cast("int"))
    keyed = sets.select(h1.alias("h1"), h2.alias("h2"), F.col("doc_id").cast("long").alias("doc_id"), F.array_distinct(low).alias("tokens"))
    nodes = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.any_value("tokens").alias("tokens"))
    nodes = materialize(nodes.withColumn("rep", F.monotonically_increasing_id()), "sets-nodes")
    free_shuffles(spark)
    counts = spark.sparkContext.broadcast(count_cells(nodes))
    bounds = length_bounds(threshold, LONGEST)

    def emit(batches):
        for batch in giving_back(batches):
            tokens, ends = _lists(batch.column(1))
            reps, routes = batch.column(0).to_numpy(), []
            for k in range(batch.num_rows):
                routes.append(routes_of(tokens[ends[k] : ends[k + 1]], counts.value, threshold, bounds))
            size = np.array([len(r) for r in routes])
            flat = np.concatenate(routes) if routes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(reps, size))], names=["route", "rep"])

    met = materialize(nodes.select("rep", "tokens").mapInArrow(emit, "route long, rep long"), "sets-routes")
    first = met.groupBy("route").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("route", "a")
    roots = components(met.join(first, "route").where("rep <> a").select("a", F.col("rep").alias("b")))
    release(met)
    together = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("rep", "tokens", F.coalesce("root", "rep").alias("group"))
    sizes = materialize(together.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "sets-groups")
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    placed = attach(together.select("rep", "tokens", "group"), sizes, "group", sizes.count())
    mine = F.pmod(F.xxhash64(F.lit(11), "rep"), parts).cast("int")
    placed = placed.select("rep", "tokens", "group", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    routed = placed.select(F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("route"), "rep", "tokens")
    links = routed.repartition("route").sortWithinPartitions("route").mapInArrow(_linked(threshold), "a long, b long").distinct()
    classes = components(links)
    named = nodes.select("h1", "h2", "least", "rep").join(classes, F.col("rep") == classes["node"], "left").select("h1", "h2", "least", F.coalesce("root", "rep").alias("class"))
    named = materialize(named, "sets-named")
    release(nodes)
    release(sizes)
    free_shuffles(spark)
    ids = named.groupBy("class").agg(F.min("least").alias("class_id"), F.count("*").alias("class_sets"))
    return named.join(ids, "class").select("h1", "h2", "class_id", "class_sets")


def set_keys(column: str):
    """Two hashes that tell a set of ascending signatures."""
    return F.xxhash64(column), F.xxhash64(F.lit(1), column)
