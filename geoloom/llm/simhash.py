"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is the majority of that bit over the XXH64 (seed 42) hashes
of a text's word shingles.  Fingerprints within ``radius`` bits are linked, and
documents get the smallest doc_id reachable.

Each distinct fingerprint is compared once, whatever its number of copies.
Its 64 bits are cut into ``blocks``; two fingerprints within the radius agree
on at least ``blocks - radius`` of them, so they meet in one of the buckets
keyed by that many blocks.  Inside a bucket fingerprints are stored vertically,
one word per bit and 64 fingerprints; a query is compared with 64 at a time by
adding difference bits, three planes at a step, in carry-save counters, and a
block of 64 is abandoned once all its counters exceed the radius.  A bucket
hands on a spanning forest of its links, not all pairs.  Buckets of more than
``tile`` fingerprints are cut into tiles, every two of which meet in a task of
their own, so a hot bucket is spread and nothing is dropped.

Choose ``blocks`` so that buckets stay small: 6 (15 tables of 21 bits) serves
to some 10^8 distinct fingerprints, 8 (70 tables of 32 bits) beyond.

Cases: null, empty and wordless texts have fingerprint zero and are linked
like any other; a text of fewer words than a shingle is one shingle; texts of
any length are read whole, batches are cut by bytes; rows with equal text or
equal id share a component; null ids never become a component's id unless it
holds no other, when it is null; repeated rows each get their row; of the table
only doc_id and text are read (``keep_one`` hands all columns on); an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.common import attach, materialize
from geoloom.llm.components import components
from geoloom.llm.words import giving_back, slices, text_buffer

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
TILE = 4096
#: Ids above stand for fingerprints all of whose rows have a null id.
NO_ID = 1 << 62
_ONE = np.uint64(1)


# ---- fingerprints


def shingle_digests(column: pa.Array, shingle: int, hashes: list) -> tuple[list[np.ndarray], np.ndarray]:
    """For each hash (bytes -> bytes) the digests of all shingles of all texts, one row each, and the number of shingles of each text."""
    data, at = text_buffer(column)
    raw, counts = data.tobytes(), []
    flat: list[list[bytes]] = [[] for _ in hashes]
    for a, b in zip(at[:-1], at[1:]):
        words = raw[a:b].lower().split()  # bytes: only A-Z change, only ASCII white space parts
        text = b" ".join(words)
        n = len(words)
        if n <= shingle:
            parts = [text] if n else []
        else:
            ends = list(accumulate(map(len, words), lambda x, y: x + y + 1))
            starts = [0, *(e + 1 for e in ends[: n - shingle])]
            parts = [text[s:e] for s, e in zip(starts, ends[shingle - 1 :])]
        for found, h in zip(flat, hashes):
            found.extend([h(x) for x in parts])
        counts.append(len(parts))
    return [np.frombuffer(b"".join(found), np.uint8).reshape(-1, len(h(b"")))[:, ::-1] for found, h in zip(flat, hashes)], np.array(counts, np.int64)


def majorities(digests: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Texts x 64-bit parts: bits set in over half of a text's digests, which come as little-endian bytes."""
    out = np.zeros((len(count), digests.shape[1] // 8), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        first = np.concatenate([[0], np.cumsum(count[some])[:-1]])
        votes = np.add.reduceat(np.unpackbits(digests, axis=1, bitorder="little"), first, axis=0, dtype=np.int32)
        major = (2 * votes > count[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)
    return out


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A uint64 a text."""
    return wide_fingerprints(column, shingle, (seed,), wide=False)[:, 0]


def wide_fingerprints(column: pa.Array, shingle: int, seeds: tuple[int, ...], wide: bool = True) -> np.ndarray:
    """Texts x 64-bit parts: one part a seed by XXH64, or two by 128-bit XXH3 where ``wide``."""
    from xxhash import xxh3_128_digest, xxh64_digest

    digest = xxh3_128_digest if wide else xxh64_digest
    found, count = shingle_digests(column, shingle, [lambda x, s=s: digest(x, s) for s in seeds])
    return np.column_stack([majorities(np.ascontiguousarray(d), count) for d in found])


def columns_of(seeds: tuple[int, ...], wide: bool = False) -> list[str]:
    return [f"fp{i or ''}" for i in range(len(seeds) * (1 + wide))]


def fingerprint_documents(docs: DataFrame, shingle: int = SHINGLE, seeds: tuple[int, ...] = (SEED,), marked: bool = False, wide: bool = False) -> DataFrame:
    """doc_id, fp, fp1 ...: 64 bits a part, as signed longs; ``marked``: also mark, a hash of the text."""
    extra = ["mark"] if marked else []
    names = ["doc_id", *columns_of(seeds, wide), *extra]

    def run(batches):
        for batch in giving_back(batches):
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                prints = wide_fingerprints(part.column(1), shingle, seeds, wide)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in prints.T), *part.columns[2:]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.xxhash64("text").alias(c) for c in extra]).mapInArrow(run, ", ".join(f"{n} long" for n in names))


# ---- bit-sliced comparison


def _abandon(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            above |= equal & counter[k]
            equal &= ~counter[k]
    return above


def close_lanes(fp: np.ndarray, planes: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry (query ``fp`` against the 64 fingerprints of ``word``): the entries left and their lanes within the radius.

    ``fp`` is entries x 64-bit parts, ``planes`` bits x words; ``lanes`` the lanes to compare.
    """
    index = np.arange(len(fp))
    bits = max(2, (radius + 3).bit_length())
    counter = [np.zeros(len(fp), np.uint64) for _ in range(bits)]
    alive = lanes.copy()
    for b in range(0, len(planes), 3):
        d = [planes[k][word] ^ (np.uint64(0) - ((fp[:, k // 64] >> np.uint64(k % 64)) & _ONE)) for k in range(b, min(b + 3, len(planes)))]
        half = d[0] ^ d[1] if len(d) > 1 else d[0]
        if len(d) == 3:
            carry = [half ^ d[2], (d[0] & d[1]) | (d[2] & half)]
        else:
            carry = [half, d[0] & d[1] if len(d) == 2 else np.zeros_like(half)]
        ripple = np.zeros_like(alive)
        for k in range(bits):  # add the two-bit sum and ripple the carry
            x = carry[k] if k < 2 else np.zeros_like(alive)
            both = counter[k] ^ x
            ripple, counter[k] = (counter[k] & x) | (ripple & both), both ^ ripple
        alive &= ~_abandon(counter, radius)
        if b % 6 == 0 and len(alive):
            stay = alive != 0
            if stay.mean() < 0.7:
                fp, word, alive, index = fp[stay], word[stay], alive[stay], index[stay]
                counter = [c[stay] for c in counter]
    stay = alive != 0
    return index[stay], alive[stay]


def merge_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Union by least label, in place; ``label`` ends flat."""
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (flat := label[label]) is not None and (flat != label).any():
            label[:] = flat


def bucket_labels(fp: np.ndarray, bucket: np.ndarray, radius: int, entries: int = 1 << 16) -> np.ndarray:
    """Component label of each fingerprint (a row of 64-bit parts) among those of its bucket; ``bucket`` is sorted."""
    fp = fp.reshape(len(fp), -1)
    n = len(fp)
    label = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, size)
    words = -(-size // 64)
    base = np.concatenate([[0], np.cumsum(words)])
    word = np.repeat(base[:-1], size) + place // 64
    lane = (place % 64).astype(np.uint64)
    begin = np.flatnonzero(place % 64 == 0)
    valid = np.bitwise_or.reduceat(_ONE << lane, begin)
    planes = np.stack([np.bitwise_or.reduceat(((fp[:, b // 64] >> np.uint64(b % 64)) & _ONE) << lane, begin) for b in range(64 * fp.shape[1])])
    ahead = np.repeat(base[1:], size) - word  # words of the bucket from the own one on
    upto = np.concatenate([[0], np.cumsum(ahead)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + entries, "right")) - 1)
        count = ahead[at:to]
        query = np.repeat(np.arange(at, to), count)
        against = np.repeat(word[at:to], count) + np.arange(len(query)) - np.repeat(upto[at:to] - upto[at], count)
        own = against == word[query]
        later = np.where(lane[query] == 63, np.uint64(0), (~np.uint64(0)) << ((lane[query] + _ONE) & np.uint64(63)))
        lanes = np.where(own, later, ~np.uint64(0)) & valid[against]
        # a block whose fingerprints are all in the query's component already has nothing to add
        low, high = np.minimum.reduceat(label, begin), np.maximum.reduceat(label, begin)
        todo = (lanes != 0) & ~((low[against] == high[against]) & (low[against] == label[query]))
        query, against, lanes = query[todo], against[todo], lanes[todo]
        if len(query):
            left, found = close_lanes(fp[query], planes, against, lanes, radius)
            entry, which = np.nonzero(np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            merge_labels(label, query[left][entry], begin[against[left][entry]] + which)
        at = to
    return label


def forest(route: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least rep of the component, rep) of all buckets of sorted rows."""
    change = np.concatenate([[True], route[1:] != route[:-1], [True]])
    several = ~(change[:-1] & change[1:])
    if not several.any():
        return rep[:0], rep[:0]
    route, fp, rep = route[several], fp[several], rep[several]
    label = bucket_labels(np.ascontiguousarray(fp).view(np.uint64), route, radius)
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, label, rep)
    root = least[label]
    out = root != rep
    return root[out], rep[out]


def _forests(radius: int, rows: int = 150_000):
    def run(batches):
        held: list[list[np.ndarray]] = []
        count = 0

        def flush(last: bool):
            nonlocal held, count
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = len(cols[0])
            if not last:  # the last bucket may go on
                cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            held, count = [[c[cut:] for c in cols]], len(cols[0]) - cut
            route, rep, *fp = (c[:cut] for c in cols)
            a, b = forest(route, np.column_stack(fp), rep, radius) if cut else (rep, rep)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy() for k in range(batch.num_columns)])
                count += batch.num_rows
                if count >= rows:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``blocks - radius`` blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def sampled_masks(tables: int, key_bits: int, parts: int, seed: int = 7) -> list[list[int]]:
    """For each table a signed mask a 64-bit part; together they pick ``key_bits`` bits at random."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        picked = rng.choice(64 * parts, key_bits, replace=False).tolist()
        masks = [sum(1 << (b % 64) for b in picked if b // 64 == p) for p in range(parts)]
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def link(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE, tables: int | None = None, key_bits: int = 16) -> DataFrame:
    """(rep, fp, fp1 ...) with distinct fingerprints -> edges (a, b) between reps that span the links within the radius.

    Without ``tables`` the buckets are those of the pigeonhole and no link is
    missed.  With ``tables`` (for radii that the pigeonhole can't serve) they
    are keyed by so many samples of ``key_bits`` bits: a link at distance d is
    found with probability 1 - (1 - (1 - d / bits)^key_bits)^tables, nearly.
    """
    prints = [c for c in nodes.columns if c != "rep"]
    masks = [[m] for m in block_masks(blocks, radius)] if tables is None else sampled_masks(tables, key_bits, len(prints))
    keys = F.array(*[F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(m).cast("long")) for c, m in zip(prints, row)]) for t, row in enumerate(masks)])
    keyed = nodes.select("rep", *prints, F.explode(keys).alias("key"))
    hot = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile), "simhash-hot")
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(9), *prints), parts).cast("int")
    n_hot = hot.count()
    if n_hot:
        placed = attach(keyed, hot, "key", n_hot, "left")
        partner = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), parts - 1)))
        placed = placed.select("rep", *prints, "key", "n", mine.alias("mine"), partner.alias("other"))
        pair = F.xxhash64(F.col("key"), F.least("mine", "other"), F.greatest("mine", "other"))
        routed = placed.select(F.when(F.col("n").isNull(), F.col("key")).otherwise(pair).alias("route"), "rep", *prints)
    else:
        routed = keyed.select(F.col("key").alias("route"), "rep", *prints)
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(_forests(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE, seeds: tuple[int, ...] = (SEED,), tables: int | None = None, key_bits: int = 16) -> DataFrame:
    """doc_id, fp (signed long; fp1 ... for more seeds), component_id; one row a row of ``docs``."""
    names = columns_of(seeds)
    prints = materialize(fingerprint_documents(docs, shingle, seeds), "simhash-prints")
    alone = F.lit(NO_ID) + F.pmod(F.xxhash64(*names), F.lit(1 << 61))
    nodes = materialize(prints.groupBy(*names).agg(F.coalesce(F.min("doc_id"), alone).alias("rep")), "simhash-nodes")
    roots = components(link(nodes, radius, blocks, tile, tables, key_bits))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(*[F.col(c).alias(f"node_{c}") for c in names], F.coalesce("root", "rep").alias("component"))
    named = materialize(named, "simhash-named")
    on = [prints[c] == named[f"node_{c}"] for c in names]
    out = prints.join(named, on, "left")
    return out.select("doc_id", *names, F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE, seeds: tuple[int, ...] = (SEED,), tables: int | None = None, key_bits: int = 16, wide: bool = False) -> DataFrame:
    """``docs`` with one document of each group of linked texts: the one with the smallest id.

    Groups are told by fingerprints alone: texts that are not linked all stay,
    also where their ids are null or the same.  A group's document without an
    id is kept only if none has one; ties go by fingerprint, then by hash of
    the text, and of rows with equal id and text one is kept.
    """
    names = columns_of(seeds, wide)
    prints = materialize(fingerprint_documents(docs, shingle, seeds, True, wide), "simhash-prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *names, "mark")).alias("least")
    # numbers of fingerprints, not ids: rows that share an id are no link
    nodes = materialize(prints.groupBy(*names).agg(least).withColumn("rep", F.monotonically_increasing_id()), "simhash-nodes")
    roots = components(link(nodes.select("rep", *names), radius, blocks, tile, tables, key_bits))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(F.coalesce("root", "rep").alias("component"), "least")
    kept = named.groupBy("component").agg(F.min("least").alias("least")).select("least.*")
    # a null id as a value and a flag: joins by equal keys, which Spark can split where they are hot
    flat = lambda df: (F.coalesce(df["doc_id"], F.lit(0)).alias("__id"), df["doc_id"].isNull().alias("__none"), df["mark"].alias("__text"))
    again = prints.groupBy("doc_id", "mark").agg(F.count("*").alias("__rows")).where("__rows > 1")
    keys = ["__id", "__none", "__text"]
    kept = kept.select(*flat(kept)).join(again.select(*flat(again), "__rows"), keys, "left")
    kept = materialize(kept.select(*keys, (F.col("__rows") > 1).alias("__again")), "simhash-kept")
    id_ = F.col("doc_id").cast("long")
    keyed = docs.withColumns({"__id": F.coalesce(id_, F.lit(0).cast("long")), "__none": id_.isNull(), "__text": F.xxhash64("text")})
    once = keyed.join(kept.where("__again IS NULL"), keys, "left_semi").drop(*keys)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    plain = [f.name for f in docs.schema if f.dataType.typeName() != "map"]
    several = keyed.join(kept.where("__again"), keys, "left_semi").groupBy(*keys).agg(F.min_by(whole, F.xxhash64(*plain)).alias("row")).select("row.*")
    return once.unionByName(several)
