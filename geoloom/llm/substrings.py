"""Removal of word sequences that an earlier document has, by prefix-partitioned suffix trees.

Every window of ``length`` words is the head of a suffix.  Suffixes are split
by variable-length prefixes into groups that fit into memory: a first pass
counts them by a short code of their first words; a code path that holds too
many is extended by another word, small neighbours are put together, and a
path that is too heavy at its full length goes on by the words below it, told
by their digest, so that no prefix, however hot, makes a group too large.  A
group's suffixes are ordered by their leading ``length`` words; a run of equal
ones is an internal node at that depth, the head of a maximal repeat, and all
its suffixes but those of the smallest document are repeats.
``maximal_repeats`` follows the nodes along the texts.

Groups are worked off in ``rounds``, so that only a part of all suffixes is on
disk at a time.  What travels is a digest and a place for each suffix, not its
words, in compressed column-wise blocks.  Each task first orders its own
suffixes and sends one document's of every node, the others being settled on
the spot; so a passage that a third of all documents share is as light as any
other.  Settled windows return to their documents as packed places, where they
become removed words.

A digest has 128 bits in two halves of unlike making: a polynomial and a
multilinear hash, the latter with keys drawn anew in every run, so that no text
can be made to collide; two unlike sequences are taken for equal with
probability 2**-64 at most even where the first half is equal.

Windows are judged on the input: removing one does not save another.

Cases: null and empty texts have no words; texts shorter than a window stay
whole; repeats inside one document count only if a smaller document has them
too; a null doc_id counts as larger than any other, and rows of one id never
remove each other's words; texts of any length are read whole; columns that
are not named in ``keep`` are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from geoloom.llm.common import free_shuffles, materialize
from geoloom.llm.words import Words, giving_back, keyed_sequences, mix, sequence_hashes, slices

LENGTH = 13
#: Suffixes a group may hold at most; a group is one task's memory.
GROUP_SUFFIXES = 2_000_000
#: Groups for each shuffle partition where the corpus is small, so that all tasks have some.
GROUPS_A_PARTITION = 4
#: Bits of the code that a word adds to a prefix, and words it may have.
WORD_BITS, PREFIX_WORDS = 6, 3
CODES = 1 << (WORD_BITS * PREFIX_WORDS)
#: Suffixes that a task gathers before it sends its blocks.
BLOCK_SUFFIXES = 1_500_000
#: Parts of all groups that are worked off one after another.
ROUNDS = 4
#: Words of the documents whose settled windows meet in one bucket.
BUCKET_WORDS = 1_000_000
NULL_ID = np.iinfo(np.int64).max


def prefix_codes(h: np.ndarray) -> np.ndarray:
    """Code of the first words of each suffix, the first word in the leading bits."""
    out = np.zeros(max(len(h) - PREFIX_WORDS + 1, 0), np.int64)
    for j in range(PREFIX_WORDS):
        out = (out << WORD_BITS) | (h[j : j + len(out)] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return out


def windows(column: pa.Array, length: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, their hashes, and the places where a window lies within one document."""
    w = Words(column)
    h = w.hashes()
    if len(h) < length:
        return w, h, np.zeros(0, np.int64)
    return w, h, np.flatnonzero(w.doc[: len(h) - length + 1] == w.doc[length - 1 :])


def count_prefixes(docs: DataFrame, length: int) -> np.ndarray:
    """Suffixes by prefix code; what reaches the driver is at most CODES sums, whatever the corpus."""

    def run(batches):
        counts = np.zeros(CODES, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                _, h, at = windows(batch.column(0).slice(a, b - a), length)
                if len(at):
                    counts += np.bincount(prefix_codes(h)[at], minlength=CODES)
        used = np.flatnonzero(counts)
        for k in range(0, len(used), 1 << 16):
            ids = used[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts[ids])], names=["code", "n"])

    got = docs.select("__text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CODES, np.int64)
    counts[got["code"].to_numpy()] = got["n"].to_numpy()
    return counts


def group_prefixes(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First group of every code and the number of its groups: a prefix is extended while it holds more than ``most``, light neighbours share a group."""
    group, parts = np.zeros(CODES, np.int32), np.ones(CODES, np.int32)
    state = {"id": 0, "load": 0}
    sums = np.concatenate([[0], np.cumsum(counts)])

    def place(start: int, span: int) -> None:
        n = int(sums[start + span] - sums[start])
        if n > most and span > 1:
            step = span >> WORD_BITS
            for k in range(1 << WORD_BITS):
                place(start + k * step, step)
            return
        if state["load"] and state["load"] + n > most:
            state["id"], state["load"] = state["id"] + 1, 0
        group[start : start + span] = state["id"]
        if n > most:  # a full-length prefix: the words below it part its suffixes
            parts[start] = -(-n // most)
            state["id"], state["load"] = state["id"] + int(parts[start]), 0
        else:
            state["load"] += n

    for k in range(1 << WORD_BITS):
        place(k * (CODES >> WORD_BITS), CODES >> WORD_BITS)
    return group, parts


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as compressed byte planes, which suits sorted and small values; sizes go in front."""
    import zstandard

    sizes = np.array([len(columns), *(len(c) for c in columns)], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(sizes + planes)


def _unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, count, 8)
    out, at = [], 8 + 8 * count
    for n, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of ascending values; the first is itself."""
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def _settle(key: np.ndarray, low: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes; which of them, in that order, come after a smaller document of their node; the first suffix of each one's node."""
    order = np.lexsort((rank, low, key))
    k, j, r = key[order], low[order], rank[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (j[1:] != j[:-1])])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    return order, r > r[first], order[first]


class _Plan:
    """How suffixes are grouped and told apart."""

    def __init__(self, length: int, group: np.ndarray, parts: np.ndarray, rounds: int, marked: bool, sources: bool, seed: int):
        self.length, self.group, self.parts, self.rounds = length, group, parts, rounds
        self.marked, self.sources, self.seed = marked, sources, seed

    def groups(self, codes: np.ndarray, low: np.ndarray) -> np.ndarray:
        return self.group[codes] + (low % self.parts[codes].astype(np.uint64)).astype(np.int32)


class _Chunk:
    """Suffixes of a round's groups that a task has gathered."""

    def __init__(self, plan: _Plan, turn: int):
        self.plan, self.turn = plan, turn
        self.ids, self.keys, self.lows, self.groups, self.docs, self.places = [], [], [], [], [], []
        self.rows = self.suffixes = 0

    def add(self, ids: np.ndarray, buckets: np.ndarray, texts: pa.Array) -> None:
        plan = self.plan
        w, h, at = windows(texts, plan.length)
        if len(at):
            low = keyed_sequences(w.keyed_hashes(plan.seed), plan.length, plan.seed)[at]
            of = plan.groups(prefix_codes(h)[at], low)
            mine = of % plan.rounds == self.turn
            at = at[mine]
            self.keys.append(sequence_hashes(h, plan.length)[at])
            self.lows.append(low[mine])
            self.groups.append(of[mine])
            self.docs.append((w.doc[at] + self.rows).astype(np.uint32))
            self.places.append((at - w.first[w.doc[at]]).astype(np.uint32))
            self.suffixes += len(at)
        marks = text_marks(w) if plan.marked else np.zeros(len(ids), np.int64)
        self.ids.append(np.column_stack([ids, marks, buckets]))
        self.rows += len(ids)

    def rows_out(self) -> pa.RecordBatch:
        """Blocks of unsettled suffixes by group (0 and up), settled places by bucket (-1 and down)."""
        if not self.suffixes:
            return _out([])
        ids = np.concatenate(self.ids)
        key, low, of, doc, place = map(np.concatenate, (self.keys, self.lows, self.groups, self.docs, self.places))
        order, repeat, first = _settle(key, low, np.unique(ids[:, 0], return_inverse=True)[1][doc])
        if self.plan.sources:  # a node's source is known for certain only where all its suffixes meet
            repeat[:] = False
        out = _places_out(ids, doc[order[repeat]], place[order[repeat]])
        keep = order[~repeat]
        keep = keep[np.argsort(of[keep], kind="stable")]
        cuts = np.flatnonzero(np.diff(of[keep], prepend=-1, append=-1))
        by_id = np.argsort(ids[:, 0], kind="stable")  # documents of a block go in order of their ids
        rank = np.empty(len(ids), np.uint32)
        rank[by_id] = np.arange(len(ids), dtype=np.uint32)
        for a, b in zip(cuts, cuts[1:]):
            part = keep[a:b]
            used, local = np.unique(rank[doc[part]], return_inverse=True)
            mine = ids[by_id[used]]
            payload = _pack(_steps(key[part]), low[part], local.astype(np.uint32), place[part], _steps(mine[:, 0]), mine[:, 1], mine[:, 2].astype(np.int32))
            out.append((int(of[part[0]]), payload))
        return _out(out)


def _out(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["grp", "payload"])


def _places_out(ids: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[tuple[int, bytes]]:
    """Settled windows, packed by bucket of their documents."""
    if not len(doc):
        return []
    bucket = ids[doc, 2]
    order = np.lexsort((place, doc, bucket))
    doc, place, bucket = doc[order], place[order], bucket[order]
    out = []
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:]):
        first = np.flatnonzero(np.diff(doc[a:b].astype(np.int64), prepend=-1))
        used = doc[a:b][first]
        counts = np.diff(np.append(first, b - a)).astype(np.uint32)
        out.append((-1 - int(bucket[a]), _pack(ids[used, 0], ids[used, 1], counts, place[a:b])))
    return out


def text_marks(w: Words) -> np.ndarray:
    """A signed 64-bit mark of each text, to tell rows of one id apart."""
    n = len(w.first) - 1
    out = np.zeros(n, np.int64)
    h = w.hashes()
    if len(h):
        some = np.flatnonzero(np.diff(w.first))
        weight = mix((np.arange(len(h)) - w.first[w.doc]).astype(np.uint64)) | np.uint64(1)
        out[some] = np.add.reduceat(h * weight, w.first[some]).view(np.int64)
    return out


def _tree(batches):
    """Rows come sorted by group; a group's suffixes are ordered together.

    Settled places of many groups are packed together, those of the rows that
    come settled pass through.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0
    for item in _subtrees(batches):
        if isinstance(item, pa.RecordBatch):
            yield item
            continue
        ids, doc, place, order, repeat, _ = item
        used, local = np.unique(doc[order[repeat]], return_inverse=True)
        found.append((ids[used], local, place[order[repeat]]))
        waiting += len(local)
        if waiting >= BLOCK_SUFFIXES:
            yield _out(_all_places(found))
            found, waiting = [], 0
    if found:
        yield _out(_all_places(found))


def _subtrees(batches):
    """What ``_nodes`` gives for every group, and rows that come settled."""
    held: list[bytes] = []
    at = None
    for batch in giving_back(batches):
        for g, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if g < 0:
                yield _out([(g, payload)])
                continue
            if g != at and held:
                yield _nodes(held)
                held = []
            at = g
            held.append(payload)
    if held:
        yield _nodes(held)


def _all_places(found: list) -> list[tuple[int, bytes]]:
    """One packing of the places of several groups; a document of several groups is one document."""
    ids = np.concatenate([f[0] for f in found])
    base = np.cumsum([0, *(len(f[0]) for f in found)])
    doc = np.concatenate([f[1] + b for f, b in zip(found, base)])
    place = np.concatenate([f[2] for f in found])
    unique, same = np.unique(ids, axis=0, return_inverse=True)
    return _places_out(unique, same.ravel()[doc], place) if len(doc) else []


def _nodes(held: list[bytes]) -> tuple[np.ndarray, ...]:
    """A group's documents, and of its suffixes: document, place, order, which are repeats, the first of each one's node."""
    keys, lows, docs, places, ids, base = [], [], [], [], [], 0
    for payload in held:
        k, j, d, p, doc_ids, marks, buckets = _unpack(payload, np.uint64, np.uint64, np.uint32, np.uint32, np.int64, np.int64, np.int32)
        keys.append(np.cumsum(k, dtype=np.uint64))
        lows.append(j)
        docs.append(d.astype(np.int64) + base)
        places.append(p)
        ids.append(np.column_stack([np.cumsum(doc_ids), marks, buckets]))
        base += len(doc_ids)
    ids = np.concatenate(ids)
    key, low, doc, place = map(np.concatenate, (keys, lows, docs, places))
    return ids, doc, place, *_settle(key, low, np.unique(ids[:, 0], return_inverse=True)[1][doc])


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("__id"), F.col("text").alias("__text"), *more)


def _prepared(docs: DataFrame, length: int, group_suffixes: int, rounds: int, sources: bool):
    """Documents with their buckets, a broadcast plan of groups, and the number of buckets."""
    spark = docs.sparkSession
    docs = _keyed(docs)
    counts = count_prefixes(docs, length)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = int(counts.sum()) // (GROUPS_A_PARTITION * rounds * partitions) + 1
    buckets = max(partitions, int(counts.sum()) // BUCKET_WORDS)
    marked = not docs.groupBy("__id").count().where("count > 1").isEmpty()
    plan = spark.sparkContext.broadcast(_Plan(length, *group_prefixes(counts, min(group_suffixes, spread)), rounds, marked, sources, secrets.randbits(63)))
    return docs.select("__id", F.pmod(F.xxhash64("__id"), F.lit(buckets)).alias("__bucket"), "__text"), plan, buckets


def _grouped(placed: DataFrame, plan, turn: int) -> DataFrame:
    """The suffixes of a round, dealt and sorted by group."""

    def gather(batches):
        chunk = _Chunk(plan.value, turn)
        for batch in giving_back(batches):
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                chunk.add(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2))
                if chunk.suffixes >= BLOCK_SUFFIXES:
                    yield chunk.rows_out()
                    chunk = _Chunk(plan.value, turn)
        yield chunk.rows_out()

    return placed.mapInArrow(gather, _KIND).repartition("grp").sortWithinPartitions("grp")


_KIND = "grp int, payload binary"


def repeated_places(docs: DataFrame, length: int = LENGTH, group_suffixes: int = GROUP_SUFFIXES, rounds: int = ROUNDS) -> tuple[DataFrame, int, bool]:
    """(bucket, payload) rows of windows that a smaller document has, the number of buckets, and whether ids clash."""
    spark = docs.sparkSession
    placed, plan, buckets = _prepared(docs, length, group_suffixes, rounds, False)
    found = None
    for turn in range(rounds):
        settled = _grouped(placed, plan, turn).mapInArrow(_tree, _KIND)
        part = materialize(settled.select((-1 - F.col("grp")).alias("bucket"), "payload"), "substrings-places")
        del settled
        free_shuffles(spark)
        found = part if found is None else found.unionByName(part)
    return found, buckets, plan.value.marked


def maximal_repeats(docs: DataFrame, length: int = LENGTH, group_suffixes: int = GROUP_SUFFIXES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, start, words, source_id, source_start: stretches of ``words`` (at least ``length``) words that stand in a smaller document.

    Every window is told by the first place in the smallest document that has
    it; windows that follow each other here and there are one repeat.  Of rows
    with one id, the places are those of either row.
    """
    placed, plan, _ = _prepared(docs, length, group_suffixes, rounds, True)

    def pairs(batches):
        for item in _subtrees(batches):
            if isinstance(item, pa.RecordBatch):
                continue
            ids, doc, place, order, repeat, first = item
            mine, theirs = order[repeat], first[repeat]
            for a in range(0, len(mine), 1 << 18):
                m, t = mine[a : a + (1 << 18)], theirs[a : a + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[m], 0]), pa.array(place[m].astype(np.int64)), pa.array(ids[doc[t], 0]), pa.array(place[t].astype(np.int64))], names=["doc_id", "place", "source_id", "source_place"])

    found = None
    for turn in range(rounds):
        part = materialize(_grouped(placed, plan, turn).mapInArrow(pairs, "doc_id long, place long, source_id long, source_place long"), "substrings-pairs")
        found = part if found is None else found.unionByName(part)
    # windows that go on are one stretch: their place less their source's stays, and places have no gap
    shift = (F.col("place") - F.col("source_place")).alias("shift")
    line = Window.partitionBy("doc_id", "source_id", "shift").orderBy("place")
    runs = found.distinct().select("doc_id", "place", "source_id", "source_place", shift).withColumn("run", F.col("place") - F.row_number().over(line))
    stretches = runs.groupBy("doc_id", "source_id", "shift", "run").agg(F.min("place").alias("start"), (F.count("*") + length - 1).alias("words"), F.min("source_place").alias("source_start"))
    return stretches.select(F.nullif("doc_id", F.lit(int(NULL_ID))).alias("doc_id"), "start", "words", "source_id", "source_start")


def covered(places: list[np.ndarray], n: int, length: int) -> np.ndarray:
    """Which of n words the windows at these places cover."""
    step = np.zeros(n + 1, np.int32)
    for p in places:
        p = p.astype(np.int64)
        np.add.at(step, p, 1)
        np.add.at(step, np.minimum(p + length, n), -1)
    return np.cumsum(step[:n]) > 0


def dedup_substrings(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), group_suffixes: int = GROUP_SUFFIXES, rounds: int = ROUNDS) -> DataFrame:
    """``keep`` columns, n_words, n_removed, kept_sha256 (of the kept words joined by spaces) and deduped (the text without them).

    ``deduped`` is the text itself where nothing goes; otherwise the bytes of
    removed words go, and of white space that stood between two of them.
    ``doc_id`` is among ``keep``.
    """
    places, buckets, marked = repeated_places(docs, length, group_suffixes, rounds)
    texts = _keyed(docs, *keep).select(F.pmod(F.xxhash64("__id"), F.lit(buckets)).cast("int").alias("__bucket"), F.lit(1).alias("__kind"), F.lit(None).cast("binary").alias("__payload"), "__id", "__text", *keep)
    both = texts.unionByName(places.select(F.col("bucket").cast("int").alias("__bucket"), F.lit(0).alias("__kind"), F.col("payload").alias("__payload")), allowMissingColumns=True)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_words long, n_removed long, kept_sha256 string, deduped string"

    def run(batches):
        at, known = None, {}
        for batch in giving_back(batches):
            kind, bucket = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (bucket[1:] != bucket[:-1]), [True]]))
            for a, b in zip(cuts, cuts[1:]):  # a bucket's places stand before its texts
                if bucket[a] != at:
                    at, known = bucket[a], {}
                if kind[a] == 0:
                    for payload in batch.column(2).slice(a, b - a).to_pylist():
                        ids, marks, counts, place = _unpack(payload, np.int64, np.int64, np.uint32, np.uint32)
                        for i, m, p in zip(ids.tolist(), marks.tolist(), np.split(place, np.cumsum(counts)[:-1])):
                            known.setdefault((i, m), []).append(p)
                    continue
                part = batch.slice(a, b - a)
                for x, y in slices(part.column(4)):
                    yield _cut(part.slice(x, y - x), known, marked, length, list(keep))

    return both.repartition("__bucket").sortWithinPartitions("__bucket", "__kind").mapInArrow(run, schema)


def _cut(part: pa.RecordBatch, known: dict, marked: bool, length: int, keep: list[str]) -> pa.RecordBatch:
    w = Words(part.column(4))
    ids = part.column(3).to_pylist()
    marks = text_marks(w).tolist() if marked else [0] * part.num_rows
    raw, null = w.data.tobytes(), part.column(4).is_null().to_pylist()
    n_words, n_removed, digests, texts = [], [], [], []
    for i in range(part.num_rows):
        a, b = int(w.first[i]), int(w.first[i + 1])
        text = raw[w.at[i] : w.at[i + 1]]
        places = known.get((ids[i], marks[i]))
        gone = covered(places, b - a, length) if places else None
        if gone is None or not gone.any():
            digests.append(hashlib.sha256(b" ".join(raw[s:e] for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist()))).hexdigest())
            texts.append(None if null[i] else text)
            n_removed.append(0)
        else:
            left = np.flatnonzero(~gone) + a
            digests.append(hashlib.sha256(b" ".join(raw[s:e] for s, e in zip(w.start[left].tolist(), w.end[left].tolist()))).hexdigest())
            n_removed.append(int(gone.sum()))
            # the white space after a kept word stays, one stretch a run of kept words
            new = np.flatnonzero(np.diff(left, prepend=-2) != 1)
            ends = np.append(new[1:], len(left))
            stretches = []
            for x, y in zip(new, ends):
                stop = int(w.end[left[y - 1]])
                after = int(w.start[left[y - 1] + 1]) if left[y - 1] + 1 < b else int(w.at[i + 1])
                stretches.append(raw[w.start[left[x]] : after if y < len(left) else stop])
            texts.append(b"".join(stretches))
        n_words.append(b - a)
    return pa.RecordBatch.from_arrays(
        [*part.columns[5 : 5 + len(keep)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array([t if t is None else t.decode("utf-8", "replace") for t in texts], pa.string())],
        names=[*keep, "n_words", "n_removed", "kept_sha256", "deduped"],
    )
