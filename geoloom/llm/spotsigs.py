"""Document fingerprints by SpotSigs.

A signature is an anchor (a very common word) with the chain of the next
content words after it; a document's fingerprint is its set of signatures, so
it follows the running prose and ignores lists, menus and marks around it.
Sets are compared by Jaccard similarity, pruned by length: sets whose lengths
alone rule the threshold out are never compared, and a comparison stops as soon
as the threshold is out of reach.  ``length_bounds`` parts lengths so that only
equal or neighbouring partitions can hold a pair; ``setjoin.set_classes`` joins
the fingerprints of a corpus that way.

Where no anchor is among the words just before (other languages, tables, the
head of a text) a content word is an anchor itself, so every text with a word
has a fingerprint.  Each signature depends on its neighbourhood only: what an
edit leaves alone keeps its signatures.

Cases: null, empty and wordless texts have the empty set, which is like itself
(1.0) and unlike all else (0.0); equal texts have equal fingerprints; long
texts are read whole and batches are cut by bytes; rows that share an id, and
those without one, follow each other by hash of the text, so that a hot id is
split like a range of ids; repeated rows are independent; columns other than
doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from geoloom.llm.words import giving_back, slices

# Very common function words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the of and to a in is that it was for on are as with his they be at this have from or by "
    "der die das und ist den von zu mit sich des auf für nicht ein eine als auch "
    "le la les de des et un une du en que qui dans pour par au aux "
    "el los las y del se con su al lo una".split()
)
CHAIN = 2
#: A content word without an anchor among so many words before it is an anchor itself.
SPARSE = 12
MARKS = re.compile(r"[^\w\s]+")
#: Bytes of text and rows whose results are gathered before they are handed on.
BATCH_BYTES, BATCH_ROWS = 1 << 19, 256


def signatures(text: str | None, chain: int = CHAIN, anchors: frozenset = ANCHORS) -> frozenset[int]:
    """The set of signature hashes."""
    words = MARKS.sub(" ", (text or "").lower()).split()
    content = [w for w in words if w not in anchors]
    found, at, last = set(), 0, -SPARSE - 1
    for i, w in enumerate(words):
        if w in anchors:
            last = i
        else:
            at += 1
            if i - last <= SPARSE:
                continue
        ahead = content[at : at + chain]
        if len(ahead) < chain:  # at the end of the content words
            ahead = words[i + 1 : i + chain + 1]
        found.add((w, *ahead, *[""] * (chain - len(ahead))))
    return frozenset(map(hash_chain, found))


def hash_chain(chain: tuple[str, ...]) -> int:
    """A signed 64-bit hash, the same on every machine."""
    return int.from_bytes(hashlib.blake2b("\0".join(chain).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def likeness(a: frozenset[int], b: frozenset[int], threshold: float = 0.0) -> float:
    """Jaccard similarity; 0.0 where it is below the threshold, found out as early as lengths and misses allow."""
    if not a and not b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short or len(short) < threshold * len(long):
        return 0.0
    if threshold <= 0:
        both = len(short & long)
        return both / (len(a) + len(b) - both)
    need = threshold / (1 + threshold) * (len(a) + len(b))
    missing = len(short) - need
    both = 0
    for x in short:
        if x in long:
            both += 1
        else:
            missing -= 1
            if missing < -1e-9:
                return 0.0
    found = both / (len(a) + len(b) - both)
    return found if found >= threshold else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the head of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def length_bounds(threshold: float, most: int) -> list[int]:
    """Partition bounds for set lengths: lengths of one partition and the next are the only ones within the threshold."""
    bounds, at = [1], 1
    while at <= most:
        at = max(at + 1, int(at / threshold) + 1)
        bounds.append(at)
    return bounds


def ranges(keyed: DataFrame, buckets: int, coarse: int = 256):
    """A column with the number of the range that a row lies in, descending by ``__key``, then by ``__h``.

    Keys are cut at up to ``coarse`` approximate quantiles and evenly between
    them, so the expression stays short however many ranges there are.  A key
    that fills several quantiles, and rows without an id, are cut by ``__h``.
    """
    coarse = max(1, min(coarse, buckets))
    fine = -(-buckets // coarse)
    known = F.when(F.col("doc_id").isNotNull(), F.col("__key"))
    got = keyed.agg(
        F.percentile_approx(known, [k / coarse for k in range(1, coarse)] or [0.5], 10_000).alias("c"), F.min(known).alias("lo"), F.max(known).alias("hi"), F.count("*").alias("n"), F.count("doc_id").alias("known")
    ).first()
    turned = F.lit(0.5) - F.col("__h").cast("double") / F.lit(2.0**64)  # descending hashes as 0 to 1
    part = lambda parts: F.least(F.floor(turned * parts), parts - 1).cast("long")
    lacking = got["n"] - got["known"]
    last = F.lit(buckets + coarse + 1).cast("long") * F.lit(buckets + 2) + part(F.lit(lacking * buckets // max(got["n"], 1) + 1))
    if got["lo"] is None:
        return last
    times = Counter(int(c) for c in got["c"][: coarse - 1])
    cuts = sorted(times, reverse=True)
    upper, lower = [got["hi"] + 1, *cuts], [*cuts, got["lo"]]
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    at = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c > F.col("__key"))) if cuts else F.lit(0)
    keyed_at = F.get(numbers(upper), at) - F.col("__key").cast("double")
    share = F.coalesce(F.try_divide(keyed_at, F.get(numbers(upper), at) - F.get(numbers(lower), at)), F.lit(0.0))
    number = at * F.lit(fine) + F.least(F.floor(share * F.lit(fine)), F.lit(fine - 1)).cast("int")
    hot = {c: m * fine for c, m in times.items() if m > 1}
    within = F.lit(0).cast("long")
    if hot:  # such a key is the lowest of its range
        parts = F.element_at(F.create_map(*[F.lit(x).cast("long") for c, m in hot.items() for x in (c, m)]), F.col("__key"))
        within = F.when(parts.isNotNull(), part(parts) + 1).otherwise(within)
    return F.when(F.col("doc_id").isNull(), last).otherwise(number.cast("long") * F.lit(buckets + 2) + within)


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt by ranges of doc_id, each range with the first row of the one below it at its end.

    Adds ``__key``, ``__h``, ``__bucket`` and ``__guest``; ranges descend, and
    only one row a range is sent twice.
    """
    lowest = F.lit(-(1 << 62))
    keyed = docs.withColumn("__key", F.greatest(F.coalesce(F.col("doc_id").cast("long"), lowest), lowest)).withColumn("__h", F.xxhash64("text"))
    keyed = keyed.withColumn("__bucket", ranges(keyed, buckets))
    heads = keyed.groupBy("__bucket").agg(F.max(F.struct("__key", "__h")).alias("__head"))  # a row a range
    line = Window.orderBy("__bucket")
    host = F.coalesce(F.lag("__bucket").over(line), F.max("__bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = F.broadcast(heads.select(F.col("__head.__key").alias("__k"), F.col("__head.__h").alias("__g"), host.alias("__host")))
    guests = keyed.join(heads, (keyed["__key"] == heads["__k"]) & (keyed["__h"] == heads["__g"]))
    first = F.row_number().over(Window.partitionBy("__key", "__h").orderBy("__h"))
    guests = guests.withColumn("__first", first).where("__first = 1").withColumn("__bucket", F.col("__host")).drop("__first", "__host", "__k", "__g")
    return keyed.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__guest", F.lit(1)))


def packed(found: frozenset[int]) -> np.ndarray:
    """Signatures in ascending order, eight bytes each."""
    return np.sort(np.fromiter(found, np.int64, len(found)))


def signature_sets(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, signatures (ascending array<long>); one row a row of ``docs``."""

    def run(batches):
        for batch in giving_back(batches):
            for a, b in slices(batch.column(1), BATCH_BYTES, BATCH_ROWS):
                part = batch.slice(a, b - a)
                found = [packed(signatures(t, chain)) for t in part.column(1).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, signatures array<long>")


def fingerprint_edits(docs: DataFrame, chain: int = CHAIN, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, signatures, edited_signatures (ascending array<long>), near_edited, near_next.

    The next document is the one with the next smaller doc_id (after the last,
    the first); rows of one id follow each other by hash of the text, descending.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_order(docs.select("doc_id", "text"), buckets)
    schema = "doc_id long, n_chars long, edited_sha256 string, signatures array<long>, edited_signatures array<long>, near_edited double, near_next double"

    def run(batches):
        out: list[tuple] = []
        gathered = 0
        before = None  # (bucket, doc_id, text, signatures, packed signatures) of the row that waits for its next one

        def pair(row, text, found):
            _, doc_id, own, mine, own_packed = row
            changed = edited(own, text)
            if changed == own:
                theirs, changed_packed = mine, own_packed
            else:
                theirs = signatures(changed, chain)
                changed_packed = packed(theirs)
            out.append((doc_id, len(own), hashlib.sha256(changed.encode()).hexdigest(), own_packed, changed_packed, likeness(mine, theirs), likeness(mine, found)))

        def flush():
            columns = list(zip(*out))
            out.clear()
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c))) for c in columns[3:5]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns[:3], _ARROW)), *lists, *(pa.array(c, pa.float64()) for c in columns[5:])], schema=_ARROW)

        for batch in giving_back(batches):
            for a, b in slices(batch.column(1), BATCH_BYTES, BATCH_ROWS):
                part = batch.slice(a, b - a)
                for doc_id, text, bucket, guest in zip(*(part.column(k).to_pylist() for k in range(4))):
                    text = text or ""
                    found = signatures(text, chain)
                    if before is not None and before[0] == bucket:
                        pair(before, text, found)
                        gathered += len(text)
                    before = None if guest else (bucket, doc_id, text, found, packed(found))
                if len(out) >= BATCH_ROWS or gathered >= BATCH_BYTES:
                    gathered = 0
                    if out:
                        yield flush()
        if out:
            yield flush()

    dealt = ordered.repartition("__bucket").sortWithinPartitions("__bucket", "__guest", F.desc("__key"), F.desc("__h"))
    return dealt.select(F.col("doc_id").cast("long"), "text", "__bucket", "__guest").mapInArrow(run, schema)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("signatures", pa.list_(pa.int64())), ("edited_signatures", pa.list_(pa.int64())), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
