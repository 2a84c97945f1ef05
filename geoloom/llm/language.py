"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: every slot holds a mask with
one bit a language (a plane of 64 for each 64 languages), so that the AND of an
n-gram's slots returns all languages which contain it in one look-up.  A text
is scored by per-language popcounts over its n-grams, each corrected for the
false positives to expect from the filter's fill; the largest decides.

Learning counts the n-grams of the training rows per language, exactly, by
their 64-bit hashes.  A language has the n-grams that make up at least
``least_per_million`` of its own and that it uses about as often as the
language that uses them most.  These hashes, whole, enter the filter, which
gets ``slots_a_gram`` slots for each n-gram of the language that has most.

Bounds, as parameters: at most ``max_rows`` labelled rows a language are
fitted, chosen by hash of their id; the rate bounds the n-grams of a language
by ``10**6 / least_per_million``, and so the filter and what the driver sees.

Cases: null texts and texts without a letter are ``und`` with score 0; a text
none of whose n-grams is known gets the most frequent language with score 0;
ties go to the language first in code point order; without any training row
every text is ``und``; repeated rows get equal results; long texts are read
whole, batches are cut by bytes; of the table only doc_id, text and lang are
read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from geoloom.llm.common import fold_of, materialize, release
from geoloom.llm.words import giving_back, slices

NGRAMS = (3, 4)
HASHES = 2
SLOTS_A_GRAM = 16
MAX_ROWS = 20_000
#: Bytes of text worked on at once, and n-grams that a task gathers before it hands their counts on.
BATCH_BYTES, HELD_GRAMS = 1 << 18, 1 << 20
#: A language has an n-gram if it uses it at least so often against the language that does most.
SHARE = 0.34
#: ... and at least so often in a million n-grams.
LEAST_PER_MILLION = 4.0
_STRIDE = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """1 for every code point that is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of letters with word edges, the text each belongs to, and texts that have a letter."""
    codes = np.frombuffer("\0".join([" " + t.lower() + " " for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    owner = np.cumsum(codes == 0)
    known = letters()[codes]
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[known]] = True
    plain = np.where(known, codes, 1)  # whatever isn't a letter is an edge
    keep = known | np.concatenate([[True], known[:-1] | (owner[1:] != owner[:-1])])  # one edge for a run of them
    plain, owner = plain[keep].astype(np.uint64), owner[keep]
    hashes, owners = [], []
    for n in NGRAMS:
        if len(plain) < n:
            continue
        h = np.full(len(plain) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ plain[j : len(plain) - n + 1 + j]) * _STRIDE
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        for j in range(1, n - 1):
            inside &= plain[j : len(h) + j] != 1  # edges only at the ends
        hashes.append(h[inside])
        owners.append(owner[: len(h)][inside])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has_letter
    return np.concatenate(hashes), np.concatenate(owners), has_letter


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) * _STRIDE) >> np.uint64(64 - bits) for i in range(HASHES)]


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def count_grams(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, h, n): how often the rows of a language (its place in ``langs``) have the n-gram of hash ``h``."""

    def run(batches):
        index = {g: i for i, g in enumerate(langs)}
        held: dict[int, list] = {}
        size = 0

        def flush():
            for i, parts in held.items():
                h, n = _summed(*map(np.concatenate, zip(*parts)))
                for k in range(0, len(h), 1 << 16):
                    some = h[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.view(np.int64)), pa.array(n[k : k + (1 << 16)])], names=["lang", "h", "n"])

        for batch in giving_back(batches):
            for a, b in slices(batch.column(1), BATCH_BYTES):
                part = batch.slice(a, b - a)
                lang = np.array([index[g] for g in part.column(0).to_pylist()], np.int64)
                h, owner, _ = grams(part.column(1).to_pylist())
                of = lang[owner]
                for i in np.unique(of).tolist():
                    found, n = np.unique(h[of == i], return_counts=True)
                    held.setdefault(i, []).append((found, n))
                    size += len(found)
                if size >= HELD_GRAMS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return rows.select("lang", "text").mapInArrow(run, "lang int, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS, slots_a_gram: int = SLOTS_A_GRAM, share: float = SHARE, least_per_million: float = LEAST_PER_MILLION) -> dict:
    """Learn from (doc_id, text, lang) rows.  The model is a dict of languages, masks and false-positive rates."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return {"langs": [], "masks": None}
    limit = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, max_rows / totals[g])))])
    chosen = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < F.element_at(limit, F.col("lang")) * F.lit(1 << 20)
    counts = materialize(count_grams(rows.where(chosen), langs), "language-counts")
    whole = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    got = None
    if whole:
        of = F.create_map(*[x for i, n in whole.items() for x in (F.lit(i), F.lit(float(n)))])
        rated = counts.select("lang", "h", (F.col("n") / F.element_at(of, F.col("lang"))).alias("rate"))
        rated = rated.withColumn("most", F.max("rate").over(Window.partitionBy("h")))  # a row a language
        got = rated.where((F.col("rate") >= share * F.col("most")) & (F.col("rate") * 1e6 >= least_per_million)).select("lang", "h").toArrow()
    release(counts)
    lang = got["lang"].to_numpy() if got else np.zeros(0, np.int32)
    h = got["h"].to_numpy().view(np.uint64) if got else np.zeros(0, np.uint64)
    most_grams = int(np.bincount(lang, minlength=1).max())
    bits = max(10, int(slots_a_gram * most_grams).bit_length())
    masks = np.zeros((-(-len(langs) // 64), 1 << bits), np.uint64)
    for i in range(len(langs)):
        for s in slots(h[lang == i], bits):
            np.bitwise_or.at(masks[i // 64], s.astype(np.int64), np.uint64(1 << (i % 64)))
    fill = np.array([(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))])
    most = min(range(len(langs)), key=lambda i: (-totals[langs[i]], i))
    return {"langs": langs, "masks": masks, "false": fill**HASHES, "most": most, "bits": bits}


def languages_of(model: dict, h: np.ndarray) -> np.ndarray:
    """A mask of the languages that have each n-gram, a row for each 64 languages."""
    found = np.full((len(model["masks"]), len(h)), ~np.uint64(0))
    for s in slots(h, model["bits"]):
        found &= model["masks"][:, s.astype(np.int64)]
    return found


def classify(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    langs = model["langs"]
    texts = [t or "" for t in texts]
    h, owner, has_letter = grams(texts)
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    found = languages_of(model, h)
    total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    hits = np.stack([np.bincount(owner, (found[i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=len(texts)) for i in range(len(langs))])
    false = model["false"][:, None]
    true = np.clip((hits / total - false) / np.maximum(1 - false, 1e-9), 0, 1)
    best = true.argmax(axis=0)
    score = true.max(axis=0) / np.maximum(true.sum(axis=0), 1e-12)
    best = np.where(true.max(axis=0) > 0, best, model["most"])
    score = np.where(has_letter, np.clip(score, 0, 1), 0.0)
    return [langs[b] if ok else "und" for b, ok in zip(best, has_letter)], score


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score.  The model has a fixed size and goes out as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches):
        model = shared.value
        for batch in giving_back(batches):
            for a, b in slices(batch.column(len(keep)), BATCH_BYTES):
                part = batch.slice(a, b - a)
                langs, score = classify(model, part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, **bounds) -> DataFrame:
    """Fit on the rows outside the held-out fold, predict all: doc_id, held_out, lang_pred, score."""
    marked = docs.select("doc_id", "text", "lang", (fold_of(F.col("doc_id"), modulus) == held).alias("held_out"))
    model = fit(marked.where(~F.col("held_out")), **bounds)
    return predict(marked, model, keep=("doc_id", "held_out"))
