"""Toxicity by compression distance.

One zstandard dictionary is trained on windows of ordinary documents, another
on passages of toxic ones.  A text is cut into windows of a few words; each is
compressed under the ordinary dictionary and under the toxic one, and the
difference of the two lengths is compared with thresholds.  The shares of
windows that pass them are calibrated so that a score of ``cut`` is the best
threshold; calibration sees only texts that its dictionaries were not trained
on: each half of the rows is measured with dictionaries of the other half, and
those that score are then trained on both.

Toxic documents are mostly ordinary text, so the toxic dictionary is trained on
their passages (a word and its neighbours) around words that stand out in them
(``telling_heads``: heads of words whose log odds of document counts lie well
above their standard error).  What it learns is appended to the ordinary
dictionary, so that ordinary words cost the same under both.

Bounds, as parameters: at most ``rows_a_class`` labelled rows, and
``bytes_a_class`` bytes of text, of either class are fitted, weighted so that
the classes keep their shares among all labels; at most ``passages`` toxic
passages and ``ordinary_windows`` ordinary windows of these rows train the
dictionaries; the model is two dictionaries of fixed size and a few numbers.

Cases: null, empty and wordless texts have no window and get the lowest score
the calibration can give; without rows of both classes every score is 0; long
texts are read whole, batches are cut by bytes; rows with a null id count as
not held out by the id ''; repeated rows get equal scores; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.common import fold_of
from geoloom.llm.labelled import sample_labelled
from geoloom.llm.words import giving_back, slices

ROWS_A_CLASS = 5000
BYTES_A_CLASS = 48 << 20
WINDOW_WORDS = 6
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 4_096
#: What of the fitted rows trains the dictionaries, chosen at random.
PASSAGES, ORDINARY_WINDOWS = 30_000, 40_000
#: Words on either side of a telling one that belong to its passage.
AROUND = 1
THRESHOLDS = (3, 4, 5, 6)
HEADS = (4, 5, 6, 7)
LEVEL = 3
NOT_WORD = re.compile(r"\W+")


def window_list(text: str | None, n: int = WINDOW_WORDS) -> list[bytes]:
    words = words_of(text or "")
    return [f" {' '.join(words[i : i + n])} ".encode() for i in range(0, len(words), n)]


def heads(word: str) -> set[str]:
    """Leading parts of a word by which families of words are told."""
    return {word[:k] for k in HEADS if len(word) >= k}


def words_of(text: str) -> list[str]:
    return NOT_WORD.sub(" ", text.lower()).split()


def telling_heads(texts: list[str], toxic: np.ndarray, least: int = 5, least_odds: float = 2.0, least_z: float = 6.0) -> dict[str, float]:
    """Heads of words of toxic documents whose log odds stand well above their error, with the weight of each.

    Occurrences count once a neighbourhood (the word and those beside it), so
    that copies of one document do not make its rare words telling.  Three
    passes, each over the heads that the one before it left, keep memory small.
    """
    bad, plain = [t for t, y in zip(texts, toxic) if y], [t for t, y in zip(texts, toxic) if not y]
    seen: Counter = Counter()
    for text in bad:
        seen.update({h for w in set(words_of(text)) for h in heads(w)})
    seen = Counter({h: a for h, a in seen.items() if a >= least})
    usual: Counter = Counter()
    for text in plain:
        usual.update({h for w in set(words_of(text)) for h in heads(w)} & seen.keys())

    def odds(h: str, a: int) -> float:
        return math.log((a + 0.5) / (len(bad) + 1)) - math.log((usual[h] + 0.5) / (len(plain) + 1))

    around: dict[str, set] = {h: set() for h, a in seen.items() if odds(h, a) >= least_odds}
    for text in bad:
        words = words_of(text)
        for before, w, after in zip(["", *words], words, [*words[1:], ""]):
            for h in heads(w) & around.keys():
                around[h].add(hash((before, w, after)))
    found = {}
    for h, near in around.items():
        a = min(seen[h], len(near))
        if a >= least and odds(h, a) >= least_odds and odds(h, a) * math.sqrt(a) >= least_z:
            found[h] = a * len(h) ** 2
    return found


def _train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A zstandard dictionary; the samples themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:].ljust(8, b" ")


class Windows:
    """Compares window lengths under both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        def compressor(content: bytes):
            content = z.ZstdCompressionDict(content)
            content.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False, write_checksum=False).compress

        self.plain, self.toxic = compressor(ordinary), compressor(ordinary + toxic)  # what stands last is cheapest to refer to

    def features(self, text: str | None) -> list[float]:
        saved = [len(self.plain(w)) - len(self.toxic(w)) for w in window_list(text)]
        n = len(saved)
        if not n:
            return [0.0] * (2 * len(THRESHOLDS) + 2)
        passed = [sum(s >= t for s in saved) for t in THRESHOLDS]
        top = sorted(saved)[-max(1, n // 8) :]
        return [*(p / (n + 5) for p in passed), *(math.log1p(p) for p in passed), sum(top) / len(top) / 4, max(saved) / 8]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the best F1 of the weighted rows, midway to the next score below."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum((weight * y)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * y).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


def train_dictionaries(texts: list[str], toxic: np.ndarray, passages: int = PASSAGES, ordinary_windows: int = ORDINARY_WINDOWS) -> dict[str, bytes]:
    """The ordinary dictionary, and what the toxic one has beyond it."""
    telling = telling_heads(texts, toxic)
    rng = np.random.default_rng(11)
    bad: list[bytes] = []
    plain: list[bytes] = []
    for text, y in zip(texts, toxic):
        if not y:
            plain += window_list(text)
            continue
        words = words_of(text)
        for i, w in enumerate(words):
            if telling.keys() & heads(w):
                bad.append(f" {' '.join(words[max(0, i - AROUND) : i + AROUND + 1])} ".encode())
    if not bad:  # nothing stands out: all of the toxic text
        bad = [w for text, y in zip(texts, toxic) if y for w in window_list(text)]
    some = lambda rows, n: [rows[i] for i in rng.permutation(len(rows))[:n]]
    return {"ordinary": _train(some(plain, ordinary_windows), ORDINARY_BYTES, 64, 6), "toxic": _train(some(bad, passages), TOXIC_BYTES, 16, 6)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, cut: float = 0.7, rows_a_class: int = ROWS_A_CLASS, bytes_a_class: int = BYTES_A_CLASS, **bounds) -> dict | None:
    got = sample_labelled(docs, labels, label, modulus, held, rows_a_class, bytes_a_class).toPandas().sort_values("doc_id", kind="stable")
    y = got["label"].to_numpy(np.int64)
    texts = [t or "" for t in got["text"]]
    if len(set(y)) < 2:
        return None
    weight = got["weight"].to_numpy(np.float64)
    weight = weight / weight.mean()  # as much evidence as there are rows
    half = np.array([zlib.crc32(t.encode()) & 1 for t in texts])  # copies of a text lie in one half
    x = np.zeros((len(y), 2 * len(THRESHOLDS) + 2))
    for k in (0, 1):
        own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        if len(set(y[other])) < 2:
            other = np.arange(len(y))  # too few rows to part
        windows = Windows(**train_dictionaries([texts[i] for i in other], y[other], **bounds))
        for i in own:
            x[i] = windows.features(texts[i])
    centre = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - centre) ** 2, axis=0, weights=weight)) + 1e-9
    w = fit_logistic((x - centre) / scale, y, weight)
    raw = np.column_stack([(x - centre) / scale, np.ones(len(x))]) @ w
    shift = math.log(cut / (1 - cut)) - best_cut(raw, y, weight)
    return train_dictionaries(texts, y, **bounds) | {"centre": centre, "scale": scale, "weights": w, "shift": shift}


def score_texts(model: dict | None, windows: Windows | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.zeros(len(texts))
    x = (np.array([windows.features(t) for t in texts]) - model["centre"]) / model["scale"]
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ model["weights"] + model["shift"], -30, 30)))


def predict(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def run(batches):
        model = shared.value
        windows = model and Windows(model["ordinary"], model["toxic"])
        for batch in giving_back(batches):
            for a, b in slices(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(score_texts(model, windows, part.column(len(keep)).to_pylist()))], names=[*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, cut: float = 0.7, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, "toxic", modulus, held, cut, **bounds)
    marked = docs.select("doc_id", "text", (fold_of(F.col("doc_id"), modulus) == held).alias("held_out"))
    return predict(marked, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
