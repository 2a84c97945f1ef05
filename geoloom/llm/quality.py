"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words.  Every passage is
encoded (character classes, punctuation, word shapes, repetition), mapped to a
hidden representation h, and weighted by gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))``; the weighted sum of passages is
scored.  Only document labels are used: the weights learn which passages
matter.  Encoding is vectorised over the bytes of an Arrow batch.

Bounds, as parameters: at most ``rows_a_class`` labelled rows, and
``bytes_a_class`` bytes of text, of either class are fitted, on the driver, weighted so that the classes keep their shares among
all labels; the model is a few small matrices.

Cases: null, empty and wordless texts are a bag of one empty passage; without
rows of both classes every score is 0.5; long texts are read whole, batches are
cut by bytes; rows with a null id are never fitted; repeated rows get equal
scores; of the table only doc_id and text are read (``keep_good`` hands all
columns on).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.common import fold_of
from geoloom.llm.labelled import sample_labelled
from geoloom.llm.words import Words, giving_back, sequence_hashes, slices

ROWS_A_CLASS = 3000
BYTES_A_CLASS = 48 << 20
PASSAGE_WORDS = 64
HIDDEN = 24
EPOCHS = 160
#: 0 lower-case letter, 1 capital, 2 digit, 3 white space, 4 first byte of a longer character, 5 its other bytes, 6.. ASCII marks
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[:33] = 3
_CLASS[127] = 3
_CLASS[128:192] = 5
_CLASS[192:] = 4
_MARKS = [c for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)]
_CLASS[_MARKS] = np.arange(len(_MARKS)) + 6
CLASSES = 6 + len(_MARKS)
FEATURES = CLASSES + 9


def encode_passages(column: pa.Array, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, row of each passage); every row has one passage at least."""
    w = Words(column)
    n = len(column)
    count = np.diff(w.first)
    bags = np.maximum(-(-count // size), 1)
    begin = np.concatenate([[0], np.cumsum(bags)])
    rows, m = np.repeat(np.arange(n), bags), int(begin[-1])
    x = np.zeros((m, FEATURES), np.float32)
    if not len(w.start):
        return x, rows
    place = np.arange(len(w.start)) - w.first[w.doc]
    passage = begin[w.doc] + place // size
    # bytes belong to the passage of the last word begun before them
    first_word = np.flatnonzero(np.diff(passage, prepend=-1))
    cuts = w.start[first_word]
    byte_passage = np.repeat(passage[first_word], np.diff(np.append(cuts, len(w.data))))
    classes = np.bincount(byte_passage * CLASSES + _CLASS[w.data[cuts[0] :]], minlength=m * CLASSES).reshape(m, CLASSES)
    length = (w.end - w.start).astype(np.float64)
    words = np.bincount(passage, minlength=m).astype(np.float64)
    per = lambda v: np.bincount(passage, v, minlength=m) / np.maximum(words, 1)
    mean = per(length)
    head, tail = _CLASS[w.data[w.start]], _CLASS[w.data[w.end - 1]]
    h = w.hashes()
    order = np.lexsort((h, passage))
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (passage[order][1:] == passage[order][:-1])])
    runs = sequence_hashes(h, 4)
    inside = w.doc[: len(runs)] == w.doc[3:]
    runs, run_doc, run_passage = runs[inside], w.doc[: len(inside)][inside], passage[: len(inside)][inside]
    order4 = np.lexsort((np.arange(len(runs)), runs, run_doc))
    again = np.concatenate([[False], (runs[order4][1:] == runs[order4][:-1]) & (run_doc[order4][1:] == run_doc[order4][:-1])]) if len(runs) else np.zeros(0, bool)
    repeated = np.bincount(run_passage[order4][again], minlength=m) / np.maximum(words, 1)
    total = np.maximum(classes.sum(axis=1, keepdims=True), 1)
    x[:, :CLASSES] = np.sqrt(classes / total)
    x[:, CLASSES] = mean / 8
    x[:, CLASSES + 1] = np.sqrt(np.maximum(per(length**2) - mean**2, 0)) / 8
    x[:, CLASSES + 2] = per((length <= 3).astype(float))
    x[:, CLASSES + 3] = np.bincount(passage[order][same], minlength=m) / np.maximum(words, 1)
    x[:, CLASSES + 4] = repeated
    x[:, CLASSES + 5] = per((head == 1).astype(float))
    x[:, CLASSES + 6] = per((tail > 5).astype(float))
    x[:, CLASSES + 7] = np.log1p(words) / 4
    x[:, CLASSES + 8] = np.log1p(count[rows]) / 8
    return x, rows


def _pool(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(v, at, axis=0)


def forward(p: dict, x: np.ndarray, at: np.ndarray, bag: np.ndarray) -> dict:
    """``at`` the first passage of each bag, ``bag`` the bag of each passage."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    a = e / _pool(e, at)[bag]
    z = _pool(a[:, None] * h, at)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3) -> dict:
    """Adam on the weighted log loss of the bags, whole sample a step."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    p = {"W": rng.normal(0, f**-0.5, (f, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, HIDDEN)), "U": rng.normal(0, 0.2, (HIDDEN, HIDDEN)), "w": rng.normal(0, 0.2, HIDDEN), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    at = np.flatnonzero(np.diff(bag, prepend=-1))
    for step in range(1, EPOCHS + 1):
        o = forward(p, x, at, bag)
        g = ((o["y"] - y) * weight / weight.sum()).astype(np.float32)
        dz = g[:, None] * p["c"]
        grad = {"c": o["z"].T @ g, "d": np.array([g.sum()])}
        dh = o["a"][:, None] * dz[bag]
        inner = (o["h"] * dz[bag]).sum(axis=1)
        de = o["a"] * (inner - _pool(o["a"] * inner, at)[bag])
        gate = o["t"] * o["s"]
        grad["w"] = gate.T @ de
        dt = de[:, None] * p["w"] * o["s"] * (1 - o["t"] ** 2)
        ds = de[:, None] * p["w"] * gate * (1 - o["s"])
        grad["V"], grad["U"] = o["h"].T @ dt, o["h"].T @ ds
        dh += dt @ p["V"].T + ds @ p["U"].T
        dh *= 1 - o["h"] ** 2
        grad["W"], grad["b"] = x.T @ dh + 1e-4 * p["W"], dh.sum(axis=0)
        rate = 0.02 * min(1.0, 2.0 - 2.0 * step / EPOCHS + 0.02)
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
            m2[k] = 0.99 * m2[k] + 0.01 * grad[k] ** 2
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, rows_a_class: int = ROWS_A_CLASS, bytes_a_class: int = BYTES_A_CLASS) -> dict | None:
    sample = sample_labelled(docs, labels, label, modulus, held, rows_a_class, bytes_a_class)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                x, rows = encode_passages(part.column(1))
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends * FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), values], names=["doc_id", "label", "weight", "x"])

    got = sample.select("doc_id", "text", "label", "weight").mapInArrow(run, "doc_id long, label int, weight double, x array<float>").toArrow().sort_by("doc_id")
    y = np.array(got["label"].to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        return None
    lists = got["x"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    bag = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()) // FEATURES)
    weight = got["weight"].to_numpy().astype(np.float32)
    centre = np.average(x, axis=0, weights=weight[bag])
    scale = np.sqrt(np.average((x - centre) ** 2, axis=0, weights=weight[bag])) + 0.02
    p = train(((x - centre) / scale).astype(np.float32), bag, y, weight)
    return {"centre": centre, "scale": scale, "p": p}


def score_column(model: dict | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(column), 0.5)
    x, rows = encode_passages(column)
    at = np.flatnonzero(np.diff(rows, prepend=-1))
    return forward(model["p"], ((x - model["centre"]) / model["scale"]).astype(np.float32), at, rows)["y"].astype(np.float64)


def predict(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score; the model has a fixed size and goes out as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def run(batches):
        for batch in giving_back(batches):
            for a, b in slices(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(score_column(shared.value, part.column(len(keep))))], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, cut: float = 0.5, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, "quality", modulus, held, **bounds)
    marked = docs.select("doc_id", "text", (fold_of(F.col("doc_id"), modulus) == held).alias("held_out"))
    return predict(marked, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, cut: float = 0.5, **bounds) -> DataFrame:
    """``docs`` without the documents scored below ``cut``, all columns kept.

    Only the text goes to Python and only the score comes back.
    """
    model = fit(docs, labels, "quality", modulus, held, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in giving_back(texts):
            parts = [score_column(shared.value, column.slice(a, b - a)) for a, b in slices(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(score(F.col("text")) >= cut)
