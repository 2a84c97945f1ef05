"""The pipeline's stages against brute force, and on awkward rows."""

import re

import numpy as np
import pytest

import corpus_pipeline as C
from geoloom.llm.queries import piece_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    words = [f"{a}{b}" for a in ("tion", "er", "an", "re", "lo", "mi") for b in ("st", "ou", "nd", "ing", "ble", "ka", "pe", "zu")]
    passage = " ".join(rng.choice(words, 60))
    data, marks = [], []
    for i in range(160):
        text = rng.choice(words, int(rng.integers(90, 160))).tolist()
        bad = i % 5 == 0
        if bad:
            text = [w.upper() + "!!" for w in text]
        if i in (31, 32, 33):
            text[40:40] = passage.split()
        data.append((i, " ".join(text), "en", f"s{i % 3}", 0))
        marks.append((i, int(not bad), 0))
    data += [(200, data[1][1], "en", "s0", 0), (201, data[2][1], "en", None, 0), (202, " ".join(["edited", *data[3][1].split()[1:]]), "en", "s1", 0)]
    data = [(i, t, g, s, len(t)) for i, t, g, s, _ in data]
    data += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, "x", "en", "s1", 1), (None, "no id but words " + passage[:80], "en", "s2", 9), (303, " ".join(rng.choice(words, 9000)), "en", "s2", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in data}


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, corpus):
    path, data = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, path)
        seen[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "pieces":
            assert docs.columns == list(C.COLUMNS)
    good = rows(seen["quality"])
    assert not any(i is not None and i < 160 and i % 5 == 0 for i in good) and sum(i is not None and i < 160 for i in good) == 128
    one = rows(seen["near_copies"])
    assert {200, 201, 202}.isdisjoint(one) and {i for i in good if i is not None and i < 160} <= set(one)
    # brute force: windows of 50 words that a smaller id has
    first, gone = {}, {}
    texts = {i: WORD.findall(r["text"] or "") for i, r in one.items()}
    big = 1 << 62
    for i, w in texts.items():
        for k in range(len(w) - C.PASSAGE_WORDS + 1):
            key = tuple(w[k : k + C.PASSAGE_WORDS])
            first[key] = min(first.get(key, big), big if i is None else i)
    for i, w in texts.items():
        gone[i] = {k + j for k in range(len(w) - C.PASSAGE_WORDS + 1) if first[tuple(w[k : k + C.PASSAGE_WORDS])] < (big if i is None else i) for j in range(C.PASSAGE_WORDS)}
    cut = rows(seen["passages"])
    assert len(gone[32]) >= 60 and len(gone[33]) >= 60 and not gone[31]
    for i, w in texts.items():
        left = [x for k, x in enumerate(w) if k not in gone[i]]
        if w and not left:
            assert i not in cut
        else:
            assert WORD.findall(cut[i]["text"] or "") == left
            assert gone[i] or cut[i]["text"] == one[i]["text"] and cut[i]["n_chars"] == one[i]["n_chars"]
            assert not gone[i] or cut[i]["n_chars"] == len(cut[i]["text"])
    mixed = seen["mixing"].collect()
    total = sum(len(WORD.findall(r["text"] or "")) for r in cut.values())
    assert abs(sum(len(WORD.findall(r["text"])) for r in mixed) - total) <= 4
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    coded = seen["pieces"].collect()
    assert len(coded) == len(mixed)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in coded) == sorted((r["doc_id"] or -1, processor.encode(r["text"])) for r in mixed)
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded"] == processor.decode(r["ids"]) for r in coded)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
