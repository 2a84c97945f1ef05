"""Each dealt operator against brute force, and on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} of the tale{i % 131}" for i in range(6000))


def rows():
    base = "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest at night while the moon shines"
    texts = [base, base, base + " again", None, "", "   \n\t ", "one", LONG, "Größe und Übermut tun selten gut, sagt der alte Mann in der kleinen Stadt am See", "le chat est sur la table et le chien dort dans la maison de ma tante", "!!! ### 123", "日本語のテキスト 😀 ok", base.upper()]
    out = [(i, t, ("en", "de", "fr", None)[i % 4], ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*out, (3, None, None, None, None), (None, base, "en", "a", 1)]


def awkward(spark):
    return spark.createDataFrame(rows(), DOCS).withColumn("score", F.lit(1)).withColumn("size", F.lit("x")).withColumn("fp", F.lit(2)).withColumn("bucket", F.lit(3))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, n=60):
    return spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(n)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


# ---- 1 mixing


def fill(sizes, weights, cap, total):
    """Clamp and share again until nothing is above its cap."""
    target, fixed = {}, set()
    while True:
        left = total - sum(target[s] for s in fixed)
        w = sum(weights[s] for s in sizes if s not in fixed)
        for s in sizes:
            if s not in fixed:
                target[s] = left * weights[s] / w
        over = [s for s in sizes if s not in fixed and target[s] > cap * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            fixed.add(s)
        if len(fixed) == len(sizes):
            return target


def test_mixing_fills_like_clamp_and_share(spark):
    from geoloom.llm.mixing import water_fill

    rng = np.random.default_rng(1)
    for trial in range(5):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(1, 1000, 9) ** 2)}
        weights = {s: int(rng.integers(1, 5)) for s in sizes}
        got = water_fill(spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight long"), 1.5).collect()
        want = fill(sizes, weights, 1.5, sum(sizes.values()))
        assert {r["source"]: pytest.approx(r["target"], rel=1e-9) for r in got} == want


def test_mixing_takes_targets(spark):
    from geoloom.llm.mixing import mix_sources

    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 40)), None, f"s{i % 5 if i % 2 else 0}", 0) for i in range(800)], DOCS)
    got = mix_sources(docs).toPandas()
    again = mix_sources(docs.repartition(3)).toPandas()
    assert got.sort_values("doc_id")["extra"].tolist() == again.sort_values("doc_id")["extra"].tolist()
    got["taken"] = got["whole"] * got["size"] + got["extra"]
    assert (got["taken"] <= 3 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 1
        assert ((g["extra"] > 0) & (g["extra"] < g["size"])).sum() <= 1


def test_mixing_awkward(spark):
    from geoloom.llm.mixing import mix_sources, sample_mixture

    got = mix_sources(awkward(spark)).toPandas()
    assert len(got) == len(rows()) and (got[got["text"].isna()]["size"] == 0).all()
    assert mix_sources(empty(spark)).count() == 0
    mixed = sample_mixture(spark.createDataFrame(rows(), DOCS))
    plan = mix_sources(spark.createDataFrame(rows(), DOCS)).toPandas()
    words = sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect())
    assert words == int((plan["whole"] * plan["size"] + plan["extra"]).sum())
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # white space of every kind around words, at the head too, in a row that is cut
    texts = ["\t\n one two\x0bthree  four ", "\n\nfive six seven", "\x0ceight nine", "\r a b c d e f g"]
    odd = spark.createDataFrame([(i, t, None, ("a", "b", "c")[i % 3], 0) for i in range(40) for t in [texts[i % 4]]], DOCS).withColumn("size", F.lit("own")).withColumn("target", F.lit(7))
    plan = mix_sources(odd).toPandas()
    assert ((plan["extra"] > 0) & (plan["extra"] < plan["size"])).any()
    taken = sample_mixture(odd)
    assert taken.columns == odd.columns and {(r["size"], r["target"]) for r in taken.collect()} == {("own", 7)}
    assert sum(len(WORD.findall(r["text"])) for r in taken.collect()) == int((plan["whole"] * plan["size"] + plan["extra"]).sum())
    part = [r["text"] for r in taken.where(~F.col("text").isin(texts)).collect()]
    assert part and all(any(" ".join(WORD.findall(t)).startswith(p) for t in texts) for p in part)


# ---- 2 language


def test_language(spark):
    from geoloom.llm.language import classify, identify

    words = {"en": "the and of that with from this have were which".split(), "de": "der die und nicht eine auch werden sich mit auf".split(), "fr": "les des est dans pour une avec sont mais tout".split()}
    rng = np.random.default_rng(2)
    data = [(i, " ".join(rng.choice(words[g], 40)), g, "s", 0) for i in range(240) for g in [("en", "de", "fr")[i % 3]]]
    docs = spark.createDataFrame([*data, (900, None, "en", "s", 0), (901, "123 !!", "de", None, 0), (902, "", None, "s", 0), (903, "日本", "fr", "s", 0)], DOCS)
    got = identify(docs).toPandas().set_index("doc_id")
    for i, _, g, *_ in data:
        assert got.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got.loc[i, "lang_pred"] == g
    assert got.loc[[900, 901, 902], "lang_pred"].tolist() == ["und"] * 3 and (got.loc[[900, 901, 902], "score"] == 0).all()
    assert got.loc[903, "lang_pred"] in words and got["score"].between(0, 1).all()
    assert identify(empty(spark)).count() == 0
    assert set(identify(spark.createDataFrame([(1, "abc", None, None, 0)], DOCS)).toPandas()["lang_pred"]) == {"und"}
    assert identify(awkward(spark)).count() == len(rows())
    assert classify({"langs": [], "masks": None}, ["a"])[0] == ["und"]


def plain_grams(text):
    """n-grams of letters with word edges, as strings."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [f" {w} "[k : k + n] for w in words for n in (3, 4) for k in range(len(w) + 3 - n)]


def test_language_against_sets_of_grams(spark):
    from collections import Counter

    from geoloom.llm.language import LEAST_PER_MILLION, SHARE, classify, fit

    rng = np.random.default_rng(31)
    syllables = {f"l{i:02}": [f"{a}{b}" for a in rng.choice(list("bcdfghklmnprstvwzéßñ"), 6) for b in rng.choice(list("aeiouäö"), 3)] for i in range(70)}
    make = lambda g, n: " ".join("".join(rng.choice(syllables[g], int(rng.integers(1, 4)))) for _ in range(n))
    data = [(i * 70 + j, make(g, 60), g) for i in range(4) for j, g in enumerate(syllables)]
    model = fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), slots_a_gram=4096)
    counts = {g: Counter(x for _, t, k in data if k == g for x in plain_grams(t)) for g in syllables}
    rate = {g: {x: n / c.total() for x, n in c.items()} for g, c in counts.items()}
    most = {x: max(r.get(x, 0) for r in rate.values()) for r in rate.values() for x in r}
    has = {g: {x for x, v in r.items() if v >= SHARE * most[x] and v * 1e6 >= LEAST_PER_MILLION} for g, r in rate.items()}
    texts = [make(g, int(rng.integers(1, 30))) + " 12, !" for g in syllables] + ["zzzqqq", "ba", "Ünd, ß"]
    langs, scores = classify(model, texts)
    for t, lang, score in zip(texts, langs, scores):
        x = plain_grams(t)
        share = {g: sum(w in has[g] for w in x) / len(x) for g in sorted(has)}
        if max(share.values()):
            assert share[lang] == pytest.approx(max(share.values()), abs=1e-3)
            assert score == pytest.approx(max(share.values()) / sum(share.values()), abs=1e-3)
        else:
            assert score == pytest.approx(0, abs=1e-3) or share[lang] == 0
    assert len(model["masks"]) == 2 and np.mean([a == g for a, g in zip(langs, syllables)]) > 0.9


def test_language_false_positives_are_corrected(spark):
    from geoloom.llm.language import classify, fit, languages_of

    rng = np.random.default_rng(33)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(400))
    rows = spark.createDataFrame([(i, text(("abcdef", "ghijkl")[i % 2]), ("x", "y")[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    model = fit(rows, slots_a_gram=2)  # a full filter
    strange = rng.integers(0, 2**63, 20000).astype(np.uint64) * np.uint64(2)
    found = languages_of(model, strange)[0]
    for i in range(2):  # what false positives the fill predicts is what there are
        assert ((found >> np.uint64(i)) & np.uint64(1)).mean() == pytest.approx(model["false"][i], abs=0.03) and model["false"][i] > 0.05
    assert classify(model, [text("abcdef"), text("ghijkl")])[0] == ["x", "y"]


def test_language_bloom_has_no_false_negatives():
    from geoloom.llm.language import languages_of, slots

    h = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    masks = np.zeros((2, 1 << 16), np.uint64)
    for s in slots(h, 16):
        np.bitwise_or.at(masks[1], s.astype(np.int64), np.uint64(5))
    found = languages_of({"masks": masks, "bits": 16}, h)
    assert ((found[1] & np.uint64(5)) == 5).all() and not found[0].any()


# ---- 3 simhash


def plain_fingerprint(text, n=4):
    from xxhash import xxh64_intdigest

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_fingerprints():
    from geoloom.llm.simhash import fingerprints

    texts = [r[1] for r in rows()]
    assert fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]
    assert fingerprints(pa.array([], pa.string())).tolist() == []
    from geoloom.llm.simhash import wide_fingerprints
    from xxhash import xxh3_128_intdigest

    wide = wide_fingerprints(pa.array(texts), 5, (42, 43))
    for t, row in zip(texts, wide.tolist()):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[i : i + 5]).encode() for i in range(max(1, len(words) - 4))] if words else []
        want = []
        for seed in (42, 43):
            h = [xxh3_128_intdigest(x, seed) for x in shingles]
            bits = sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
            want += [bits & (1 << 64) - 1, bits >> 64]
        assert row == want
    assert wide_fingerprints(pa.array([], pa.string()), 5, (42, 43)).shape == (0, 4)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_simhash_buckets_against_brute_force(radius):
    from geoloom.llm.simhash import bucket_labels

    rng = np.random.default_rng(radius)
    fp, bucket = [], []
    for b, n in enumerate([2, 5, 64, 65, 200, 1, 3]):
        base = rng.integers(0, 2**64, 4, dtype=np.uint64)
        for _ in range(n):
            x = int(base[rng.integers(4)])
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            fp.append(x)
            bucket.append(b)
    label = bucket_labels(np.array(fp, np.uint64), np.array(bucket), radius, entries=50)
    at = 0
    for b in range(7):
        own = [x for x, k in zip(fp, bucket) if k == b]
        assert [int(v) - at for v in label[at : at + len(own)]] == plain_components(own, radius)
        at += len(own)


@pytest.mark.parametrize("tile", [4096, 16])
def test_simhash_components(spark, tile):
    from geoloom.llm.simhash import link, near_duplicates
    from geoloom.llm.components import components

    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**64, 12, dtype=np.uint64)]
    fps = []
    for _ in range(260):
        x = base[int(rng.integers(12))] if rng.random() < 0.8 else int(rng.integers(0, 2**64, dtype=np.uint64))
        for k in rng.integers(0, 64, int(rng.integers(0, 7))):
            x ^= 1 << int(k)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "rep long, fp long")
    roots = {r["node"]: r["root"] for r in components(link(nodes, tile=tile)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == plain_components(fps)
    if tile == 16:
        got = near_duplicates(awkward(spark)).toPandas()
        assert len(got) == len(rows())
        assert set(got[got["doc_id"].isin([3, 4, 5])]["component_id"]) == {3}
        assert set(got[got["doc_id"].isin([0, 1])]["component_id"]) == {0}
        assert near_duplicates(empty(spark)).count() == 0


def test_simhash_sampled_tables(spark):
    from geoloom.llm.simhash import bucket_labels, keep_one

    rng = np.random.default_rng(12)
    a = rng.integers(0, 2**64, (40, 2), dtype=np.uint64)
    b = a.copy()
    for i in range(40):  # 128 bits, i of them differ
        for k in rng.choice(128, i, replace=False):
            b[i, k // 64] ^= np.uint64(1 << int(k % 64))
    label = bucket_labels(np.stack([a, b], axis=1).reshape(80, 2), np.repeat(np.arange(40), 2), 25)
    assert [bool(label[2 * i] == label[2 * i + 1]) for i in range(40)] == [i <= 25 for i in range(40)]
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(60)]
    near = []
    for t in texts[:30]:
        w = t.split()
        for at in rng.choice(200, 3, replace=False):
            w[at] = "changed"
        near.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts + near + texts[:5])], DOCS)
    kept = sorted(r["doc_id"] for r in keep_one(docs, shingle=5, radius=25, seeds=(42, 43), tables=64).collect())
    assert set(range(60)) <= set(kept) and len(kept) <= 62
    assert keep_one(empty(spark), shingle=5, radius=25, seeds=(42, 43), tables=64).count() == 0
    assert len({r["doc_id"] for r in keep_one(awkward(spark)).collect()}) == keep_one(awkward(spark)).count()


def test_keep_one_without_ids_and_with_clashing_ids(spark):
    from geoloom.llm.simhash import keep_one

    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(50)]
    near = lambda t: " ".join(["changed", *t.split()[1:]])
    data = [(i, t) for i, t in enumerate(texts[:10])]  # with an id
    data += [(None, t) for t in texts[10:40]] + [(None, t) for t in texts[10:20]]  # without, some twice
    data += [(None, near(t)) for t in texts[:5]] + [(None, near(texts[39]))]  # near copies without an id
    data += [(77, t) for t in texts[40:]] + [(77, texts[40])]  # one id, other texts
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], DOCS).repartition(3)
    found = keep_one(docs, shingle=5, radius=25, seeds=(42, 43), tables=64)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in found.collect())
    either = {texts[39], near(texts[39])}
    assert [r for r in kept if r[2] not in either] == sorted([(False, i, t) for i, t in enumerate(texts[:10])] + [(True, 0, t) for t in texts[10:39]] + [(False, 77, t) for t in texts[40:]])
    assert sum(r[2] in either for r in kept) == 1 and found.columns == docs.columns
    same = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    assert keep_one(same).count() == 1
    # a third of the rows without an id and with one text; a column that can't be compared
    hot = spark.createDataFrame([(None, "the same text of five words") for _ in range(60)] + [(i, texts[i % 50]) for i in range(100)] + [(5, texts[5])], "doc_id long, text string").withColumn("more", F.create_map(F.lit("k"), F.lit(1)))
    left = keep_one(hot, shingle=5, radius=51, seeds=(42, 43), wide=True, tables=128).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left) == [(False, i) for i in range(50)] + [(True, 0)] and all(r["more"] == {"k": 1} for r in left)


def test_near_copies_are_linked_at_the_radius(spark):
    """Of texts with a shingle similarity of 0.8 and more over 0.9 are linked, texts below 0.5 are not."""
    from geoloom.llm.simhash import keep_one

    rng = np.random.default_rng(14)
    words = [f"w{i}" for i in range(5000)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    data, near, far = [], [], []
    for i in range(120):
        t = rng.choice(words, 300).tolist()
        u = list(t)
        for at in rng.choice(300, 6 if i % 2 else 40, replace=False):
            u[at] = "other"
        a, b = shingles(t), shingles(u)
        j = len(a & b) / len(a | b)
        (near if j >= 0.8 else far).append(i)
        assert j >= 0.8 or j < 0.5
        data += [(i, " ".join(t)), (1000 + i, " ".join(u))]
    kept = {r["doc_id"] for r in keep_one(spark.createDataFrame(data, "doc_id long, text string"), shingle=5, radius=51, seeds=(42, 43), wide=True, tables=128).collect()}
    assert set(range(120)) <= kept and len(near) == 60
    assert sum(1000 + i not in kept for i in near) >= 0.95 * len(near) and all(1000 + i in kept for i in far)


def test_components_of_a_chain_and_a_star(spark):
    from geoloom.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(300, 400)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{k: 5 for k in range(300, 400)}}


# ---- 4 and 5 classifiers


def test_toxicity(spark):
    from geoloom.llm.toxicity import score_toxicity

    rng = np.random.default_rng(5)
    plain, bad = [f"{a}{b}" for a in ("tion", "er", "an", "re") for b in ("st", "ou", "nd", "ing", "ble")], ["scoundrel", "blockhead", "nitwit"]
    data, marks = [], []
    for i in range(300):
        words = rng.choice(plain, 60).tolist()
        if i % 4 == 0:
            for at in rng.integers(0, 60, 6):
                words[at] = str(rng.choice(bad))
        data.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame([*data, (900, None, None, None, None), (901, "", "en", "s", 0), (902, "?!", "en", "s", 0)], DOCS)
    lab = spark.createDataFrame([*marks, (901, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, lab).toPandas().set_index("doc_id")
    truth = np.array([i % 4 == 0 for i in range(300)])
    held = got.loc[range(300), "held_out"].to_numpy()
    assert (held == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)]).all()
    assert ((got.loc[range(300), "predicted"] == 1).to_numpy() == truth)[held].mean() > 0.95
    assert got["score"].between(0, 1).all() and (got.loc[[900, 901, 902], "predicted"] == 0).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    assert score_toxicity(empty(spark), lab).count() == 0
    assert set(score_toxicity(awkward(spark), lab.where("false")).toPandas()["score"]) == {0.0}


def uneven(spark, n=600):
    """Documents and labels with one bad row in ten, and the number of labels of either class outside fold 1 of 3."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("tion", "er", "an", "re") for b in ("st", "ou", "nd", "ing", "ble")]
    docs = spark.createDataFrame([(i, " ".join([*rng.choice(words, 40), *["scoundrel!!"] * (4 * (i % 10 == 0))]), "en", "s", 0) for i in range(n)], DOCS)
    lab = spark.createDataFrame([(i, int(i % 10 != 0), int(i % 10 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    fitted = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    return docs, lab, sum(i % 10 == 0 for i in fitted), sum(i % 10 != 0 for i in fitted)


def test_toxicity_cut_keeps_the_labels_shares(spark, monkeypatch):
    from geoloom.llm import toxicity as T

    rng = np.random.default_rng(8)
    y = (rng.random(400) < 0.1).astype(int)
    score = rng.normal(0, 1, 400) + 1.5 * y
    some = (y == 1) | (np.arange(400) % 9 == 0)  # one in nine of the plain rows, all others
    weight = np.where(y[some] == 1, 1.0, 9.0)
    whole = np.repeat(np.arange(some.sum()), weight.astype(int))
    assert T.best_cut(score[some], y[some], weight) == pytest.approx(T.best_cut(score[some][whole], y[some][whole], np.ones(len(whole))))
    docs, lab, bad, plain = uneven(spark)
    seen, fit_logistic, best_cut = [], T.fit_logistic, T.best_cut
    monkeypatch.setattr(T, "fit_logistic", lambda x, y, w: seen.append((y, w)) or fit_logistic(x, y, w))
    monkeypatch.setattr(T, "best_cut", lambda s, y, w: seen.append((y, w)) or best_cut(s, y, w))
    T.fit(docs, lab, rows_a_class=5000)
    T.fit(docs, lab, rows_a_class=30)
    assert len(seen) == 4 and all(len(y) == bad + plain and (w == 1).all() for y, w in seen[:2])
    for y, w in seen[2:]:
        assert 15 < y.sum() < bad and 15 < (1 - y).sum() < 60
        assert w[y == 0].mean() / w[y == 1].mean() == pytest.approx(plain / bad) and w.mean() == pytest.approx(1)


def test_quality(spark):
    from geoloom.llm.quality import encode_passages, keep_good, score_quality

    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("tion", "er", "an", "re") for b in ("st", "ou", "nd", "ing", "ble")]
    data, marks = [], []
    for i in range(240):
        text = rng.choice(words, 150).tolist()
        if i % 3 == 0:  # low quality in one passage only
            text[64:128] = [w.upper() + "!!" for w in text[64:128]]
        data.append((i, " ".join(text), "en", "s", 0))
        marks.append((i, int(i % 3 != 0), 0))
    docs = spark.createDataFrame([*data, (900, None, None, None, None), (901, "", "en", "s", 0)], DOCS)
    lab = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = score_quality(docs, lab).toPandas().set_index("doc_id")
    held = got.loc[range(240), "held_out"].to_numpy()
    right = (got.loc[range(240), "predicted"] == 1).to_numpy() == np.array([i % 3 != 0 for i in range(240)])
    assert right[held].mean() > 0.95 and got["score"].between(0, 1).all()
    kept = {r["doc_id"] for r in keep_good(docs, lab).collect()}
    assert kept == set(got[got["predicted"] == 1].index)
    assert set(score_quality(awkward(spark), lab.where("false")).toPandas()["score"]) == {0.5}
    assert score_quality(empty(spark), lab).count() == 0
    x, bag = encode_passages(pa.array([None, "", LONG]))
    assert bag.tolist()[:3] == [0, 1, 2] and len(x) == len(bag) == 2 + -(-len(WORD.findall(LONG)) // 64)


def test_quality_keeps_the_labels_shares(spark, monkeypatch):
    from geoloom.llm import quality as Q

    docs, lab, bad, good = uneven(spark)
    seen, train = [], Q.train
    monkeypatch.setattr(Q, "train", lambda x, bag, y, weight: seen.append((y, weight)) or train(x, bag, y, weight))
    Q.fit(docs, lab, rows_a_class=3000)
    Q.fit(docs, lab, rows_a_class=30)
    assert len(seen[0][0]) == bad + good and (seen[0][1] == 1).all()
    y, w = seen[1]
    assert 15 < (1 - y).sum() < bad and 15 < y.sum() < 60
    assert w[y == 1].mean() / w[y == 0].mean() == pytest.approx(good / bad, rel=1e-5)


def test_quality_gradients():
    from geoloom.llm import quality as Q

    rng = np.random.default_rng(7)
    x, bag = rng.normal(size=(30, 5)).astype(np.float32), np.sort(rng.integers(0, 6, 30))
    bag = np.unique(bag, return_inverse=True)[1]
    y = (rng.random(bag.max() + 1) > 0.5).astype(np.float32)
    p = Q.train(x, bag, y, np.ones(len(y), np.float32))
    out = Q.forward(p, x, np.flatnonzero(np.diff(bag, prepend=-1)), bag)
    assert np.allclose(np.bincount(bag, out["a"]), 1, atol=1e-5)
    assert (((out["y"] > 0.5) == (y > 0.5)).mean()) == 1


# ---- 6 top-k


def test_topk(spark):
    from geoloom.llm.topk import scaled, top_k

    rng = np.random.default_rng(8)
    data = [(int(i), [float(v) for v in rng.integers(-3, 4, 8) / 8]) for i in range(400)]
    data += [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, [float("inf")] * 8), (None, [0.5] * 8), (399, data[399][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).withColumn("rank", F.lit(9))
    v = df.select("vec_id", scaled(F.col("embedding")).alias("v"))
    got = top_k(v, F.col("vec_id") % 20 == 0, k=20, pivots=5, query_bytes=300, sample_rows=30, growth=4).toPandas()
    ints = [(i, np.floor(64 * np.array(e)).astype(int)) for i, e in data[:400]] + [(399, np.floor(64 * np.array(data[399][1])).astype(int))]
    for q, x in ints[:400:20]:
        want = sorted(((-int(x @ y), i) for i, y in ints if i != q))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(zip(-mine["score"], mine["vec_id"])) == want and mine["rank"].tolist() == list(range(1, 21))
    assert top_k(v.limit(0), F.lit(True)).count() == 0
    few = top_k(v.where("vec_id < 3"), F.col("vec_id") == 0, k=20)
    assert few.count() == 2


def test_topk_odd_vectors(spark):
    from geoloom.llm.topk import scaled, top_k

    rng = np.random.default_rng(9)
    data = [(i, [float(v) for v in rng.integers(-40, 40, int(rng.integers(0, 6))) / 64 * 10.0 ** int(rng.integers(0, 8))]) for i in range(120)]
    data += [(120, [1e20]), (121, [3e38, 1.0]), (122, [])] + [(20, data[20][1])] * 3 + [(40, [0.5, 0.25])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = top_k(df.select("vec_id", scaled(F.col("embedding")).alias("v")), F.col("vec_id") % 20 == 0, k=5, pivots=3, sample_rows=20, growth=2).toPandas()
    ints = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in data if all(abs(x) * 64 < 2**31 for x in e) and sum(float(np.floor(64 * x)) ** 2 for x in e) < 2.0**62]
    assert {120, 121}.isdisjoint(got["vec_id"]) and 122 in {i for i, _ in ints}
    want = []
    for i, x in {(i, tuple(x)) for i, x in ints if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in ints if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(want) == sorted(zip(got["query_id"], got["rank"], got["vec_id"], got["score"]))
    alike = spark.createDataFrame([(i, []) for i in range(5)], "vec_id long, v array<long>")
    assert top_k(alike, F.col("vec_id") == 0).count() == 4


# ---- 7 SpotSigs


def spot_order(data):
    """(id, text) by id, descending, null last; rows of one id by signed XXH64 (seed 42, itself for null) of the text, descending."""
    from xxhash import xxh64_intdigest

    def h(t):
        x = 42 if t is None else xxh64_intdigest(t.encode(), 42)
        return x - (1 << 64) if x >> 63 else x

    return sorted(((i, t) for i, t, *_ in data), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, h(r[1])), reverse=True)


def test_spotsigs_hot_ids_are_split(spark):
    from geoloom.llm.spotsigs import edited, fingerprint_edits, in_order

    rng = np.random.default_rng(21)
    data = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} the {rng.integers(1 << 30)} of tale {i % 11}") for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    sizes = in_order(docs, 32).where("__guest = 0").groupBy("__bucket").count().toPandas()["count"]
    assert sizes.sum() == 900 and sizes.max() < 120 and len(sizes) >= 20
    order = spot_order(data)
    want = sorted((repr(i), hashlib.sha256(edited(t, order[(k + 1) % 900][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    got = fingerprint_edits(docs, buckets=32).select("doc_id", "edited_sha256").collect()
    assert sorted((repr(r[0]), r[1]) for r in got) == want


def test_spotsigs(spark):
    from geoloom.llm.spotsigs import edited, fingerprint_edits, length_bounds, likeness, signatures

    data = rows()
    got = fingerprint_edits(awkward(spark), buckets=4).toPandas()
    assert len(got) == len(data)
    order = [(i, t or "") for i, t in spot_order(data)]
    want = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        changed = edited(t, following)
        want.setdefault(i, []).append((len(t), hashlib.sha256(changed.encode()).hexdigest(), round(likeness(signatures(t), signatures(changed)), 9), round(likeness(signatures(t), signatures(following)), 9)))
    have = {}
    for r in got.to_dict("records"):
        i = None if r["doc_id"] != r["doc_id"] else int(r["doc_id"])
        have.setdefault(i, []).append((r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert fingerprint_edits(empty(spark)).count() == 0
    alone = fingerprint_edits(spark.createDataFrame([(5, "abcdef", None, None, 0)], DOCS)).collect()
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    a, b = frozenset(range(100)), frozenset(range(5, 105))
    assert likeness(a, b) == pytest.approx(95 / 105) == likeness(a, b, 0.8) and likeness(a, b, 0.95) == 0.0
    bounds = length_bounds(0.8, 100)
    assert all(hi * 0.8 <= nxt for hi, nxt in zip(bounds, bounds[1:]))


def plain_set_classes(data, t):
    """Smallest id reachable over sets with a Jaccard similarity of t and more, by all pairs."""
    ids, sets = [i for i, _ in data], [frozenset(s) for _, s in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(data)), 2):
        both = len(sets[i] & sets[j])
        if not sets[i] and not sets[j] or both and both >= t * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(data)):
        r = find(i)
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(data))]


@pytest.mark.parametrize("threshold,tile", [(0.8, 2048), (0.8, 7), (0.5, 2048)])
def test_set_classes(spark, threshold, tile):
    from geoloom.llm.setjoin import set_classes, set_keys

    rng = np.random.default_rng(51)
    base = [rng.integers(-(2**62), 2**62, int(n)).tolist() for n in rng.integers(1, 60, 25)]
    common = rng.integers(-(2**62), 2**62, 6).tolist()  # in every third set, and small sets of nothing else
    data = []
    for i in range(220):
        s = list(base[int(rng.integers(25))])
        for _ in range(int(rng.integers(0, 1 + len(s) // 4))):
            s[int(rng.integers(len(s)))] = int(rng.integers(-(2**62), 2**62))
        s += common[: int(rng.integers(7))] if i % 3 == 0 else []
        data.append((i, sorted(set(s))))
    data += [(300 + k, sorted(common[:k])) for k in range(7)] + [(400, []), (None, []), (None, data[0][1]), (500, data[1][1])]
    df = spark.createDataFrame(data, "doc_id long, signatures array<long>").repartition(4)
    classes = set_classes(df, threshold, tile)
    h1, h2 = set_keys("signatures")
    got = df.withColumn("a", h1).withColumn("b", h2).join(classes, (F.col("a") == F.col("h1")) & (F.col("b") == F.col("h2"))).select("doc_id", "class_id").collect()
    assert sorted(map(repr, ((r["doc_id"], r["class_id"]) for r in got))) == sorted(map(repr, zip([i for i, _ in data], plain_set_classes(data, threshold))))
    assert set_classes(df.limit(0)).count() == 0


def plain_signatures(text):
    """Anchors, and words with no anchor among the dozen before them, each with the next two content words (or words, at the end)."""
    from geoloom.llm.spotsigs import ANCHORS

    words = re.sub(r"[^\w\s]+", " ", (text or "").lower()).split()
    out = set()
    for i, w in enumerate(words):
        if w not in ANCHORS and any(x in ANCHORS for x in words[max(0, i - 12) : i]):
            continue
        ahead = [x for x in words[i + 1 :] if x not in ANCHORS][:2]
        if len(ahead) < 2:
            ahead = words[i + 1 : i + 3]
        out.add((w, *ahead, *[""] * (2 - len(ahead))))
    return out


def test_op7_against_plain_signatures(spark, tmp_path):
    from geoloom.llm.queries import QUERIES

    rng = np.random.default_rng(61)
    words = [f"{a}{b}" for a in ("tion", "er", "an", "re") for b in ("st", "ou", "nd", "ing", "ble", "lo")] + ["the", "of", "and", "der", "die", "le"]
    data = [(i, " ".join(rng.choice(words, int(rng.integers(0, 80))))) for i in range(50)]
    data += [(60, data[3][1]), (61, data[4][1] + " more"), (62, " ".join(["changed", *data[5][1].split()[1:]])), (63, None), (64, ""), (65, "?!")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op7_spotsigs"](spark, str(tmp_path)).collect()}
    texts = {i: t or "" for i, t in data}
    sets = {i: plain_signatures(t) for i, t in texts.items()}
    order = sorted(texts, reverse=True)
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for i, j in zip(order, order[1:] + order[:1]):
        n = len(texts[i])
        changed = texts[i][: n - n // 3] + texts[j][: n // 3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(sets[i], plain_signatures(changed))) and r["near_next"] == pytest.approx(like(sets[i], sets[j]))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (sets[i] == plain_signatures(changed))
    assert len(got) == len(data) and got[3]["fingerprint"] == got[60]["fingerprint"]
    from geoloom.llm.setjoin import set_classes, set_keys
    from geoloom.llm.spotsigs import signature_sets

    found = signature_sets(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    h1, h2 = set_keys("signatures")
    classes = found.withColumn("h1", h1).withColumn("h2", h2).join(set_classes(found, 0.8), ["h1", "h2"]).collect()
    assert {r["doc_id"]: r["class_id"] for r in classes} == dict(zip(texts, plain_set_classes([(i, sets[i]) for i in texts], 0.8)))


def test_spotsigs_are_local():
    from geoloom.llm.spotsigs import SPARSE, edited, likeness, signatures

    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in ("tion", "er", "an", "re") for b in ("st", "ou", "nd", "ing", "ble") for c in ("ka", "lo", "mi")]
    # the text has an anchor in 14 words, the edited one more than one in 12
    text = " ".join("the" if i % 14 == 0 else str(rng.choice(words)) for i in range(420))
    prose = " ".join("the" if i % 4 == 0 else str(rng.choice(words)) for i in range(420))
    changed = edited(text, prose)
    assert sum(w == "the" for w in text.split()) * SPARSE < len(text.split()) and sum(w == "the" for w in changed.split()) * SPARSE >= len(changed.split())
    assert likeness(signatures(text), signatures(changed)) > 0.3
    # a table set into prose leaves the signatures of the prose, and the other way round
    table = " ".join(rng.choice(words, 200))
    both = signatures(f"{prose} {table} {prose}")
    assert len(signatures(prose) & both) >= len(signatures(prose)) - 3 and len(signatures(table) & both) >= len(signatures(table)) - SPARSE - 3
    assert signatures("") == signatures(None) == frozenset() and all(signatures(t) for t in ("x", "the", "the of and"))
    assert signatures("the of") != signatures("of the")


# ---- 8 pieces


def test_pieces(spark):
    from geoloom.llm.pieces import MARK, _load, encode_decode
    from geoloom.llm.queries import piece_model

    processor, own = _load(piece_model())
    rng = np.random.default_rng(9)
    alphabet = list("abcdeXYZ 0123.,\n\t▁éß日😀\x00") + ["  ", "the ", "ing "]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(800)] + [r[1] or "" for r in rows()] + ["a" * 5000, MARK * 40, " " * 33]
    own.learn(texts)
    for t in texts:
        theirs = processor.encode(t)
        assert np.frombuffer(own.encode(t), np.int32).tolist() == theirs
        assert own.decode(theirs) == processor.decode(theirs)
        part = MARK + t.replace(" ", MARK)
        if t:
            assert own.agenda(part) == theirs
        if len(part) <= 400:  # the flat agenda is for short parts
            assert own.agenda(part) == own.short_agenda(part) == np.frombuffer(own.agendas([part, "x"])[0], np.int32).tolist()
    assert not own.differing
    got = encode_decode(awkward(spark), piece_model()).toPandas()
    assert got["agrees"].all() and len(got) == len(rows())
    assert encode_decode(empty(spark), piece_model()).count() == 0


# ---- 9 substrings


def plain_substrings(data, n):
    words = [(i, WORD.findall(t or "")) for i, t, *_ in data]
    big = 1 << 62
    first = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (big if i is None else i):
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,groups,rounds", [(13, 2_000_000, 4), (5, 20, 3), (3, 50, 1)])
def test_substrings(spark, n, groups, rounds):
    from geoloom.llm.substrings import dedup_substrings

    rng = np.random.default_rng(n)
    vocabulary = [f"w{i}" for i in range(12)]
    data = rows() + [(50 + i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))), None, None, 0) for i in range(60)] + [(60, "clash of ids w1 w2 w3 w4 w5 w6", None, None, 0)]
    df = spark.createDataFrame(data, DOCS).withColumn("runs", F.lit(1)).withColumn("grp", F.lit(2)).repartition(3)
    got = dedup_substrings(df, n, group_suffixes=groups, rounds=rounds).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == plain_substrings(data, n)
    for r in got:
        assert hashlib.sha256(" ".join(WORD.findall(r["deduped"] or "")).encode()).hexdigest() == r["kept_sha256"]
    assert dedup_substrings(empty(spark), n).count() == 0


def plain_repeats(data, n):
    """Windows of n words with the first place in the smallest document that has them, put together where both go on."""
    words = {i: WORD.findall(t or "") for i, t in data}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), (i, k))
    out = []
    for i, w in words.items():
        found = {k: first[tuple(w[k : k + n])] for k in range(len(w) - n + 1)}
        found = {k: s for k, s in found.items() if s[0] != i}
        for k, (j, at) in found.items():
            if found.get(k - 1) != (j, at - 1):
                m = 1
                while found.get(k + m) == (j, at + m):
                    m += 1
                out.append((i, k, m + n - 1, j, at))
    return sorted(out)


def test_maximal_repeats(spark):
    from geoloom.llm.substrings import maximal_repeats

    rng = np.random.default_rng(41)
    vocabulary = [f"w{i}" for i in range(9)]
    data = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 50))))) for i in range(50)]
    data += [(60 + i, f"{i} " + data[i][1] + " tail " + data[(i + 7) % 50][1]) for i in range(20)]
    got = maximal_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(4), 4, group_suffixes=40, rounds=2).collect()
    assert sorted((r["doc_id"], r["start"], r["words"], r["source_id"], r["source_start"]) for r in got) == plain_repeats(data, 4)
    assert maximal_repeats(empty(spark)).count() == 0


def test_substrings_with_colliding_digests_and_a_hot_prefix(spark, monkeypatch):
    from geoloom.llm import substrings as S
    from geoloom.llm import words as W

    counts = np.zeros(S.CODES, np.int64)
    counts[[5, 6, 7, 70_000, 200_000]] = [10, 1_000_000, 3, 40, 2]
    group, parts = S.group_prefixes(counts, 1000)
    assert parts[6] == 1000 and (np.delete(parts, 6) == 1).all()  # a hot three-word prefix goes on below
    used = {int(group[6]) + k for k in range(1000)}
    assert used.isdisjoint({int(group[c]) for c in (5, 7, 70_000, 200_000)}) and group[7] < group[70_000] + 1

    rng = np.random.default_rng(43)
    same = "the same head of words"
    data = [(i, f"{same} " + " ".join(f"{same} x{rng.integers(6)}" for _ in range(12)), None, None, 0) for i in range(40)]
    plain = plain_substrings(data, 8)
    df = spark.createDataFrame(data, DOCS).repartition(3)
    digest = lambda rows: sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=str)
    assert digest(S.dedup_substrings(df, 8, group_suffixes=50, rounds=2).collect()) == plain
    # the first half of the digests says nothing: the second tells sequences apart
    plan = S._Plan(8, np.zeros(S.CODES, np.int32), np.ones(S.CODES, np.int32), 1, False, False, 12345)
    monkeypatch.setattr(S, "sequence_hashes", lambda h, n, seed=1: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    texts = pa.array([t for _, t, *_ in data])
    chunk = S._Chunk(plan, 0)
    chunk.add(np.arange(40), np.zeros(40, np.int64), texts)
    rows = chunk.rows_out()
    found = np.zeros(40, np.int64)
    for g, payload in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        if g < 0:
            ids, _, n, place = S._unpack(payload, np.int64, np.int64, np.uint32, np.uint32)
            for i, p in zip(ids, np.split(place, np.cumsum(n)[:-1])):
                found[i] += S.covered([p], len(WORD.findall(data[i][1])), 8).sum()
    assert found.tolist() == [r[2] for r in sorted(plain)]
    # keyed hashes of words: equal for equal words, whatever stands around them
    w = W.Words(pa.array(["a bb ccc dddd", "dddd x" * 3 + " a bb", "é " + "y" * 5000 + " a"]))
    h = w.keyed_hashes(7)
    seen = {}
    raw = w.data.tobytes()
    for a, b, x in zip(w.start, w.end, h.tolist()):
        assert seen.setdefault(raw[a:b], x) == x
    assert len(set(seen.values())) == len(seen) and not set(seen.values()) & set(w.keyed_hashes(8).tolist())


# ---- 10 pages


def test_pages(spark):
    from geoloom.llm.pages import extract, main_text

    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div id="cookie-notice"><p>We use cookies, and more cookies, on this site.</p></div><aside><p>Side, bar</p></aside>
    <main><article><h1>Head &amp; line</h1><p>First,&nbsp;long   paragraph, with
    <a href=x>a link</a> inside.<p>Second one<br>goes on.<ul><li>item 1<li>item 2</ul><form><input><p>Sign up</p></form></article></main>
    <section class="comments"><p>Nice, really, nice, I say, very nice article, wow.</p></section><footer>&copy; me</footer></body></html>"""
    assert extract(page) == "Head & line\nFirst, long paragraph, with a link inside.\nSecond one goes on.\nitem 1\nitem 2"
    assert extract(None) == extract("") == extract("<script>x") == "" and extract("plain text") == "plain text"
    assert extract("<div><p>one</p><p>two" + "<b>" * 5000) == "one\ntwo"
    body = "<p>A long enough paragraph, with commas, to earn its points here.</p><p>And another one, short.</p>"
    for furniture in (
        '<div class="main-menu"><a href=1>One</a></div>', '<div id="sidebar-left"><p>Left, text, of, some, length, here.</p></div>', '<div class="ad-slot banner"><p>Buy, now, cheap.</p></div>', '<section class="post-comments"><p>I, too, think so, very much, indeed, yes.</p></section>',
        '<ul class="breadcrumbs"><li><a href=1>Home</a></li></ul>', '<div role="alert"><p>Notice, please.</p></div>', '<div style="display:none"><p>Hidden, text, here.</p></div>', '<form class="newsletter"><p>Sign, up.</p></form>', '<article class="comment"><p>Reader, says, so.</p></article>', "<noscript><p>Enable it.</p></noscript>",
        '<div class="related-posts"><h3>Related</h3><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div>', "<!-- <p>not this</p> -->", '<div hidden><p>nor, this.</p></div>',
    ):
        for page in (f"<body>{furniture}<article><h1>T</h1>{body}</article></body>", f'<body><div id="wrap"><div class="content has-sidebar" data-note="not hidden at all"><h1>T</h1>{body}{furniture}</div></div></body>', f'<div class="post"><div class="entry-header"><h1>T</h1></div><div class="entry-content">{body}</div></div>{furniture}'):
            assert extract(page) == "T\nA long enough paragraph, with commas, to earn its points here.\nAnd another one, short.", page
    for names in ("post long-form", "article-body share-enabled", "long-form", "sidebar-wrap", "entry-content comments-enabled"):  # no furniture, or all there is
        assert extract(f'<div class="{names}"><h1>T</h1>{body}</div>').endswith("And another one, short."), names
    assert extract('<div class="menu"><p>a, b, c.</p></div>') == extract('<div class="main-menu"><a href=1>One</a><a href=2>Two</a></div>') == ""
    links = "<ul><li><a href=1>ref one</a><li><a href=2>ref two</a><li><a href=3>ref three</a></ul>"
    assert extract(f"<article><h1>T</h1>{body}{links}</article>").endswith("ref one\nref two\nref three")
    assert extract("text > x <!-- unclosed > and <p>y") == "text > x" and extract("<p>a <!-- b") == "a"
    for deep in ("<div><p>some text, more ", "<div>", "<p>x</section>", "<b>x</i>", "<a ", "x <!-- ", '<a b="', "<li><div>"):
        began = time.process_time()
        extract(deep * 8000)
        assert time.process_time() - began < 5, deep
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, None), (None, "x", "<p>a < b &lt; c</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r["page_id"], r["text"]) for r in main_text(df).collect()}
    assert (2, "") in got and (None, "a < b < c") in got
    assert main_text(df.limit(0)).count() == 0
