import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sylvane.llm import quality_model as M


def test_pairs_order_the_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = M.quality_scores(docs, labels).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    assert (found.predicted == (found.score >= 0.3)).all()
    joined = found.merge(labels.toPandas(), on="doc_id")
    held = joined[joined.held_out]
    good, bad = (held[held.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (held.predicted == held.quality).mean() > 0.95


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").toPandas()
    flipped = labels.assign(quality=[1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q for i, q in zip(labels.doc_id, labels.quality)])
    a, b = (M.quality_scores(docs, spark.createDataFrame(x)).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, flipped))
    assert np.allclose(a, b)


def test_gradient_vanishes_at_the_fit():
    """The loss, written as a sum over single pairs, is at its least: every small step makes it larger."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, len(M.FEATURES)))
    good = x[:, 0] + 0.5 * rng.normal(size=120) > -1
    model = M.fit(x, good, partners=3, ridge=1e-2)
    z = (x - x.mean(0)) / x.std(0)
    better, worse = [i for i in range(120) if good[i]], [i for i in range(120) if not good[i]]
    partners = max(3, -(-len(better) // len(worse)))
    pairs = [(better[(k * partners + j) % len(better)], w) for k, w in enumerate(worse) for j in range(partners)]
    assert {b for b, _ in pairs} == set(better)

    def loss(w):
        return sum(math.log1p(math.exp(-float(w @ (z[b] - z[c])))) for b, c in pairs) / len(pairs) + 0.5e-2 * float(w @ w)

    best = np.array(model.weights)
    for i in range(len(best)):
        for h in (-1e-3, 1e-3):
            step = np.zeros(len(best))
            step[i] = h
            slope = (loss(best + step) - loss(best - step)) / (2 * h)
            assert loss(best + step) > loss(best) and abs(slope) < 1e-6
    worth = z @ best
    assert (worth[good][:, None] > worth[~good][None, :]).mean() > 0.9 and model.weights[0] == max(model.weights)


def plain_features(text):
    """The features once more, character by character."""
    words = text.split()
    if not words:
        return [0.0] * 18
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    is_upper = lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×"
    letters = sum(c == "_" or c.isalnum() for c in text) - sum(c == "_" or c.isdecimal() for c in text)
    symbol_words, at = 0, 0
    while at < chars:  # runs of two and more symbols before a space or the end, or of | # * between spaces
        run = at
        while run < chars and text[run] in "#*$%&|<>":
            run += 1
        if run - at >= 2 and (run == chars or text[run].isspace()):
            symbol_words, at = symbol_words + 1, run + (run < chars)
            continue
        begin = at if at == 0 else None
        if text[at].isspace():
            begin = at + 1
        if begin is not None:
            run = begin
            while run < chars and text[run] in "|#*":
                run += 1
            if run > begin and run < chars and text[run].isspace():
                symbol_words, at = symbol_words + 1, run
                continue
        at += 1
    bangs, at = 0, text.find("!!")
    while at >= 0:
        bangs, at = bangs + 1, text.find("!!", at + 2)
    cut = lambda a, b: min(1.0, a / max(1, b))
    most = max(words.count(w) for w in set(words))
    return [
        math.log(1 + n) / 10, cut(sum(c in "#*$%&|<>{}[]\\^~_=+@" for c in text), chars) ** 0.5, cut(symbol_words, n) ** 0.5, cut(bangs, n) ** 0.5,
        cut(sum(map(is_upper, text)), letters) ** 0.5, cut(sum(c in "0123456789" for c in text), chars) ** 0.5, cut(sum(c == "|" for c in text), n) ** 0.5,
        cut(sum(c in ".,;:?" for c in text), n), len(set(words)) / n, cut(sum(words[i] == words[i + 1] for i in range(n - 1)), n) ** 0.5,
        min(20.0, sum(map(len, words)) / n) / 20, cut(sum(len(w) > 20 for w in words), n), cut(sum(len(w) < 3 for w in words), n),
        math.log(1 + chars / max(1, len(lines))) / 10, cut(sum(x.rstrip()[-1] in '.!?…"”' for x in lines), len(lines)),
        (len(lines) - len(set(lines))) / max(1, len(lines)), most / n, cut(sum(ord(c) > 127 for c in text), chars),
    ]


def test_features_one_by_one(odd_texts):
    rng = np.random.default_rng(4)
    texts = [t for t in odd_texts if t and len(t) < 30_000]
    texts += ["".join(rng.choice(list("aB é.,!!#*| |\n7×Þ_=\"”日"), 60)) for _ in range(300)]
    for t in texts:
        assert np.allclose(M.features(t), plain_features(t)), t[:80]


def test_repeated_ids_and_the_bound_on_rows(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} with words " * (i % 7 + 1)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    a, b = (M.learn_documents(d, labels) for d in (docs, docs.orderBy(F.desc("text")).repartition(5)))
    assert np.allclose(a.weights, b.weights)
    chosen = [r["doc_id"] for r in M.training_labels(labels, most=10).collect()]
    hashed = spark.range(40).where(~M.held_out(F.col("id"))).orderBy(F.xxhash64("id")).limit(10).collect()
    assert sorted(chosen) == sorted(r["id"] for r in hashed)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(3, 0, 0), (4, 1, 0), (4, 1, 0), (5, 1, None), (6, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert M.quality_scores(odd_docs, labels).count() == len(odd_rows)
    none = M.quality_scores(odd_docs, labels.where("false")).toPandas()
    assert len(none) == len(odd_rows) and (none.predicted == 1).all()
    assert M.quality_scores(no_docs, labels).count() == 0
    assert M.features("") == [0.0] * len(M.FEATURES) == M.features(" \n")
    assert pd.Series(M.features("word " * 50_000)).notna().all()


def test_all_labels_are_learned_from(spark):
    """Over 20,000 labelled rows, as spread out: the same model as by one array of all of them, and more labels change it."""
    rng = np.random.default_rng(2)
    n = 30_000
    x = rng.normal(size=(n, len(M.FEATURES))).round(2)
    x[:, 3] = 0.25
    good = x[:, 0] + rng.normal(size=n) > -1
    found = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "x": x.tolist()}), "doc_id long, x array<double>").repartition(7)
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "quality": good.astype(int)}), "doc_id long, quality int")
    chosen = M.training_labels(labels)
    own = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(n)])
    assert chosen.count() == own.sum() > 20_000
    model, plain = M.learn(found, chosen), M.fit(x[own], good[own])
    assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(model, plain))
    assert not np.allclose(model.weights, M.learn(found, M.training_labels(labels, most=20_000)).weights, rtol=1e-6)


def test_chunks_of_pairs(spark, monkeypatch):
    """Few of one kind, chunks smaller than the good rows, equal worths: as by one array."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(M, "CHUNK", 64)
    for n, bad in ((300, 1), (300, 299), (300, 40), (2, 1), (200, 100)):
        x = rng.integers(0, 3, size=(n, len(M.FEATURES))) / 2.0
        if bad == 100:
            x[:] = 0.5
        good = rng.permutation(n) >= bad
        rows = spark.createDataFrame([(i, x[i].tolist(), bool(good[i])) for i in range(n)], "doc_id long, x array<double>, good boolean").repartition(3)
        assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(M.fit_rows(rows), M.fit(x, good))), (n, bad)
