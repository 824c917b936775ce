import math
import zlib
from collections import Counter

import numpy as np

from sylvane.llm import ctw, language_model as L


def test_log_gamma():
    x = np.concatenate([np.arange(0.5, 50, 0.5), [1e3, 1e6, 1e9]])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_kt_is_the_sequential_estimate():
    p, zeros, ones = 1.0, 0, 0
    for bit in (0, 1, 1, 1, 0, 1):
        p *= ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
        zeros, ones = zeros + (not bit), ones + bit
    assert np.isclose(np.exp(ctw.log_kt(np.array([2.0]), np.array([4.0])))[0], p)


def test_kt_of_large_counts():
    z, o = np.array([0.0, 3, 65_535, 65_536, 1e7]), np.array([0.0, 65_600, 1, 70_000, 3])
    assert np.allclose(ctw.log_kt(z, o), [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(z, o)], rtol=1e-7)


def test_documents(spark, odd_docs, odd_rows, no_docs):
    rows = L.language_scores(odd_docs).collect()
    counts, total = Counter(), 0
    words = [((t or "").encode().lower().split(), d) for d, t, *_ in odd_rows]
    for w, d in words:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            counts.update([*w, None])
    total, kinds = sum(counts.values()), len(counts)
    expected = {}
    for w, d in words:
        tokens = [*w, None]
        score = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        expected[d] = (len(tokens), sum(counts[t] > 0 for t in tokens), total, score)
    assert len(rows) == len(odd_rows)
    for r in rows:
        n, known, train, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, train) and math.isclose(r["base_score"], score, rel_tol=1e-9)
        assert r["score"] < 0 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    assert L.language_scores(no_docs).count() == 0


def test_rare_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 5)
    docs = spark.createDataFrame([(i, f"common words and rare{i % 7} ones{i}") for i in range(60)], "doc_id long, text string")
    few = {r["doc_id"]: r for r in L.language_scores(docs).collect()}
    monkeypatch.undo()
    many = {r["doc_id"]: r for r in L.language_scores(docs).collect()}
    assert all(few[i]["n_known"] == many[i]["n_known"] and math.isclose(few[i]["base_score"], many[i]["base_score"]) for i in many)


def test_better_than_unigrams_on_held_out_documents(spark):
    found = L.language_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum()
