import math
import zlib

import numpy as np

from sylvane.llm import ctw, language_model as L


N = ctw.DEPTH


def brute(texts, context, byte):
    """log10 probability of a byte after ``N`` others, by plain recursion over all contexts that were met."""
    seen = [(bytes([255] * N) + t + b"\xff")[i : i + N + 1] for t in texts for i in range(len(t) + 1)]

    def counts(suffix, level, prefix):
        bits = [s[N] >> (7 - level) & 1 for s in seen if s[:N].endswith(suffix) and s[N] >> (8 - level) == prefix]
        return len(bits) - sum(bits), sum(bits)

    def own(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def product(suffix, level, prefix):
        kids = {s[N - 1 - len(suffix) : N] for s in seen if s[:N].endswith(suffix) and s[N] >> (8 - level) == prefix}
        return sum(weighted(k, level, prefix) for k in kids)

    def weighted(suffix, level, prefix):
        o = own(*counts(suffix, level, prefix))
        return o if len(suffix) == N else np.logaddexp(o, product(suffix, level, prefix)) - math.log(2)

    log = 0.0
    for level in range(8):
        prefix, p = byte >> (8 - level), 0.5
        for depth in range(N, -1, -1):
            suffix = context[N - depth :]
            z, o = counts(suffix, level, prefix)
            if z + o == 0:
                continue
            estimate = (o + 0.5) / (z + o + 1)
            deeper = depth < N and sum(counts(context[N - 1 - depth :], level, prefix))
            trust = 1 / (1 + math.exp(product(suffix, level, prefix) - own(z, o))) if deeper else 1
            p = trust * estimate + (1 - trust) * p
        log += math.log10(p if byte >> (7 - level) & 1 else 1 - p)
    return log


def brute_text(texts, text):
    padded = bytes([255] * N) + text + b"\xff"
    return sum(brute(texts, padded[i : i + N], padded[i + N]) for i in range(len(text) + 1))


def scores(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = L.language_scores(docs).collect()
    assert all(math.isclose(r["bits_per_byte"], -r["score"] / math.log10(2) / (len(texts[r["doc_id"]].encode()) + 1)) for r in rows)
    return {r["doc_id"]: r["score"] for r in rows}


TEXTS = ["abracadabra", "banana bandana", "слово и дело", "дело слова", "日本語の本", "abc", "日本", "", "зебра", "bandabra", "日語", "xyz"]


def test_scores_are_those_of_all_contexts_and_whole_bytes(spark, monkeypatch):
    data = [t.encode() for t in TEXTS]
    training = [t for i, t in enumerate(data) if zlib.crc32(str(i).encode()) % 10]
    expected = [brute_text(training, t) for t in data]
    assert len(training) < len(data)
    for head in (1 << 20, 5, 0):  # all, few and no contexts broadcast
        monkeypatch.setattr(L, "GRAM_HEAD", head)
        found = scores(spark, TEXTS)
        assert np.allclose([found[i] for i in range(len(data))], expected, rtol=1e-9), head


def test_documents_in_many_blocks_and_buckets(spark, monkeypatch):
    """Blocks of two documents, contexts handed on after every few: the same sums."""
    monkeypatch.setattr(L, "GRAM_HEAD", 5)
    expected = scores(spark, TEXTS * 3)
    monkeypatch.setattr(L, "BLOCK_ROWS", 2)
    monkeypatch.setattr(L, "GATHERED_GRAMS", 10)
    found = scores(spark, TEXTS * 3)
    assert all(math.isclose(found[i], expected[i]) for i in expected)


def test_bytes_of_a_context_add_up_to_one():
    codes, n = ctw.counted(np.concatenate([ctw.grams(t.encode()) for t in TEXTS]))
    context = codes[len(codes) // 2] >> np.uint64(8)
    asked = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    codes, n = ctw.counted(np.concatenate([codes, asked]), np.concatenate([n, np.zeros(256, np.int64)]))
    ordered = ctw.tree_order(codes)
    order = np.argsort(ordered)
    logs = ctw.log_probabilities(ordered[order], n[order], ctw.upper(*ctw.contributions(ordered[order], n[order])))
    own = np.isin(codes[order], asked)
    assert own.sum() == 256 and np.isclose((10.0 ** logs[own]).sum(), 1)
