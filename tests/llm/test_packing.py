import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sylvane.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    return tokens.load_encoder(PATH)


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(PATH)


@given(text=st.text(max_size=80) | st.text(st.characters(max_codepoint=0x24F), max_size=80))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_library(encode, exact, text):
    assert encode([text]) == [exact.encode(text, add_special_tokens=False).ids]


def test_every_low_character_in_context(encode, exact):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}\n" for c in range(0x24F)]
    assert encode(texts) == [exact.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("unit", ["\n", " ", "\t", "x", "7", "#", "-=", "ab c\n"])
def test_long_runs(encode, exact, unit):
    text = "a " + unit * ((1_200_000 if unit.isspace() else 100_000) // len(unit)) + "b"
    assert encode([text]) == [exact.encode(text, add_special_tokens=False).ids]


def test_ten_megabytes_of_white_space(encode):
    (ids,) = encode(["a" + "\n" * 10_000_000])
    assert len(ids) > 1_000_000 and len(set(ids[5:-5])) == 1


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan_places_everything_and_is_near_the_bound(histogram):
    made = packing.plan(histogram, 64)
    placed: dict[int, int] = {}
    for n, times in made:
        assert sum(k * v for k, v in times.items()) <= 64
        for k, v in times.items():
            placed[k] = placed.get(k, 0) + n * v
    assert placed == histogram
    counts = np.zeros(65, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    best_fit = sum(n for n, _ in packing.best_fit(counts, 64))
    assert sum(n for n, _ in made) <= best_fit + 1 + best_fit // 40


def test_best_fit_is_that_of_single_documents():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 65, 500).tolist(), reverse=True)
    free: list[int] = []
    for n in lengths:
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(64 - n)
    counts = np.bincount(lengths, minlength=65)
    assert sum(n for n, _ in packing.best_fit(counts, 64)) == len(free)


def test_nnls_solves_an_exact_case():
    columns = np.array([[1, 3, 0], [2, 2, 0], [1, 1, 2]])
    x = packing.nnls(columns, np.array([0, 700, 2000, 100]), np.ones(4))
    assert np.allclose(x, [100, 850, 300], atol=1)


def test_packed_documents(spark, exact, odd_docs, odd_rows):
    found = packing.pack_documents(odd_docs, PATH, 2, 128).toPandas()
    expected = []
    for doc_id, text, *_ in odd_rows:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 128 or 128, len(ids), 128), len(ids)]
        expected += [(doc_id, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    got = [(None if d != d else int(d), p, s, n, bytes(i)) for d, p, s, n, i in zip(found.doc_id, found.piece, found.start, found.length, found.ids)]
    assert sorted(got, key=key) == sorted(expected, key=key)
    rows = found.sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id").length.cumsum()
    assert (ends - rows.length == rows.offset).all() and ends.max() <= 128
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 128) + 2


def test_digest_and_empty_table(spark, odd_docs, no_docs):
    one = packing.pack_documents(odd_docs, PATH, 2, digest=True).where("doc_id = 3").first()
    ids = [*Tokenizer.from_file(PATH).encode("word", add_special_tokens=False).ids, 2]
    assert one["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packing.pack_documents(no_docs, PATH, 2).count() == 0
