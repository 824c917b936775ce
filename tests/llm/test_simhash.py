import numpy as np
import xxhash
from pyspark.sql import functions as F

from sylvane.llm import simhash as S
from sylvane.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def roots(n, links):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


def test_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    for c in centres.tolist():
        fps.add(c)
        for _ in range(40):
            f = c
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                f ^= 1 << b
            fps.add(f)
    values = np.array(sorted(fps), np.uint64)
    signed = values.view(np.int64).tolist()
    df = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    expected = {tuple(sorted((signed[i], signed[j]))) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    for blocks in (5, 6):
        found = [(r["a"], r["b"]) for r in S.near_pairs(df, blocks=blocks).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(600, 600 + i) for i in range(1, 50)]
    df = spark.createDataFrame([*links, (7, None), (None, 8), (3, 3)], "a long, b long")
    expected = roots(700, links)
    found = {r["node"]: r["root"] for r in components(df).collect()}
    assert found == {n: expected[n] for n in {x for link in links for x in link if link[0] != link[1]}}
    assert components(df.where("false")).count() == 0


def test_documents(spark, odd_docs, odd_rows, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in odd_rows]
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    ids_of = {r: [odd_rows[i][0] for i in range(len(fps)) if root[i] == r and odd_rows[i][0] is not None] for r in set(root)}
    least = {r: min(found, default=None) for r, found in ids_of.items()}
    key = lambda r: tuple(-1 if x is None else x for x in r)
    expected = sorted(((odd_rows[i][0], int(np.uint64(fps[i]).astype(np.int64)), least[root[i]]) for i in range(len(fps))), key=key)
    assert sorted(map(tuple, rows), key=key) == expected
    kept = S.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r[0] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({d for d, _, c in expected if d is not None and d == c}) and ids.count(None) == 1
    assert len(ids) == len(set(root))
    assert S.near_duplicates(no_docs).count() == 0 and S.drop_near_duplicates(no_docs).count() == 0


def test_one_id_with_several_texts_loses_none(spark):
    long_ = "one two three four five six seven eight nine ten " * 3
    texts = [(1, long_), (1, "quite another text about rivers and boats"), (2, long_), (1, long_), (None, "no id here at all"), (None, "no id here at all"), (None, None), (5, " "), (6, "")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(texts)], "doc_id long, text string, row int")
    kept, again = (sorted((r["doc_id"] or 0, r["text"], r["row"]) for r in S.drop_near_duplicates(rows).collect()) for rows in (docs, docs.orderBy(F.desc("row")).coalesce(2)))
    assert kept == again and [r[:2] for r in kept] == [(0, "no id here at all"), (1, long_), (1, "quite another text about rivers and boats"), (5, " ")]


def test_pivots_discard_most_bucket_mates(spark):
    """Of random fingerprints that share a bucket, the distances to the pivots tell all but a few apart before any bit is compared."""
    rng = np.random.default_rng(9)
    mask = int(np.uint64(S._masks(5, 2)[0] & (1 << 64) - 1))
    values = (rng.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(~mask & (1 << 64) - 1)).view(np.int64).tolist()
    rows = spark.createDataFrame([(v,) for v in values], "fp long").select("fp", *S.pivot_table(F.col("fp"), S.reference_fingerprints()))
    pairs = rows.alias("a").join(rows.alias("b"), F.col("a.fp") < F.col("b.fp"))
    passed = pairs.where(S._within("a", "b", 2, S.PIVOTS, 3)).count()
    assert passed < 0.05 * pairs.count()


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(2000))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "CHUNK", 100)
    assert S.fingerprint(text.encode()) == whole == brute_fingerprint(text)
