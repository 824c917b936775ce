"""What keeps queries whole on larger tables: work done once, neighbours and clusters that don't depend on blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sylvane.functions import text as T
from sylvane.operators import baselines, blocks, build, knn, models, pairs, sampling
from sylvane.session import ensure_checkpoint_dir


def test_tokens_of_ngrams_are_computed_once(spark):
    df = spark.createDataFrame([("a b  c a b",), ("",), ("one",)], "t string")
    made = df.select(T.ngrams_up_to(T.words(F.col("t")), 2).alias("g"))
    assert [sorted(r["g"]) for r in made.collect()] == [["a", "a b", "b", "b c", "c", "c a"], [], ["one"]]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_lists_of_the_best_over_parts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 2)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 300")
    many = rows.unionByName(rows.withColumn("vec_id", F.col("vec_id") + 1000))  # every vector twice, so ties
    got = knn.knn(many, many, 7, size=64)
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in many.collect()}
    ids = np.array(sorted(x))
    sims = np.stack([x[i] for i in ids]) @ np.stack([x[i] for i in ids]).T
    np.fill_diagonal(sims, -np.inf)
    best = np.lexsort((np.broadcast_to(ids, sims.shape), -sims.round(9)), axis=1)[:, :7]
    assert sorted((r["src"], r["rank"], r["dst"]) for r in got.where("rank < 8").collect() if r["rank"] == 1) == sorted((int(i), 1, int(ids[b[0]])) for i, b in zip(ids, best))
    assert np.allclose([r["sim"] for r in got.orderBy("src", "rank").collect()], np.take_along_axis(sims, best, 1).ravel())


def test_blocks_are_shuffled_once(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    made = pairs.cosine_pairs(rows, "vec_id", "embedding")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # blocks are not copied for each other one
    n = rows.count()
    side = blocks.packed(rows, "vec_id", "embedding", size=64)
    met = blocks.block_pairs(side, side, lambda a, b: pd.DataFrame({"n": [len(a[0])]}), "n long", once=True).count()
    assert made.count() == made.select("i", "j").distinct().count() == n * (n - 1) // 2 and met == side[1] * (side[1] + 1) // 2


def test_density_clusters_over_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (70, 3)) for c in (0, 4, 9)] + [rng.uniform(-20, 20, (30, 3))])
    rows = spark.createDataFrame([(i * 7, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    for samples in (1, 4):
        whole = baselines.density_labels(x, 5, samples)
        got = {r["doc_id"] // 7: r["cluster"] for r in baselines.density_clusters(rows, 5, samples, size=16).collect()}
        assert [got[i] for i in range(len(x))] == whole.tolist() and whole.max() > 1
    assert {r["cluster"] for r in baselines.density_clusters(rows.limit(3)).collect()} == {-1}


def test_density_clusters_of_many_rows(spark):
    ensure_checkpoint_dir(spark)
    rows = spark.range(10_002).select(F.col("id").alias("doc_id"), F.array(F.col("id") % 2 * 100 + F.randn(3), F.randn(4)).alias("embedding")).checkpoint()
    got = baselines.density_clusters(rows, 200, 1)
    assert got.select("doc_id").distinct().count() == got.count() == 10_002
    sides = got.where("cluster >= 0").select("cluster", (F.col("doc_id") % 2).alias("side")).distinct()
    assert sides.count() == sides.select("cluster").distinct().count() >= 2  # no cluster has rows of both sides


def test_large_nodes_with_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(build, "DENSE_NODE", 8)  # so the nodes are spread over the cluster
    docs = spark.createDataFrame([(i, "" if i in (3, 17) else f"{'cats purr' if i % 2 else 'dogs bark'} number {i % 5}") for i in range(30)], "doc_id long, text string")
    vectors = models.embed_documents(docs, models.HashingEmbedder(32))
    for config in (build.TreeConfig(max_depth=1, split="kmeans", nli_overrides_kmeans=False, max_retries=0, medoids_per_cluster=2), build.TreeConfig(max_depth=1, max_retries=0, select=sampling.SamplingConfig("kmeans", 4))):
        nodes, at = build.build_tree(docs, vectors, config)
        assert at.where("node_id = ''").count() == 30 and sum(r["n_docs"] for r in nodes.where("depth = 1").collect()) in (0, 30)
    nothing = vectors.where("doc_id in (3, 17)")
    assert {r["cluster"] for r in sampling.kmeans_clusters(nothing, 2, "doc_id").collect()} == {0}
    assert sampling.sample_ids(nothing, sampling.SamplingConfig("kmeans", 2), "doc_id") == [3]


def test_large_nodes_compare_equal_vectors_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, (40, 3)).astype(float)[rng.integers(0, 40, 300)]  # at most 27 vectors, with many ties between them
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(300) * 3, x)], "doc_id long, embedding array<double>").repartition(3).checkpoint()
    count = len(np.unique(x, axis=0))
    whole = knn.knn(rows, rows, 5, "doc_id", "embedding").collect()
    met = []

    def watched(left, right, *more, plain=knn.block_rows, **named):
        met.append(left[0].agg(F.sum(F.length("vectors"))).first()[0] // 24)
        return plain(left, right, *more, **named)

    monkeypatch.setattr(knn, "block_rows", watched)
    for held in (2, 32):  # in several parts of the right side, and in one
        monkeypatch.setattr(blocks, "HELD", held)
        lists = knn.distinct_lists(rows, 5, count, "doc_id", "embedding", size=5)
        assert sorted(knn.listed(lists, 5).collect()) == sorted(whole)
    frontier = rows.select(F.lit("").alias("node_id"), "doc_id")
    lists = build.Neighbours(rows, build.TreeConfig(n_neighbors=5)).of(frontier, "", 300)
    assert sorted(knn.listed(lists, 5).collect()) == sorted(whole)
    assert met == [count] * 3
    few = rows.where("doc_id < 12")
    assert sorted(knn.listed(knn.distinct_lists(few, 5, 4, "doc_id", "embedding"), 5).collect()) == sorted(knn.knn(few, few, 5, "doc_id", "embedding").collect())


def test_texts_outside_a_sample_are_not_joined(spark, monkeypatch):
    rows = spark.range(900).select(F.when(F.col("id") < 600, "L").otherwise("R").alias("node_id"), F.col("id").alias("doc_id")).checkpoint()
    for ranked in (build.RANKED_SAMPLE, 20):
        monkeypatch.setattr(build, "RANKED_SAMPLE", ranked)
        quotas = [("L", 60, 600), ("R", 30, 300)]
        table = spark.createDataFrame(quotas, "node_id string, quota int, size long")
        drawn = {r["doc_id"] for r in build._first(rows, table, "nli42").collect()}
        kept = {r["doc_id"] for r in rows.where(build._may_be_first(quotas, "nli42")).collect()}
        assert drawn <= kept and len(kept) < 600
    assert rows.where(build._may_be_first([(str(i), 1, 9) for i in range(9)], "nli42")).count() == 900
