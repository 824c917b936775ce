"""Queries over embeddings: neighbours, propagation, samples, trees and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvane.operators import infer, knn, metrics, pairs, reports, sampling, tree
from sylvane.plans.text_queries import read

DEPTH = 2


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


def rounded(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def pairwise_cosine(spark, sf_dir):
    return rounded(pairs.cosine_pairs(vectors(spark, sf_dir), "vec_id", "embedding"), "sim")


def semantic_pooled(spark, sf_dir):
    return rounded(pairs.semantic_similarity(vectors(spark, sf_dir), "embedding"), "mean", "std")


def semantic_by_label(spark, sf_dir):
    return rounded(pairs.semantic_similarity(vectors(spark, sf_dir), "embedding", ["label"]), "mean", "std")


def graph(spark, sf_dir, k=10):
    return knn.knn_graph(vectors(spark, sf_dir), k)


def knn_graph(spark, sf_dir):
    return rounded(graph(spark, sf_dir), "distance")


def affinity_edges(spark, sf_dir):
    return rounded(knn.affinity(graph(spark, sf_dir)), "w")


def adaptive_sigma(spark, sf_dir):
    return rounded(knn.adaptive_sigma(graph(spark, sf_dir)), "sigma")


def seeds_of(rows):
    return rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("doc_id"), "label")


def label_propagation(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return knn.label_propagation(rows, seeds_of(rows), k=10, max_iter=10, tol=None)


def label_propagation_converged(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return knn.label_propagation(rows, seeds_of(rows), k=10, alpha=0.5, max_iter=30)


def knn_classifier(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return knn.knn_classify(rows, rows)  # each row by the others


def index_top_k(spark, sf_dir):
    """The searches of every row whose id is divisible by 100, against all rows."""
    rows = vectors(spark, sf_dir)
    return rounded(knn.knn(rows.where("vec_id % 100 = 0"), rows, 20), "sim")


def lsh_neighbours(spark, sf_dir):
    return knn.ivf_knn(vectors(spark, sf_dir), 10)


def votek_votes(spark, sf_dir):
    return sampling.vote_counts(sampling.votes(vectors(spark, sf_dir), 15))


def votek_sample(spark, sf_dir):
    chosen = sampling.vote_k(sampling.votes(vectors(spark, sf_dir), 15), 8)
    return spark.createDataFrame(list(enumerate(chosen)), "pick int, doc_id long")


def random_sample(spark, sf_dir):
    return sampling.random_sample(vectors(spark, sf_dir), 0.1, 42).select("vec_id")


def stratified_split(spark, sf_dir):
    return sampling.stratified_split(vectors(spark, sf_dir), "label").select("vec_id", "is_train")


def medoids_by_label(spark, sf_dir):
    return sampling.medoids(vectors(spark, sf_dir), "label")


def kmeans_sample(spark, sf_dir):
    return sampling.kmeans_sample(vectors(spark, sf_dir), 14)


def two_means(spark, sf_dir):
    return sampling.kmeans_clusters(vectors(spark, sf_dir), 2).groupBy("cluster").agg(F.count("*").alias("n"))


# --- the halving tree over the labels --------------------------------------------------------


def members(spark, sf_dir, max_depth=10):
    return tree.halving_members(vectors(spark, sf_dir), max_depth, 1, "vec_id", "label")


def labels(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "label")


def pruned(spark, sf_dir):
    at = members(spark, sf_dir)
    return tree.prune(tree.nodes_of(at), DEPTH), at


def clustered(spark, sf_dir):
    """Documents with the leaf of the pruned tree as their cluster."""
    nodes, at = pruned(spark, sf_dir)
    return metrics.assign_clusters(nodes, at)


def with_label(spark, sf_dir):
    return clustered(spark, sf_dir).join(labels(spark, sf_dir), "doc_id")


def with_vector(spark, sf_dir):
    return clustered(spark, sf_dir).join(vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


def predicted(spark, sf_dir):
    return metrics.majority(clustered(spark, sf_dir), labels(spark, sf_dir))


def halving_tree_nodes(spark, sf_dir):
    return tree.nodes_of(members(spark, sf_dir)).drop("question")


def noisy_tree_membership(spark, sf_dir):
    """The same where every seventh row is noise."""
    noisy = vectors(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")))
    return tree.halving_members(noisy, 10, 1, "vec_id", "label").select("node_id", "doc_id")


def measured_nodes(spark, sf_dir):
    """The halving tree's nodes with split metrics made of their sizes."""
    kinds = {"success": F.col("n_docs") > 0} | {m: ((F.col("n_docs") + i) % (7 + i)).cast("int" if m in tree.WHOLE else "double") for i, m in enumerate(tree.SPLIT_METRICS) if i}
    return tree.nodes_of(members(spark, sf_dir)).withColumn("metrics", F.struct(*[kinds[m].alias(m) for m in tree.SPLIT_METRICS]))


def split_metrics_sum(spark, sf_dir):
    return reports.split_metrics_sum(measured_nodes(spark, sf_dir))


def tree_statistics(spark, sf_dir):
    made = reports.tree_statistics(measured_nodes(spark, sf_dir))
    return rounded(made, *reports.AVERAGED)


def halving_tree_membership(spark, sf_dir):
    return members(spark, sf_dir).select("node_id", "doc_id")


def prune_tree(spark, sf_dir):
    return pruned(spark, sf_dir)[0].select("node_id", "n_docs", "is_leaf")


def tree_structure(spark, sf_dir):
    return tree.structure(tree.nodes_of(members(spark, sf_dir)))


def leaf_sizes(spark, sf_dir):
    made = tree.leaf_sizes(pruned(spark, sf_dir)[0])
    return rounded(made.withColumn("sizes", F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",")), "mean", "std", "relative_std")


def find_leaf(spark, sf_dir):
    at = members(spark, sf_dir)
    return tree.find_leaf(tree.nodes_of(at), at)


def sample_documents(spark, sf_dir):
    return tree.sample_documents(members(spark, sf_dir))


def text_dump(spark, sf_dir):
    made = members(spark, sf_dir)
    return tree.text_dump(tree.nodes_of(made), made)


def path_documents(spark, sf_dir):
    """Three documents of its leaf for each row, whose path is the one to it."""
    made = members(spark, sf_dir)
    leaves = tree.nodes_of(made).where("is_leaf").select("node_id")
    paths = made.join(leaves, "node_id", "left_semi").select(F.col("doc_id").alias("path_no"), "node_id")
    return infer.path_documents(paths, made, 3)


def union_reports(spark, sf_dir):
    whole, cut = tree.nodes_of(members(spark, sf_dir)), pruned(spark, sf_dir)[0]
    return reports.union_reports({"whole": tree.structure(whole), "pruned": tree.structure(cut)})


def union_samples(spark, sf_dir):
    parts = stratified_split(spark, sf_dir)
    side = lambda flag: parts.where(F.col("is_train") == flag).select("vec_id")
    return reports.union_samples(side(True), side(False))


def size_points(spark, sf_dir):
    return reports.size_points(tree.nodes_of(members(spark, sf_dir)), "depth")


def dot_labels(spark, sf_dir):
    return tree.node_labels(tree.nodes_of(members(spark, sf_dir)))


def tree_layout(spark, sf_dir):
    return tree.layout(tree.nodes_of(members(spark, sf_dir)))


def cluster_assignment(spark, sf_dir):
    return clustered(spark, sf_dir).select("doc_id", "cluster")


def contingency(spark, sf_dir):
    return metrics.contingency(with_label(spark, sf_dir))


def nmi_all(spark, sf_dir):
    made = metrics.nmi(metrics.contingency(with_label(spark, sf_dir)))
    return rounded(made, *made.columns)


def homogeneity(spark, sf_dir):
    made = metrics.homogeneity(metrics.contingency(with_label(spark, sf_dir)))
    return rounded(made, *made.columns)


def ari(spark, sf_dir):
    return rounded(metrics.ari(metrics.contingency(with_label(spark, sf_dir))), "ari")


def majority_labels(spark, sf_dir):
    return predicted(spark, sf_dir)


def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(predicted(spark, sf_dir)), "accuracy")


def f1_all(spark, sf_dir):
    made = metrics.f1(predicted(spark, sf_dir))
    return rounded(made, *made.columns)


def classification_report(spark, sf_dir):
    return rounded(metrics.per_class(predicted(spark, sf_dir)), "precision", "recall", "f1")


def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predicted(spark, sf_dir))


def leaf_purity(spark, sf_dir):
    return rounded(metrics.leaf_purity(with_label(spark, sf_dir)), "purity", "entropy")


def purity_summary(spark, sf_dir):
    made = metrics.purity_summary(with_label(spark, sf_dir))
    return rounded(made, *made.columns[1:])


def isolation_depth(spark, sf_dir):
    return metrics.isolation_depth(members(spark, sf_dir), labels(spark, sf_dir))


def exploratory_power(spark, sf_dir):
    nodes, at = pruned(spark, sf_dir)
    made = metrics.exploratory_power(nodes, at, labels(spark, sf_dir))
    return rounded(made, *[c for c in made.columns if not c.startswith("n_")])


def leaf_bundle(spark, sf_dir):
    made = reports.leaf_bundle(with_label(spark, sf_dir))
    return rounded(made, *made.columns)


def tree_report(spark, sf_dir):
    made = reports.evaluate(tree.nodes_of(members(spark, sf_dir)), members(spark, sf_dir), labels(spark, sf_dir), DEPTH)
    return rounded(made, *[c for c, t in made.dtypes if t == "double"])


def silhouette(spark, sf_dir):
    return rounded(metrics.silhouette(with_vector(spark, sf_dir)), "silhouette")


def davies_bouldin(spark, sf_dir):
    return rounded(metrics.davies_bouldin(with_vector(spark, sf_dir)), "davies_bouldin")


def calinski_harabasz(spark, sf_dir):
    return rounded(metrics.calinski_harabasz(with_vector(spark, sf_dir)), "calinski_harabasz")


def child_parent(spark, sf_dir):
    return rounded(metrics.child_parent(members(spark, sf_dir), vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding")), "similarity", "uniqueness")


def vector_histogram(spark, sf_dir):
    return reports.histogram(vectors(spark, sf_dir).select(F.element_at("embedding", 1).cast("double").alias("x")), "x", 30)


def token_usage(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.length("text").alias("i"), (F.length("text") % 97).alias("o"), (F.col("turn") * 10 + F.length("text")).alias("ms"))
    return rounded(reports.usage(rows, "i", "o", "ms"), "tokens_per_node", "corr_tokens_time")


def experiment_grid(spark, sf_dir):
    return reports.experiment_grid(spark, model=["gpt-oss", "gpt-4o"], sampler=["votek", "kmeans"], dataset=["wikipedia", "bills"])


# --- SQL ---------------------------------------------------------------------------------------

V = "v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def _knn(k: int, sim: str = "list_dot_product(a.v, b.v)") -> str:
    return f"""{V}, r AS (SELECT a.id AS src, b.id AS dst, {sim} AS sim, row_number() OVER (PARTITION BY a.id ORDER BY {sim} DESC, b.id) AS rank
      FROM v a JOIN v b ON a.id <> b.id), nn AS MATERIALIZED (SELECT * FROM r WHERE rank <= {k})"""


EDGES = f"""{_knn(10)}, w AS (SELECT src, dst, exp(-((1 - sim) ** 2) / 2) / 2 AS w FROM nn),
  e AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY ALL)"""


def _propagated(steps: int, alpha: float) -> str:
    parts = [EDGES, "s AS MATERIALIZED (SELECT src, dst, w / (sum(w) OVER (PARTITION BY src) + 1e-12) AS s FROM e)", "f0 AS MATERIALIZED (SELECT id AS doc, label AS lab, 1.0::DOUBLE AS f FROM v WHERE id % 10 = 0)"]
    for i in range(steps):
        parts.append(f"f{i + 1} AS MATERIALIZED (SELECT src AS doc, lab, {alpha} * sum(s * f) AS f FROM s JOIN f{i} ON dst = doc WHERE src % 10 <> 0 GROUP BY ALL UNION ALL SELECT * FROM f0)")
    return ", ".join(parts)


TREE = f"""RECURSIVE {V}, ranked AS (SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 AS c FROM v), k AS (SELECT max(c) + 1 AS k FROM ranked),
  spans(node_id, lo, hi) AS (SELECT '', CAST(0 AS BIGINT), CAST(k AS BIGINT) FROM k UNION ALL
    SELECT node_id || side, CASE side WHEN 'L' THEN lo ELSE lo + (hi - lo) // 2 END, CASE side WHEN 'L' THEN lo + (hi - lo) // 2 ELSE hi END
    FROM spans, (VALUES ('L'), ('R')) sides(side) WHERE hi - lo >= 2 AND length(node_id) < 10),
  m AS MATERIALIZED (SELECT node_id, id AS doc_id, label FROM spans JOIN ranked ON c >= lo AND c < hi),
  n AS MATERIALIZED (SELECT node_id, count(*) AS n_docs FROM m GROUP BY node_id),
  nodes AS MATERIALIZED (SELECT *, NOT EXISTS (SELECT 1 FROM n x WHERE length(x.node_id) = length(n.node_id) + 1 AND starts_with(x.node_id, n.node_id)) AS is_leaf FROM n),
  p AS MATERIALIZED (SELECT node_id, n_docs, is_leaf OR length(node_id) = {DEPTH} AS is_leaf FROM nodes WHERE length(node_id) <= {DEPTH})"""
CLUSTERS = f"""{TREE}, leaf AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS cluster FROM p WHERE is_leaf),
  cl AS MATERIALIZED (SELECT doc_id, cluster, label FROM m JOIN leaf USING (node_id)),
  t AS MATERIALIZED (SELECT label AS y, cluster AS c, count(*)::DOUBLE AS n FROM cl GROUP BY ALL)"""
VOTED = f"""{CLUSTERS}, votes AS (SELECT cluster, label, count(*) AS n, min(doc_id) AS f FROM cl GROUP BY ALL),
  best AS (SELECT cluster, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) AS r FROM votes) WHERE r = 1),
  pr AS MATERIALIZED (SELECT doc_id, cluster, label, predicted FROM cl JOIN best USING (cluster))"""
INFORMATION = f"""{CLUSTERS}, tot AS (SELECT sum(n) AS total FROM t), ty AS (SELECT y, sum(n) AS ny FROM t GROUP BY y), tc AS (SELECT c, sum(n) AS nc FROM t GROUP BY c),
  i AS (SELECT (SELECT -sum(ny / total * ln(ny / total)) FROM ty, tot) AS hy, (SELECT -sum(nc / total * ln(nc / total)) FROM tc, tot) AS hc, (SELECT sum(n / total * ln(n * total / (ny * nc))) FROM t JOIN ty USING (y) JOIN tc USING (c), tot) AS mi)"""
PER_CLASS = f"""{VOTED}, lb AS (SELECT label AS l FROM pr UNION SELECT predicted FROM pr),
  pc AS MATERIALIZED (SELECT l AS label, (SELECT count(*) FROM pr WHERE label = l AND predicted = l)::DOUBLE AS tp, (SELECT count(*) FROM pr WHERE predicted = l)::DOUBLE AS made, (SELECT count(*) FROM pr WHERE label = l)::DOUBLE AS support FROM lb),
  f AS MATERIALIZED (SELECT label, CASE WHEN made = 0 THEN 0 ELSE tp / made END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, CASE WHEN made + support = 0 THEN 0 ELSE 2 * tp / (made + support) END AS f1, support FROM pc)"""
ARI = f"""{CLUSTERS}, a AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS b, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t GROUP BY y)) AS y, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM t GROUP BY c)) AS c, (SELECT sum(n) * (sum(n) - 1) / 2 FROM t) AS p),
  ari AS (SELECT (b - y * c / p) / ((y + c) / 2 - y * c / p) AS ari FROM a)"""
PURITY = f"""{CLUSTERS}, sh AS (SELECT c AS cluster, n, n / sum(n) OVER (PARTITION BY c) AS p FROM t), pu AS MATERIALIZED (SELECT cluster, CAST(sum(n) AS BIGINT) AS n, max(p) AS purity, -sum(p * log2(p)) AS entropy FROM sh GROUP BY cluster)"""
ISOLATED = """pure AS (SELECT node_id, min(label) AS label FROM m GROUP BY node_id HAVING count(DISTINCT label) = 1), iso AS MATERIALIZED (SELECT l.label, min(length(node_id)) AS depth FROM (SELECT DISTINCT label FROM v) l LEFT JOIN pure ON pure.label = l.label GROUP BY l.label)"""
CENTROIDS = f"""{CLUSTERS}, x AS MATERIALIZED (SELECT doc_id, cluster, v FROM cl JOIN v ON id = doc_id), pos AS (SELECT doc_id, cluster, unnest(v) AS e, unnest(range(len(v))) AS i FROM x),
  ce AS (SELECT cluster, i, avg(e) AS e FROM pos GROUP BY ALL), cen AS MATERIALIZED (SELECT cluster, list(e ORDER BY i) AS mu FROM ce GROUP BY cluster)"""
_STD = "sqrt(greatest(avg(sim * sim) - avg(sim) ** 2, 0))"
_COS = "list_cosine_similarity(a.v, b.v)"

QUERIES = {
    f.__name__: f
    for f in (
        pairwise_cosine, semantic_pooled, semantic_by_label, knn_graph, affinity_edges, adaptive_sigma, label_propagation, label_propagation_converged,
        knn_classifier, index_top_k, lsh_neighbours, votek_votes, votek_sample, random_sample, stratified_split, medoids_by_label, kmeans_sample, two_means,
        halving_tree_nodes, halving_tree_membership, noisy_tree_membership, split_metrics_sum, tree_statistics, prune_tree, tree_structure, leaf_sizes, find_leaf, sample_documents, text_dump, path_documents, dot_labels, tree_layout,
        cluster_assignment, contingency, nmi_all, homogeneity, ari, majority_labels, accuracy, f1_all, classification_report, confusion_matrix,
        leaf_purity, purity_summary, isolation_depth, exploratory_power, leaf_bundle, tree_report, silhouette, davies_bouldin, calinski_harabasz, child_parent,
        vector_histogram, token_usage, experiment_grid, union_reports, union_samples, size_points,
    )
}

ORACLES = {
    "pairwise_cosine": f"WITH {V} SELECT a.id AS i, b.id AS j, round({_COS}, 6) AS sim FROM v a JOIN v b ON a.id < b.id",
    "semantic_pooled": f"WITH {V}, p AS (SELECT {_COS} AS sim FROM v a JOIN v b ON a.id < b.id) SELECT (SELECT count(*) FROM v) AS n, round(avg(sim), 6) AS mean, round({_STD}, 6) AS std FROM p",
    "semantic_by_label": f"WITH {V}, p AS (SELECT a.label, {_COS} AS sim FROM v a JOIN v b ON a.id < b.id AND a.label = b.label) SELECT label, (SELECT count(*) FROM v WHERE v.label = p.label) AS n, round(avg(sim), 6) AS mean, round({_STD}, 6) AS std FROM p GROUP BY label",
    "knn_graph": f"WITH {_knn(10)} SELECT src, dst, round(1 - sim, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM nn",
    "affinity_edges": f"WITH {EDGES} SELECT src, dst, round(w, 6) AS w FROM e",
    "adaptive_sigma": f"WITH {_knn(10)}, d AS (SELECT src, max(1 - sim) AS d FROM nn GROUP BY src) SELECT round(sqrt(quantile_cont(d, 0.5)), 6) AS sigma FROM d",
    "label_propagation": f"WITH {_propagated(10, 0.99)}, b AS (SELECT doc, lab, row_number() OVER (PARTITION BY doc ORDER BY f DESC, lab) AS r FROM f10) SELECT id AS doc_id, coalesce(lab, (SELECT min(lab) FROM f0)) AS label FROM v LEFT JOIN (SELECT * FROM b WHERE r = 1) ON doc = id",
    "knn_classifier": f"""WITH {_knn(5, sim='-list_distance(a.v, b.v)')}, c AS (SELECT src, v.label, count(*) AS n FROM nn JOIN v ON v.id = dst GROUP BY ALL)
      SELECT src AS doc_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS r FROM c) WHERE r = 1""",
    "index_top_k": f"WITH {_knn(20)} SELECT src, dst, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM nn WHERE src % 100 = 0",
    "votek_votes": f"WITH {_knn(15)} SELECT dst AS candidate, count(*) AS n_votes, min(src) AS first_vote FROM nn GROUP BY dst",
    "random_sample": "SELECT vec_id FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT (SELECT count(*) // 10 FROM embeddings)",
    "stratified_split": "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8) AS is_train FROM embeddings",
    "medoids_by_label": f"""WITH {V}, s AS (SELECT a.label, a.id, sum(list_distance(a.v, b.v) ** 2) AS s FROM v a JOIN v b ON a.label = b.label GROUP BY ALL)
      SELECT label AS cluster, id AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s, id) AS r FROM s) WHERE r = 1""",
    "halving_tree_nodes": f"WITH {TREE} SELECT node_id, CASE WHEN node_id <> '' THEN left(node_id, -1) END AS parent_id, CASE WHEN node_id <> '' THEN right(node_id, 1) END AS side, CAST(length(node_id) AS INTEGER) AS depth, CAST(row_number() OVER (ORDER BY node_id) - 1 AS INTEGER) AS preorder, n_docs, is_leaf FROM nodes",
    "halving_tree_membership": f"WITH {TREE} SELECT node_id, doc_id FROM m",
    "prune_tree": f"WITH {TREE} SELECT * FROM p",
    "tree_structure": f"""WITH {TREE} SELECT count(*) AS n_nodes, CAST(max(length(node_id)) AS INTEGER) AS height, count(*) FILTER (is_leaf) AS n_leaves,
      CAST(abs(coalesce(max(length(node_id) - 1) FILTER (starts_with(node_id, 'L')), -1) - coalesce(max(length(node_id) - 1) FILTER (starts_with(node_id, 'R')), -1)) AS INTEGER) AS node_unbalance,
      abs(coalesce(max(n_docs) FILTER (node_id = 'L'), 0) - coalesce(max(n_docs) FILTER (node_id = 'R'), 0)) AS doc_unbalance FROM nodes""",
    "leaf_sizes": f"WITH {TREE} SELECT string_agg(n_docs, ',' ORDER BY node_id) AS sizes, round(avg(n_docs), 6) AS mean, round(stddev_pop(n_docs), 6) AS std, min(n_docs) AS least, max(n_docs) AS greatest, round(stddev_pop(n_docs) / avg(n_docs), 6) AS relative_std FROM p WHERE is_leaf",
    "find_leaf": f"WITH {TREE} SELECT doc_id, node_id FROM m JOIN nodes USING (node_id) WHERE is_leaf",
    "text_dump": f"""WITH {TREE}, i AS (SELECT *, repeat('  ', length(node_id)) AS pre FROM nodes), r AS (SELECT node_id, doc_id, row_number() OVER (PARTITION BY node_id ORDER BY doc_id) AS r FROM m)
      SELECT node_id, 0 AS no, pre || CASE WHEN node_id = '' THEN '' ELSE right(node_id, 1) || ':' END || 'Node with ' || n_docs || ' documents' AS line FROM i
      UNION ALL SELECT node_id, CAST(r + 1 AS INTEGER), repeat('  ', length(node_id)) || '  - ' || doc_id FROM r WHERE r <= 3
      UNION ALL SELECT node_id, 5, pre || '  ... and ' || (n_docs - 3) || ' more documents' FROM i WHERE n_docs > 3""",
    "path_documents": f"""WITH {TREE}, s AS (SELECT node_id, doc_id, row_number() OVER (PARTITION BY node_id ORDER BY CAST('0x' || left(md5('42:' || doc_id), 8) AS BIGINT), doc_id) - 1 AS r, count(*) OVER (PARTITION BY node_id) AS size FROM m JOIN nodes USING (node_id) WHERE is_leaf),
      b AS (SELECT doc_id AS path_no, node_id, size, (CAST('0x' || left(md5('42:path:' || doc_id), 8) AS BIGINT) % size + i) % size AS r FROM s JOIN range(3) t(i) ON i < size)
      SELECT path_no, s.doc_id FROM b JOIN s ON s.node_id = b.node_id AND s.r = b.r""",
    "union_reports": f"""WITH {TREE}, a AS (SELECT 'whole' AS report, * FROM nodes UNION ALL SELECT 'pruned', * FROM p)
      SELECT count(*) AS n_nodes, CAST(max(length(node_id)) AS INTEGER) AS height, count(*) FILTER (is_leaf) AS n_leaves,
      CAST(abs(coalesce(max(length(node_id) - 1) FILTER (starts_with(node_id, 'L')), -1) - coalesce(max(length(node_id) - 1) FILTER (starts_with(node_id, 'R')), -1)) AS INTEGER) AS node_unbalance,
      abs(coalesce(max(n_docs) FILTER (node_id = 'L'), 0) - coalesce(max(n_docs) FILTER (node_id = 'R'), 0)) AS doc_unbalance, report FROM a GROUP BY report""",
    "union_samples": "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8) AS is_train FROM embeddings",
    "size_points": f"WITH {TREE} SELECT n_docs, CAST(length(node_id) AS DOUBLE) AS x, count(*) AS n FROM nodes GROUP BY ALL",
    "sample_documents": f"WITH {TREE} SELECT node_id, CAST(r AS INTEGER) AS r, doc_id, greatest(c - 3, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY node_id) AS c FROM m) WHERE r <= 3",
    "dot_labels": f"WITH {TREE} SELECT CAST(row_number() OVER (ORDER BY length(node_id), node_id) - 1 AS INTEGER) AS rank, node_id, 'Docs: ' || n_docs AS label, CASE WHEN is_leaf THEN 'lightgreen' ELSE 'lightblue' END AS colour FROM nodes",
    "cluster_assignment": f"WITH {CLUSTERS} SELECT doc_id, CAST(cluster AS INTEGER) AS cluster FROM cl",
    "contingency": f"WITH {CLUSTERS} SELECT y, CAST(c AS INTEGER) AS c, n FROM t",
    "nmi_all": f"WITH {INFORMATION} SELECT round(mi / ((hy + hc) / 2), 6) AS nmi_arithmetic, round(mi / sqrt(hy * hc), 6) AS nmi_geometric, round(mi / least(hy, hc), 6) AS nmi_min, round(mi / greatest(hy, hc), 6) AS nmi_max FROM i",
    "homogeneity": f"WITH {INFORMATION} SELECT round(mi / hy, 6) AS homogeneity, round(mi / hc, 6) AS completeness, round(2 * (mi / hy) * (mi / hc) / (mi / hy + mi / hc), 6) AS v_measure FROM i",
    "ari": f"WITH {ARI} SELECT round(ari, 6) AS ari FROM ari",
    "majority_labels": f"WITH {VOTED} SELECT doc_id, CAST(cluster AS INTEGER) AS cluster, label, predicted FROM pr",
    "accuracy": f"WITH {VOTED} SELECT round(avg((label = predicted)::INT), 6) AS accuracy FROM pr",
    "f1_all": f"WITH {PER_CLASS} SELECT round(sum(recall * support) / sum(support), 6) AS f1_micro, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f",
    "classification_report": f"WITH {PER_CLASS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f",
    "confusion_matrix": f"WITH {VOTED}, lb AS (SELECT label AS l FROM pr UNION SELECT predicted FROM pr) SELECT a.l AS label, b.l AS predicted, (SELECT count(*) FROM pr WHERE label = a.l AND predicted = b.l) AS n FROM lb a, lb b",
    "leaf_purity": f"WITH {PURITY} SELECT CAST(cluster AS INTEGER) AS cluster, n, round(purity, 6) AS purity, round(entropy, 6) AS entropy FROM pu",
    "purity_summary": f"WITH {PURITY} SELECT count(*) AS n_leaves, round(avg(purity), 6) AS average_purity, round(avg(entropy), 6) AS average_entropy, round(sum(purity * n) / sum(n), 6) AS weighted_purity FROM pu",
    "isolation_depth": f"WITH {TREE}, {ISOLATED} SELECT label, CAST(depth AS INTEGER) AS depth FROM iso",
    "exploratory_power": f"WITH {PURITY}, {ISOLATED} SELECT count(*) AS n_leaves, round(avg(purity), 6) AS average_purity, round(avg(entropy), 6) AS average_entropy, round(sum(purity * n) / sum(n), 6) AS weighted_purity, (SELECT count(depth) FROM iso) AS n_isolated, (SELECT round(avg(depth), 6) FROM iso) AS average_isolation_depth FROM pu",
    "leaf_bundle": f"WITH {INFORMATION}, {PURITY.split(', sh AS')[1].join(['sh AS', ''])}, {ARI.split(', a AS')[1].join(['a AS', ''])} SELECT round(mi / ((hy + hc) / 2), 6) AS nmi, round(mi / hy, 6) AS homogeneity, (SELECT round(sum(purity * n) / sum(n), 6) FROM pu) AS purity, (SELECT round(ari, 6) FROM ari) AS ari FROM i",
    "silhouette": f"""WITH {CLUSTERS}, x AS MATERIALIZED (SELECT doc_id, cluster, v FROM cl JOIN v ON id = doc_id), d AS (SELECT a.doc_id, a.cluster AS own, b.cluster, avg(list_distance(a.v, b.v)) AS d FROM x a JOIN x b ON a.doc_id <> b.doc_id GROUP BY ALL),
      s AS (SELECT doc_id, max(d) FILTER (own = cluster) AS a, min(d) FILTER (own <> cluster) AS b FROM d GROUP BY doc_id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
    "davies_bouldin": f"""WITH {CENTROIDS}, s AS (SELECT cluster, avg(list_distance(v, mu)) AS s, any_value(mu) AS mu FROM x JOIN cen USING (cluster) GROUP BY cluster)
      SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.cluster, max((a.s + b.s) / list_distance(a.mu, b.mu)) AS r FROM s a JOIN s b ON a.cluster <> b.cluster GROUP BY a.cluster)""",
    "calinski_harabasz": f"""WITH {CENTROIDS}, g AS (SELECT list(e ORDER BY i) AS mu FROM (SELECT i, avg(e) AS e FROM pos GROUP BY i)),
      z AS (SELECT sum(list_distance(cen.mu, g.mu) ** 2) AS b, sum(list_distance(v, cen.mu) ** 2) AS w, count(DISTINCT cluster) AS k, count(*) AS n FROM x JOIN cen USING (cluster), g) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM z""",
    "child_parent": f"""WITH {TREE}, pos AS (SELECT node_id, unnest(v) AS e, unnest(range(len(v))) AS i FROM m JOIN v ON id = doc_id), ce AS (SELECT node_id, i, avg(e) AS e FROM pos GROUP BY ALL), cen AS (SELECT node_id, list(e ORDER BY i) AS mu FROM ce GROUP BY node_id)
      SELECT round(avg(list_cosine_similarity(c.mu, p.mu)), 6) AS similarity, round(1 - avg(list_cosine_similarity(c.mu, p.mu)), 6) AS uniqueness, count(*) AS n_pairs FROM cen c JOIN cen p ON c.node_id <> '' AND p.node_id = left(c.node_id, -1)""",
    "vector_histogram": "WITH x AS (SELECT embedding[1]::DOUBLE AS x FROM embeddings), s AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT CAST(least(floor((x - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM x, s GROUP BY 1",
    "token_usage": "WITH r AS (SELECT length(text) AS i, length(text) % 97 AS o, turn * 10 + length(text) AS ms FROM conversations) SELECT CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(i + o) / count(*), 6) AS tokens_per_node, round(corr(o, ms), 6) AS corr_tokens_time FROM r",
    "experiment_grid": "SELECT * FROM (SELECT unnest(['gpt-oss', 'gpt-4o']) AS model), (SELECT unnest(['votek', 'kmeans']) AS sampler), (SELECT unnest(['wikipedia', 'bills']) AS dataset)",
}
_METRIC = lambda m, i: f"(n_docs + {i}) % {7 + i}"
_SUMS = {m: f"CAST(sum({_METRIC(m, i)}) AS {'BIGINT' if m in tree.WHOLE else 'DOUBLE'})" for i, m in enumerate(tree.SPLIT_METRICS)}
ORACLES["split_metrics_sum"] = f"WITH {TREE} SELECT " + ", ".join(f"{'true' if m == 'success' else '0.0::DOUBLE' if m in reports.NOT_SUMMED else _SUMS[m]} AS {m}" for m in tree.SPLIT_METRICS) + " FROM nodes"
ORACLES["tree_statistics"] = f"WITH {TREE} SELECT " + ", ".join(
    f"{'true' if m == 'success' else f'round({_SUMS[m]} / count(*) FILTER (NOT is_leaf), 6)' if m in reports.AVERAGED else _SUMS[m]} AS {m}" for m in tree.SPLIT_METRICS
) + ", count(*) FILTER (NOT is_leaf) AS n_inner FROM nodes"
ORACLES["noisy_tree_membership"] = f"""WITH {TREE.split(V)[0]}{V}, noisy AS (SELECT id, CASE WHEN id % 7 = 0 THEN -1 ELSE label END AS label FROM v),
  ranked AS (SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 AS c FROM noisy WHERE label <> -1), {TREE.split('ranked AS (SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 AS c FROM v), ')[1]}
  SELECT node_id, doc_id FROM m UNION ALL SELECT unnest(['', CASE WHEN k // 2 <= k - k // 2 THEN 'L' ELSE 'R' END]), id FROM noisy, k WHERE label = -1"""
ORACLES["tree_layout"] = f"""WITH {TREE}, l AS (SELECT node_id, (row_number() OVER (ORDER BY node_id) - 1) * 150.0 AS x FROM nodes WHERE is_leaf)
  SELECT n.node_id, CAST(sum(l.x * pow(0.5, length(l.node_id) - length(n.node_id))) AS DOUBLE) AS x, CAST(length(n.node_id) * 120.0 AS DOUBLE) AS y FROM nodes n JOIN l ON starts_with(l.node_id, n.node_id) GROUP BY n.node_id"""


def _greedy(picks: int) -> str:
    """Vote-k, pick by pick."""
    parts = [_knn(15), "vo AS MATERIALIZED (SELECT dst AS cand, src AS sup FROM nn)"]
    for i in range(picks):
        before = " UNION ALL ".join(f"SELECT cand FROM p{j}" for j in range(i)) or "SELECT NULL::BIGINT AS cand"
        parts.append(f"c{i} AS MATERIALIZED ({before}), t{i} AS MATERIALIZED (SELECT sup, count(*) AS times FROM vo WHERE cand IN (SELECT cand FROM c{i}) GROUP BY sup)")
        parts.append(f"p{i} AS MATERIALIZED (SELECT {i} AS pick, cand FROM vo LEFT JOIN t{i} USING (sup) WHERE cand NOT IN (SELECT cand FROM c{i} WHERE cand IS NOT NULL) GROUP BY cand ORDER BY round(sum(10.0 ** -coalesce(times, 0)), 9) DESC, count(*) DESC, min(sup), cand LIMIT 1)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT pick, cand AS doc_id FROM p{i}" for i in range(picks))


ORACLES["votek_sample"] = f"WITH {_greedy(8)}"
_STEPS = 30
_CHANGES = " UNION ALL ".join(f"SELECT {i} AS i, (SELECT max(abs(coalesce(a.f, 0) - coalesce(b.f, 0))) FROM f{i} a FULL JOIN f{i + 1} b ON a.doc = b.doc AND a.lab = b.lab) AS d" for i in range(_STEPS))
_VALUES = " UNION ALL ".join(f"SELECT {i} AS i, doc, lab, f FROM f{i}" for i in range(_STEPS + 1))
ORACLES["label_propagation_converged"] = f"""WITH {_propagated(_STEPS, 0.5)}, ch AS MATERIALIZED ({_CHANGES}), stop AS (SELECT coalesce(min(i), {_STEPS}) AS i FROM ch WHERE d IS NULL OR d < 1e-3),
  b AS (SELECT doc, lab, row_number() OVER (PARTITION BY doc ORDER BY f DESC, lab) AS r FROM ({_VALUES}) JOIN stop USING (i)) SELECT id AS doc_id, coalesce(lab, (SELECT min(lab) FROM f0)) AS label FROM v LEFT JOIN (SELECT * FROM b WHERE r = 1) ON doc = id"""
ORACLES["tree_report"] = f"""WITH {INFORMATION}, {ARI.split(', a AS')[1].join(['a AS', ''])}, {PER_CLASS.split(CLUSTERS + ', ')[1]},
  st AS (SELECT count(*) AS n_nodes, CAST(max(length(node_id)) AS INTEGER) AS height, count(*) FILTER (is_leaf) AS n_leaves,
    CAST(abs(coalesce(max(length(node_id) - 1) FILTER (starts_with(node_id, 'L')), -1) - coalesce(max(length(node_id) - 1) FILTER (starts_with(node_id, 'R')), -1)) AS INTEGER) AS node_unbalance,
    abs(coalesce(max(n_docs) FILTER (node_id = 'L'), 0) - coalesce(max(n_docs) FILTER (node_id = 'R'), 0)) AS doc_unbalance FROM p),
  sz AS (SELECT round(avg(n_docs), 6) AS mean, round(stddev_pop(n_docs), 6) AS std, round(stddev_pop(n_docs) / avg(n_docs), 6) AS relative_std FROM p WHERE is_leaf)
  SELECT st.*, sz.*, round(mi / ((hy + hc) / 2), 6) AS nmi, (SELECT round(ari, 6) FROM ari) AS ari, round(mi / hy, 6) AS homogeneity, round(mi / hc, 6) AS completeness,
    round(2 * (mi / hy) * (mi / hc) / (mi / hy + mi / hc), 6) AS v_measure, (SELECT round(avg((label = predicted)::INT), 6) FROM pr) AS accuracy,
    (SELECT round(sum(recall * support) / sum(support), 6) FROM f) AS f1_micro, (SELECT round(avg(f1), 6) FROM f) AS f1_macro, (SELECT round(sum(f1 * support) / sum(support), 6) FROM f) AS f1_weighted FROM i, st, sz"""
