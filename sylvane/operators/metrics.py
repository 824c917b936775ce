"""Tree and clustering metrics from tables of (doc_id, cluster, label)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvane.functions import text as T
from sylvane.functions import vectors as V
from sylvane.operators.blocks import BLOCK, block_pairs, packed


def assign_clusters(nodes: DataFrame, members: DataFrame, leaves_only: bool = True) -> DataFrame:
    """``(doc_id, cluster, pos)``: the pre-order number of the first leaf (or node) that holds a document."""
    kept = nodes.where("is_leaf") if leaves_only else nodes
    ranked = kept.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("cluster"))  # nodes are few
    found = members.join(F.broadcast(ranked), "node_id")
    return found.groupBy("doc_id").agg(F.min("cluster").alias("cluster"), F.min_by("pos", "cluster").alias("pos"))


def majority(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, cluster, label, predicted)``: the most frequent label of the cluster, the one seen first on a tie."""
    rows = assigned.join(labels, "doc_id").select("doc_id", "cluster", "pos", "label")
    votes = rows.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = votes.groupBy("cluster").agg(F.max_by("label", F.struct("n", (-F.col("first")).alias("f"), (-F.hash("label")).alias("h"))).alias("predicted"))
    return rows.join(best, "cluster").select("doc_id", "cluster", "label", "predicted")


def contingency(rows: DataFrame, a: str = "label", b: str = "cluster") -> DataFrame:
    """``(y, c, n)``: how often each pair of values occurs."""
    return rows.groupBy(F.col(a).alias("y"), F.col(b).alias("c")).agg(F.count("*").cast("double").alias("n"))


def information(table: DataFrame) -> DataFrame:
    """One row: n, number of labels and clusters, entropies and mutual information in nats."""
    total = table.agg(F.sum("n").alias("total"))
    y = table.groupBy("y").agg(F.sum("n").alias("ny"))
    c = table.groupBy("c").agg(F.sum("n").alias("nc"))
    h = lambda t, n: t.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(F.col(n) / F.col("total") * F.ln(F.col(n) / F.col("total"))), F.lit(0.0)).alias("h"), F.count("*").alias("k"))
    joined = table.join(y, "y").join(c, "c").crossJoin(F.broadcast(total))
    mi = joined.agg(F.coalesce(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("ny") * F.col("nc")))), F.lit(0.0)).alias("mi"))
    return (
        total.select(F.coalesce("total", F.lit(0.0)).alias("total"))
        .crossJoin(h(y, "ny").select(F.col("h").alias("hy"), F.col("k").alias("ky")))
        .crossJoin(h(c, "nc").select(F.col("h").alias("hc"), F.col("k").alias("kc")))
        .crossJoin(mi.select(F.greatest("mi", F.lit(0.0)).alias("mi")))
    )


def nmi(table: DataFrame) -> DataFrame:
    """One row: normalised mutual information by arithmetic, geometric, least and greatest entropy.

    0 without rows or mutual information; 1 where both sides have a single value.
    """
    mean = {"arithmetic": (F.col("hy") + F.col("hc")) / 2, "geometric": F.sqrt(F.col("hy") * F.col("hc")), "min": F.least("hy", "hc"), "max": F.greatest("hy", "hc")}

    def value(m: Column) -> Column:
        return F.when(F.col("total") == 0, 0.0).when((F.col("ky") == 1) & (F.col("kc") == 1), 1.0).when(F.col("mi") <= 1e-15, 0.0).otherwise(F.col("mi") / F.when(m > 0, m))

    return information(table).select(*[value(m).alias(f"nmi_{k}") for k, m in mean.items()])


def homogeneity(table: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: homogeneity, completeness and their weighted harmonic mean."""
    part = lambda h: F.when(F.col("total") == 0, 0.0).when(F.col(h) == 0, 1.0).otherwise(F.col("mi") / F.when(F.col(h) != 0, F.col(h)))
    rows = information(table).select(part("hy").alias("homogeneity"), part("hc").alias("completeness"))
    weight = beta * F.col("homogeneity") + F.col("completeness")
    v = (1 + beta) * F.col("homogeneity") * F.col("completeness") / F.when(weight != 0, weight)
    return rows.withColumn("v_measure", F.coalesce(v, F.lit(0.0)))


def ari(table: DataFrame) -> DataFrame:
    """One row: the adjusted Rand index; 1 for identical trivial partitions, 0 without rows."""
    pairs = lambda t, n: t.agg(F.coalesce(F.sum(F.col(n) * (F.col(n) - 1) / 2), F.lit(0.0)).alias("p"))
    y = pairs(table.groupBy("y").agg(F.sum("n").alias("m")), "m").withColumnRenamed("p", "py")
    c = pairs(table.groupBy("c").agg(F.sum("n").alias("m")), "m").withColumnRenamed("p", "pc")
    both = table.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("pb"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))
    rows = both.crossJoin(y).crossJoin(c)
    all_pairs = F.col("total") * (F.col("total") - 1) / 2
    expected = F.col("py") * F.col("pc") / F.when(all_pairs > 0, all_pairs)
    top, under = F.col("pb") - expected, (F.col("py") + F.col("pc")) / 2 - expected
    return rows.select(F.when(F.col("total") == 0, 0.0).when(F.coalesce(under, F.lit(0.0)) == 0, 1.0).otherwise(top / F.when(under != 0, under)).alias("ari"))


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: the share of documents whose predicted label is right; 0 without rows."""
    return rows.agg(F.coalesce(F.avg((F.col("label") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))


def per_class(rows: DataFrame) -> DataFrame:
    """``(label, precision, recall, f1, support)`` of every true or predicted label; 0 where undefined."""
    hits = rows.select("label", "predicted", (F.col("label") == F.col("predicted")).cast("double").alias("hit"))
    true = hits.groupBy("label").agg(F.count("*").cast("double").alias("support"), F.sum("hit").alias("tp"))
    made = hits.groupBy(F.col("predicted").alias("label")).agg(F.count("*").cast("double").alias("made"))
    both = true.join(made, "label", "full").na.fill(0.0, ["support", "tp", "made"])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))
    tp, support, made_ = F.col("tp"), F.col("support"), F.col("made")
    return both.select("label", ratio(tp, made_).alias("precision"), ratio(tp, support).alias("recall"), ratio(2 * tp, made_ + support).alias("f1"), support.cast("long").alias("support"))


def f1(rows: DataFrame) -> DataFrame:
    """One row: F1 micro, macro and weighted by support, over the union of labels; 0 without rows."""
    total = F.sum("support")
    return per_class(rows).agg(
        F.coalesce(F.sum(F.col("recall") * F.col("support")) / F.when(total > 0, total), F.lit(0.0)).alias("f1_micro"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1_macro"),
        F.coalesce(F.sum(F.col("f1") * F.col("support")) / F.when(total > 0, total), F.lit(0.0)).alias("f1_weighted"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """``(label, predicted, n)`` of all pairs of the labels that occur, zeros included."""
    labels = rows.select("label").union(rows.select("predicted")).distinct()
    grid = labels.crossJoin(F.broadcast(labels.withColumnRenamed("label", "predicted")))  # labels are few
    counts = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return grid.join(counts, ["label", "predicted"], "left").na.fill(0, ["n"])


def leaf_purity(rows: DataFrame) -> DataFrame:
    """``(cluster, n, purity, entropy)``: largest share of a label and entropy in bits."""
    counts = rows.groupBy("cluster", "label").agg(F.count("*").cast("double").alias("m"))
    p = F.col("m") / F.sum("m").over(Window.partitionBy("cluster"))
    shares = counts.withColumn("p", p)
    return shares.groupBy("cluster").agg(F.sum("m").cast("long").alias("n"), F.max("p").alias("purity"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def purity_summary(rows: DataFrame) -> DataFrame:
    """One row: leaves, their average purity and entropy, and purity weighted by size."""
    return leaf_purity(rows).agg(
        F.count("*").alias("n_leaves"),
        F.avg("purity").alias("average_purity"),
        F.avg("entropy").alias("average_entropy"),
        (F.sum(F.col("purity") * F.col("n")) / F.sum("n")).alias("weighted_purity"),
    )


def isolation_depth(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, depth)``: the least depth of a node that holds only that label; null if none does."""
    rows = members.join(labels, "doc_id")
    pure = rows.groupBy("node_id").agg(F.count_distinct("label").alias("k"), F.min("label").alias("label")).where("k = 1")
    depths = pure.groupBy("label").agg(F.min(F.length("node_id")).alias("depth"))
    return labels.select("label").distinct().join(depths, "label", "left")


def exploratory_power(nodes: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: leaves, average purity and entropy, and how many labels get isolated, at what depth on average."""
    rows = assign_clusters(nodes, members).join(labels, "doc_id")
    depths = isolation_depth(members, labels).agg(F.count("depth").alias("n_isolated"), F.avg("depth").alias("average_isolation_depth"))
    return purity_summary(rows).crossJoin(depths)


# --- with embeddings ------------------------------------------------------------------------


def silhouette_sums(rows: DataFrame, id_col: str = "doc_id", vector_col: str = "embedding", cluster_col: str = "cluster", size: int = BLOCK) -> DataFrame:
    """``(doc_id, own, cluster, s, n)``: the sum of Euclidean distances from each row to each cluster, itself left out."""

    def of(a, b) -> pd.DataFrame:
        (ids, x, own), (others, y, clusters) = a, b
        kinds, at = np.unique(clusters, return_inverse=True)
        sums, counts = np.zeros((len(ids), len(kinds))), np.zeros((len(ids), len(kinds)))
        for first in range(0, len(ids), 256):
            part = slice(first, first + 256)
            square = (x[part] ** 2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x[part] @ y.T
            same = ids[part][:, None] == others[None, :]
            distance = np.where(same, 0, np.sqrt(np.maximum(square, 0)))
            onehot = np.zeros((len(others), len(kinds)))
            onehot[np.arange(len(others)), at] = 1
            sums[part], counts[part] = distance @ onehot, (~same) @ onehot
        n = len(kinds)
        made = pd.DataFrame({"doc_id": np.repeat(ids, n), "own": np.repeat(own, n), "cluster": np.tile(kinds, len(ids)), "s": sums.ravel(), "n": counts.ravel().astype(np.int64)})
        return made

    side = packed(rows, id_col, vector_col, cluster_col, size)
    found = block_pairs(side, side, of, "doc_id long, own long, cluster long, s double, n long")
    return found.groupBy("doc_id", "own", "cluster").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def silhouette(rows: DataFrame, id_col: str = "doc_id", vector_col: str = "embedding", cluster_col: str = "cluster") -> DataFrame:
    """One row: the mean of (b - a) / max(a, b) over all rows, 0 for a row alone in its cluster; Euclidean distances."""
    if rows.select(cluster_col).distinct().limit(2).count() < 2:
        raise ValueError("at least 2 leaf nodes with documents are needed")
    sums = silhouette_sums(rows, id_col, vector_col, cluster_col).where("n > 0").withColumn("m", F.col("s") / F.col("n"))
    a = F.max(F.when(F.col("own") == F.col("cluster"), F.col("m")))
    b = F.min(F.when(F.col("own") != F.col("cluster"), F.col("m")))
    each = sums.groupBy("doc_id").agg(a.alias("a"), b.alias("b"))
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(top != 0, top))
    return each.agg(F.avg(value).alias("silhouette"))


def _centred(rows: DataFrame, vector_col: str, cluster_col: str) -> tuple[DataFrame, DataFrame]:
    centroids = V.mean_vectors(rows, [cluster_col], vector_col)
    return centroids, rows.join(F.broadcast(centroids), cluster_col)  # a row for each cluster


def davies_bouldin(rows: DataFrame, vector_col: str = "embedding", cluster_col: str = "cluster") -> DataFrame:
    """One row: the mean over clusters of the worst (S_i + S_j) / distance of centroids."""
    centroids, joined = _centred(rows, vector_col, cluster_col)
    spread = joined.groupBy(F.col(cluster_col).alias("i")).agg(F.avg(V.euclidean(V.doubles(F.col(vector_col)), F.col("centroid"))).alias("s"))
    c = spread.join(centroids.withColumnRenamed(cluster_col, "i"), "i").select("i", "s", "centroid")
    pair = c.alias("a").join(F.broadcast(c).alias("b"), F.col("a.i") != F.col("b.i"))
    d = V.euclidean(F.col("a.centroid"), F.col("b.centroid"))
    ratio = F.when(d == 0, 0.0).otherwise((F.col("a.s") + F.col("b.s")) / F.when(d != 0, d))
    return pair.groupBy("a.i").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame, vector_col: str = "embedding", cluster_col: str = "cluster") -> DataFrame:
    """One row: between-cluster over within-cluster variance; 1 where there is no variance within."""
    _, joined = _centred(rows, vector_col, cluster_col)
    overall = V.mean_vectors(rows.withColumn("__all", F.lit(1)), ["__all"], vector_col, "mean").select("mean")
    joined = joined.crossJoin(F.broadcast(overall))
    square = lambda a, b: F.pow(V.euclidean(a, b), 2)
    sums = joined.agg(
        F.sum(square(F.col("centroid"), F.col("mean"))).alias("between"),
        F.sum(square(V.doubles(F.col(vector_col)), F.col("centroid"))).alias("within"),
        F.count_distinct(cluster_col).alias("k"),
        F.count("*").alias("n"),
    )
    value = (F.col("between") / (F.col("k") - 1)) / F.when(F.col("within") != 0, F.col("within") / (F.col("n") - F.col("k")))
    return sums.select(F.when(F.col("within") == 0, 1.0).otherwise(value).alias("calinski_harabasz"))


def child_parent(members: DataFrame, embeddings: DataFrame, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """One row: mean cosine of the mean vectors of each node and its parent, 1 minus it, and the pairs; zeros without pairs."""
    vectors = embeddings.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v"))
    means = V.mean_vectors(members.join(vectors, "doc_id"), ["node_id"], "v").select("node_id", "centroid")
    child = means.where("node_id <> ''").select(F.expr("left(node_id, length(node_id) - 1)").alias("parent"), F.col("centroid").alias("c"))
    pair = child.join(means.select(F.col("node_id").alias("parent"), F.col("centroid").alias("p")), "parent")
    sim = F.avg(V.cosine(F.col("c"), F.col("p")))
    return pair.agg(F.coalesce(sim, F.lit(0.0)).alias("similarity"), F.coalesce(1 - sim, F.lit(0.0)).alias("uniqueness"), F.count("*").alias("n_pairs"))


# --- of questions ---------------------------------------------------------------------------


def topic_diversity(nodes: DataFrame, mode: str = "full_tree", topk: int = 10, min_word_length: int = 3, stop_words: tuple[str, ...] = T.STOP_WORDS) -> DataFrame:
    """One row: distinct over all top words of the questions, of the whole tree or on average over the paths to the leaves.

    Empty questions count as none; paths without words are left out; without words it is 0.
    """
    asked = nodes.where("question is not null and question <> ''")
    if asked.limit(1).count() == 0:
        raise ValueError("No questions found")
    terms = asked.select("node_id", F.explode(T.top_words(F.col("question"), topk, min_word_length, stop_words)).alias("w"))
    ratio = F.count_distinct("w") / F.when(F.count("w") > 0, F.count("w"))
    if mode == "full_tree":
        return terms.agg(F.coalesce(ratio, F.lit(0.0)).alias("topic_diversity"))
    if mode == "leaf_paths":
        leaf = nodes.where("is_leaf").select(F.col("node_id").alias("leaf"))
        steps = leaf.select("leaf", F.explode(F.transform(F.sequence(F.lit(0), F.length("leaf")), lambda i: F.left(F.col("leaf"), i))).alias("node_id"))
        return steps.join(terms, "node_id").groupBy("leaf").agg(ratio.alias("r")).agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("topic_diversity"))
    raise ValueError(f"Unknown mode: {mode}")


# --- as objects that are called either way ----------------------------------------------------


class Metric:
    """A metric to be called as ``metric(...)`` or ``metric.call(...)``; subclasses define ``compute``."""

    def compute(self, *args, **kwargs):
        raise NotImplementedError

    def __call__(self, *args, **kwargs):
        return self.compute(*args, **kwargs)

    def call(self, *args, **kwargs):
        return self.compute(*args, **kwargs)


class TableMetric(Metric):
    """A metric object around one of the functions of this module: the value, or the row, of its one-row result."""

    def __init__(self, function, column: str | None = None, **fixed):
        self.function, self.column, self.fixed = function, column, fixed

    def compute(self, *args, **kwargs):
        row = self.function(*args, **(self.fixed | kwargs)).first()
        return row[self.column] if self.column else row[0] if len(row) == 1 else row.asDict()
