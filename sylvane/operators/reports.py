"""Reports over trees, runs and judgements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvane.functions import text as T
from sylvane.operators import metrics as M
from sylvane.operators import tree
from sylvane.operators.tree import SPLIT_METRICS
from sylvane.session import ensure_checkpoint_dir

#: What the plain sum of split metrics leaves out; the corrected sum has all.
NOT_SUMMED = ("kmeans_time_ms", "medoid_selection_time_ms", "medoid_label_propagation_accuracy")
AVERAGED = ("split_ratio", "medoid_nli_confidence_avg")


def split_metrics_sum(nodes: DataFrame, corrected: bool = False) -> DataFrame:
    """One row of summed split metrics; ``success`` is true in the plain sum and the conjunction in the corrected one."""
    columns = []
    for m in SPLIT_METRICS:
        if m == "success":
            columns.append((F.coalesce(F.bool_and(f"metrics.{m}"), F.lit(True)) if corrected else F.lit(True)).alias(m))
        elif m in NOT_SUMMED and not corrected:
            columns.append(F.lit(0.0).alias(m))
        else:
            columns.append(F.coalesce(F.sum(f"metrics.{m}"), F.lit(0)).alias(m))
    return nodes.agg(*columns)


def tree_statistics(nodes: DataFrame) -> DataFrame:
    """The corrected sums, with confidence and ratio averaged over the inner nodes."""
    inner = nodes.agg(F.count_if(~F.col("is_leaf")).alias("n_inner"))
    sums = split_metrics_sum(nodes, corrected=True).crossJoin(inner)
    for m in AVERAGED:
        sums = sums.withColumn(m, F.coalesce(F.col(m) / F.when(F.col("n_inner") > 0, F.col("n_inner")), F.lit(0.0)))
    return sums


def size_points(nodes: DataFrame, value: str) -> DataFrame:
    """``(n_docs, x, n)``: how often a node of this size has this value of a metric; the points of a scatter plot."""
    return nodes.where(F.col(value).isNotNull()).groupBy("n_docs", F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))


def usage(rows: DataFrame, tokens_in: str, tokens_out: str, time_ms: str) -> DataFrame:
    """One row: token totals, tokens for each node, correlation of output tokens and time."""
    total = F.sum(F.col(tokens_in) + F.col(tokens_out))
    return rows.agg(F.sum(tokens_in).alias("input_tokens"), F.sum(tokens_out).alias("output_tokens"), (total / F.count("*")).alias("tokens_per_node"), F.corr(F.col(tokens_out).cast("double"), F.col(time_ms).cast("double")).alias("corr_tokens_time"))


def histogram(rows: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``(bin, n)``: counts of equal bins from least to greatest; the greatest value is in the last bin."""
    span = rows.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.col(column).cast("double")
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width == 0, 0).otherwise(F.least(F.floor((x - F.col("lo")) / F.when(width != 0, width)), F.lit(bins - 1)))
    return rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def evaluate(nodes: DataFrame, members: DataFrame, labels: DataFrame, max_height: int | None = None) -> DataFrame:
    """One report row of a tree, pruned first where a height is given."""
    kept = nodes if max_height is None else tree.prune(nodes, max_height)
    ensure_checkpoint_dir(nodes.sparkSession)
    # both are read by several measures; the table has a row for each cluster and label only
    rows = M.majority(M.assign_clusters(kept, members), labels).checkpoint()
    table = M.contingency(rows).checkpoint()
    made = tree.structure(kept).crossJoin(tree.leaf_sizes(kept).select("mean", "std", "relative_std"))
    for part in (M.nmi(table).select(F.col("nmi_arithmetic").alias("nmi")), M.ari(table), M.homogeneity(table), M.accuracy(rows), M.f1(rows)):
        made = made.crossJoin(part)
    return made


def leaf_bundle(rows: DataFrame) -> DataFrame:
    """One row: NMI, homogeneity, purity and ARI of (doc_id, cluster, label)."""
    table = M.contingency(rows)
    return M.nmi(table).select(F.col("nmi_arithmetic").alias("nmi")).crossJoin(M.homogeneity(table).select("homogeneity")).crossJoin(M.purity_summary(rows).select(F.col("weighted_purity").alias("purity"))).crossJoin(M.ari(table))


def best_of(results: DataFrame) -> DataFrame:
    """One row: the method with the greatest purity and the one with the least entropy; on a tie the first by ``priority``."""
    first = (-F.col("priority")).alias("p")
    return results.agg(F.max_by("method", F.struct("purity", first)).alias("best_purity"), F.max_by("method", F.struct((-F.col("entropy")).alias("e"), first)).alias("best_entropy"))


def fidelity(runs: DataFrame, levels: int = 5) -> DataFrame:
    """One row: mean share of equal levels, share of equal paths, and that share for one node."""
    p = F.avg(F.col("equal").cast("double"))
    return runs.agg(F.avg(F.col("levels") / F.col("n_levels")).alias("level_share"), p.alias("p_path"), F.pow(p, F.lit(1.0 / levels)).alias("p_node"))


def judge_averages(scores: DataFrame, by: list[str], questions: list[str]) -> DataFrame:
    """Mean of each judgement by group."""
    return scores.groupBy(*by).agg(*[F.avg(F.col(q).cast("double")).alias(q) for q in questions])


def experiment_grid(spark, **choices) -> DataFrame:
    """All combinations of the given settings."""
    made = None
    for name, values in choices.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        made = one if made is None else made.crossJoin(F.broadcast(one))
    return made


def run_names(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Files with the settings their names tell."""
    return files.select(path_col, T.run_parameters(F.col(path_col)).alias("r")).select(path_col, "r.*")


def union_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """The rows of several reports below one another, named in ``report``; a column that one lacks is null there."""
    made = None
    for name, report in reports.items():
        one = report.withColumn("report", F.lit(name))
        made = one if made is None else made.unionByName(one, allowMissingColumns=True)
    if made is None:
        raise ValueError("no report given")
    return made


def union_samples(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows and test rows in one table with ``is_train``; repeated rows stay."""
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))


def evaluate_files(files: list[str], load: Callable[[str], tuple[DataFrame, DataFrame]], labels: DataFrame, max_height: int | None = None) -> DataFrame:
    """One report row for each tree file, named in ``report``; ``load`` gives a file's nodes and members."""
    return union_reports({f: evaluate(*load(f), labels, max_height) for f in files})


def inference_report(predicted: DataFrame) -> DataFrame:
    """One row: accuracy, macro F1, NMI and ARI of (label, predicted)."""
    table = M.contingency(predicted, "label", "predicted")
    return M.accuracy(predicted).crossJoin(M.f1(predicted).select("f1_macro")).crossJoin(M.nmi(table).select(F.col("nmi_arithmetic").alias("nmi"))).crossJoin(M.ari(table))
