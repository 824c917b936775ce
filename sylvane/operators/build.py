"""Topic trees, built level by level.

All nodes of a depth are handled together: one table of (node, document), embeddings made
once. Representatives (a bounded number of texts a node) go to the hypothesis generator on the
driver; scoring and label propagation run per node in the cluster; a node whose split is
rejected tries again with its hypothesis on the blacklist.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvane.functions import text as T
from sylvane.operators import knn, nli, tree
from sylvane.operators.blocks import block_size
from sylvane.operators.models import EntailmentScorer, HypothesisGenerator, LexicalEntailment, TokenHypothesis
from sylvane.operators.sampling import SamplingConfig, how_many, key_number, kmeans_clusters, sample_ids, vote_k
from sylvane.session import ensure_checkpoint_dir, release


#: Words of a document that the generator is shown.
SHOWN_WORDS = 350


@dataclass(frozen=True)
class TreeConfig:
    """Settings of a build. ``select`` chooses the documents shown to the generator: "random", "kmeans" or "vote_k", a number or a share. ``split`` is "propagate" or "kmeans"; with "kmeans" clusters come first and the hypothesis contrasts them."""

    min_node_size: int = 2
    max_depth: int = 10
    min_split_ratio: float = 0.2
    max_split_ratio: float = 0.8
    max_retries: int = 3
    select: SamplingConfig = field(default_factory=lambda: SamplingConfig("random"))
    n_scored: int | float = 0.1
    least_scored: int = 10
    n_neighbors: int = 10
    sigma: float = 1.0
    alpha: float = 0.99
    max_iter: int = 100
    tol: float = 1e-3
    split: str = "propagate"
    nli_overrides_kmeans: bool = True
    medoids_per_cluster: int = 7
    seed: int = 42


def nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, the earlier one first among equals at the edge."""
    if k >= sims.shape[1]:
        return np.argsort(-sims, axis=1, kind="stable")[:, :k]
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(sims, best, 1).min(1)
    for row in np.flatnonzero((sims >= edge[:, None]).sum(1) > k):
        found = np.flatnonzero(sims[row] >= edge[row])
        best[row] = found[np.argsort(-sims[row, found], kind="stable")[:k]]
    return best


def propagate_node(x: np.ndarray, y: np.ndarray, k: int, sigma: float, alpha: float, max_iter: int, tol: float) -> np.ndarray:
    """Labels 0 and 1 for the rows of one node from known ones (-1: unknown), by the same rule as the edge tables."""
    n = len(x)
    if n < 2 or not (y >= 0).any():
        return np.maximum(y, 0)
    k = min(k, n - 1)
    near, weight = np.zeros((n, k), np.int64), np.zeros((n, k))
    for at in range(0, n, 512):
        part = slice(at, at + 512)
        sims = x[part] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
        best = nearest(sims, k)
        near[part] = best
        weight[part] = np.exp(-((1 - np.take_along_axis(sims, best, 1).astype(float)) ** 2) / (2 * sigma**2)) / 2
    rows, columns, w = np.repeat(np.arange(n), k), near.ravel(), weight.ravel()

    def passed(f: np.ndarray) -> np.ndarray:
        """W f, with halves of both directions added."""
        return np.bincount(rows, w * f[columns], n) + np.bincount(columns, w * f[rows], n)

    degree = passed(np.ones(n)) + 1e-12
    start = np.stack([y == 0, y == 1], 1).astype(float)
    now, known = start.copy(), y >= 0
    for _ in range(max_iter):
        after = np.stack([alpha * passed(now[:, c]) / degree for c in (0, 1)], 1) + (1 - alpha) * start
        after[known] = start[known]
        if np.abs(after - now).max() < tol:
            break
        now = after
    return np.where(now[:, 1] > now[:, 0], 1, 0)


#: Up to so many documents a node is one task's work; larger nodes are spread over the cluster. The rule is the same.
DENSE_NODE = 16_384
#: Samples of up to so many documents a node are exact; of a larger one each document is drawn by its hash.
RANKED_SAMPLE = 65_536


class Neighbours:
    """The packed neighbour lists of large nodes, made once for a node: for its votes and for each try of its split."""

    def __init__(self, vectors: DataFrame, config: TreeConfig):
        self.vectors, self.made = vectors, {}
        select = config.select
        votes = select.k_neighbors if config.split != "kmeans" and select.selection_strategy in ("vote_k", "votek") else 0
        self.k = max(config.n_neighbors, votes)

    def of(self, frontier: DataFrame, node: str, size: int) -> DataFrame:
        if node not in self.made:
            own = frontier.where(F.col("node_id") == node).select("doc_id")
            keys = own.join(self.vectors.select("doc_id", F.xxhash64("embedding").alias("key")), "doc_id")
            distinct = keys.agg(F.approx_count_distinct("key")).first()[0]
            self.made[node] = knn.distinct_lists(own.join(self.vectors, "doc_id"), self.k, distinct, "doc_id", "embedding", block_size(distinct)).checkpoint()
            release(frontier.sparkSession)
        return self.made[node]


def _labels(frontier: DataFrame, vectors: DataFrame, answers: DataFrame, sizes: dict[str, int], config: TreeConfig, neighbours: Neighbours) -> DataFrame:
    """``(node_id, doc_id, label)`` of all documents of the frontier."""
    joined = frontier.join(vectors, "doc_id").join(answers, ["node_id", "doc_id"], "left")
    small = [n for n, size in sizes.items() if size <= DENSE_NODE]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = np.array(pdf["embedding"].tolist(), float).reshape(len(pdf), -1)
        y = pdf["answer"].fillna(-1).astype(int).to_numpy()
        label = propagate_node(x, y, config.n_neighbors, config.sigma, config.alpha, config.max_iter, config.tol)
        return pd.DataFrame({"node_id": pdf["node_id"], "doc_id": pdf["doc_id"], "label": label})

    made = joined.where(F.col("node_id").isin(small)).groupBy("node_id").applyInPandas(each, "node_id string, doc_id long, label int")
    for node in sorted(set(sizes) - set(small)):
        seeds = answers.where((F.col("node_id") == node) & (F.col("answer") >= 0)).select("doc_id", F.col("answer").alias("label"))
        found = knn.propagate_lists(neighbours.of(frontier, node, sizes[node]), neighbours.k, seeds, sizes[node], config.n_neighbors, config.sigma, config.alpha, config.max_iter, config.tol)
        made = made.unionByName(found.select(F.lit(node).alias("node_id"), "doc_id", F.col("label").cast("int")))
    return made


def spherical_means(x: np.ndarray, k: int, seed: int, steps: int = 50, restarts: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest centre of each row) of the best of a few runs; rows are of unit length."""
    best, cost = None, -np.inf
    for restart in range(restarts):
        rng = np.random.default_rng(seed + restart)
        centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
        for _ in range(steps):
            side = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, side, x)
            fresh = np.where(np.bincount(side, minlength=len(centres))[:, None] > 0, sums, centres)
            fresh = fresh / np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
            if np.allclose(fresh, centres):
                break
            centres = fresh
        value = (x @ centres.T).max(1).sum()
        if value > cost + 1e-12:
            best, cost = (centres, side), value
    return best


def _by_size(rows: DataFrame, sizes: dict[str, int], small, large, schema: str, by: list[str]) -> DataFrame:
    """``small`` on each group of the nodes that are one task's work, ``large(rows of a node, node)`` on each other node."""
    few = [n for n, size in sizes.items() if size <= DENSE_NODE]
    made = rows.where(F.col("node_id").isin(few)).groupBy(*by).applyInPandas(small, schema)
    for node in sorted(set(sizes) - set(few)):
        made = made.unionByName(large(rows.where(F.col("node_id") == node), node))
    return made


def _two_means(frontier: DataFrame, vectors: DataFrame, sizes: dict[str, int], seed: int) -> DataFrame:
    """``(node_id, doc_id, cluster)``: spherical 2-means inside each node; large nodes by distributed k-means."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        _, side = spherical_means(np.array(pdf["embedding"].tolist(), float).reshape(len(pdf), -1), 2, seed)
        return pd.DataFrame({"node_id": pdf["node_id"], "doc_id": pdf["doc_id"], "cluster": side})

    def spread(rows: DataFrame, node: str) -> DataFrame:
        return kmeans_clusters(rows, 2, "doc_id", seed=seed).select(F.lit(node).alias("node_id"), "doc_id", "cluster")

    return _by_size(frontier.join(vectors, "doc_id"), sizes, each, spread, "node_id string, doc_id long, cluster int", ["node_id"])


def _order(salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), "node_id", F.lit(":"), F.col("doc_id").cast("string")))


#: Nodes up to which texts are kept from a join by the keys of the documents that samples may have.
FEW_NODES = 4


def _may_be_first(quotas: list[tuple[str, int, int]], salt: str) -> Column:
    """Whether a document passes the threshold of :func:`_first` in one of the nodes, told by its id alone; true if there are many nodes."""
    passed = F.lit(len(quotas) > FEW_NODES)
    for node, quota, size in quotas if len(quotas) <= FEW_NODES else []:
        spare = 0.0 if quota > RANKED_SAMPLE else 6 * quota**0.5 + 20
        key = F.md5(F.concat(F.lit(f"{salt}:{node}:"), F.col("doc_id").cast("string")))
        passed = passed | (key_number(key) <= 2.0**32 * (quota + spare) / size + 1)
    return passed


def _first(frontier: DataFrame, quotas: DataFrame, salt: str) -> DataFrame:
    """The first ``quota`` documents of each node in a keyed order, with the columns of ``quotas(node_id, quota, size, ...)``.

    A threshold of the key leaves a little more than the quota before anything is ranked; a
    quota over ``RANKED_SAMPLE`` is met by its share of the keys alone.
    """
    met = frontier.join(F.broadcast(quotas), "node_id").withColumn("__key", _order(salt))
    many = F.col("quota") > RANKED_SAMPLE
    spare = F.when(many, 0.0).otherwise(6 * F.sqrt("quota") + 20)
    met = met.where(key_number(F.col("__key")) < 2.0**32 * (F.col("quota") + spare) / F.col("size"))
    ranked = met.where(~many).withColumn("__r", F.row_number().over(Window.partitionBy("node_id").orderBy("__key", "doc_id")))
    return met.where(many).unionByName(ranked.where(F.col("__r") <= F.col("quota")).drop("__r")).drop("__key")


def _chosen(here: DataFrame, vectors: DataFrame, sizes: dict[str, int], n: int | float, config: TreeConfig, by: list[str], neighbours: Neighbours) -> DataFrame:
    """``(node_id, cluster, doc_id)``: representatives of each node (and cluster) by the configured strategy.

    ``by`` has the columns of a group. Random ones are the first in a keyed order.
    """
    select = config.select
    strategy = {"votek": "vote_k"}.get(select.selection_strategy, select.selection_strategy) if by == ["node_id"] else "kmeans"
    if strategy not in ("random", "kmeans", "vote_k"):
        raise ValueError(f"Unknown selection strategy: {select.selection_strategy}")
    if strategy == "random":
        table = [(node, max(1, how_many(size, n)), size) for node, size in sizes.items()]
        quotas = here.sparkSession.createDataFrame(table, "node_id string, quota int, size long")
        return _first(here, quotas, f"llm{config.seed}").select("node_id", F.lit(0).alias("cluster"), "doc_id")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = np.array(pdf["embedding"].tolist(), float).reshape(len(pdf), -1)
        m = max(1, how_many(len(x), n))
        picked = greedy_votes(x, m, select.k_neighbors) if strategy == "vote_k" else sorted(set((spherical_means(x, m, config.seed, select.niter)[0] @ x.T).argmax(1).tolist()))
        pdf = pdf.iloc[picked]
        return pd.DataFrame({"node_id": pdf["node_id"], "cluster": pdf["cluster"], "doc_id": pdf["doc_id"]})

    def spread(rows: DataFrame, node: str) -> DataFrame:
        found = []
        if strategy == "vote_k":
            near = knn.listed(neighbours.of(here, node, sizes[node]), neighbours.k, select.k_neighbors)
            votes = near.select(F.col("dst").alias("candidate"), F.col("src").alias("supporter"))
            found = [(node, 0, i) for i in vote_k(votes.repartition("candidate"), how_many(sizes[node], n))]  # so that no pick shuffles the votes
            return rows.sparkSession.createDataFrame(found, "node_id string, cluster int, doc_id long")
        for cluster in [r["cluster"] for r in rows.select("cluster").distinct().collect()]:  # two at most
            own = rows.where(F.col("cluster") == cluster).select("doc_id", "embedding")
            chosen = replace(select, selection_strategy=strategy, n_select=n)
            found += [(node, cluster, i) for i in set(sample_ids(own, chosen, "doc_id"))]
        return rows.sparkSession.createDataFrame(found, "node_id string, cluster int, doc_id long")

    rows = here if "cluster" in here.columns else here.withColumn("cluster", F.lit(0))
    return _by_size(rows.join(vectors, "doc_id"), sizes, each, spread, "node_id string, cluster int, doc_id long", by)


def greedy_votes(x: np.ndarray, n: int, k: int) -> list[int]:
    """Vote-k inside one node, as :func:`sampling.vote_k` does it; rows that nobody votes for can't be chosen."""
    if len(x) < 2:
        return list(range(len(x)))
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    near = nearest(sims, min(k, len(x) - 1))
    voters = [np.flatnonzero((near == c).any(1)) for c in range(len(x))]
    served, chosen = np.zeros(len(x)), []
    while len(chosen) < n:
        left = [c for c in range(len(x)) if len(voters[c]) and c not in chosen]
        if not left:
            break
        best = min(left, key=lambda c: (-round(float((10.0 ** -served[voters[c]]).sum()), 9), -len(voters[c]), voters[c][0], c))
        chosen.append(best)
        served[voters[best]] += 1
    return chosen


def build_tree(
    docs: DataFrame,
    vectors: DataFrame,
    config: TreeConfig = TreeConfig(),
    scorer: EntailmentScorer | None = None,
    generator: HypothesisGenerator | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    initial_blacklist: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of a topic tree over the documents; vectors are (doc_id, embedding), of unit length.

    Yes goes left. A node stops when it is small or deep; after a split, a side stops when the
    split was one-sided or unbalanced. A split is tried again while both sides have documents
    but the smaller share is outside the bounds; the last try stands. A generator that
    fails leaves a leaf. Without documents: ValueError.
    """
    scorer, generator = scorer or LexicalEntailment(), generator or TokenHypothesis()
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    members = texts.select(F.lit("").alias("node_id"), "doc_id").checkpoint()
    total = members.count()
    if not total:
        raise ValueError("Text collection cannot be empty")
    vectors = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")).checkpoint()
    release(spark)
    all_members, frontier, sizes = members, members, {"": total}
    questions: dict[str, str] = {}
    metrics: dict[str, dict] = {}
    blacklists = {"": list(initial_blacklist or [])}
    for depth in range(config.max_depth):
        open_ = {n: s for n, s in sizes.items() if s >= max(2, config.min_node_size)}
        if not open_:
            break
        frontier = frontier.where(F.col("node_id").isin(list(open_))).checkpoint()
        clusters = _two_means(frontier, vectors, open_, config.seed).checkpoint() if config.split == "kmeans" else None
        pending, accepted, neighbours = dict(open_), [], Neighbours(vectors, config)
        for attempt in range(config.max_retries + 1):
            here = frontier.where(F.col("node_id").isin(list(pending)))
            shown = _representatives(here, clusters, vectors, texts, pending, config, neighbours)
            for node in list(pending):
                tokens = sum(len(t.split()) for side in shown.get(node, {}).values() for t in side)
                metrics.setdefault(node, {"success": True, "n_attempts": 0, "nli_calls": 0, "llm_input_tokens": 0, "llm_output_tokens": 0, "num_nodes": 1})
                try:
                    sides = shown[node]
                    questions[node] = generator.contrast(sides[1], sides[0], blacklists[node]) if clusters is not None else generator.about(sides[0], blacklists[node])
                except Exception as error:  # whatever the generator raises, the node stays a leaf
                    warnings.warn(f"no hypothesis for node {node!r}: {error!r}", stacklevel=2)
                    metrics[node]["success"] = False
                    del pending[node]
                    continue
                metrics[node]["n_attempts"] += 1
                metrics[node]["llm_input_tokens"] += tokens
                metrics[node]["llm_output_tokens"] += len(questions[node].split())
            if not pending:
                break
            here = here.where(F.col("node_id").isin(list(pending)))
            labelled = _split(here, clusters, vectors, texts, pending, questions, scorer, config, neighbours).checkpoint()
            release(spark)
            shares = {r["node_id"]: (r["yes"], r["n"]) for r in labelled.groupBy("node_id").agg(F.sum("label").alias("yes"), F.count("*").alias("n"), F.count("answer").alias("asked")).collect()}
            asked = {r["node_id"]: (r["asked"], r["confidence"]) for r in labelled.groupBy("node_id").agg(F.count("answer").alias("asked"), F.avg("confidence").alias("confidence")).collect()}
            done = []
            for node, (yes, n) in shares.items():
                least = min(yes, n - yes) / n
                metrics[node]["nli_calls"] += asked[node][0]
                bad = 0 < yes < n and not config.min_split_ratio <= least <= config.max_split_ratio
                if bad and attempt < config.max_retries:
                    blacklists[node] = [*blacklists[node], questions[node]]
                    continue
                entropy = -sum(p * np.log2(p) for p in (least, 1 - least) if p > 0)
                metrics[node] |= {"split_ratio": yes / n, "split_entropy": float(entropy), "medoid_nli_confidence_avg": asked[node][1]}
                done.append(node)
                pending.pop(node)
            if done:
                accepted.append(labelled.where(F.col("node_id").isin(done)))
            if not pending:
                break
        if not accepted:
            break
        labelled = accepted[0]
        for more in accepted[1:]:
            labelled = labelled.unionByName(more)
        child = F.concat("node_id", F.when(F.col("label") == 1, "L").otherwise("R"))
        frontier = labelled.select(child.alias("node_id"), "doc_id").checkpoint()
        sizes = {r["node_id"]: r["n"] for r in frontier.groupBy("node_id").agg(F.count("*").alias("n")).collect()}
        parents = {n[:-1] for n in sizes}
        for parent in parents:
            sides = [sizes.get(parent + s, 0) for s in "LR"]
            blacklists |= {parent + s: list(blacklists[parent]) for s in "LR"}
            n = sum(sides)
            if not min(sides):  # one-sided: the node stays a leaf that carries its question
                sizes.pop(parent + "L", None), sizes.pop(parent + "R", None)
            elif not config.min_split_ratio <= min(sides) / n <= config.max_split_ratio:
                for s in "LR":
                    sizes[parent + s] = -sizes[parent + s]  # kept, but not split any further
        frontier = frontier.where(F.col("node_id").isin(list(sizes)))
        all_members = all_members.unionByName(frontier)
    asked_ = spark.createDataFrame(sorted(questions.items()), "node_id string, question string")
    measured = spark.createDataFrame([(n, {k: m.get(k) for k in tree.SPLIT_METRICS}) for n, m in sorted(metrics.items())], f"node_id string, metrics struct<{tree.metrics_schema()}>")
    lists = spark.createDataFrame(sorted((n, b) for n, b in blacklists.items()), "node_id string, blacklist array<string>")
    nodes = tree.nodes_of(all_members, asked_).join(lists, "node_id", "left").join(measured, "node_id", "left")
    return nodes, all_members.select("node_id", "doc_id", F.col("doc_id").alias("pos"))


def _representatives(here: DataFrame, clusters: DataFrame | None, vectors: DataFrame, texts: DataFrame, sizes: dict[str, int], config: TreeConfig, neighbours: Neighbours) -> dict[str, dict[int, list[str]]]:
    """The texts shown to the generator, by node and cluster (0 where there are none), cut to their first words.

    Without clusters they are chosen by ``config.select``; with them, the documents nearest to
    the centres of ``medoids_per_cluster`` parts of each cluster.
    """
    if clusters is None:
        chosen = _chosen(here, vectors, sizes, config.select.n_select, config, ["node_id"], neighbours)
    else:
        chosen = _chosen(here.join(clusters, ["node_id", "doc_id"]), vectors, sizes, config.medoids_per_cluster, config, ["node_id", "cluster"], neighbours)
    shown: dict[str, dict[int, list[str]]] = {}
    met = texts.join(F.broadcast(chosen), "doc_id").withColumn("text", T.crop_words(F.col("text"), SHOWN_WORDS))  # as many as the driver gets
    for r in met.select("node_id", "cluster", "doc_id", "text").orderBy("node_id", "cluster", "doc_id").collect():
        shown.setdefault(r["node_id"], {}).setdefault(r["cluster"], []).append(r["text"])
    return shown


def _split(here: DataFrame, clusters: DataFrame | None, vectors: DataFrame, texts: DataFrame, sizes: dict[str, int], questions: dict[str, str], scorer: EntailmentScorer, config: TreeConfig, neighbours: Neighbours) -> DataFrame:
    """``(node_id, doc_id, label, answer, confidence)``: entailment of a sample, spread to all documents of each node."""
    spark = here.sparkSession
    quotas = {n: max(config.least_scored, how_many(s, config.n_scored)) for n, s in sizes.items()}
    asked = spark.createDataFrame([(n, questions[n], quotas[n], s) for n, s in sizes.items()], "node_id string, hypothesis string, quota int, size long")
    texts = texts.where(_may_be_first([(n, quotas[n], s) for n, s in sizes.items()], f"nli{config.seed}"))  # before they are shuffled
    sample = _first(here, asked, f"nli{config.seed}").select("node_id", "doc_id", "hypothesis")
    logits = nli.pooled_logits(sample.select("doc_id").distinct().join(texts, "doc_id"), sample.select("doc_id", "hypothesis").distinct(), scorer)
    scored = nli.nli_logits(logits).select("doc_id", "hypothesis", "p_entailment")
    answers = sample.join(scored, ["doc_id", "hypothesis"]).select("node_id", "doc_id", (F.col("p_entailment") > 0.5).cast("int").alias("answer"), F.greatest("p_entailment", 1 - F.col("p_entailment")).alias("confidence")).checkpoint()
    release(spark)
    if clusters is not None and not config.nli_overrides_kmeans:
        labels = here.join(clusters, ["node_id", "doc_id"]).select("node_id", "doc_id", F.col("cluster").alias("label"))
    else:
        labels = _labels(here, vectors, answers.select("node_id", "doc_id", "answer"), sizes, config, neighbours)
    return labels.join(answers, ["node_id", "doc_id"], "left")
