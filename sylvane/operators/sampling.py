"""Choosing representatives: random, by k-means, by votes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvane.functions import vectors as V
from sylvane.operators.knn import knn


@dataclass(frozen=True)
class SamplingConfig:
    selection_strategy: str = "kmeans"
    n_select: int | float = 14
    k_neighbors: int = 30
    seed: int = 42
    niter: int = 50
    spherical: bool = True


def how_many(total: int, n: int | float) -> int:
    """A whole number as it is, a share rounded down; never more than there are."""
    return min(total, int(total * n) if isinstance(n, float) else n)


def random_order(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """Rows with ``__key``, the MD5 of seed and id: an order that no partitioning changes."""
    return df.withColumn("__key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))


def key_number(key: Column) -> Column:
    """The first 32 bits of an MD5 key as a number: in the order of the keys."""
    return F.conv(F.left(key, F.lit(8)), 16, 10).cast("long")


def _bin(key: Column, bins: int = 4096) -> Column:
    return F.shiftright(key_number(key), 32 - bins.bit_length() + 1).cast("int")


def random_sample(df: DataFrame, n: int | float, seed: int = 42, id_col: str = "vec_id") -> DataFrame:
    """Rows without replacement, the first by keyed order; the same for the same seed.

    A histogram of the keys tells in which of 4,096 bins the last row lies: bins before it are
    taken whole, and only the rows of that one are ordered.
    """
    keyed = random_order(df, seed, id_col)
    counts = sorted((r["bin"], r["count"]) for r in keyed.groupBy(_bin(F.col("__key")).alias("bin")).count().collect())
    n = how_many(sum(c for _, c in counts), n)
    before, last = 0, -1
    for last, count in counts:
        if before + count > n:
            break
        before += count
    else:
        return keyed.drop("__key")
    edge = keyed.where(_bin(F.col("__key")) == last).orderBy("__key", id_col).limit(n - before)
    return keyed.where(_bin(F.col("__key")) < last).unionByName(edge).drop("__key")


def permuted(df: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    return random_order(df, seed, id_col).orderBy("__key", id_col).drop("__key")


def kmeans_centres(df: DataFrame, k: int, seed: int = 42, niter: int = 50, spherical: bool = True, restarts: int = 5, vector_col: str = "embedding"):
    """The best of a few k-means models by training cost; MLlib spreads the work over the rows.

    Zero vectors have no direction, and MLlib raises an error on them: spherical ones are learned from the others, None without any.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    used = df.where(V.norm(V.doubles(F.col(vector_col))) > 0) if spherical else df
    rows = used.select(array_to_vector(V.doubles(F.col(vector_col))).alias("features")).persist()
    try:
        if spherical and rows.isEmpty():
            return None
        models = [KMeans(k=k, maxIter=niter, seed=seed + i, distanceMeasure="cosine" if spherical else "euclidean").fit(rows) for i in range(restarts)]
    finally:
        rows.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def kmeans_clusters(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """``(doc_id, cluster)`` by the nearest centre; zero vectors, equally far from all spherical ones, go to the first."""
    from pyspark.ml.functions import array_to_vector

    model = kmeans_centres(df, k, vector_col=vector_col, **options)
    first = lambda rows: rows.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("cluster"))
    if model is None:
        return first(df)
    zero = V.norm(V.doubles(F.col(vector_col))) == 0 if options.get("spherical", True) else F.lit(False)
    rows = df.where(~zero).select(F.col(id_col).alias("doc_id"), array_to_vector(V.doubles(F.col(vector_col))).alias("features"))
    made = model.setFeaturesCol("features").setPredictionCol("cluster").transform(rows).select("doc_id", "cluster")
    return made.unionByName(first(df.where(zero)))


def kmeans_sample(df: DataFrame, n: int | float, config: SamplingConfig = SamplingConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(cluster, doc_id)``: the row nearest to each centre, by inner product; a row may stand for two centres."""
    n = how_many(df.count(), n) if isinstance(n, float) else n
    model = kmeans_centres(df, n, config.seed, config.niter, config.spherical, vector_col=vector_col)
    found = model.clusterCenters() if model else [r[0] for r in df.select(V.doubles(F.col(vector_col))).take(1)]
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cluster int, centre array<double>")
    met = df.crossJoin(F.broadcast(centres))  # as many centres as are asked for
    sim = V.dot(V.doubles(F.col(vector_col)), F.col("centre"))
    return met.groupBy("cluster").agg(F.max_by(id_col, F.struct(sim.alias("s"), (-F.col(id_col)).alias("i"))).alias("doc_id"))


def medoids(df: DataFrame, cluster_col: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(cluster, doc_id)``: the row with the least sum of squared distances in its cluster, which is the one nearest to the mean."""
    means = V.mean_vectors(df, [cluster_col], vector_col)
    d = V.euclidean(V.doubles(F.col(vector_col)), F.col("centroid"))
    return df.join(F.broadcast(means), cluster_col).groupBy(F.col(cluster_col).alias("cluster")).agg(F.min_by(id_col, F.struct(d.alias("d"), F.col(id_col).alias("i"))).alias("doc_id"))


def votes(df: DataFrame, k: int = 15, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(candidate, supporter)``: who has whom among its k nearest."""
    return knn(df, df, k, id_col, vector_col).select(F.col("dst").alias("candidate"), F.col("src").alias("supporter"))


def vote_counts(found: DataFrame) -> DataFrame:
    """``(candidate, n_votes, first_vote)`` of a vote table."""
    return found.groupBy("candidate").agg(F.count("*").alias("n_votes"), F.min("supporter").alias("first_vote"))


def vote_k(found: DataFrame, n: int, skip_supporters: bool = False) -> list[int]:
    """The n candidates chosen one by one, each for the supporters that few chosen ones have yet.

    The score of a candidate is the sum over its supporters of 10 to the minus times the
    supporter was served. Ties go to more votes, then to the earlier first vote, then to the
    smaller id. Each pick is one aggregation over the vote table; only the pick and how often
    supporters were served (at most n k rows) move. Without candidates left it ends early.
    """
    found = found.persist()
    spark = found.sparkSession
    chosen: list[int] = []
    served: dict[int, int] = {}
    try:
        while len(chosen) < n:
            times = spark.createDataFrame(list(served.items()), "supporter long, times int") if served else None
            scored = found.where(~F.col("candidate").isin(chosen)) if chosen else found
            if skip_supporters and served:
                scored = scored.where(~F.col("candidate").isin(list(served)))
            scored = scored.join(F.broadcast(times), "supporter", "left") if times is not None else scored.withColumn("times", F.lit(0))
            score = F.sum(F.pow(F.lit(10.0), -F.coalesce("times", F.lit(0))))
            best = scored.groupBy("candidate").agg(F.round(score, 9).alias("score"), F.count("*").alias("votes"), F.min("supporter").alias("first"))
            row = best.orderBy(F.desc("score"), F.desc("votes"), "first", "candidate").first()
            if row is None:
                break
            chosen.append(row["candidate"])
            for r in found.where(F.col("candidate") == row["candidate"]).collect():
                served[r["supporter"]] = served.get(r["supporter"], 0) + 1
    finally:
        found.unpersist()
    return chosen


def sample_ids(df: DataFrame, config: SamplingConfig, id_col: str = "vec_id", vector_col: str = "embedding") -> list[int]:
    """The ids that a configured strategy chooses; a bounded number by nature."""
    n = how_many(df.count(), config.n_select)
    if config.selection_strategy == "random":
        return [r[0] for r in random_sample(df, n, config.seed, id_col).select(id_col).collect()]
    if config.selection_strategy in ("vote_k", "votek"):
        return vote_k(votes(df, config.k_neighbors, id_col, vector_col), n)
    if config.selection_strategy == "kmeans":
        return [r["doc_id"] for r in kmeans_sample(df, max(1, n), config, id_col, vector_col).orderBy("cluster").collect()]
    raise ValueError(f"Unknown selection strategy: {config.selection_strategy}")


def stratified_split(df: DataFrame, label_col: str, share: float = 0.8, seed: int = 42, id_col: str = "vec_id") -> DataFrame:
    """Rows with ``is_train``: of each label the first ``share`` by keyed order.

    Counts of each label and bin of keys tell in which bin its last row lies; only the rows of
    that bin are ranked, so no task holds a label.
    """
    keyed = random_order(df, seed, id_col).withColumn("__bin", _bin(F.col("__key")))
    counts = keyed.groupBy(F.col(label_col).alias("__label"), "__bin").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy("__label").orderBy("__bin")  # at most 4,096 rows a label
    counts = counts.select("__label", "__bin", (F.sum("__n").over(upto) - F.col("__n")).alias("__before"), F.floor(F.sum("__n").over(Window.partitionBy("__label")) * share).alias("__most"), "__n")
    edge = counts.where("__before < __most and __before + __n > __most")
    at = edge.select("__label", F.col("__bin").alias("__edge"), "__before", "__most")
    whole = counts.groupBy("__label").agg(F.max(F.when(F.col("__before") + F.col("__n") <= F.col("__most"), F.col("__bin"))).alias("__whole"))
    met = keyed.join(F.broadcast(whole.join(at, F.equal_null(whole["__label"], at["__label"]), "left").select(whole["__label"], "__whole", "__edge", "__before", "__most")), F.equal_null(F.col(label_col), F.col("__label")), "left")
    inside = F.coalesce(F.col("__bin") <= F.col("__whole"), F.lit(False))
    rest = met.where(F.coalesce(F.col("__bin") == F.col("__edge"), F.lit(False)))
    ranked = rest.withColumn("__r", F.row_number().over(Window.partitionBy(label_col, "__bin").orderBy("__key", id_col))).withColumn("is_train", F.col("__before") + F.col("__r") <= F.col("__most")).drop("__r")
    others = met.where(F.coalesce(F.col("__bin") != F.col("__edge"), F.lit(True))).withColumn("is_train", inside)
    return others.unionByName(ranked).select(*df.columns, "is_train")
