"""Connected components by alternating stars, for links that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvane.session import ensure_checkpoint_dir


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link; root is the least node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014) alternate until the links are
    stars around the least node of each component. Minima are aggregated before they are
    shuffled and no neighbourhood is gathered as a list, so a hub costs a skewed join that
    AQE can split. Each round is checkpointed. Self links, repeated links and links with a
    null end are dropped; no links give an empty result.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    edges = edges.where("x and y and u <> v").select("u", "v").distinct().checkpoint()
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
