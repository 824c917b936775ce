"""Classifying documents with a tree, and paths through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvane.operators import nli
from sylvane.operators.models import EntailmentScorer


def leaf_labels(nodes: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node_id, label)``: the most frequent label of each leaf, the one seen first on a tie."""
    votes = members.join(F.broadcast(nodes.where("is_leaf").select("node_id")), "node_id").join(labels, "doc_id")
    counted = votes.groupBy("node_id", "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("node_id").agg(F.max_by("label", F.struct("n", (-F.col("first")).alias("f"))).alias("label"))


def walk(docs: DataFrame, nodes: DataFrame, scorer: EntailmentScorer, id_col: str = "doc_id", text_col: str = "text", max_depth: int | None = None, short: int | None = None) -> DataFrame:
    """``(doc_id, node_id, path)``: the leaf each document comes to, and its decisions from the root.

    All documents go down together, a level at a time, each meeting the question of its own
    node; yes goes left. ``path`` is an array of (hypothesis, decision). A missing child raises.
    """
    inner = [r.asDict() for r in nodes.where("not is_leaf").select("node_id", "question").collect()]
    ids = {r["node_id"] for r in nodes.select("node_id").collect()}
    if missing := [r["node_id"] + s for r in inner for s in "LR" if r["node_id"] + s not in ids]:
        raise ValueError(f"missing child: {missing[0]}")
    spark = docs.sparkSession
    asked = spark.createDataFrame([(r["node_id"], r["question"] or "") for r in inner], "node_id string, hypothesis string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    empty = F.array().cast("array<struct<hypothesis:string,decision:string>>")
    at = texts.select("doc_id", F.lit("").alias("node_id"), empty.alias("path"))
    # a document is scored for the questions of its own path only: level by level
    for depth in range(max((len(r["node_id"]) for r in inner), default=-1) + 1):
        level = asked.where(F.length("node_id") == depth)
        here = at.join(F.broadcast(level), "node_id")
        logits = nli.pooled_logits(texts.join(here.select("doc_id"), "doc_id", "left_semi"), here.select("doc_id", "hypothesis"), scorer)
        verdict = nli.nli_logits(logits).select("doc_id", "is_entailed")
        moved = here.join(verdict, "doc_id").select(
            "doc_id",
            F.concat("node_id", F.when(F.col("is_entailed"), "L").otherwise("R")).alias("node_id"),
            F.concat("path", F.array(F.struct("hypothesis", F.when(F.col("is_entailed"), "yes").otherwise("no").alias("decision")))).alias("path"),
        )
        at = at.join(F.broadcast(level.select("node_id")), "node_id", "left_anti").unionByName(moved)
    return at


def classify(docs: DataFrame, nodes: DataFrame, members: DataFrame, labels: DataFrame, scorer: EntailmentScorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, node_id, path, label)``: the leaf, the decisions and the leaf's most frequent label."""
    return walk(docs, nodes, scorer, id_col, text_col).join(F.broadcast(leaf_labels(nodes, members, labels)), "node_id", "left")


def path_documents(paths: DataFrame, members: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """``(path_no, doc_id)``: up to ``most`` documents of each path's leaf, without replacement.

    A leaf's documents are ordered by a key of the seed, and every path takes the run of them
    that begins at a place of its own, so the work is one ranking and a join of equal keys.
    """
    hashed = lambda *c: F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *c)), F.lit(8)), 16, 10).cast("long")
    wanted = paths.select("node_id").distinct()
    w = Window.partitionBy("node_id")
    ranked = members.join(F.broadcast(wanted), "node_id", "left_semi").select(
        "node_id", "doc_id", (F.row_number().over(w.orderBy(hashed(F.col("doc_id").cast("string")), "doc_id")) - 1).alias("r"), F.count("*").over(w).alias("size")
    )
    sizes = ranked.where("r = 0").select("node_id", "size")
    begun = paths.join(sizes, "node_id").select("path_no", "node_id", "size", (hashed(F.lit("path"), F.col("path_no").cast("string")) % F.col("size")).alias("start"))
    places = begun.select("path_no", "node_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(i < F.col("size"), (F.col("start") + i) % F.col("size")))).alias("r"))
    return places.where("r is not null").join(ranked.select("node_id", "r", "doc_id"), ["node_id", "r"]).select("path_no", "doc_id")


def random_paths(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``(path_no, node_id, path)``: n paths by fair, keyed coins; a coin for a missing child takes the other one."""
    spark = nodes.sparkSession
    table = {r["node_id"]: r["question"] for r in nodes.select("node_id", "question").collect()}
    deepest = max(map(len, table))
    coins = spark.range(n).select(F.col("id").alias("path_no"), *[(F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.lit(str(d)))), F.lit(1)), 16, 10).cast("int") % 2).alias(f"c{d}") for d in range(max(1, deepest))])
    at, path = F.lit(""), F.array().cast("array<struct<hypothesis:string,decision:string>>")
    known = F.create_map(*[x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(v or ""))])
    rows = coins.select("*", at.alias("node_id"), path.alias("path"))
    for d in range(deepest):
        left, right = F.concat("node_id", F.lit("L")), F.concat("node_id", F.lit("R"))
        has = lambda c: F.try_element_at(known, c).isNotNull()
        goes = F.when(has(left) & ((F.col(f"c{d}") == 1) | ~has(right)), left).when(has(right), right)
        step = F.struct(F.try_element_at(known, F.col("node_id")).alias("hypothesis"), F.when(F.right(goes, F.lit(1)) == "L", "yes").otherwise("no").alias("decision"))
        rows = rows.select("path_no", *[f"c{i}" for i in range(deepest)], F.coalesce(goes, F.col("node_id")).alias("node_id"), F.when(goes.isNotNull(), F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"))
    return rows.select("path_no", "node_id", "path")
