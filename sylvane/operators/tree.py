"""Binary topic trees as two flat tables, nodes and membership.

A node's id is its path from the root: "" for the root, then L (yes) or R (no) for each step.
Depth is the length of the id, the parent is its prefix, and pre-order is the order of ids.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "node_id string, parent_id string, side string, depth int, preorder int, question string, n_docs bigint, is_leaf boolean"
MEMBERS = "node_id string, doc_id bigint, pos int"

# The measures of a split, in order.
SPLIT_METRICS = (
    "success", "llm_input_tokens", "llm_output_tokens", "nli_calls", "faiss_search_time_ms", "kmeans_time_ms", "label_propagation_time_ms",
    "total_time_ms", "split_ratio", "medoid_nli_confidence_avg", "llm_request_time_ms", "nli_time_ms", "num_nodes", "split_entropy",
    "medoid_selection_time_ms", "n_attempts", "medoid_label_propagation_accuracy",
)
WHOLE = ("llm_input_tokens", "llm_output_tokens", "nli_calls", "num_nodes", "n_attempts")


def metrics_schema() -> str:
    return ", ".join(f"{m} {'boolean' if m == 'success' else 'int' if m in WHOLE else 'double'}" for m in SPLIT_METRICS)


def nodes_of(members: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """The node table of a membership table, with ``questions(node_id, question)`` where given."""
    sizes = members.groupBy("node_id").agg(F.count("*").alias("n_docs"))
    parents = sizes.where("node_id <> ''").select(F.expr("left(node_id, length(node_id) - 1)").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    joined = sizes.join(parents, "node_id", "left")
    joined = joined.join(questions, "node_id", "left") if questions is not None else joined.withColumn("question", F.lit(None).cast("string"))
    root = F.col("node_id") == ""
    return joined.select(
        "node_id",
        F.when(~root, F.expr("left(node_id, length(node_id) - 1)")).alias("parent_id"),
        F.when(~root, F.right("node_id", F.lit(1))).alias("side"),
        F.length("node_id").alias("depth"),
        (F.row_number().over(Window.orderBy("node_id")) - 1).alias("preorder"),  # nodes are few: one tree of summaries
        "question",
        "n_docs",
        F.col("inner").isNull().alias("is_leaf"),
    )


def halving_members(assigned: DataFrame, max_depth: int = 10, min_leaf: int = 1, id_col: str = "doc_id", cluster_col: str = "cluster") -> DataFrame:
    """Membership of the tree that halves the sorted list of cluster ids at each node.

    A node with c clusters gives its first c // 2 to the left and the others to the right, until
    one cluster, ``max_depth`` or a side with fewer than ``min_leaf`` documents. Noise (cluster
    -1) goes to the child of the root with fewer clusters, left on a tie, and no deeper. The
    splits depend on the list of clusters only, so they are computed there and joined back.
    """
    rows = assigned.select(F.col(id_col).cast("long").alias("doc_id"), F.col(cluster_col).alias("cluster"))
    sizes = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    noise = sizes.pop(-1, 0)
    paths: list[tuple[str, int]] = []

    def split(clusters: list[int], node: str) -> None:
        paths.extend((node, c) for c in clusters)
        if noise and node == "":
            paths.append(("", -1))
        if len(clusters) < 2 or len(node) >= max_depth:
            return
        left, right = clusters[: len(clusters) // 2], clusters[len(clusters) // 2 :]
        if min(sum(sizes[c] for c in left), sum(sizes[c] for c in right)) < min_leaf:
            return
        if noise and node == "":
            paths.append(("L" if len(left) <= len(right) else "R", -1))
        split(left, node + "L")
        split(right, node + "R")

    if sizes or noise:
        split(sorted(sizes), "")
    table = assigned.sparkSession.createDataFrame(paths, f"node_id string, cluster {dict(rows.dtypes)['cluster']}")
    members = rows.join(F.broadcast(table), "cluster")  # (depth + 1) x clusters rows
    return members.select("node_id", "doc_id", (F.col("doc_id")).alias("pos"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_leaf").orderBy("node_id")


def find_leaf(nodes: DataFrame, members: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(doc_id, node_id)``: the leaf that holds each document."""
    found = members.join(F.broadcast(nodes.where("is_leaf").select("node_id")), "node_id").select("doc_id", "node_id")
    return found if ids is None else found.join(ids, "doc_id", "left_semi")


def prune(nodes: DataFrame, height: int) -> DataFrame:
    """The nodes down to a depth; those at that depth become leaves. One-child nodes are fine."""
    return nodes.where(F.col("depth") <= height).withColumn("is_leaf", F.col("is_leaf") | (F.col("depth") == height))


def structure(nodes: DataFrame) -> DataFrame:
    """One row: number of nodes, height (-1 without nodes), leaves, unbalance of heights and of documents at the root."""
    side = lambda s, x: F.max(F.when(F.col("node_id").startswith(s), x))
    height = lambda s: F.coalesce(side(s, F.col("depth") - 1), F.lit(-1))
    docs = lambda s: F.coalesce(F.max(F.when(F.col("node_id") == s, F.col("n_docs"))), F.lit(0))
    single = F.count("*") < 2
    return nodes.agg(
        F.count("*").alias("n_nodes"),
        F.coalesce(F.max("depth"), F.lit(-1)).alias("height"),
        F.count_if("is_leaf").alias("n_leaves"),
        F.when(single, 0).otherwise(F.abs(height("L") - height("R"))).cast("int").alias("node_unbalance"),
        F.abs(docs("L") - docs("R")).cast("long").alias("doc_unbalance"),
    )


def leaf_sizes(nodes: DataFrame) -> DataFrame:
    """One row: sizes of the leaves in pre-order, with mean, deviation, relative deviation, least and greatest."""
    d = F.col("n_docs").cast("double")
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("node_id", "n_docs"))), lambda x: x["n_docs"])
    std, mean = F.coalesce(F.stddev_pop(d), F.lit(0.0)), F.coalesce(F.avg(d), F.lit(0.0))
    made = nodes.where("is_leaf").agg(sizes.alias("sizes"), mean.alias("mean"), std.alias("std"), F.min("n_docs").alias("least"), F.max("n_docs").alias("greatest"))
    return made.withColumn("relative_std", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.col("mean")))


def sample_documents(members: DataFrame, most: int = 3) -> DataFrame:
    """``(node_id, pos, doc_id, more)``: the first documents of each node and how many it has beyond them."""
    w = Window.partitionBy("node_id")
    ranked = members.select("*", F.row_number().over(w.orderBy("pos", "doc_id")).alias("r")).where(F.col("r") <= most)
    sizes = members.groupBy("node_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return ranked.join(sizes, "node_id").select("node_id", "r", "doc_id", "more")


def text_dump(nodes: DataFrame, members: DataFrame, texts: DataFrame | None = None, most: int = 3) -> DataFrame:
    """``(node_id, no, line)``: the tree as indented lines, to be read by node and number.

    Each node has its size, its question, its first documents (their texts, from a table
    (doc_id, text), or their ids) and how many more there are.
    """
    indent = F.repeat(F.lit("  "), F.length("node_id"))
    side = F.when(F.col("node_id") == "", "").otherwise(F.concat(F.right("node_id", F.lit(1)), F.lit(":")))
    shown = sample_documents(members, most)
    if texts is None:
        shown = shown.withColumn("shown", F.col("doc_id").cast("string"))
    else:
        shown = shown.join(texts.select("doc_id", F.col("text").alias("shown")), "doc_id", "left")
    line = lambda no, text: F.struct(F.lit(no).cast("int").alias("no"), text.alias("line"))
    heads = nodes.select("node_id", F.inline(F.filter(F.array(
        line(0, F.concat(indent, side, F.lit("Node with "), F.col("n_docs").cast("string"), F.lit(" documents"))),
        line(1, F.concat(indent, F.lit("  Question: "), F.col("question"))),
        line(most + 2, F.when(F.col("n_docs") > most, F.concat(indent, F.lit("  ... and "), (F.col("n_docs") - most).cast("string"), F.lit(" more documents")))),
    ), lambda x: x["line"].isNotNull())))
    return heads.unionByName(shown.select("node_id", (F.col("r") + 1).alias("no"), F.concat(indent, F.lit("  - "), F.coalesce("shown", F.lit(""))).alias("line")))


# --- interchange: nested JSON, DOT, layout -------------------------------------------------


def from_json(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of a nested tree document; unknown keys are ignored."""
    nodes, members, stack = [], [], [(json.loads(text), "")]
    while stack:
        node, at = stack.pop()
        kids = [(node.get(k), s) for k, s in (("left", "L"), ("right", "R"))]
        docs = node["documents"]
        members += [(at, int(d), i) for i, d in enumerate(docs)]
        metrics = node.get("metrics")
        nodes.append((at, at[:-1] if at else None, at[-1:] or None, len(at), 0, node.get("question"), len(docs), not any(k for k, _ in kids), node.get("blacklist"), {m: metrics.get(m) for m in SPLIT_METRICS} if metrics else None))
        stack += [(k, at + s) for k, s in kids if k]
    nodes.sort()
    rows = [(*n[:4], i, *n[5:]) for i, n in enumerate(nodes)]
    rows = [(*r[:9], _typed(r[9])) for r in rows]
    return spark.createDataFrame(rows, f"{NODES}, blacklist array<string>, metrics struct<{metrics_schema()}>"), spark.createDataFrame(members, MEMBERS)


def _typed(metrics: dict | None) -> dict | None:
    if metrics is None:
        return None
    kind = lambda m: bool if m == "success" else int if m in WHOLE else float
    return {m: None if v is None else kind(m)(v) for m, v in metrics.items()}


def to_json(nodes: DataFrame, members: DataFrame) -> str:
    """The nested document of a tree whose nodes and members fit the driver, as trees that people read do."""
    docs: dict[str, list[int]] = {}
    for r in members.orderBy("node_id", "pos", "doc_id").toLocalIterator():
        docs.setdefault(r["node_id"], []).append(r["doc_id"])
    made: dict[str, dict] = {}
    for r in sorted(nodes.collect(), key=lambda r: r["node_id"]):
        d = r.asDict(True)
        made[d["node_id"]] = {"documents": docs.get(d["node_id"], []), "left": None, "right": None, "question": d["question"], "metrics": d.get("metrics"), "blacklist": d.get("blacklist")}
        if d["node_id"]:
            made[d["node_id"][:-1]]["left" if d["node_id"][-1] == "L" else "right"] = made[d["node_id"]]
    return json.dumps(made[""], indent=2) if made else "null"


def node_labels(nodes: DataFrame, metrics: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """``(rank, node_id, label, colour)`` in breadth-first order: question, documents, then the asked metrics that are there."""
    from sylvane.functions.text import short_label

    lines: list[Column] = [F.when(F.col("question").isNotNull() & (F.col("question") != ""), F.concat(F.lit("Q: "), short_label(F.col("question")))), F.concat(F.lit("Docs: "), F.col("n_docs").cast("string"))]
    for m in metrics or []:
        v = F.col(f"metrics.{m}")
        if m.endswith("_time_ms"):
            shown = F.concat(F.format_string("%.1f", v.cast("double")), F.lit("ms"))
        elif "ratio" in m or "confidence" in m:
            shown = F.format_string("%.3f", v.cast("double"))
        elif m in WHOLE or m == "success":
            shown = v.cast("string")
        else:
            shown = F.format_string("%.2f", v.cast("double"))
        lines.append(F.when(v.isNotNull(), F.concat(F.lit(f"{m}: "), shown)))
    ranked = nodes.withColumn("rank", F.row_number().over(Window.orderBy("depth", "node_id")) - 1)  # nodes are few
    made = ranked.select("rank", "node_id", F.concat_ws("\n", *lines).alias("label"), F.when(F.col("is_leaf"), "lightgreen").otherwise("lightblue").alias("colour"))
    return made.where(F.col("rank") < max_nodes) if max_nodes is not None else made


def to_dot(nodes: DataFrame, metrics: list[str] | None = None, max_nodes: int | None = None, font_size: int = 10, graph_attr: dict | None = None, node_attr: dict | None = None, edge_attr: dict | None = None) -> str:
    """A DOT graph of the tree; edges are labelled YES and NO."""
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    attributes = lambda d: ", ".join(f"{k}={quote(v)}" for k, v in d.items())
    rows = sorted(node_labels(nodes, metrics, max_nodes).collect(), key=lambda r: r["rank"])
    number = {r["node_id"]: r["rank"] for r in rows}
    out = ["digraph tree {", f"  graph [{attributes({'rankdir': 'TB'} | (graph_attr or {}))}];"]
    out.append(f"  node [{attributes({'shape': 'box', 'style': 'filled', 'fontsize': font_size} | (node_attr or {}))}];")
    out.append(f"  edge [{attributes({'fontsize': font_size} | (edge_attr or {}))}];")
    out += [f"  node_{r['rank']} [label={quote(r['label'])}, fillcolor={r['colour']}];" for r in rows]
    for r in rows:
        if r["node_id"] and r["node_id"][:-1] in number:
            out.append(f"  node_{number[r['node_id'][:-1]]} -> node_{r['rank']} [label={'YES' if r['node_id'][-1] == 'L' else 'NO'}];")
    return "\n".join([*out, "}"])


def layout(nodes: DataFrame, slot: float = 150.0, level: float = 120.0) -> DataFrame:
    """``(node_id, x, y)``: leaves side by side, parents above the middle of their children."""
    rows = {r["node_id"]: r["is_leaf"] for r in nodes.select("node_id", "is_leaf").collect()}
    x: dict[str, float] = {}
    for i, leaf in enumerate(sorted(n for n, is_leaf in rows.items() if is_leaf)):
        x[leaf] = i * slot
    for node in sorted((n for n, is_leaf in rows.items() if not is_leaf), key=len, reverse=True):
        kids = [x[node + s] for s in "LR" if node + s in x]
        x[node] = sum(kids) / len(kids)
    return nodes.sparkSession.createDataFrame([(n, v, len(n) * level) for n, v in sorted(x.items())], "node_id string, x double, y double")
