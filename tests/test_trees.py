import json

import pytest

from sylvane.operators import metrics as M
from sylvane.operators import reports, tree

SHAPES = {
    "single": {"": [0, 1, 2]},
    "pair": {"": [0, 1, 2, 3], "L": [0, 1], "R": [2, 3]},
    "complex5": {"": [0, 1, 2, 3, 4, 5], "L": [0, 1, 2], "LL": [0], "LR": [1, 2], "R": [3, 4, 5]},
    "complex_one_child": {"": [0, 1, 2, 3, 4, 5], "L": [0, 1, 2], "LL": [0], "LR": [1, 2], "R": [3, 4, 5], "RL": [3]},
    "chain": {"": [0, 1, 2, 3], "L": [0, 1, 2], "LL": [0], "LLL": [0]},
    "unbalanced3": {"": [0, 1, 2, 3, 4], "L": [0, 1, 2], "LL": [0], "LLL": [0], "LR": [1, 2], "R": [3, 4]},
    "left_only": {"": [0, 1, 2], "L": [0, 1, 2]},
    "three_leaf": {"": [0, 1, 2, 3, 4, 5], "L": [0, 1], "R": [2, 3, 4, 5], "RL": [2, 3], "RR": [4, 5]},
    "four_leaf9": {"": list(range(9)), "L": [0, 1, 2, 3], "LL": [0, 1], "LR": [2, 3], "R": [4, 5, 6, 7, 8], "RL": [4, 5, 6], "RR": [7, 8]},
    "halves6": {"": [0, 1, 2, 3, 4, 5], "L": [0, 1, 2], "R": [3, 4, 5]},
    "single4": {"": [0, 1, 2, 3]},
}


def members(spark, name):
    return spark.createDataFrame([(n, d, i) for n, docs in SHAPES[name].items() for i, d in enumerate(docs)], tree.MEMBERS)


def majority(spark, name, y):
    at = members(spark, name)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, label int")
    return M.majority(M.assign_clusters(tree.nodes_of(at), at), labels)


@pytest.mark.parametrize(
    ("name", "expected", "sizes"),
    [
        ("single", (1, 0, 1, 0, 0), [3]),
        ("pair", (3, 1, 2, 0, 0), [2, 2]),
        ("complex5", (5, 2, 3, 1, 0), [1, 2, 3]),
        ("complex_one_child", (6, 2, 3, 0, 0), [1, 2, 1]),
        ("chain", (4, 3, 1, 3, 3), [1]),
        ("unbalanced3", (6, 3, 3, 2, 1), [1, 2, 2]),
        ("left_only", (2, 1, 1, 1, 3), [3]),
    ],
)
def test_structure(spark, name, expected, sizes):
    nodes = tree.nodes_of(members(spark, name))
    assert tuple(tree.structure(nodes).first()) == expected
    assert tree.leaf_sizes(nodes).first()["sizes"] == sizes


def test_no_tree(spark):
    nodes = tree.nodes_of(members(spark, "pair").where("false"))
    assert tuple(tree.structure(nodes).first()) == (0, -1, 0, 0, 0)


@pytest.mark.parametrize(
    ("name", "y", "nmi", "ari", "hcv", "accuracy", "macro", "weighted"),
    [
        ("pair", [0, 0, 1, 1], 1, 1, (1, 1, 1), 1, 1, 1),
        ("halves6", [0, 0, 1, 0, 1, 1], 0.081704, -0.111111, (0.081704,) * 3, 0.666667, 0.666667, 0.666667),
        ("halves6", [0, 0, 1, 1, 1, 1], 0.478704, 0.324324, (0.5, 0.459148, 0.478704), 0.833333, 0.828571, 0.838095),
        ("halves6", [0, 0, 1, 1, 2, 2], 0.515804, 0.242424, (0.42062, 0.666667, 0.515804), 0.666667, 0.533333, 0.533333),
        ("four_leaf9", [0, 0, 1, 1, 1, 2, 2, 2, 2], 0.69857, 0.368421, (0.8, 0.619966, 0.69857), 0.888889, 0.896296, 0.883951),
        ("single4", [0, 0, 1, 1], 0, 0, (0, 1, 0), 0.5, 0.333333, 0.333333),
        ("three_leaf", [0, 0, 1, 1, 2, 2], 1, 1, (1, 1, 1), 1, 1, 1),
    ],
)
def test_supervised(spark, name, y, nmi, ari, hcv, accuracy, macro, weighted):
    rows = majority(spark, name, y)
    table = M.contingency(rows)
    near = lambda x: pytest.approx(x, abs=1e-6)
    assert M.nmi(table).first()["nmi_arithmetic"] == near(nmi) and M.ari(table).first()[0] == near(ari)
    assert tuple(M.homogeneity(table).first()) == near(hcv)
    f1 = M.f1(rows).first()
    assert M.accuracy(rows).first()[0] == near(accuracy) and (f1["f1_macro"], f1["f1_weighted"]) == near((macro, weighted))


def test_without_rows(spark):
    rows = majority(spark, "pair", [0, 0, 1, 1]).where("false")
    table = M.contingency(rows)
    assert M.nmi(table).first()[0] == M.ari(table).first()[0] == M.accuracy(rows).first()[0] == M.f1(rows).first()["f1_macro"] == 0
    assert tuple(M.homogeneity(table).first()) == (0, 0, 0) and M.confusion(rows).count() == 0


def test_confusion(spark):
    found = {(r["label"], r["predicted"]): r["n"] for r in M.confusion(majority(spark, "halves6", [0, 0, 1, 1, 1, 1])).collect()}
    assert found == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 3}


E6 = [[0, 0], [0.5, 0.5], [0.2, 0.3], [10, 10], [10.5, 10.5], [10.2, 10.3]]
POOR = [[i / 2, i / 2] for i in range(6)]


@pytest.mark.parametrize(
    ("vectors", "clusters", "silhouette", "db", "ch"),
    [
        (E6, [0, 0, 0, 1, 1, 1], 0.966321, 0.035630, 2368.421053),
        (E6, [0, 0, 1, 2, 2, 2], 0.319794, 3.347605, 894.049669),
        (POOR, [0, 0, 0, 1, 1, 1], 0.513889, 0.444444, 13.5),
    ],
)
def test_embedding_metrics(spark, vectors, clusters, silhouette, db, ch):
    rows = spark.createDataFrame([(i, c, [float(x) for x in v]) for i, (c, v) in enumerate(zip(clusters, vectors))], "doc_id long, cluster int, embedding array<double>")
    assert M.silhouette(rows).first()[0] == pytest.approx(silhouette, abs=1e-6)
    assert M.davies_bouldin(rows).first()[0] == pytest.approx(db, abs=1e-6)
    assert M.calinski_harabasz(rows).first()[0] == pytest.approx(ch, abs=1e-5)
    with pytest.raises(ValueError, match="at least 2 leaf nodes"):
        M.silhouette(rows.where("cluster = 0"))


def test_child_parent(spark):
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(E6)], "doc_id long, embedding array<double>")
    row = M.child_parent(members(spark, "halves6"), vectors).first()
    assert (row["similarity"], row["n_pairs"]) == (pytest.approx(0.998995, abs=1e-6), 2)
    assert tuple(M.child_parent(members(spark, "single"), vectors).first()) == (0, 0, 0)


def test_topic_diversity(spark):
    def nodes(questions):
        return spark.createDataFrame([(n, q, len(n) == max(map(len, questions))) for n, q in questions.items()], "node_id string, question string, is_leaf boolean")

    simple = {"": "Is it about topic A?", "L": "Is it about subtopic A1?", "R": "Is it about subtopic B1?"}
    assert M.topic_diversity(nodes(simple)).first()[0] == pytest.approx(0.5)
    deeper = {"": "Main topic?", "L": "Left topic?", "R": "Right topic?", "LL": "Left-left topic?", "LR": "Left-right topic?"}
    rows = spark.createDataFrame([(n, q, n in ("LL", "LR", "R")) for n, q in deeper.items()], "node_id string, question string, is_leaf boolean")
    assert M.topic_diversity(rows, "leaf_paths").first()[0] == pytest.approx(0.583333, abs=1e-6)
    with pytest.raises(ValueError, match="No questions found"):
        M.topic_diversity(nodes({"": ""}))
    with pytest.raises(ValueError, match="Unknown mode"):
        M.topic_diversity(rows, "other")


def test_json_round_trip_and_dot(spark):
    text = json.dumps({"documents": [0, 1, 2], "question": "Is it " + "long " * 20 + "?", "left": {"documents": [0], "metrics": None}, "right": {"documents": [1, 2]}, "metrics": {"success": True, "nli_calls": 10, "total_time_ms": 100.5, "split_ratio": 0.5, "unknown": 1}})
    nodes, at = tree.from_json(spark, text)
    again = json.loads(tree.to_json(nodes, at))
    assert again["documents"] == [0, 1, 2] and again["right"]["documents"] == [1, 2] and again["metrics"]["nli_calls"] == 10
    dot = tree.to_dot(nodes, ["total_time_ms", "split_ratio", "nli_calls"])
    for part in ("Docs: 3", "total_time_ms: 100.5ms", "split_ratio: 0.500", "nli_calls: 10", "label=YES", "label=NO", "lightgreen", "..."):
        assert part in dot
    assert tree.to_dot(nodes, max_nodes=1).count("Docs:") == 1
    sums = reports.split_metrics_sum(nodes).first()
    assert sums["success"] and sums["nli_calls"] == 10
    assert tree.layout(nodes).count() == 3


def test_isolation(spark):
    at = members(spark, "complex5")
    labels = spark.createDataFrame(list(enumerate([0, 1, 1, 2, 2, 2])), "doc_id long, label int")
    assert {r["label"]: r["depth"] for r in M.isolation_depth(at, labels).collect()} == {0: 2, 1: 2, 2: 1}
    assert M.purity_summary(M.assign_clusters(tree.nodes_of(at), at).join(labels, "doc_id")).first()["average_purity"] == 1


def test_metric_objects(spark):
    metric = M.TableMetric(tree.structure, "height")
    nodes = tree.nodes_of(members(spark, "chain"))
    assert metric(nodes) == metric.call(nodes) == 3
