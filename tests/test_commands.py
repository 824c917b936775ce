"""The commands and the operators behind them."""

import json

import pytest

from sylvane import cli, defaults
from sylvane.operators import pairs, reports, tree
from sylvane.operators.models import LexicalEntailment
from sylvane.sources import readers


def pages_of(content: bytes) -> list[str]:
    """Stands for a PDF extractor: pages end with a form feed."""
    return content.decode().split("\f")


def test_search_goes_below_folders(spark, tmp_path, capsys):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one key")
    (tmp_path / "in" / "deep" / "b.txt").write_text("no such word")
    (tmp_path / "r.toml").write_text('keywords = ["key"]')
    cli.main(["search", str(tmp_path / "in"), str(tmp_path / "r.toml")])
    found = {r["id"].rsplit("/", 1)[1]: r["answers"][0]["output"] for r in json.loads(capsys.readouterr().out)}
    assert found == {"a.txt": "true", "b.txt": "false"}


def test_pages_of_pdf_files(spark, tmp_path, capsys):
    (tmp_path / "a.PDF").write_bytes(b"nothing here\f" + defaults.PROBLEMS["fairness"].encode())
    cli.main(["issues", str(tmp_path), "--findings", "--extract", f"{__name__}:pages_of"])
    assert {"page": 1, "problem_name": "fairness"}.items() <= max(json.loads(capsys.readouterr().out), key=lambda r: r["problem_name"] == "fairness").items()
    cli.main(["issues", str(tmp_path), "--findings", "--end-page", "1", "--extract", f"{__name__}:pages_of"])
    assert json.loads(capsys.readouterr().out) == []
    with pytest.raises(SystemExit):
        cli.main(["issues", str(tmp_path)])


def test_similarities_of_phrases_and_tables(spark, tmp_path, capsys):
    cli.main(["phrases", "red house", "red house", "--digits", "2"])
    assert capsys.readouterr().out == "all, 1.00 \\pm 0.00, 1.00 \\pm 0.00, 0.87 \\pm 0.00\n"
    (tmp_path / "t.csv").write_text("t,c\nred house,x\nred house,x\nblue sky,y\n,y\n")
    cli.main(["from-table", str(tmp_path / "t.csv"), "t", "c", "--digits", "1"])
    assert capsys.readouterr().out == "x, 1.0 \\pm 0.0, 1.0 \\pm 0.0, 0.9 \\pm 0.0\ny, NaN \\pm NaN, NaN \\pm NaN, NaN \\pm NaN\n"


def test_components_that_are_not_asked_for_are_null(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, None)], "id int, t string")
    row = pairs.similarity_report(df, "id", "t", scorer=LexicalEntailment()).first()
    assert row["n"] == 2 and row["semantic"] is None and row["lexical"]["mean"] == pytest.approx(1 / 5)


def test_semantic_similarity_without_vectors(spark):
    df = spark.createDataFrame([(1, None)], "id int, v array<double>")
    assert pairs.semantic_similarity(df, "v").first()["n"] == 0


def test_text_dump_reads_from_top_to_bottom(spark):
    nodes = spark.createDataFrame([("", "Is it red?", 4), ("L", None, 1), ("R", None, 3)], "node_id string, question string, n_docs long")
    members = spark.createDataFrame([("", i, i) for i in range(4)] + [("L", 0, 0)] + [("R", i, i) for i in (1, 2, 3)], "node_id string, doc_id long, pos int")
    texts = spark.createDataFrame([(0, "rose"), (1, "sky"), (2, None)], "doc_id long, text string")
    lines = [r["line"] for r in tree.text_dump(nodes, members, texts, 2).orderBy("node_id", "no").collect()]
    assert lines == ["Node with 4 documents", "  Question: Is it red?", "  - rose", "  - sky", "  ... and 2 more documents", "  L:Node with 1 documents", "    - rose", "  R:Node with 3 documents", "    - sky", "    - ", "    ... and 1 more documents"]


def test_reports_with_different_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    rows = {r["report"]: (r["x"], r["y"]) for r in reports.union_reports({"a": a, "b": b}).collect()}
    assert rows == {"a": (1, None), "b": (2, 3)}
    with pytest.raises(ValueError):
        reports.union_reports({})


def test_files_that_have_a_result_are_skipped(spark):
    files = spark.createDataFrame([("d/a.json",), ("d/b.json",), ("d.x/c",)], "path string")
    done = spark.createDataFrame([("d/a.csv",), ("d/a.csv",)], "path string")
    assert {r["path"] for r in readers.without_output(files, done).collect()} == {"d/b.json", "d.x/c"}


def test_tree_of_a_data_set(spark, tmp_path, capsys):
    lines = [json.dumps({"doc_id": i, "text": f"{'red rose flower' if i % 2 else 'blue sky cloud'} {i % 3}", "label": i % 2}) for i in range(24)]
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    cli.main(["build-tree", str(tmp_path / "d.jsonl"), str(tmp_path / "out"), "--max-depth", "1"])
    assert capsys.readouterr().out.strip().startswith(str(tmp_path / "out"))
    nodes, members = readers.tree(spark, str(tmp_path / "out.json"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, label int")
    made = reports.evaluate_files([str(tmp_path / "out.json")], lambda f: readers.tree(spark, f), labels).collect()
    assert nodes.where("node_id = ''").first()["n_docs"] == 24 and len(made) == 1 and made[0]["n_nodes"] == nodes.count()
