"""Command line: ``python -m sylvane.cli COMMAND ...``."""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark import cloudpickle
from pyspark.sql import functions as F

from sylvane import defaults
from sylvane.operators import build, nli, pairs, search
from sylvane.operators.models import HashingEmbedder, LexicalEntailment, embed_documents
from sylvane.session import ensure_checkpoint_dir, local_session
from sylvane.sources import readers, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sylvane")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *arguments: str, **options) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=about)
        for a in arguments:
            made.add_argument(a)
        for a, given in options.items():
            made.add_argument(f"--{a.replace('_', '-')}", **given)
        return made

    output = {"output_file": {}}
    extract = {"extract": {"help": "module:function from the bytes of a PDF to its page texts"}}
    command("entail", "does a premise entail a hypothesis?", "premise", "hypothesis")
    command("entail-files", "text files against hypotheses", hypothesis={"action": "append", "required": True}, **output).add_argument("files", nargs="+")
    command("search", "files of a directory, and of those below it, against a TOML recipe", "directory", "recipe", n_max={"type": int}, suffix={"choices": ["txt", "pdf"], "default": "txt"}, **extract, **output)
    command("issues", "problems that the pages of a PDF raise, and how deeply", "pdf", start_page={"type": int, "default": 0}, end_page={"type": int, "default": -1}, findings={"action": "store_true"}, **extract, **output)
    command("phrases", "similarities of the given phrases", max_ngram={"type": int, "default": 3}, digits={"type": int, "default": 4}).add_argument("phrases", nargs="+")
    command("from-table", "similarities of a table's texts by category", "file", "text", max_ngram={"type": int, "default": 3}, digits={"type": int, "default": 4}).add_argument("categories", nargs="*")
    command("build-tree", "a topic tree of a JSONL or Parquet data set, as JSON and DOT or PDF", "data", "output", n={"type": int, "default": 500}, dataset={"default": "default"}, max_depth={"type": int, "default": 10}, split={"choices": ["propagate", "kmeans"], "default": "propagate"})
    return parser


def _extractor(name: str | None):
    if not name:
        raise SystemExit("PDF files need --extract module:function")
    module, function = name.split(":")
    found = import_module(module)
    # executors may not have the module
    cloudpickle.register_pickle_by_value(found)
    return getattr(found, function)


def similarities(rows, text: str, categories: list[str], n: int = 3, digits: int = 4):
    """``(category, line)`` of a table's texts, all three components, with the stand-in models."""
    # the checkpoint keeps the ids as they were made first
    ids = rows.select(F.col(text).alias("text"), *categories).withColumn("id", F.uuid()).checkpoint()
    vectors = ids.withColumn("vector", HashingEmbedder().embed(F.col("text")))
    return pairs.similarity_lines(pairs.similarity_report(vectors, "id", "text", "vector", categories or None, n, LexicalEntailment()), digits)


def main(args: list[str] | None = None) -> None:
    given = _parser().parse_args(args)
    spark, scorer = local_session(), LexicalEntailment()
    if given.command in ("phrases", "from-table"):
        ensure_checkpoint_dir(spark)
        rows = readers.table(spark, given.file) if given.command == "from-table" else spark.createDataFrame([(p,) for p in given.phrases], "text string")
        named = (given.text, given.categories) if given.command == "from-table" else ("text", [])
        for row in similarities(rows, *named, given.max_ngram, given.digits).orderBy("category").toLocalIterator():
            print(row["line"])
        return
    if given.command == "build-tree":
        rows = readers.sample(spark, given.data, given.n, dataset=given.dataset)
        made = build.build_tree(rows, embed_documents(rows, HashingEmbedder()), build.TreeConfig(max_depth=given.max_depth, split=given.split))
        sinks.tree_json(*made, f"{given.output}.json")
        print(sinks.tree_pdf(made[0], f"{given.output}.pdf"))
        return
    if given.command == "search":
        if given.suffix == "pdf":
            files = readers.first_files(readers.pdf_files(spark, given.directory), given.n_max)
            files = readers.whole_text(readers.pdf_pages(files, _extractor(given.extract)))
        else:
            files = readers.first_files(readers.text_files(spark, given.directory, recursive=True), given.n_max)
        result = search.report(search.search(files, readers.recipe(given.recipe), scorer, "path"))
    elif given.command == "issues":
        pages = readers.pdf_pages(readers.pdf_files(spark, given.pdf), _extractor(given.extract))
        found = search.issues(pages, defaults.PROBLEMS, defaults.DEPTHS, scorer, start=given.start_page, end=given.end_page)
        result = found[0 if given.findings else 1]
    else:
        if given.command == "entail":
            docs, asked = spark.createDataFrame([("premise", given.premise)], "path string, text string"), [given.hypothesis]
        else:
            docs, asked = readers.text_files(spark, given.files), given.hypothesis
        table = spark.createDataFrame([(h,) for h in asked], "hypothesis string")
        result = nli.nli_results(nli.pooled_logits(docs, table, scorer, "path")).orderBy("hypothesis", "doc_id")
    text = sinks.json_array(result, getattr(given, "output_file", None))
    if not getattr(given, "output_file", None):
        print(text)


if __name__ == "__main__":
    main()
