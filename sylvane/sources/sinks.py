"""Sinks: JSON, tree documents, DOT and PDF, HTML, LaTeX, CSV, and caches for paid calls."""

from __future__ import annotations

import json
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvane.operators import tree as trees


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_array(df: DataFrame, path: str | None = None) -> str:
    """All rows as one indented array, to a file or returned; for results that people read."""
    text = json.dumps([json.loads(x) for x in df.toJSON().collect()], indent=2, ensure_ascii=False)
    if path:
        Path(path).write_text(text, encoding="utf-8")
    return text


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def latex(df: DataFrame, digits: int = 2) -> str:
    """A small table as LaTeX."""
    return df.toPandas().to_latex(index=False, float_format=f"%.{digits}f") if _has("jinja2") else _plain_latex(df, digits)


def _has(module: str) -> bool:
    import importlib.util

    return importlib.util.find_spec(module) is not None


def _plain_latex(df: DataFrame, digits: int) -> str:
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [" & ".join(df.columns), *[" & ".join(map(show, r)) for r in df.collect()]]
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + " \\\\\n".join(lines) + " \\\\\n\\end{tabular}\n"


def tree_json(nodes: DataFrame, members: DataFrame, path: str) -> None:
    Path(path).write_text(trees.to_json(nodes, members), encoding="utf-8")


def tree_pdf(nodes: DataFrame, path: str, cleanup: bool = True, **options) -> str:
    """A PDF of the tree where Graphviz is installed; else the DOT file. Returns what was written."""
    stem = path.removesuffix(".pdf")
    Path(f"{stem}.dot").write_text(trees.to_dot(nodes, **options), encoding="utf-8")
    if not shutil.which("dot"):
        return f"{stem}.dot"
    subprocess.run(["dot", "-Tpdf", f"{stem}.dot", "-o", f"{stem}.pdf"], check=True, timeout=120)
    if cleanup:
        Path(f"{stem}.dot").unlink()
    return f"{stem}.pdf"


def tree_html(nodes: DataFrame, path: str) -> None:
    """A standalone page with the tree as SVG: green edges for yes, red ones for no."""
    from html import escape

    at = {r["node_id"]: (r["x"] + 80, r["y"] + 40) for r in trees.layout(nodes).collect()}
    labels = {r["node_id"]: (r["label"], r["colour"]) for r in trees.node_labels(nodes).collect()}
    width, height = (max((p[i] for p in at.values()), default=0) + 120 for i in (0, 1))
    parts = []
    for n, (x, y) in at.items():
        if n:
            px, py = at[n[:-1]]
            parts.append(f'<line x1="{px}" y1="{py}" x2="{x}" y2="{y}" stroke="{"green" if n[-1] == "L" else "red"}"/>')
    for n, (x, y) in at.items():
        label, colour = labels[n]
        parts.append(f'<rect x="{x - 65}" y="{y - 18}" width="130" height="36" fill="{colour}" stroke="black"><title>{escape(label)}</title></rect>')
        parts.append(f'<text x="{x}" y="{y + 4}" text-anchor="middle" font-size="10">{escape(label.split(chr(10))[0][:24])}</text>')
    body = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(parts)}</svg>'
    Path(path).write_text(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Topic tree</title></head><body>{body}</body></html>', encoding="utf-8")


class Cache:
    """Results of expensive calls in Parquet, by a hash of model, parameters and input."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"key string, input string, {schema}"

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], self.schema)

    @staticmethod
    def keyed(df: DataFrame, input_col: str, model: str, parameters: str = "") -> DataFrame:
        return df.withColumn("key", F.sha2(F.concat_ws("\u0001", F.lit(model), F.lit(parameters), F.col(input_col)), 256))

    def split(self, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hits with their results, misses)."""
        known = self.rows().drop("input").dropDuplicates(["key"])
        return keyed.join(known, "key"), keyed.join(known, "key", "left_anti")

    def add(self, rows: DataFrame) -> None:
        rows.dropDuplicates(["key"]).write.mode("append").parquet(self.path)

    def stats(self) -> DataFrame:
        """``(n_items, n_bytes)`` of the inputs."""
        return self.rows().agg(F.count("*").alias("n_items"), F.coalesce(F.sum(F.octet_length("input")), F.lit(0)).alias("n_bytes"))
