import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry(spark):
    import __spark_entry__

    made = __spark_entry__.entry(spark)
    assert made.columns == ["node_id", "question", "n_docs", "is_leaf"] and made.count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_folders(tmp_path):
    """The library imports and lists its other queries when those folders are gone."""
    import shutil

    for name in ("sylvane", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "sylvane/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_a_missing_module_of_the_llm_folders_leaves_the_rest(tmp_path):
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_llm_folders():
    own = [p for p in (ROOT / "sylvane").rglob("*.py") if "llm" not in p.parts] + [p for p in (ROOT / "tests").glob("*.py")]
    assert not [p for p in own if p != Path(__file__) and ("sylvane.llm" in p.read_text() or "corpus_pipeline" in p.read_text())]


def test_no_local_checkpoint_folder_on_a_cluster():
    import pytest

    from sylvane import session

    class Context:
        master, _jsc = "spark://host:7077", type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()
        getConf = lambda self: {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(type("Spark", (), {"sparkContext": Context()})())
    assert session.is_local("local[8]") and session.is_local("local") and not session.is_local("local-cluster[3,2,1024]")
