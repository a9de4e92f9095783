import os
import shutil
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from stylomill.functions import constants as C

ROOT = Path(__file__).resolve().parent.parent


def test_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "stylomill", tmp_path / "stylomill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()), len(e.oracle_sql()) > 30)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert said.stdout.split()[1:] == ["False", "True"]


def test_nothing_else_imports_it():
    for path in (ROOT / "stylomill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path


def test_import_needs_no_jars(tmp_path):
    """A driver may have a PySpark whose jars lie elsewhere."""
    home = Path(pyspark.__file__).parent
    (tmp_path / "pyspark").mkdir()
    for part in home.iterdir():
        if part.name != "jars":
            (tmp_path / "pyspark" / part.name).symlink_to(part)
    code = "import pyspark, pathlib, __spark_entry__ as e; print(pathlib.Path(pyspark.__file__).parent.joinpath('jars').exists(), len(e.queries()) > 40, len(e.oracle_sql()) > 40)"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["False", "True", "True"]


def test_stop_words_are_the_public_list():
    import zipfile

    jars = list(Path(pyspark.__file__).parent.joinpath("jars").glob("spark-mllib_*.jar"))
    if not jars:
        pytest.skip("no jar to compare with")
    with zipfile.ZipFile(jars[0]) as z:
        words = z.read("org/apache/spark/ml/feature/stopwords/german.txt").decode().split()
    assert set(C.stopwords()) == {*words, "dass"}


def test_a_broken_dependency_is_told(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('broken', name='xxhash')")
    code = "import __spark_entry__ as e; print(any(q.startswith('op') for q in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["False"] and "left out" in said.stderr


def test_command_line(spark, tmp_path, capsys):
    from stylomill.__main__ import main

    main([])
    assert "bigram_topk_by_register" in capsys.readouterr().out.split()
    main(["top_tics", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "t"), "--format", "tsv", "--set", "spark.sql.session.timeZone=UTC"])
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).columns == ["arm", "place", "tic", "hits"]
    main(["slop_score", "--rows", "2"])
    assert "slop_score" in capsys.readouterr().out
    with pytest.raises(SystemExit, match="no query"):
        main(["nothing"])
