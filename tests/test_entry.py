"""The driver contract without the text operators, and scratch space on clusters."""

import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from vexilar import session
from vexilar.plans import queries as core

HOME = Path(__file__).parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("pipeline", [False, True])
def test_core_queries_stand_without_the_text_operators(tmp_path, pipeline):
    shutil.copytree(HOME / "vexilar", tmp_path / "vexilar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (HOME / "corpus_pipeline.py").exists())
    for name in names:
        shutil.copy(HOME / name, tmp_path / name)
    found = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert found == [str(len(core.queries())), str(len(core.oracle_sql())), "False"]


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://host"])
def test_clusters_need_a_shared_folder(master):
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)
