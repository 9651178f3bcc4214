"""The training-data operators can be deleted, with or without the pipeline beside them."""

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

SAYS = """
import importlib, pkgutil
import __spark_entry__ as entry, strataglyph
for m in pkgutil.walk_packages(strataglyph.__path__, "strataglyph."):
    if not m.name.endswith("__main__"):
        importlib.import_module(m.name)
print(len(entry.queries()), len(entry.oracle_sql()), any(n.startswith("op") or n == "pipeline" for n in entry.queries()))
"""


@pytest.mark.parametrize("gone", [("strataglyph/llm", "corpus_pipeline.py"), ("strataglyph/llm",)])
def test_without_the_optional_parts(tmp_path, gone):
    from strataglyph.plans.registry import ORACLES, QUERIES

    shutil.copytree(ROOT / "strataglyph", tmp_path / "strataglyph", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "False"], done.stderr


def test_a_module_that_is_missing_inside_them_is_told(tmp_path):
    for name in ("__spark_entry__.py",):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "strataglyph", tmp_path / "strataglyph", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "strataglyph/llm").mkdir()
    (tmp_path / "strataglyph/llm/__init__.py").touch()
    (tmp_path / "strataglyph/llm/registry.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
