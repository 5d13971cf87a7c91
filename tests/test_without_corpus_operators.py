"""The entry module and its queries stand without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sharecast"), tmp_path / "sharecast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = ("import __spark_entry__ as e; q = e.queries(); assert len(q) == len(e.oracle_sql()) == 64, len(q); "
            "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_an_error_inside_the_optional_parts_is_not_hidden(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sharecast"), tmp_path / "sharecast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
