from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_corpus_operators(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tessera/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q) and not [k for k in q if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)


def test_a_missing_library_is_not_hidden(tmp_path):
    for name in ("tessera", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if not source.exists():
            pytest.skip("the corpus operators are absent")
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    if not (tmp_path / "tessera/llm").is_dir():
        pytest.skip("the corpus operators are absent")
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError(name='xxhash')")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, timeout=120)
    assert done.returncode and b"xxhash" in done.stderr


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_flagship(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["cls", "thr", "ap"] and frame.count() == 60
