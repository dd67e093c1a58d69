"""The repository with and without the parts that can be taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("taken_out", [False, True])
def test_everything_is_collected(tmp_path, taken_out):
    out = ("stratamesh/llm", "tests/llm", "corpus_pipeline.py") if taken_out else ()
    shutil.copytree(ROOT, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or str((Path(d) / n).relative_to(ROOT)) in out])
    run = lambda *a: subprocess.run([sys.executable, *a], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    entry = run("-c", "import __spark_entry__ as e; print(sum(q.startswith('op') and '_' in q for q in e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))")
    assert entry.returncode == 0, entry.stderr
    has_llm = (ROOT / "stratamesh/llm").exists() and not taken_out
    assert entry.stdout.split()[1:] == [str(has_llm), "True"]
    got = run("-m", "pytest", "tests", "--collect-only", "-q")
    assert got.returncode == 0, got.stdout[-2000:]
    assert "test_operators.py::" in got.stdout and ("tests/llm/" in got.stdout) == has_llm


def test_a_broken_subpackage_is_no_missing_one(tmp_path):
    if not (ROOT / "stratamesh/llm").exists():
        pytest.skip("taken out")
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "r/stratamesh/llm/packing.py").write_text("import no_such_library\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert got.returncode and "no_such_library" in got.stderr
