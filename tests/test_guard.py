import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_library_stands_without_the_corpus_operations(tmp_path):
    shutil.copytree(REPO / "trellis", tmp_path / "trellis", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.queries()) > 50)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["0", "True"], done.stderr


def test_nothing_else_imports_them():
    for path in (REPO / "trellis").rglob("*.py"):
        if "llm" not in path.parts:
            assert "trellis.llm" not in path.read_text()
