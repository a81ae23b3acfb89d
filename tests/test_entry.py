import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "paginal", tmp_path / "paginal", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_names_the_subpackage():
    found = [p for p in (ROOT / "paginal").rglob("*.py") if "llm" not in p.parts and "paginal.llm" in p.read_text()]
    assert not found
