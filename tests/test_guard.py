"""The registered queries without the subpackage on training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.queries()) == set(e.oracle_sql())"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert "enriched_log" in said.stdout and "op1_" not in said.stdout and "pipeline" not in said.stdout.split()


def test_nothing_else_imports_it():
    for path in [*ROOT.glob("footfall/**/*.py"), *ROOT.glob("testbed/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != Path(__file__).name:
            assert "footfall.llm" not in path.read_text()
