import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["event_type", "a", "b", "gap"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_the_removable_part(tmp_path):
    import shutil

    shutil.copytree(HERE / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
