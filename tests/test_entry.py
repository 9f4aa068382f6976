import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_without_the_training_data_folder(tmp_path):
    shutil.copytree(ROOT / "colloquy", tmp_path / "colloquy", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "colloquy/llm/__pycache__").mkdir(parents=True)  # what a deleted folder may leave
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
