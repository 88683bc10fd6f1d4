"""The library works without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_llm(tmp_path):
    for name in ("tessera", "__spark_entry__.py", "bench.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dedup_summary' in q and not any(k.startswith('op2_') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
