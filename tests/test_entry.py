"""The entry module with and without its optional parts."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for path in (ROOT / "strandwise").rglob("*.py"):
        if "llm" not in path.parts:
            to = tmp_path / path.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'smem' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
