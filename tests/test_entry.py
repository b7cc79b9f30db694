import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_corpus_subpackage(tmp_path):
    """The library and its queries do without the subpackage and the pipeline."""
    for name in ("__spark_entry__.py", "tablewright"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "tablewright"
    package.mkdir()
    for p in (ROOT / "tablewright").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 45; print(len(q))"
    copy = tmp_path / "__spark_entry__.py"
    copy.unlink()
    copy.write_text((ROOT / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
    assert out.returncode == 0, out.stderr
