"""The package of training-data operators can be taken away as a whole."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
         "print('COUNTS', len(q), len(o), len(set(o) - set(q)), sum(n.startswith('op') or n == 'pipeline' for n in q))")


@pytest.mark.parametrize("gone", [("parallax/llm", "corpus_pipeline.py"), ("parallax/llm",), ("corpus_pipeline.py",)])
def test_entry_without(tmp_path, gone):
    from parallax.plans import registry

    registry.load_all()
    left_out = [g.split("/")[1] for g in gone if "/" in g]
    shutil.copytree(os.path.join(ROOT, "parallax"), tmp_path / "parallax",
                    ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    queries, oracles, strays, dealt = map(int, done.stdout.rpartition("COUNTS")[2].split())
    assert strays == 0
    if "parallax/llm" in gone:
        assert (queries, oracles, dealt) == (len(registry.QUERIES), len(registry.ORACLE), 0)
        assert queries >= 93
