"""The entry module works with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_llm_folder(tmp_path):
    shutil.copytree(os.path.join(HERE, "sparkloom"), tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(HERE, "sparkloom")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert ".llm" not in f.read(), n
