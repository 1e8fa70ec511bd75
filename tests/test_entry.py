"""The entry file without the training-data part, and a session without a checkpoint folder."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code, cwd, **env):
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True, timeout=300, env={**os.environ, **env, "PYTHONPATH": str(cwd)})
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_entry_without_the_training_data_part(tmp_path):
    for part in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, part)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 280 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    _run(code, tmp_path)
    # what git leaves behind when only modules go: a folder without them
    os.makedirs(tmp_path / "tidemark" / "llm" / "__pycache__")
    _run(code, tmp_path)


def test_a_local_session_without_the_setting_gets_its_own_folder(tmp_path):
    os.makedirs(tmp_path / "conf")
    code = (
        "from tidemark.session import local_session, cut_lineage\n"
        "spark = local_session('2', shuffle_partitions=2, memory='1g')\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert cut_lineage(spark.range(7)).count() == 7\n"
    )
    _run(code, ROOT, SPARK_CONF_DIR=str(tmp_path / "conf"))
