"""Tasks carry their code: workers that cannot import the package run the Python operators."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from tidemark.session import local_session
spark = local_session("2", 2, "1g")

def probe(batches):
    import importlib.util
    for batch in batches:
        yield batch.assign(found=importlib.util.find_spec("tidemark") is not None)

assert not any(r["found"] for r in spark.range(2).mapInPandas(probe, "id long, found boolean").collect())
from tidemark.llm import periodic_runs, sentencepieces, token_counts
docs = spark.createDataFrame([(1, "one two three " * 900), (2, None)], "doc_id long, text string")
assert token_counts.counted_documents(docs, "/opt/tokenizers/word_bpe_49k.json").count() == 2
assert periodic_runs.runs_of_documents(docs).count() == 2
out = sentencepieces.encoded(docs, "/opt/tokenizers/piece_bpe_32k.model", giant=1000, chunk=4000).collect()
assert len(out) == 2 and all(r["round_trip"] for r in out)
"""


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="vocabularies not present")
def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
