"""What tasks of the pipeline hold beside their executor's heap."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest

import corpus_pipeline as P

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Runs a task of the sketches on 24 MB of texts beside the tokenizer, as the stages share their workers; prints the MB that its process holds before and afterwards, and its peak.
TASK = """
import ctypes, random, re
import pyarrow as pa
from quern.llm import bpe, order_minhash
from quern.llm.queries import tokenizer_path

class Docs:
    columns = ["doc_id", "text"]
    def select(self, *columns):
        return self
    def mapInArrow(self, over, schema):
        return over

def held(of="Rss", file="smaps_rollup"):
    return int(re.search(rf"\\n{of}:\\s+(\\d+)", open(f"/proc/self/{file}").read())[1]) // 1024

def batches():
    r = random.Random(7)
    for k in range(12):
        words = ["".join(r.choices("aeiounrstl", k=r.randint(3, 9))) for _ in range(30_000)]
        texts = [" ".join(r.choices(words, k=300)) for _ in range(1000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(k * 1000, k * 1000 + 1000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

path = tokenizer_path()
bpe.load(path)
over = order_minhash._sketched(Docs(), 5)
for b in batches():
    pass
del b
ctypes.CDLL(None).malloc_trim(0)
pa.default_memory_pool().release_unused()
before = held()
for b in over(batches()):
    pass
print(before, held(), held("VmHWM", "status"))
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_task_hands_its_memory_back():
    out = subprocess.run([sys.executable, "-c", TASK], capture_output=True, text=True, timeout=300, cwd=ROOT, env=os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))})
    assert out.returncode == 0, out.stderr
    before, after, peak = map(int, out.stdout.split())
    assert after - before <= 30
    assert peak - before <= 55


@pytest.mark.parametrize("k", [0, 2, 4])
def test_texts_reach_python_in_small_batches(spark, k):
    stage = P.STAGES[k][1]
    old = spark.conf.get(P.BATCH_SETTING, None)
    try:
        docs = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "concat(id, repeat(' word', 800)) text", "'en' lang", "'a' source", "4000 n_chars")
        stage(spark, docs, "/root/testdata/sf0.001")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

        got = docs.mapInArrow(sizes, "n bigint, size bigint").collect()
    finally:
        spark.conf.unset(P.BATCH_SETTING) if old is None else spark.conf.set(P.BATCH_SETTING, old)
    assert sum(r.n for r in got) == 4000
    assert max(r.size for r in got) < 2 * P.BATCH
