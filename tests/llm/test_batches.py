"""Batches are bounded by bytes, and so is what operators hold."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest

from threadloom.llm.common import BATCH_BYTES, slices

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import random, resource, sys
import pyarrow as pa
from threadloom.llm import {module} as operator
from threadloom.llm.common import paused_collection, slices
rng = random.Random(1)
words = ["w%d" % i for i in range(50)]
texts = [" ".join(rng.choices(words, k=20_000)) for _ in range(256)]
batch = pa.RecordBatch.from_pydict({{"text": texts}})
del texts
for part in slices(batch):
    with paused_collection():
        operator.{function}(part.column("text").to_pylist())
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("module,function", [("quality", "measure"), ("simhash", "fingerprints"), ("simhash", "shingle_sets")])
def test_memory_of_long_texts(module, function):
    """256 texts of 20,000 repetitive words take less than 400 MB."""
    done = subprocess.run([sys.executable, "-c", RUN.format(module=module, function=function)], capture_output=True, text=True, cwd=ROOT, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) < 400


def test_slices():
    texts = ["x" * n for n in (10, 0, 5 << 20, 1, 1 << 20, 1 << 20, 1 << 20, 1 << 20, 1 << 20, 3)] + [None]
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": list(range(len(texts)))})
    parts = list(slices(batch))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(len(texts)))
    assert all(p.nbytes <= BATCH_BYTES or p.num_rows == 1 for p in parts)
    assert list(slices(batch.slice(0, 0))) == []
