"""What an executor holds beside its heap: Python workers, how many and how large."""

import subprocess
import sys

import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

HELD = """
import numpy as np
from siftstone.llm import common

def anon():
    return int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1]) >> 10

def run(batches):
    for _ in batches:
        parts = [np.ones(12_000) for _ in range(1000)]
        kept.append(np.ones(12_000))
        yield len(parts)

kept = []
before = anon()
assert list(WRAP(run)(iter([1, 2]))) == [1000, 1000]
print(anon() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_back_what_it_freed():
    mb = lambda wrap: int(subprocess.run([sys.executable, "-c", HELD.replace("WRAP", wrap)], capture_output=True, text=True, check=True).stdout)
    assert mb("common.lean") < 20 < 80 < mb("")


def test_no_second_kind_of_worker(spark, tmp_path, monkeypatch):
    """Tables of the driver's values are no Python RDDs, for which executors start a daemon and workers beside SQL's."""
    words = {"en": "the thing was there and then some of it went on ", "de": "der und schein ist ein rechter ort unter allen "}
    rows = [(k, f"{words[lang] * 9}{k}", lang, "a", None) for k in range(20) for lang in [("en", "de")[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    none = docs.where(F.lit(False))
    monkeypatch.setattr(SparkContext, "parallelize", lambda *_, **__: pytest.fail("a Python RDD"))
    assert stages["language_id"](spark, docs, str(tmp_path)).count() == 20
    assert 0 < stages["mixing"](spark, docs, str(tmp_path)).count() <= 20
    assert stages["mixing"](spark, none, str(tmp_path)).count() == stages["language_id"](spark, none, str(tmp_path)).count() == 0
