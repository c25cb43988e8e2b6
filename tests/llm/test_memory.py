"""What the driver holds besides results, what executors give back and the files that tables are written to."""

import tracemalloc
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sylvan.llm import common, jaccard_join, nbsvm


def test_log_count_ratio_holds_no_copy_of_all_rows():
    rng, label = np.random.default_rng(0), np.arange(400) % 4 == 0
    rows = [rng.integers(0, 1000, 10_000, np.int32) for _ in label]
    tracemalloc.start()
    got = nbsvm.log_count_ratio(rows, label, 1000, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20  # the rows have 16 MB
    p, q = (1.0 + np.bincount(np.concatenate([x for x, one in zip(rows, label, strict=True) if one == kind]), minlength=1000) for kind in (True, False))
    assert np.array_equal(got, np.log(p / p.sum()) - np.log(q / q.sum()))
    assert np.array_equal(nbsvm.log_count_ratio([], np.zeros(0), 4, 1.0), np.zeros(4))


@pytest.mark.parametrize(("total", "runs"), [(300, 0), (400, 1)])
def test_driver_heap_is_collected_beyond_half_its_limit(total, runs):
    calls = []
    heap = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 750, gc=lambda: calls.append(1))
    common.collected(SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap)))))
    assert len(calls) == runs


def test_tables_are_written_with_little_heap(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "collected", lambda jvm: calls.append(jvm.java.lang.Runtime.getRuntime().maxMemory() > 0))
    assert common.written(spark.range(3), "small").count() == 3 and calls == [True]


def test_executors_collect_their_garbage(spark):
    """In local mode the driver's JVM is the executor's."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    common.collected_by_executors(spark)
    assert full() > before


def test_large_steps_and_stages_end_with_a_collection(spark, monkeypatch):
    calls = []
    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "collected_by_executors", lambda s: calls.append(s))
    common.written(spark.range(3), "small")
    assert not calls
    common.written(spark.range(3), "large", large=True)
    assert len(calls) == 1
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, "")
    assert len(calls) == 2


def test_written_tables_start_no_process_for_checksum_files(spark):
    df = common.written(spark.range(0, 100, 1, 4), "raw")
    folder = Path(urlparse(df.inputFiles()[0]).path).parent
    assert len(list(folder.glob("*.parquet"))) == 4 and not list(folder.glob(".*.crc"))
    assert sorted(r.id for r in df.collect()) == list(range(100))


def test_few_sets_of_many_files_are_written_to_few_files(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(k, text + " end" if k == 1 else text if k == 0 else f"only {k} stands here in this text") for k in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(16, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs, files, plain = spark.read.parquet(str(tmp_path / "docs")), {}, common.written

    def counted(df, tag, **rest):
        out = plain(df, tag, **rest)
        files.setdefault(tag, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(32)], "a long, b long")
    sketches = jaccard_join.summaries(docs).where("kind = 0").withColumn("sketch", F.lit(bytes(32)))
    links = jaccard_join.verified(pairs, docs, sketches).collect()
    assert [tuple(x) for x in links] == [(0, 1)] and files["sets"] == [1]
