"""The pipeline over a small table, and its stages' decisions."""

from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"


def test_stages_start_no_other_workers(docs, spark, monkeypatch):
    """Rows that are handed to executors as an RDD start Python workers beside SQL's, which stay."""
    from pyspark import SparkContext
    from quillstone.llm import mixing, near_dup, toxicity

    texts = [f"some {'scum' if i % 5 == 0 else 'fine'} words of text number {i} and more" for i in range(200)]
    rows = docs([*enumerate(texts), (1000, texts[3]), (1001, None)])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")

    def refuse(*_, **__):
        raise AssertionError("an RDD of the driver's rows")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    assert {r["doc_id"] for r in toxicity.reject_toxic(rows, labels).collect()} >= {1001}
    left = {r["doc_id"] for r in near_dup.drop_near_duplicates(rows).collect()}
    assert 3 in left and 1000 not in left and 1001 in left
    assert mixing.mixed(rows).count() >= 202


def test_worker_gives_memory_back():
    import gc
    import os

    import pyarrow as pa
    from quillstone.llm.common import releasing

    if not os.path.exists("/proc/self/statm"):
        pytest.skip("memory can't be read here")

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    pins = []

    def run(batches):
        for batch in batches:
            held = [bytearray(b"x") * 50_000 for _ in range(6000)]
            pins.append(held[-1])  # what is below it is free, but not at the heap's end
            del held
            yield batch

    gc.collect()
    before = resident()
    assert len(list(releasing(run)([pa.record_batch({"x": [1]})]))) == 1 and resident() - before < 100


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = given = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == given.columns
    ids = {name: {r[0] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    names = [n for n, _ in pipeline.STAGES]
    assert ids[names[0]] == ids[names[1]] and ids[names[2]] <= ids[names[1]] and ids[names[3]] == ids[names[2]] == ids[names[4]]
    from test_dedup import near_want

    before = [(r["doc_id"], r["text"]) for r in seen[names[1]].collect()]
    assert ids[names[2]] == {i for i, (n, c, kept) in near_want(before).items() if kept or not n}
