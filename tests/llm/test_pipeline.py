import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from webquarry.llm import decontam, mixing
from webquarry.llm.common import written

from .test_simhash import slow_components


@pytest.fixture(scope="module")
def table(spark, sf, tmp_path_factory):
    """documents of the small table, with rows that each stage must handle."""
    d = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    more = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "1234 -- 5678", "en", "src1", 12), (9004, "Some words of its own. " + leak, "en", "src1", 0), (None, "the only house in the town is here", "en", None, 0)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in cp.STAGES:
        before = docs
        docs, _ = written(stage(spark, docs, table), "t")
        steps[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns
    before, after = steps["language_id"]
    gone = {r.doc_id for r in before.select("doc_id").subtract(after.select("doc_id")).collect()}
    assert {9001, 9002, 9003} <= gone and 9004 not in gone and len(gone) < 12
    before, after = steps["simhash_near_dedup"]
    want = {c for _, _, c in slow_components([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in after.collect()} == want
    before, after = steps["benchmark_decontamination"]
    leaked = {r.doc_id for r in decontam.leaks(before, spark.read.parquet(f"{table}/benchmark.parquet")).collect()}
    assert 9004 in leaked and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaked
    before, after = steps["mixing_sources"]
    used = collections.Counter(r.doc_id for r in mixing.mix(before).collect())
    assert collections.Counter(r.doc_id for r in after.collect()) == used
    before, after = steps["sharding"]
    sizes = collections.Counter(r["shard"] for r in after.collect())
    assert after.count() == before.count() and max(sizes.values()) - min(sizes.values()) <= 1
    same = cp.run(spark, table)
    assert same.count() == after.count() and same.columns == after.columns
    assert same.select("doc_id", "shard", "slot").exceptAll(after.select("doc_id", "shard", "slot")).count() == 0


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    for _, stage in cp.STAGES:
        docs, _ = written(stage(spark, docs, sf), "t")
        assert docs.count() == 0
