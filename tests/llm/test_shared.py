"""What operators leave in the shared folder and in local ones, and the tasks of small tables."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.llm import common, exact_dedup, graph, token_files
from corvane.llm.queries import tokenizer_path


def test_cleared(spark):
    common.cleared(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    folder = common.shared_path(spark, "tokens")
    token_files.write(docs, folder, tokenizer_path())
    assert spark.read.parquet(f"{folder}/files").count() >= 1
    assert common.cleared(spark) >= 2
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    assert common.cleared(spark) == 0
    assert exact_dedup.exact_dedup(docs).agg(F.count(F.lit(1))).first()[0] == 2


@pytest.mark.parametrize("kind", ["saved", "written"])
def test_shuffle_files_go_with_their_step(spark, kind):
    files = lambda: {p.name for p in Path(spark.conf.get("spark.local.dir")).glob("blockmgr-*/*/shuffle_*")}
    before = files()
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    got = common.saved(counts) if kind == "saved" else common.written(counts, "counts")
    until = time.time() + 5
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(common.CLEANUP) == "false"
    # the table and what was made of it can be run again
    for df in (got, counts, counts):
        assert {(r.k, r.n) for r in df.collect()} == {(k, 100) for k in range(10)}


def test_few_edges_take_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "tasks_for", lambda *_: 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context, partitions = spark.sparkContext, 40
    try:
        for k, v in zip(before, (str(partitions), "false"), strict=True):
            spark.conf.set(k, v)
        context.setJobGroup("chain", "components of a chain")
        got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"))
        assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(21)}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("chain") for s in tracker.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s and s.numCompletedTasks]
    # all stages of the rounds but the first aggregation, which makes the edges distinct, and its readers
    assert len(tasks) > 20 and sum(n >= partitions for n in tasks) <= len(tasks) // 3


def test_tasks_grow_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert common.tasks_for(spark, 0) == common.tasks_for(spark, 1) == cores
    assert common.tasks_for(spark, 100 * common.TASK_ROWS + 1) == 101
