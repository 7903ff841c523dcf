"""Batches that close when their replies are in, and counts that merge."""

import pytest
from pyspark.sql import functions as F

from strandcall.operators import metrics
from strandcall.streaming import counted, replies, running

ASKED = "batch_id long, sample_id string, n long, solution string"
SAID = "batch_id long, sample_id string, answer string, failed boolean"


class Desk:
    """Three inboxes of files, and the stream that reads them."""

    def __init__(self, spark, folder, patience=3600):
        self.spark, self.folder, self.patience = spark, str(folder), patience
        for name, schema in (("asked", ASKED), ("said", SAID), ("read", SAID)):
            spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}")

    def add(self, name, rows):
        self.spark.createDataFrame(rows, ASKED if name == "asked" else SAID).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def run(self):
        source = {n: self.spark.readStream.schema(ASKED if n == "asked" else SAID).parquet(f"{self.folder}/{n}") for n in ("asked", "said", "read")}
        events = (
            replies.request_events(source["asked"], "batch_id", "sample_id", F.col("n"), F.col("solution"), F.concat(F.lit("?"), "sample_id")),
            replies.reply_events(source["said"], "generator", "batch_id", "sample_id", F.col("failed"), F.col("answer")),
            replies.reply_events(source["read"], "critic", "batch_id", "sample_id", F.col("failed")),
        )
        closed = replies.closed_batches(*events, patience=self.patience)
        out = f"{self.folder}/out"
        running.finish(running.stream_results(closed, out, f"{self.folder}/log"))
        return running.stored_results(closed, out)


def answered(df):
    rows = df.where(F.col("kind") == replies.ANSWERED).collect()
    return sorted((r.batch_id, r.sample_id, r.api_error, r.extracted_answer, r.excerpt) for r in rows)


def test_batches_close_in_any_order_and_late_replies_are_counted(spark, tmp_path):
    desk = Desk(spark, tmp_path)
    desk.add("said", [(1, "a", "up", False), (2, "c", None, True)])  # before their requests
    desk.add("asked", [(1, "a", 2, "up"), (1, "b", 2, "down")])
    assert answered(desk.run()) == []
    desk.add("said", [(1, "b", "up", False), (1, "b", "second", False)][:1])
    desk.add("read", [(1, "a", None, False)])
    desk.add("asked", [(2, "c", 1, "up")])
    assert answered(desk.run()) == []  # one critic's reply of either batch is missing
    desk.add("read", [(1, "b", None, False), (2, "c", None, False)])
    first = [(1, "a", False, "up", None), (1, "b", False, "up", None), (2, "c", True, None, "?c")]
    assert answered(desk.run()) == first
    desk.add("said", [(1, "b", "later", False), (2, "c", "down", False)])
    again = desk.run()
    assert answered(again) == first
    total = replies.progress(again).first()
    assert (total.processed, total.failed, total.late) == (3, 1, 2)


def test_a_batch_that_waits_too_long_fails(spark, tmp_path):
    desk = Desk(spark, tmp_path, patience=0)
    desk.add("asked", [(1, "a", 2, "up"), (1, "b", 2, "down")])
    desk.add("said", [(1, "a", "up", False)])
    desk.run()
    desk.add("asked", [(5, "z", 9, "up")])
    found = answered(desk.run())
    assert [r[:4] for r in found if r[0] == 1] == [(1, "a", True, None), (1, "b", True, None)]


RESULT = "cell_type string, pert string, solution string, extracted_answer string"


@pytest.fixture
def inbox(spark, tmp_path):
    for k in range(7):
        data = [("h" if i % 2 else None, f"P{i % 3}", "upregulated", ["upregulated", "downregulated", None][(i + k) % 3]) for i in range(20)]
        spark.createDataFrame(data, RESULT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_counts_merge_and_replay(spark, inbox, tmp_path, rows):
    stream = lambda: spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(inbox)
    out = str(tmp_path / "counts")
    final = counted.finish(counted.stream_counts(stream(), out, str(tmp_path / "log"), every=3), spark, out)
    whole = metrics.eval_counts(spark.read.schema(RESULT).parquet(inbox))
    assert rows(final, *whole.columns) == rows(whole)
    assert rows(metrics.accuracy_rollup(final)) == rows(metrics.accuracy_rollup(spark.read.schema(RESULT).parquet(inbox)))
    kept = counted.snapshots(spark, out)
    assert {r.batches: r.n for r in kept.groupBy("batches").agg(F.sum("n").alias("n")).collect()} == {3: 60, 6: 120}
    assert counted._numbers(spark, out, counted.VERSION) == [5, 6]
    # the last micro-batch again, as after a failure behind its write: the same version
    last = spark.read.parquet(f"{out}/version=6")
    before = rows(last, *whole.columns)
    batch = spark.createDataFrame([r for r in spark.read.schema(RESULT).parquet(inbox).collect()][:20], RESULT)
    counted.merge_counts(out, 3)(batch, 6)
    assert sum(r[-1] for r in rows(spark.read.parquet(f"{out}/version=6"), *whole.columns)) == sum(r[-1] for r in before) == 140
