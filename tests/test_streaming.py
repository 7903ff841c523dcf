import pytest
from pyspark.sql import functions as F

from strandcall.catalog import adapters as A
from strandcall.catalog.queries import RATINGS
from strandcall.catalog.queries import REGISTRY as QUERIES
from strandcall.functions.text import with_answer
from strandcall.operators import curation, metrics
from strandcall.streaming import running as K

SCHEMA = "id int, cell_type string, pert string, solution string, generated_text string"


def add_file(spark, folder, start, n=20):
    answers = ["upregulated", "downregulated", "?"]
    data = [
        (i, "k" if i % 2 else "h", f"P{i % 3}", answers[i % 2], f"<answer>{answers[i % 3]}</answer>")
        for i in range(start, start + n)
    ]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def inbox(spark, tmp_path):
    folder = str(tmp_path / "inbox")
    for start in (0, 20, 40):
        add_file(spark, folder, start)
    return folder


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_running_approval(spark, inbox, tmp_path, rows):
    def run():
        parsed = with_answer(stream(spark, inbox))
        totals = K.running_approval(parsed, F.col("extracted_answer") == F.col("solution"))
        K.finish(K.write_snapshot(totals, str(tmp_path / "totals"), str(tmp_path / "log")))
        return rows(K.read_snapshot(totals, str(tmp_path / "totals")), "processed", "approved", "approval_pct")

    def batch():
        parsed = with_answer(spark.read.schema(SCHEMA).parquet(inbox))
        right = parsed.where("extracted_answer = solution").count()
        return [(parsed.count(), right, round(100 * right / parsed.count(), 6))]

    assert run() == batch()
    add_file(spark, inbox, 60)
    assert run() == batch()


def test_results_without_duplicates(spark, inbox, tmp_path, rows):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def parsed(source):
        return metrics.with_correct(with_answer(source))

    K.finish(K.stream_results(parsed(stream(spark, inbox)), out, log))
    first = K.stored_results(parsed(stream(spark, inbox)), out)
    assert first.select("id").distinct().count() == first.count() == 60
    add_file(spark, inbox, 60)
    K.finish(K.stream_results(parsed(stream(spark, inbox)), out, log))
    # A fresh log replays every batch into its own folder again.
    K.finish(K.stream_results(parsed(stream(spark, inbox)), out, str(tmp_path / "log2")))
    stored = K.stored_results(parsed(stream(spark, inbox)), out)
    whole = parsed(spark.read.schema(SCHEMA).parquet(inbox))
    assert rows(stored) == rows(whole)
    assert rows(metrics.accuracy_rollup(stored)) == rows(metrics.accuracy_rollup(whole))


@pytest.mark.parametrize("layout", ["folder", "file"])
def test_streamed_tables_may_be_folders_or_files(spark, tmp_path, layout, rows):
    documents = [(k, ["a text", "", "<answer>upregulated</answer>"][k % 3], "en", "web") for k in range(70)]
    tables = {
        "documents": spark.createDataFrame(documents, A.SCHEMAS["documents"]),
        "labels": spark.createDataFrame([(k, int(k % 4 > 0), int(k % 5 == 0)) for k in range(0, 70, 2)], A.SCHEMAS["labels"]),
    }
    for name, table in tables.items():
        if layout == "folder":
            table.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            table.coalesce(1).write.parquet(str(tmp_path / "parts" / name))
            next((tmp_path / "parts" / name).glob("part-*")).rename(tmp_path / f"{name}.parquet")
    found = QUERIES["stream_curation"](spark, str(tmp_path)).first()
    judged = curation.judged(A.generated(spark, str(tmp_path)), A.critic(spark, str(tmp_path)), "doc_id")
    assert (found.processed, found.approved) == (70, judged.where(curation.acceptable(RATINGS)).count())
    assert rows(QUERIES["stream_batches"](spark, str(tmp_path))) == rows(QUERIES["failed_batches"](spark, str(tmp_path)))
