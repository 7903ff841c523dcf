"""The three entries from files to files."""

import pytest
from pyspark.sql import functions as F

from strandcall.operators.curation import EXAMPLE_COLUMNS
from strandcall.plans import create_examples as create
from strandcall.plans import datasets, evaluate, training_set
from strandcall.session import shared_folder, stage
from strandcall.sources.calls import read_examples, read_pairs
from strandcall.sources.sinks import write_examples, write_results
from strandcall.vocab import DOWN, SAMPLE_KEYS, UP


@pytest.fixture
def tree(tmp_path):
    for cell in ("k562", "HepG2"):
        calls = [f"P{i},G{i},{i % 2},{'train' if i % 4 else 'test'}" for i in range(200)]
        calls += ["P2,G2,0,train"] * 10
        directions = [f"P{i},G{i},{i % 3 % 2}" for i in range(200)]
        (tmp_path / f"{cell}-de.csv").write_text("pert,gene,label,split\n" + "\n".join(calls) + "\n")
        (tmp_path / f"{cell}-dir.csv").write_text("pert,gene,label\n" + "\n".join(directions) + "\n")
    return str(tmp_path)


def test_create_and_train(spark, tree, tmp_path, rows):
    calls, directions = read_pairs(spark, tree)
    used = calls.where("pert = 'P1'").select(*SAMPLE_KEYS)
    samples = datasets.load_samples(calls, directions, "train", used=used)
    assert samples.count() == 300 - 2 + 20
    assert datasets.load_samples(calls, directions, "test", "hepg2").count() == 210

    requests = stage(create.generator_requests(samples, fraction=0.9))
    assert requests.count() == requests.select("sample_id").distinct().count() == int(318 * 0.9)
    assert requests.groupBy(*SAMPLE_KEYS).count().where("count > 1").count() > 0
    assert requests.where(F.size("prompt") != 2).count() == 0

    number = F.substring("pert", 2, 9).cast("int")
    responses = stage(
        requests.select(
            "sample_id",
            "pert",
            F.concat(F.lit("<think>so</think><answer>"), "solution", F.lit("</answer>")).alias("generated_text"),
        ).where(number % 5 != 0)
    )
    texts = responses.drop("pert")
    asked = create.critic_requests(requests, texts)
    assert asked.count() == responses.count()
    critic = responses.select(
        "sample_id",
        F.when(number % 2 == 0, "<evaluation>good</evaluation>").otherwise("<evaluation>bad</evaluation>").alias("critic_text"),
    )
    accepted = create.examples(requests, texts, critic)
    assert accepted.count() == responses.where(number % 2 == 0).count() > 0
    write_examples(accepted, str(tmp_path / "examples"), "csv")
    stored = read_examples(spark, str(tmp_path / "examples"))
    assert tuple(stored.columns) == EXAMPLE_COLUMNS and rows(stored) == rows(accepted)

    training = training_set.training_set(stored)
    n = stored.count()
    assert training.where("part = 'train'").count() == int(0.9 * n)
    assert training.count() == n
    training_set.write_training_set(training, str(tmp_path / "train"))
    assert spark.read.parquet(str(tmp_path / "train")).where("part = 'val'").count() == n - int(0.9 * n)


def test_evaluate(spark, tree):
    calls, directions = read_pairs(spark, tree)
    samples = datasets.load_samples(calls, directions, "test")
    answer = F.when(F.col("label") == 1, DOWN).when(F.col("label") == 2, UP).otherwise(UP)
    responses = samples.withColumn("generated_text", F.concat(F.lit("<answer>"), answer, F.lit("</answer>")))
    report = evaluate.evaluate(responses)
    changed = samples.where("label > 0").count()
    overall = report.levels.where("level = 'overall'").first()
    assert (overall.correct, overall.evaluated) == (changed, 100)
    assert report.results.where("is_correct").count() == changed
    assert report.statistics.where(F.col("line").contains("Total Samples Evaluated: 100")).count() == 1
    assert report.class_lines.count() == 10
    lines = [r.line for r in evaluate.auroc_report(responses, "dif", SAMPLE_KEYS, 1).orderBy("section", "position").collect()]
    assert lines[0] == "--- AUROC Evaluation Summary ---" and len(lines) == 13


def test_prompts_do_not_cross_a_shuffle(spark, tree):
    calls, directions = read_pairs(spark, tree)
    requests = create.generator_requests(datasets.load_samples(calls, directions))
    plan = requests._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "molecular biologist" in above and "molecular biologist" not in below


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(3))
    assert all(shared_folder(spark) in f for f in staged.inputFiles())


def test_gene_list_samples(spark, tree, rows):
    _, directions = read_pairs(spark, tree)
    samples = datasets.gene_list_samples(directions, "test", "hepg2", "synth_data_with_ans")
    row = samples.where("pert = 'P1'").first()
    assert (row.upregulated, row.downregulated) == (["G1"], [])
    assert row.solution_text == "<answer>Upregulated: ['G1']\nDownregulated: []</answer>"
    assert "Upregulated: ['G1']\nDownregulated: []" in row.prompt[0].content
    assert {r[0] for r in rows(samples, "cell_type")} == {"HepG2"}


def test_single_file_samples(spark, rows):
    data = [("A", "x", "1"), ("A", "y", "0.0"), ("B", "x", "7")]
    frame = spark.createDataFrame(data, "pert string, gene string, label string")
    context = spark.createDataFrame([("A", "background")], "pert string, context string")
    got = datasets.single_file_samples(frame, "rpe1", context)
    assert rows(got, "pert", "gene", "cell_type", "label", "solution") == [
        ("A", "x", "rpe1", 1, "up"),
        ("A", "y", "rpe1", 0, "down"),
    ]
    assert all("rpe1" in r.prompt[1].content and "background" in r.prompt[1].content for r in got.collect())
    plain = datasets.single_file_samples(frame, "rpe1").first()
    assert "may help" not in plain.prompt[1].content


@pytest.mark.parametrize("training", [True, False])
def test_prompt_batches(spark, tree, training):
    calls, directions = read_pairs(spark, tree)
    batches = datasets.prompt_batches(datasets.load_samples(calls, directions, "test"), 32, training=training)
    assert batches.count() == (96 if training else 100)
    assert batches.where(F.size("prompt") == 2).count() == batches.count()


def test_missing_responses_fail_their_batches(spark, tree, tmp_path):
    calls, directions = read_pairs(spark, tree)
    samples = stage(datasets.load_samples(calls, directions, "test"))
    requests = stage(evaluate.eval_requests(samples, 8, 1))
    lost = F.col("pert") == "P0"
    responses = requests.where(~lost).select("sample_id", F.lit("<answer>upregulated</answer>").alias("generated_text"))
    answered = stage(evaluate.answered_samples(requests, responses))
    assert answered.count() == 100
    bad = {r.batch_id for r in answered.where(F.col("generated_text").isNull()).collect()}
    flagged = {r.batch_id for r in answered.where("api_error").collect()}
    assert bad == flagged and 0 < len(bad) < 13
    report = evaluate.evaluate(answered)
    overall = report.levels.where("level = 'overall'").first()
    assert overall.evaluated == 100 - answered.where("api_error").count()
    records = evaluate.result_records(datasets.with_prompt(report.results))
    write_results(records, str(tmp_path / "results"))
    back = spark.read.json(str(tmp_path / "results"))
    assert set(back.columns) == set(records.columns)
    errors = back.where("api_error").collect()
    assert len(errors) == answered.where("api_error").count()
    assert all(r.extracted_answer is None and not r.is_correct and r.user_prompt.endswith("(API Call Failed)") for r in errors)


def test_plans_tell_that_nothing_is_left(spark, tree):
    calls, directions = read_pairs(spark, tree)
    assert datasets.load_samples(calls, directions, "test", "hepg2", require=True).count() == 210
    assert datasets.load_samples(calls, directions, "test", "absent").count() == 0
    with pytest.raises(ValueError, match="empty: no call in split test, held-out cell lines absent"):
        datasets.load_samples(calls, directions, "test", "absent", require=True)
    bad = directions.select("pert", "gene", F.lit("1.5").alias("label"))
    with pytest.raises(ValueError, match="no row of k562"):
        datasets.single_file_samples(bad, "k562", require=True)
