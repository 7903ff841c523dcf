"""Every operator as a query over the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcall.catalog import adapters as A
from strandcall.functions import prompt_table
from strandcall.functions import prompts as P
from strandcall.functions import text as X
from strandcall.functions.labels import gold_trinary, label_text, pred_score
from strandcall.operators import batching, curation, labelling, lists, metrics, sampling, splits
from strandcall.operators.ordering import number_copies
from strandcall.plans import datasets, evaluate, reports
from strandcall.plans.training_set import sft_text
from strandcall.session import new_folder, stage
from strandcall.sources import calls as calls_files
from strandcall.sources import sinks, store
from strandcall.streaming import counted, replies, running

TEST_LINES = "ASIA, europe"
RATINGS = ("excellent", "good")
SAMPLE_KEYS = ("sample_id", "pert", "gene", "cell_type")
BATCH_SIZE = 32
WORLD = 4
PAGE = 100
SEED = 88

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_answer(A.results(spark, sf_dir))


# --- splits ---------------------------------------------------------------------


@query
def split_filter(spark, sf_dir):
    return splits.filter_split(A.calls(spark, sf_dir), "test").select(*SAMPLE_KEYS, "label")


@query
def holdout_train(spark, sf_dir):
    return splits.filter_holdout(A.calls(spark, sf_dir), "train", TEST_LINES).select(*SAMPLE_KEYS, "label")


@query
def holdout_test(spark, sf_dir):
    return splits.filter_holdout(A.calls(spark, sf_dir), "test", TEST_LINES).select(*SAMPLE_KEYS, "label")


@query
def holdout_cells(spark, sf_dir):
    return splits.holdout_cells(A.calls(spark, sf_dir), TEST_LINES)


@query
def union_cells(spark, sf_dir):
    calls = A.calls(spark, sf_dir)
    test = splits.filter_holdout(calls, "test", TEST_LINES).drop("split")
    return (
        splits.union_cells(splits.filter_holdout(calls, "train", TEST_LINES), test)
        .groupBy("cell_type", "split")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def valid_prompts(spark, sf_dir):
    return splits.valid_prompts(A.chats(spark, sf_dir)).select("doc_id", F.size("prompt").alias("n_messages"))


# --- labels ---------------------------------------------------------------------


@query
def ternary_labels(spark, sf_dir):
    calls = splits.filter_split(A.calls(spark, sf_dir), "test")
    return labelling.ternary_label_counts(calls, A.directions(spark, sf_dir))


@query
def label_quality(spark, sf_dir):
    return labelling.label_quality(A.calls(spark, sf_dir), A.directions(spark, sf_dir))


@query
def labelled_samples(spark, sf_dir):
    samples = labelling.labelled_samples(A.calls(spark, sf_dir), A.directions(spark, sf_dir))
    return samples.select(*SAMPLE_KEYS, "label", label_text(F.col("label")).alias("solution"))


@query
def label_validity(spark, sf_dir):
    return labelling.label_report(A.raw_calls(spark, sf_dir))


@query
def label_truncation(spark, sf_dir):
    """With truncation 1.5 is 1 and 0.7 is 0."""
    odd = F.when(F.col("label") == "2", "1.5").when(F.col("label") == "0.0", "0.7").otherwise(F.col("label"))
    return labelling.label_report(A.raw_calls(spark, sf_dir).withColumn("label", odd), truncate=True)


@query
def label_words(spark, sf_dir):
    return A.directions(spark, sf_dir).select(
        "pert", "gene", "cell_type", label_text(F.col("label"), "binary").alias("direction")
    )


@query
def trinary_scores(spark, sf_dir):
    scored = _parsed(spark, sf_dir).select(
        gold_trinary(F.col("solution")).alias("y"), pred_score(F.col("extracted_answer"), "trinary").alias("score")
    )
    return scored.groupBy("y", "score").agg(F.count(F.lit(1)).alias("n"))


@query
def exclude_used(spark, sf_dir):
    return labelling.exclude_used(A.calls(spark, sf_dir), A.used(spark, sf_dir)).select(*SAMPLE_KEYS, "label")


@query
def excluded_counts(spark, sf_dir):
    return labelling.excluded_counts(A.calls(spark, sf_dir), A.used(spark, sf_dir))


@query
def load_report(spark, sf_dir):
    calls = A.calls(spark, sf_dir)
    return labelling.load_report(
        calls, A.directions(spark, sf_dir), A.used(spark, sf_dir), splits.in_split(calls, "train")
    )


# --- lists ----------------------------------------------------------------------


@query
def gene_lists(spark, sf_dir):
    return lists.gene_lists(A.directions(spark, sf_dir)).select(
        "pert",
        "cell_type",
        F.array_join("upregulated", ",").alias("upregulated"),
        F.array_join("downregulated", ",").alias("downregulated"),
    )


@query
def genes_by_pert(spark, sf_dir):
    return lists.genes_by_pert(A.calls(spark, sf_dir), PAGE).select(
        "pert", "page", "n_genes", F.array_join("genes", ",").alias("genes")
    )


@query
def list_solution(spark, sf_dir):
    return lists.gene_lists(A.directions(spark, sf_dir)).select(
        "pert", "cell_type", X.list_solution(F.col("upregulated"), F.col("downregulated")).alias("solution_text")
    )


@query
def gene_list_holdout(spark, sf_dir):
    """For gene lists, ``default`` names a cell line that is not there: train has all, test nothing."""
    calls = A.directions(spark, sf_dir).withColumn("split", F.lit("train"))
    found = [
        datasets.gene_list_samples(calls, split, "default").select(
            F.lit(split).alias("split"), "pert", "cell_type", F.size("upregulated").alias("n_up"), F.size("downregulated").alias("n_down")
        )
        for split in ("train", "test")
    ]
    return found[0].unionByName(found[1])


@query
def list_prompts(spark, sf_dir):
    gold = lists.gene_lists(A.directions(spark, sf_dir))
    payload = X.list_payload(F.col("upregulated"), F.col("downregulated"))
    return gold.select(
        "pert",
        "cell_type",
        P.list_system_prompt("synth_data_with_ans", payload).alias("system_prompt"),
        P.list_user_prompt().alias("user_prompt"),
    )


@query
def extract_gene_lists(spark, sf_dir):
    parsed = X.with_gene_lists(A.list_answers(spark, sf_dir))
    return parsed.select(
        "doc_id",
        F.col("gene_lists").isNotNull().alias("readable"),
        F.array_join("gene_lists.upregulated", ",").alias("upregulated"),
        F.array_join("gene_lists.downregulated", ",").alias("downregulated"),
    )


@query
def gene_list_answers(spark, sf_dir):
    """Gene names hold both quotes and a backslash."""
    gold = lists.gene_lists(A.directions(spark, sf_dir).withColumn("gene", A.odd_name(F.col("gene"))))
    answers = X.with_gene_lists(A.list_replies(gold)).drop("generated_text")
    return lists.same_lists(answers, gold, ["pert", "cell_type"]).select("pert", "cell_type", "is_correct")


# --- parsing --------------------------------------------------------------------


@query
def extract_answer(spark, sf_dir):
    return X.with_answer(A.generated(spark, sf_dir)).select("doc_id", "extracted_answer")


@query
def extract_think_answer(spark, sf_dir):
    return X.with_think_answer(A.generated(spark, sf_dir)).select("doc_id", "generated_thinking", "generated_answer")


@query
def critic_ratings(spark, sf_dir):
    return X.with_critic(A.critic(spark, sf_dir)).select("doc_id", "critic_evaluation", "critic_reasoning")


# --- prompts and messages -------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.generated(spark, sf_dir).select("doc_id", "pert", "gene", "cell_type", "solution")


@query
def system_prompts(spark, sf_dir):
    modes = [
        F.struct(F.lit(mode).alias("mode"), P.system_prompt(mode, tool=True).alias("prompt"))
        for mode in P.SYSTEM_TEMPLATES
    ]
    return _samples(spark, sf_dir).select("doc_id", F.inline(F.array(*modes)))


@query
def user_prompts(spark, sf_dir):
    modes = [
        F.struct(F.lit(mode).alias("mode"), P.user_prompt(mode).alias("prompt"))
        for mode in ("default", "direction_test_prompt", "o3_direction_test")
    ]
    return _samples(spark, sf_dir).select("doc_id", F.inline(F.array(*modes)))


@query
def prompts_by_mode(spark, sf_dir):
    """Rows of all ten modes, and of one that no template has, in one table."""
    names = F.array(*map(F.lit, [*P.SYSTEM_TEMPLATES, "no such mode"]))
    mode = F.get(names, (F.col("doc_id") % (len(P.SYSTEM_TEMPLATES) + 1)).cast("int"))
    samples = _samples(spark, sf_dir).select("doc_id", "pert", "gene", "cell_type", "solution", mode.alias("mode"))
    found = prompt_table.with_prompts(samples, prompt_table.template_table(spark))
    return found.select("doc_id", "mode", "system", "user", "problem")


@query
def critic_prompts(spark, sf_dir):
    parsed = X.with_think_answer(A.generated(spark, sf_dir)).where(F.col("generated_thinking").isNotNull())
    prompt = P.critic_prompt(F.col("user_prompt"), F.col("generated_thinking"), checklist=True)
    return parsed.select("doc_id", X.render_chat(prompt, "blocks").alias("prompt"))


@query
def context_prompts(spark, sf_dir):
    samples = A.calls(spark, sf_dir).select(*SAMPLE_KEYS)
    joined = curation.with_context(samples, A.pert_context(spark, sf_dir), ["pert"])
    return joined.select(*SAMPLE_KEYS, P.add_context(P.user_prompt(), F.col("context")).alias("prompt"))


@query
def context_prompts_by_key(spark, sf_dir):
    samples = A.calls(spark, sf_dir).select(*SAMPLE_KEYS)
    joined = curation.with_context(samples, A.key_context(spark, sf_dir), ["pert", "gene", "cell_type"])
    return joined.select(*SAMPLE_KEYS, P.add_context(P.user_prompt(), F.col("context")).alias("prompt"))


@query
def single_file_prompts(spark, sf_dir):
    calls = A.raw_calls(spark, sf_dir)
    samples = datasets.single_file_samples(calls, "rpe1", A.pert_context(spark, sf_dir))
    return samples.select("pert", "gene", "label", "solution", X.render_chat(F.col("prompt"), "joined").alias("chat"))


@query
def first_user_message(spark, sf_dir):
    usable = F.size(X.usable_messages(F.col("prompt")))
    return splits.valid_prompts(A.chats(spark, sf_dir)).select(
        "doc_id", usable.alias("n_usable"), X.first_user(F.col("prompt")).alias("user_query")
    )


@query
def last_user_message(spark, sf_dir):
    return splits.valid_prompts(A.chats(spark, sf_dir)).select(
        "doc_id",
        X.last_user_excerpt(F.col("prompt")).alias("failed_prompt"),
        X.last_content(F.col("prompt")).alias("last_content"),
    )


@query
def generation_prompts(spark, sf_dir):
    """Chats that end with the cue for the assistant."""
    chats = splits.valid_prompts(A.chats(spark, sf_dir))
    return chats.select("doc_id", X.render_chat(F.col("prompt"), "tags", cue=True).alias("chat"))


@query
def render_chat(spark, sf_dir):
    styles = [
        F.struct(F.lit(style).alias("style"), X.render_chat(F.col("prompt"), style).alias("chat"))
        for style in ("blocks", "joined", "tags")
    ]
    return splits.valid_prompts(A.chats(spark, sf_dir)).select("doc_id", F.inline(F.array(*styles)))


@query
def chat_opening(spark, sf_dir):
    return curation.user_turns(A.turns(spark, sf_dir), "conv_id")


# --- curation -------------------------------------------------------------------


@query
def critic_join(spark, sf_dir):
    joined = curation.attach_responses(_samples(spark, sf_dir), A.critic(spark, sf_dir), ["doc_id"])
    return joined.select("doc_id", "pert", "gene", "cell_type", "critic_text")


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with a response that the critic could not read, decided on ids."""
    ids = A.table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 32).alias("batch_id"))
    unread = A.critic(spark, sf_dir).where(F.col("critic_text") == "no tags").select("doc_id")
    return curation.failed_batches(ids.join(unread, "doc_id"))


@query
def failed_batches(spark, sf_dir):
    generated = A.generated(spark, sf_dir).select("doc_id", "batch_id", "solution", "user_prompt", "generated_text")
    parsed = X.with_answer(generated).drop("generated_text")
    flagged = curation.with_failures(parsed, _failed(spark, sf_dir))
    chat = P.chat_prompt(F.lit("-"), F.col("user_prompt"))
    return metrics.with_correct(flagged).select(
        "doc_id",
        "batch_id",
        "api_error",
        F.when(~F.col("api_error"), F.col("extracted_answer")).alias("extracted_answer"),
        "is_correct",
        F.when(F.col("api_error"), X.last_user_excerpt(chat)).alias("failed_prompt"),
    )


@query
def result_records(spark, sf_dir):
    flagged = curation.with_failures(A.generated(spark, sf_dir), _failed(spark, sf_dir))
    chat = P.chat_prompt(F.lit("-"), F.col("user_prompt"))
    return evaluate.result_records(evaluate.parse_results(flagged).withColumn("prompt", chat))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.judged(A.generated(spark, sf_dir), A.critic(spark, sf_dir), "doc_id")


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.accepted_examples(A.generated(spark, sf_dir), A.critic(spark, sf_dir), "doc_id", RATINGS)


@query
def accepted_examples(spark, sf_dir):
    accepted = _accepted(spark, sf_dir)
    layout = [c for c in curation.EXAMPLE_COLUMNS if c != "user_query"]
    return accepted.withColumns(
        {"true_answer": F.col("solution"), "assistant_response": F.col("generated_text")}
    ).select("doc_id", *layout)


@query
def approval_summary(spark, sf_dir):
    return curation.approval(_judged(spark, sf_dir), RATINGS)


@query
def rejection_funnel(spark, sf_dir):
    has_query = A.chats(spark, sf_dir).select("doc_id", X.first_user(F.col("prompt")).isNotNull().alias("has_query"))
    judged = curation.judged(A.generated(spark, sf_dir), A.critic(spark, sf_dir), "doc_id", reasoning=False)
    return curation.rejection_funnel(judged.join(has_query, "doc_id"), RATINGS, F.col("has_query"))


@query
def sft_text_cot(spark, sf_dir):
    examples = _accepted(spark, sf_dir).withColumn("assistant_response", F.col("generated_text"))
    return sft_text(examples, "dif", "cot").select("doc_id", "text")


@query
def sft_text_direct(spark, sf_dir):
    examples = _accepted(spark, sf_dir).withColumn("true_answer", F.col("solution"))
    return sft_text(examples, "dir", "direct").select("doc_id", "text")


# --- metrics --------------------------------------------------------------------


@query
def accuracy_overall(spark, sf_dir):
    return metrics.accuracy(_parsed(spark, sf_dir))


@query
def accuracy_by_cell(spark, sf_dir):
    return metrics.accuracy(_parsed(spark, sf_dir), "cell_type")


@query
def accuracy_by_pert(spark, sf_dir):
    return metrics.accuracy(_parsed(spark, sf_dir), "pert")


@query
def accuracy_rollup(spark, sf_dir):
    return metrics.accuracy_rollup(_parsed(spark, sf_dir))


@query
def prediction_distribution(spark, sf_dir):
    return metrics.prediction_distribution(_parsed(spark, sf_dir))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_parsed(spark, sf_dir))


def _rounded(report: DataFrame) -> DataFrame:
    shares = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return report.select("label", *shares, "support")


@query
def class_report(spark, sf_dir):
    return _rounded(metrics.class_report(_parsed(spark, sf_dir)))


@query
def class_report_averages(spark, sf_dir):
    return _rounded(metrics.class_report_averages(metrics.class_report(_parsed(spark, sf_dir))))


@query
def report_lines(spark, sf_dir):
    return reports.report_lines(_parsed(spark, sf_dir))


@query
def auroc_dif(spark, sf_dir):
    return metrics.auroc(metrics.score_rows(_parsed(spark, sf_dir), "dif"))


@query
def auroc_dir(spark, sf_dir):
    return metrics.auroc(metrics.score_rows(_parsed(spark, sf_dir), "dir"))


@query
def auroc_by_cell(spark, sf_dir):
    return metrics.auroc(metrics.score_rows(_parsed(spark, sf_dir), "dif"), ("cell_type",))


@query
def auroc_narrow(spark, sf_dir):
    """Scores that all lie between 5000 and 5001, nearly all of them different."""
    line = A.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") != "N")
    mixed = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 1000003
    scored = line.select(
        F.col("l_linestatus").alias("cell_type"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.lit(5000.0) + mixed.cast("double") / F.lit(1000003.0)).alias("score"),
    )
    return metrics.auroc(scored, ("cell_type",))


def _stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(_parsed(spark, sf_dir).select(*SAMPLE_KEYS, "solution", "extracted_answer"), "results")


@query
def auroc_runs(spark, sf_dir):
    return evaluate.auroc_runs(_stored_results(spark, sf_dir), "dir", SAMPLE_KEYS, SEED)


@query
def auroc_text(spark, sf_dir):
    """The whole AUROC report; keys identify rows, so its rows are those of ``auroc_runs``."""
    keys = SAMPLE_KEYS
    found = evaluate.auroc_report(A.results(spark, sf_dir), "dif", keys, SEED)
    return found.select("section", "position", "line")


@query
def class_report_text(spark, sf_dir):
    return reports.class_report_lines(_parsed(spark, sf_dir))


@query
def auroc_summary(spark, sf_dir):
    runs = evaluate.auroc_runs(_stored_results(spark, sf_dir), "dif", SAMPLE_KEYS, SEED, by_cell=True)
    return metrics.auroc_summary(runs, evaluate.AUROC_RUNS, ("cell_type",))


# --- samples and batches ----------------------------------------------------------


def _stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(A.calls(spark, sf_dir).select(*SAMPLE_KEYS), "keys")


@query
def sample_exact(spark, sf_dir):
    return sampling.sample_exact(_stored_keys(spark, sf_dir), 0.15, SEED, SAMPLE_KEYS)


@query
def sample_no_min(spark, sf_dir):
    return sampling.sample_exact(_stored_keys(spark, sf_dir), 0.05, SEED, SAMPLE_KEYS, min_one=False)


@query
def direction_stage(spark, sf_dir):
    stored = _stored_results(spark, sf_dir)
    sampled = sampling.sample_exact(stored, 0.25, SEED, SAMPLE_KEYS)
    return splits.filter_direction(sampled)


GENE_KEYS = ("pert", "gene", "cell_type")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(number_copies(A.calls(spark, sf_dir).select(*GENE_KEYS), GENE_KEYS), "numbered")


@query
def sample_duplicates(spark, sf_dir):
    """Rows are drawn where keys repeat."""
    return sampling.sample_exact(_numbered(spark, sf_dir), 0.15, SEED, [*GENE_KEYS, "occurrence"])


@query
def sample_hot_key(spark, sf_dir):
    """Half of all rows share one perturbation; rows are numbered and drawn in it as in others."""
    even = F.substring_index("sample_id", "-", 1).cast("bigint") % 2 == 0
    calls = A.calls(spark, sf_dir).select(F.when(even, "HOT").otherwise(F.col("pert")).alias("pert"), "gene", "cell_type")
    numbered = stage(number_copies(calls, ["pert"]), "numbered")
    return sampling.sample_exact(numbered, 0.15, SEED, ["pert", "occurrence"])


@query
def split_duplicates(spark, sf_dir):
    return sampling.train_val_split(_numbered(spark, sf_dir), 0.9, 42, [*GENE_KEYS, "occurrence"])


@query
def train_val_split(spark, sf_dir):
    return sampling.train_val_split(_stored_keys(spark, sf_dir), 0.9, 42, SAMPLE_KEYS)


@query
def batches(spark, sf_dir):
    keys = A.calls(spark, sf_dir).select(*SAMPLE_KEYS)
    return batching.assign_batches(keys, BATCH_SIZE, SEED, SAMPLE_KEYS)


@query
def batches_drop_last(spark, sf_dir):
    keys = _samples(spark, sf_dir).select("doc_id", "pert")
    return batching.assign_batches(keys, BATCH_SIZE, 42, ["doc_id"], drop_last=True)


@query
def shards(spark, sf_dir):
    keys = A.calls(spark, sf_dir).select(*SAMPLE_KEYS)
    return batching.assign_shard(keys, WORLD, SEED, SAMPLE_KEYS)


@query
def preview(spark, sf_dir):
    return batching.preview(_parsed(spark, sf_dir).select(*SAMPLE_KEYS, "solution", "extracted_answer"), 10, SAMPLE_KEYS)


# --- missing keys, failed calls, single classes -------------------------------------


def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in which one call in ten has failed and has no answer."""
    bad = F.col("sample_id").endswith("7")
    return _parsed(spark, sf_dir).select(
        *SAMPLE_KEYS, "solution", F.when(~bad, F.col("extracted_answer")).alias("extracted_answer"), bad.alias("api_error")
    )


@query
def failed_rollup(spark, sf_dir):
    """Failed calls are outside the overall denominator and inside those of the groups."""
    return metrics.accuracy_rollup(_failing(spark, sf_dir))


@query
def failed_overall(spark, sf_dir):
    return metrics.accuracy(_failing(spark, sf_dir))


@query
def failed_distribution(spark, sf_dir):
    return metrics.prediction_distribution(_failing(spark, sf_dir))


@query
def failed_confusion(spark, sf_dir):
    return metrics.confusion(_failing(spark, sf_dir))


@query
def missing_keys_labels(spark, sf_dir):
    """Missing keys match each other in the label join."""
    calls, directions = (A.with_gaps(df(spark, sf_dir)) for df in (A.calls, A.directions))
    return labelling.ternary_label_counts(calls, directions)


@query
def missing_keys_excluded(spark, sf_dir):
    """Missing keys match nothing in the exclusion."""
    return labelling.excluded_counts(A.with_gaps(A.calls(spark, sf_dir)), A.with_gaps(A.used(spark, sf_dir)))


@query
def missing_keys_lists(spark, sf_dir):
    found = lists.gene_lists(A.with_gaps(A.directions(spark, sf_dir)))
    return found.select("pert", "cell_type", F.size("upregulated").alias("n_up"), F.size("downregulated").alias("n_down"))


@query
def auroc_one_class(spark, sf_dir):
    """A cell line with one class has no value; so has a stage without rows."""
    results = _parsed(spark, sf_dir).withColumn("solution", F.when(F.col("cell_type") == "ASIA", "upregulated").otherwise(F.col("solution")))
    by_cell = metrics.auroc(metrics.score_rows(results, "dir"), ("cell_type",))
    nothing = metrics.auroc(metrics.score_rows(results.where("cell_type = 'nowhere'"), "dir"))
    return by_cell.unionByName(nothing.select(F.lit("nothing").alias("cell_type"), "*"))


# --- files ------------------------------------------------------------------------


def _tree(spark: SparkSession, sf_dir: str) -> str:
    return A.csv_tree(spark, sf_dir, new_folder(spark, "tree"))


@query
def csv_calls(spark, sf_dir):
    """All call files of a tree, in several column orders, one without ``split``."""
    return calls_files.read_calls(spark, _tree(spark, sf_dir), "de").select("pert", "gene", "label", "split", "cell_type")


@query
def csv_manifest(spark, sf_dir):
    return calls_files.pair_manifest(spark, _tree(spark, sf_dir)).select("cell_type", "status", "reason")


@query
def csv_corrupt(spark, sf_dir):
    """Rows of every file, those with too few and too many fields, and what a reader keeps that drops them."""
    folder = A.ragged_tree(spark, sf_dir, new_folder(spark, "ragged"))
    kept = calls_files.read_calls(spark, folder, "de", ragged="drop").groupBy("cell_type")
    kept = kept.agg(F.count(F.lit(1)).alias("n_kept"), F.count("label").alias("n_labels"), F.sum("label").alias("label_sum"))
    return calls_files.file_report(spark, folder, "de").select("cell_type", "n_rows", "n_short", "n_long").join(kept, "cell_type", "left")


@query
def holdout_by_table(spark, sf_dir):
    """Rows per cell line and part, held out by a stored table of lines; calls lie in folders by cell line."""
    calls, lines = new_folder(spark, "calls"), new_folder(spark, "lines")
    A.calls(spark, sf_dir).write.partitionBy("cell_type").parquet(calls)
    A.calls(spark, sf_dir).select(F.lower("cell_type").alias("line")).where("line like '%a' or line is null").distinct().write.parquet(lines)
    stored, held = spark.read.parquet(calls), spark.read.parquet(lines)
    parts = [splits.holdout_by_lines(stored, part, held).withColumn("part", F.lit(part)) for part in ("train", "test")]
    return parts[0].unionByName(parts[1]).groupBy("cell_type", "part").agg(F.count(F.lit(1)).alias("n"))


@query
def csv_pairs(spark, sf_dir):
    """Rows per cell line and file of the pairs that a holdout leaves for training."""
    pair = calls_files.read_pairs(spark, _tree(spark, sf_dir), "train", "asia")
    counted = [df.groupBy("cell_type").count().select(F.lit(kind).alias("kind"), "cell_type", F.col("count").alias("n")) for kind, df in zip(("de", "dir"), pair)]
    return counted[0].unionByName(counted[1])


@query
def csv_single(spark, sf_dir):
    return calls_files.read_single(spark, f"{_tree(spark, sf_dir)}/EUROPE-dir.csv").select("pert", "gene", "label")


@query
def csv_exclusions(spark, sf_dir):
    target = new_folder(spark, "used")
    A.used(spark, sf_dir).withColumn("note", F.lit('said "no",\nleft')).write.option("header", True).option("escape", '"').csv(target)
    return calls_files.read_exclusions(spark, target)


@query
def examples_round_trip(spark, sf_dir):
    """Accepted examples written as CSV and read again."""
    target = new_folder(spark, "examples")
    accepted = _accepted(spark, sf_dir)
    layout = accepted.withColumns({"true_answer": F.col("solution"), "assistant_response": F.col("generated_text")})
    names = [c for c in curation.EXAMPLE_COLUMNS if c in layout.columns]
    sinks.write_examples(layout.withColumns({c: F.lit(None).cast("string") for c in curation.EXAMPLE_COLUMNS if c not in names}), target, "csv")
    return calls_files.read_examples(spark, target).groupBy("pert", "gene", "cell_type", "true_answer").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("assistant_response")).alias("response_chars")
    )


@query
def examples_store(spark, sf_dir):
    """Three example sets; one is written again with fewer rows, and takes the place of the first."""
    base = new_folder(spark, "store")
    accepted = _accepted(spark, sf_dir)
    layout = accepted.withColumns({"true_answer": F.col("solution"), "assistant_response": F.col("generated_text")})
    missing = {c: F.lit(None).cast("string") for c in curation.EXAMPLE_COLUMNS if c not in layout.columns}
    layout = stage(layout.withColumns(missing).select("doc_id", *curation.EXAMPLE_COLUMNS), "accepted")
    store.store_examples(layout, base, "first", "create")
    store.store_examples(layout, base, "second", "create", "asia")
    store.store_examples(layout.where(F.col("doc_id") % 2 == 0), base, "first", "create")
    kept = store.stored_examples(spark, base, script="create")
    return kept.groupBy("model", "script", "split_name", "pert").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("assistant_response")).alias("response_chars")
    )


@query
def shard_files(spark, sf_dir):
    """Every rank's folder, read by itself."""
    target = new_folder(spark, "shards")
    store.write_shards(A.calls(spark, sf_dir).select(*SAMPLE_KEYS), target, WORLD, SEED, SAMPLE_KEYS)
    return splits.union_cells(*[store.read_shard(spark, target, k).withColumn("shard", F.lit(k).cast("bigint")) for k in range(WORLD)])


@query
def results_round_trip(spark, sf_dir):
    """Results written as JSON lines and read again; missing answers stay missing."""
    target = new_folder(spark, "results")
    narrow = _parsed(spark, sf_dir).select(*SAMPLE_KEYS, "solution", "extracted_answer")
    sinks.write_results(narrow, target)
    return spark.read.schema(narrow.schema).json(target)


@query
def empty_reason(spark, sf_dir):
    """What the check for rows says of each split of the calls."""
    calls = A.calls(spark, sf_dir)

    def said(split: str) -> str:
        try:
            splits.require_rows(splits.filter_split(calls, split), f"no row in split {split}")
        except ValueError as error:
            return str(error)
        return "ok"

    names = [(split, said(split)) for split in ("train", "test", "holdout")]
    each = F.array(*[F.struct(F.lit(a).alias("split"), F.lit(b).alias("said")) for a, b in names])
    return calls.select("split").distinct().agg(F.count(F.lit(1)).alias("n_splits")).select("n_splits", F.inline(each))


# --- streams ----------------------------------------------------------------------


FILES_PER_BATCH = 1000


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Files of a table, a single one or a folder of them; a backlog is worked off in micro-batches of bounded size."""
    source = spark.readStream.schema(A.SCHEMAS[name]).option("maxFilesPerTrigger", FILES_PER_BATCH)
    return source.parquet(f"{sf_dir}/{name}.parque[t]")  # a plain path would have to be a folder, a pattern finds either


@query
def stream_approval(spark, sf_dir):
    totals = running.running_approval(_stream(spark, sf_dir, "events"), F.col("event_type") == "purchase")
    target = new_folder(spark, "approval")
    running.finish(running.write_snapshot(totals, target, new_folder(spark, "approval-log")))
    return running.read_snapshot(totals, target)


@query
def stream_results(spark, sf_dir):
    lines = _stream(spark, sf_dir, "lineitem")
    results = evaluate.parse_results(A.results(spark, sf_dir, lines))
    narrow = results.select(*SAMPLE_KEYS, "solution", "extracted_answer", "is_correct")
    target = new_folder(spark, "results")
    running.finish(running.stream_results(narrow, target, new_folder(spark, "results-log")))
    return metrics.accuracy_rollup(running.stored_results(narrow, target))


@query
def stream_curation(spark, sf_dir):
    documents = _stream(spark, sf_dir, "documents")
    judged = curation.judged(A.generated(spark, sf_dir, documents), A.critic(spark, sf_dir), "doc_id")
    totals = running.running_approval(judged, curation.acceptable(RATINGS))
    target = new_folder(spark, "curation")
    running.finish(running.write_snapshot(totals, target, new_folder(spark, "curation-log")))
    return running.read_snapshot(totals, target)


def _batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = A.table(spark, sf_dir, "documents")
    return documents.groupBy(F.floor(F.col("doc_id") / 32).alias("batch_id")).agg(F.count(F.lit(1)).alias("batch_size"))


@query
def stream_batches(spark, sf_dir):
    """What ``failed_batches`` says, from requests and replies that arrive as streams."""
    asked = A.generated(spark, sf_dir, _stream(spark, sf_dir, "documents")).select("doc_id", "batch_id", "solution", "user_prompt")
    judged = A.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("judged", F.lit(True))
    asked = asked.join(_batch_sizes(spark, sf_dir), "batch_id").join(judged, "doc_id", "left")
    excerpt = X.last_user_excerpt(P.chat_prompt(F.lit("-"), F.col("user_prompt")))
    requests = replies.request_events(asked, "batch_id", "doc_id", F.col("batch_size"), F.col("solution"), excerpt, F.coalesce("judged", F.lit(False)))
    said = X.with_answer(A.generated(spark, sf_dir, _stream(spark, sf_dir, "documents")))
    generator = replies.reply_events(said, "generator", "batch_id", "doc_id", F.col("generated_text").isNull(), F.col("extracted_answer"))
    read = A.critic(spark, sf_dir, _stream(spark, sf_dir, "labels")).withColumn("batch_id", F.floor(F.col("doc_id") / 32))
    critic = replies.reply_events(read, "critic", "batch_id", "doc_id", F.col("critic_text") == "no tags")
    closed = replies.closed_batches(requests, generator, critic)
    target = new_folder(spark, "batches")
    running.finish(running.stream_results(closed, target, new_folder(spark, "batches-log")))
    answered = running.stored_results(closed, target).where(F.col("kind") == replies.ANSWERED)
    return metrics.with_correct(answered).select(
        F.col("sample_id").cast("bigint").alias("doc_id"), "batch_id", "api_error", "extracted_answer", "is_correct", F.col("excerpt").alias("failed_prompt")
    )


PARTS, FILES, EVERY = 8, 4, 3


@query
def stream_snapshots(spark, sf_dir):
    """Accuracy of the snapshot after every third of eight micro-batches, and of the final counts."""
    results = _parsed(spark, sf_dir).select(*SAMPLE_KEYS, "solution", "extracted_answer")
    part = F.substring_index("sample_id", "-", 1).cast("bigint") % PARTS
    inbox, target = new_folder(spark, "inbox"), new_folder(spark, "counts")
    stored = stage(results.withColumn("part", part), "results")
    for k in range(PARTS):  # files arrive in this order, as many for each micro-batch
        stored.where(F.col("part") == k).drop("part").repartition(FILES).write.mode("append").parquet(inbox)
    arriving = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", FILES).parquet(inbox)
    final = counted.finish(counted.stream_counts(arriving, target, new_folder(spark, "counts-log"), EVERY), spark, target)
    kept = counted.snapshots(spark, target)
    levels = [metrics.accuracy_rollup(kept.where(F.col("batches") == k)).withColumn("batches", F.lit(k)) for k in range(EVERY, PARTS, EVERY)]
    return splits.union_cells(*levels, metrics.accuracy_rollup(final).withColumn("batches", F.lit(PARTS)))
