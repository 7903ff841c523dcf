"""Loading labelled samples, gene-list samples and single-file samples with prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.functions.labels import label_text
from strandcall.functions.prompts import (
    UP_DOWN_SYSTEM,
    add_context,
    chat_prompt,
    list_system_prompt,
    list_user_prompt,
    system_prompt,
    user_prompt,
)
from strandcall.functions.text import list_payload, list_solution
from strandcall.operators.batching import assign_batches
from strandcall.operators.curation import with_context
from strandcall.operators.labelling import exclude_used, labelled_samples, valid_labels
from strandcall.operators.lists import gene_lists
from strandcall.operators.splits import filter_holdout, require_rows
from strandcall.vocab import SAMPLE_KEYS


def load_samples(
    calls: DataFrame,
    directions: DataFrame,
    split: str | None = "train",
    test_lines: str | None = "none",
    used: DataFrame | None = None,
    require: bool = False,
) -> DataFrame:
    """Labelled samples of one split: keys, label, gold text.

    With ``require`` a split without calls is an error, found by looking for one row before anything is joined.
    """
    narrow = filter_holdout(calls, split, test_lines).select("cell_type", "pert", "gene", "label")
    if require:
        require_rows(narrow, f"no call in split {split}, held-out cell lines {test_lines}")
    samples = labelled_samples(narrow, directions)
    if used is not None:
        samples = exclude_used(samples, used)
    return samples.select(*SAMPLE_KEYS, "label", label_text(F.col("label")).alias("solution"))


def with_prompt(samples: DataFrame, mode: str = "default", tool: bool = False) -> DataFrame:
    """Chat prompt of each sample. Do this last: the text is wide."""
    return samples.withColumn("prompt", chat_prompt(system_prompt(mode, tool), user_prompt(mode)))


def gene_list_samples(
    directions: DataFrame, split: str | None = "train", test_lines: str | None = "none", mode: str = "default"
) -> DataFrame:
    """One sample per perturbation and cell line: gold lists, solution text, chat prompt.

    Of the words for held-out lines only ``none`` means that there are none.
    """
    up, down = F.col("upregulated"), F.col("downregulated")
    system = list_system_prompt(mode, list_payload(up, down))
    return gene_lists(filter_holdout(directions, split, test_lines, ("none",))).withColumns(
        {"solution_text": list_solution(up, down), "prompt": chat_prompt(system, list_user_prompt())}
    )


def single_file_samples(
    rows: DataFrame,
    cell_type: str,
    context: DataFrame | None = None,
    context_keys: Sequence[str] = ("pert",),
    require: bool = False,
) -> DataFrame:
    """Up / down samples of one direction file, with optional background in the prompt; ``require`` as in ``load_samples``."""
    clean, _ = valid_labels(rows)
    if require:
        require_rows(clean, f"no row of {cell_type} with a valid label")
    samples = clean.select("pert", "gene", "label").withColumn("cell_type", F.lit(cell_type))
    question = user_prompt()
    if context is not None:
        samples = with_context(samples, context, context_keys)
        question = add_context(question, F.col("context"))
    return samples.select(
        *SAMPLE_KEYS,
        "label",
        label_text(F.col("label"), "binary").alias("solution"),
        chat_prompt(F.lit(UP_DOWN_SYSTEM), question).alias("prompt"),
    )


def prompt_batches(
    samples: DataFrame, size: int = 32, seed: int = 0, training: bool = True, mode: str = "default"
) -> DataFrame:
    """Samples with batch number and prompt; training drops the incomplete last batch."""
    narrow = samples.select(*SAMPLE_KEYS, "label", "solution")
    return with_prompt(assign_batches(narrow, size, seed, SAMPLE_KEYS, drop_last=training), mode)
