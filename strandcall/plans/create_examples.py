"""Entry 1: from call files and model responses to accepted training examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.functions.prompts import critic_prompt
from strandcall.functions.text import compute_once, first_user, tag_text
from strandcall.operators.curation import accepted_examples, attach_responses, to_examples
from strandcall.operators.ordering import number_copies, with_row_index
from strandcall.operators.sampling import sample_exact
from strandcall.plans.datasets import with_prompt
from strandcall.session import stage
from strandcall.vocab import SAMPLE_KEYS

# Share and seed of the creation sample.
TRAIN_FRACTION = 0.15
SEED = 88

SAMPLE_ID = "sample_id"
OCCURRENCE = "occurrence"


def generator_requests(
    samples: DataFrame,
    mode: str = "o3_synth_data_with_ans",
    tool: bool = False,
    fraction: float = TRAIN_FRACTION,
    seed: int = SEED,
) -> DataFrame:
    """Sampled rows with a ``sample_id`` and the chat prompt to send.

    Rows are drawn, not keys: rows that share the keys are numbered first. The id
    numbers the rows, so equal samples get a response each. Prompts are
    rendered last. Responses and critic texts come back with the id.
    """
    numbered = stage(number_copies(samples, SAMPLE_KEYS, OCCURRENCE), "samples")
    chosen = sample_exact(numbered, fraction, seed, [*SAMPLE_KEYS, OCCURRENCE]).drop(OCCURRENCE)
    return with_prompt(with_row_index(chosen, seed, SAMPLE_KEYS, SAMPLE_ID), mode, tool)


def critic_requests(requests: DataFrame, responses: DataFrame, checklist: bool = False) -> DataFrame:
    """Critic prompts for the responses that contain reasoning.

    Each side is parsed and filtered where it is read; only what is asked about is joined.
    """
    asked = compute_once(requests.select(SAMPLE_ID, "prompt"), user_query=first_user(F.col("prompt"))).drop("prompt")
    reasoned = compute_once(responses, thinking=tag_text(F.col("generated_text"), "think")).select(SAMPLE_ID, "thinking")
    both = asked.where(F.col("user_query").isNotNull()).join(reasoned.where(F.col("thinking").isNotNull()), SAMPLE_ID)
    return both.select(SAMPLE_ID, critic_prompt(F.col("user_query"), F.col("thinking"), checklist).alias("prompt"))


def examples(
    requests: DataFrame, responses: DataFrame, critic: DataFrame, ratings: Sequence[str] = ("good",)
) -> DataFrame:
    """Accepted examples in file layout."""
    asked = requests.select(SAMPLE_ID, *SAMPLE_KEYS, "solution", first_user(F.col("prompt")).alias("user_prompt"))
    answered = attach_responses(asked, responses, [SAMPLE_ID]).where(F.col("user_prompt").isNotNull())
    return to_examples(accepted_examples(answered, critic, SAMPLE_ID, ratings))
