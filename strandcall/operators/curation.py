"""Attaching model responses, accepting examples and explaining rejections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcall.functions.text import (
    compute_once,
    or_not_available,
    tag_text,
    with_answer,
    with_critic,
    with_think_answer,
)
from strandcall.operators.keys import group_packed
from strandcall.operators.metrics import percent

# Columns of an accepted example, in file order.
EXAMPLE_COLUMNS = (
    "pert",
    "gene",
    "cell_type",
    "user_query",
    "true_answer",
    "user_prompt",
    "assistant_response",
    "generated_thinking",
    "generated_answer",
    "critic_evaluation",
    "critic_reasoning",
)

# Reasons in the order in which a sample can fail.
REASONS = (
    "no user query",
    "generator failed",
    "no think block",
    "critic failed",
    "rating unreadable",
    "rating below threshold",
    "answer unparsed",
    "answer wrong",
)
ACCEPTED = "accepted"


def parse_ratings(text: str) -> list[str]:
    """Accepted ratings from a comma list, trimmed."""
    return [word.strip() for word in text.split(",")]


def attach_responses(samples: DataFrame, responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of samples and model responses; a missing response is a failed call."""
    return samples.join(responses, list(keys), "left")


def critic_verdicts(
    critic: DataFrame, key: str, text: str = "critic_text", reasoning: bool = True
) -> DataFrame:
    """Parsed critic responses without their text, ready to be joined."""
    return with_critic(critic, text, reasoning).select(
        key,
        (F.col(text).isNotNull()).alias("has_critic"),
        "critic_evaluation",
        *(["critic_reasoning"] if reasoning else []),
    )


def judged(
    generated: DataFrame, critic: DataFrame, key: str, keep: Sequence[str] = (), reasoning: bool = True
) -> DataFrame:
    """Short judgement columns per sample: what was parsed on either side.

    Responses are parsed before the join and their texts dropped, unless named
    in ``keep``, so the shuffle carries flags instead of documents. ``reasoning``
    adds the critic's reasoning.
    """
    parsed = with_think_answer(generated)
    left = parsed.select(
        key,
        *keep,
        F.col("generated_text").isNotNull().alias("has_response"),
        F.col("generated_thinking").isNotNull().alias("has_thinking"),
        "generated_answer",
        "solution",
    )
    return left.join(critic_verdicts(critic, key, reasoning=reasoning), key, "left").withColumn(
        "has_critic", F.coalesce("has_critic", F.lit(False))
    )


def acceptable(ratings: Sequence[str]) -> Column:
    """Critic rating is accepted and the parsed answer is the gold answer."""
    return F.coalesce(
        F.col("critic_evaluation").isin(*ratings) & (F.col("generated_answer") == F.col("solution")),
        F.lit(False),
    )


def accepted_examples(
    generated: DataFrame, critic: DataFrame, key: str, ratings: Sequence[str]
) -> DataFrame:
    """Accepted examples with their texts.

    Both conditions are applied on their own side first: only rows that can
    still be accepted bring their text to the (then inner) join. The answer is
    the cheaper test, so reasoning is only looked for behind a right answer.
    """
    right = with_answer(generated, out="generated_answer").where(F.col("generated_answer") == F.col("solution"))
    right_answer = compute_once(right, generated_thinking=tag_text(F.col("generated_text"), "think")).where(
        F.col("generated_thinking").isNotNull()
    )
    good = critic_verdicts(critic, key).where(F.col("critic_evaluation").isin(*ratings)).drop("has_critic")
    return right_answer.join(good, key).withColumn("critic_reasoning", or_not_available(F.col("critic_reasoning")))


def to_examples(accepted: DataFrame) -> DataFrame:
    """Bring accepted rows into the layout of an example file."""
    named = accepted.withColumns(
        {
            "user_query": F.lit(None).cast("string"),
            "true_answer": F.col("solution"),
            "assistant_response": F.col("generated_text"),
        }
    )
    return named.select(*EXAMPLE_COLUMNS)


def approval(judged_rows: DataFrame, ratings: Sequence[str]) -> DataFrame:
    """Processed and approved samples, and the share in percent."""
    return judged_rows.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(acceptable(ratings)).alias("approved")
    ).withColumn("approval_pct", percent(F.col("approved"), F.col("processed")))


def rejection_reason(ratings: Sequence[str], has_query: Column | None = None) -> Column:
    """First stage a sample fails at, or ``accepted``."""
    tests = (
        ~has_query if has_query is not None else F.lit(False),
        ~F.col("has_response"),
        ~F.col("has_thinking"),
        ~F.col("has_critic"),
        F.col("critic_evaluation").isNull(),
        ~F.col("critic_evaluation").isin(*ratings),
        F.col("generated_answer").isNull(),
        F.col("generated_answer") != F.col("solution"),
    )
    expr = F.lit(ACCEPTED)
    for reason, test in reversed(list(zip(REASONS, tests))):
        expr = F.when(test, F.lit(reason)).otherwise(expr)
    return expr


def rejection_funnel(
    judged_rows: DataFrame, ratings: Sequence[str], has_query: Column | None = None
) -> DataFrame:
    return judged_rows.groupBy(rejection_reason(ratings, has_query).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def failed_batches(errors: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The batches of these rows."""
    return group_packed(errors, [batch]).withColumn("api_error", F.lit(True))


def with_failures(df: DataFrame, failed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``api_error`` on every row of a failed batch."""
    return df.join(failed, batch, "left").withColumn("api_error", F.coalesce("api_error", F.lit(False)))


def fail_batches(df: DataFrame, is_error: Column, batch: str = "batch_id") -> DataFrame:
    """One failed call fails its batch: ``api_error`` on every row of it.

    ``df`` is read twice; where it carries long texts, take ``failed_batches`` of a narrow
    frame instead. Rows are not gathered per batch.
    """
    return with_failures(df, failed_batches(df.where(is_error), batch), batch)


def with_context(samples: DataFrame, context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a context text by perturbation or by the full sample key."""
    return samples.join(context.select(*keys, "context"), list(keys), "left")


def user_turns(turns: DataFrame, key: str) -> DataFrame:
    """First and last user message of conversations stored one turn per row.

    Both come from aggregates over the turn number, so a long conversation is
    never gathered.
    """
    said = turns.where((F.col("role") == "user") & (F.length("content") > 0))
    return said.groupBy(key).agg(
        F.min_by("content", "turn").alias("first_user"),
        F.max_by("content", "turn").alias("last_user"),
        F.count(F.lit(1)).alias("user_turns"),
    )
