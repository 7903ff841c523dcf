from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandcall.operators import curation as C
from strandcall.vocab import DOWN, UP

RATINGS = ["excellent", "good"]


def think(answer):
    return f"<think>because</think><answer>{answer}</answer>"


GOOD = "<reasoning>fine</reasoning><evaluation>Good</evaluation>"
# id, gold, response, critic text, has query, expected outcome
CASES = [
    (1, UP, think("upregulated"), GOOD, True, "accepted"),
    (2, UP, think("upregulated"), "<evaluation>excellent</evaluation>", True, "accepted"),
    (3, UP, think("upregulated"), GOOD, False, "no user query"),
    (4, UP, None, None, True, "generator failed"),
    (5, UP, "<answer>upregulated</answer>", GOOD, True, "no think block"),
    (6, UP, think("upregulated"), None, True, "critic failed"),
    (7, UP, think("upregulated"), "<evaluation>[good]</evaluation>", True, "rating unreadable"),
    (8, UP, think("upregulated"), "<evaluation>average</evaluation>", True, "rating below threshold"),
    (9, UP, think("?"), GOOD, True, "answer unparsed"),
    (10, DOWN, think("upregulated"), GOOD, True, "answer wrong"),
]


@pytest.fixture(scope="module")
def frames(spark):
    generated = spark.createDataFrame(
        [(i, gold, text, "q" if q else None) for i, gold, text, _, q, _ in CASES],
        "id int, solution string, generated_text string, user_prompt string",
    ).withColumns({c: F.lit(c) for c in ("pert", "gene", "cell_type")})
    critic = spark.createDataFrame([(c[0], c[3]) for c in CASES if c[3]], "id int, critic_text string")
    return generated, critic


def test_funnel(frames):
    generated, critic = frames
    asked = generated.withColumn("has_query", F.col("user_prompt").isNotNull())
    judged = C.judged(asked, critic, "id", keep=["has_query"])
    reasons = judged.select("id", C.rejection_reason(RATINGS, F.col("has_query"))).collect()
    assert {r[0]: r[1] for r in reasons} == {c[0]: c[-1] for c in CASES}
    funnel = C.rejection_funnel(judged, RATINGS, F.col("has_query")).collect()
    assert {r.reason: r.n for r in funnel} == Counter(c[-1] for c in CASES)


def test_accepted(frames):
    generated, critic = frames
    accepted = C.accepted_examples(generated, critic, "id", RATINGS)
    got = {r.id: (r.critic_evaluation, r.critic_reasoning) for r in accepted.collect()}
    assert got == {1: ("good", "fine"), 2: ("excellent", "N/A"), 3: ("good", "fine")}
    examples = C.to_examples(accepted)
    assert tuple(examples.columns) == C.EXAMPLE_COLUMNS
    assert examples.where(F.col("user_query").isNotNull()).count() == 0


def test_approval(frames, rows):
    judged = C.judged(*frames, "id")
    assert rows(C.approval(judged, RATINGS)) == [(10, 3, 30.0)]
    assert rows(C.approval(judged.where("id < 0"), RATINGS)) == [(0, 0, 0.0)]


def test_texts_do_not_cross_the_join(frames):
    plan = C.approval(C.judged(*frames, "id"), RATINGS)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :].split("\n")[1]
    assert "generated_text" not in join


def test_ratings_list():
    assert C.parse_ratings("good, excellent ") == ["good", "excellent"]
    assert C.parse_ratings(" good") == ["good"]


def test_failed_batches(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, False), (2, 1, True), (3, 2, False), (4, 2, None), (5, None, True)], "id int, batch_id int, bad boolean"
    )
    flagged = C.fail_batches(df, F.col("bad"))
    assert rows(flagged, "id", "api_error") == [(1, True), (2, True), (3, False), (4, False), (5, False)]


def test_user_turns(spark, rows):
    df = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "user", ""), (2, 0, "assistant", "x")],
        "conv int, turn int, role string, content string",
    )
    assert rows(C.user_turns(df, "conv")) == [(1, "a", "b", 2)]


def test_context(spark, rows):
    samples = spark.createDataFrame([("A", "x"), ("B", "y"), (None, "z")], "pert string, gene string")
    context = spark.createDataFrame([("A", "about A", 1)], "pert string, context string, other int")
    assert rows(C.with_context(samples, context, ["pert"])) == [
        ("A", "x", "about A"),
        ("B", "y", None),
        (None, "z", None),
    ]
