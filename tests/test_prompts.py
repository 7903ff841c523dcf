import pytest
from pyspark.sql import functions as F

from strandcall.functions import prompts as P


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(
        [("TP53", "MYC", "k562", "upregulated", "q", "t")],
        "pert string, gene string, cell_type string, solution string, user_query string, thinking string",
    )


@pytest.mark.parametrize("mode", P.SYSTEM_TEMPLATES)
@pytest.mark.parametrize("tool", [False, True])
def test_system_prompts_are_filled(sample, mode, tool):
    text = sample.select(P.system_prompt(mode, tool)).first()[0]
    assert "{" not in text and "<answer>" in text
    given = mode in ("o3_synth_data_with_ans", "ans_with_biologist_lemmas")
    assert ("TP53" in text and "MYC" in text) == given
    assert ("I do not know" in text) == (tool and mode != "o3_direction_test")
    assert (P.CHECKLIST in text) == ("lemmas" in mode)
    assert (P.WORKED_EXAMPLE in text) == ("gold_solution" in mode)


def test_user_prompts(sample):
    plain, direction, short = (
        sample.select(P.user_prompt(m)).first()[0] for m in ("default", "direction_test_prompt", "o3_direction_test")
    )
    assert all(word in plain for word in ("TP53", "MYC", "k562"))
    assert direction.endswith(plain) and short.endswith(plain)
    assert "not an option" in direction and "not an option" not in short


def test_unknown_mode():
    with pytest.raises(ValueError):
        P.system_prompt("nope")
    with pytest.raises(ValueError):
        P.user_prompt("nope")
    assert P.list_template("nope") == P.LIST_FALLBACK


def test_critic_prompt(sample):
    short, long = (
        sample.select(P.critic_prompt(F.col("user_query"), F.col("thinking"), c)).first()[0] for c in (False, True)
    )
    assert [m.role for m in short] == ["system", "user"]
    assert long[0].content == short[0].content + P.CHECKLIST
    assert "Question:\nq\n" in short[1].content and "review:\nt\n" in short[1].content


def test_context_is_optional(spark):
    df = spark.createDataFrame([("p", "c"), ("p", None)], "prompt string, context string")
    got = [r[0] for r in df.select(P.add_context(F.col("prompt"), F.col("context"))).collect()]
    assert got == ["p\nBackground that may help:\nc", "p"]


def test_sft_messages(spark):
    df = spark.createDataFrame([("u", "full", "upregulated")], "user_prompt string, assistant_response string, true_answer string")
    cot = df.select(P.sft_messages("dif", "cot")).first()[0]
    direct = df.select(P.sft_messages("dir", "direct")).first()[0]
    assert [m.content for m in cot] == [P.SFT_SYSTEM["dif"], "u", "full"]
    assert [m.content for m in direct] == [P.SFT_SYSTEM["dir"], "u", "<answer>upregulated</answer>"]
    assert "not differentially expressed" in P.SFT_SYSTEM["dif"]
    assert "not differentially expressed" not in P.SFT_SYSTEM["dir"]
