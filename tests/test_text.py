"""Parsers against plain regular expressions, row by row."""

import ast
import random
import re

from pyspark.sql import functions as F

from strandcall.functions import text as X

RESPONSES = [
    "<answer>upregulated</answer>",
    "<ANSWER>\n Downregulated\t</Answer>",
    "<answer>not upregulated but downregulated</answer>",
    "<answer>Not Differentially Expressed.</answer>",
    "<answer></answer>",
    "<answer>maybe</answer><answer>upregulated</answer>",
    "</answer> <answer>downregulated</answer>",
    "<answer>upregulated",
    "upregulated",
    "<answer><answer>upregulated</answer></answer>",
    "<anſwer>downregulated</anſwer>",
    "<answer>İ upregulated</answer>",
    "<think>a\nb</think><answer>upregulated</answer>",
    "<THINK>　 x \x0b</THINK> <answer>nothing</answer>",
    "<think></think>",
    "<think>one</think><think>two</think><answer>downregulated</answer>",
    "<think>x</think>",
    "",
    None,
]
CLASSES = ["upregulated", "downregulated", "not differentially expressed"]


def tagged(text, tag):
    if text is None:
        return None
    found = re.search(f"<{tag}>(.*?)</{tag}>", text, re.IGNORECASE | re.DOTALL)
    return found.group(1).strip() if found else None


def answer_of(text):
    inner = tagged(text, "answer")
    if inner is None:
        return None
    return next((c for c in CLASSES if c in inner.lower()), None)


def test_answers(spark):
    df = spark.createDataFrame([(t,) for t in RESPONSES], "generated_text string")
    rows = X.with_answer(df).withColumn("again", X.extract_answer(F.col("generated_text"))).collect()
    for row in rows:
        assert row.extracted_answer == answer_of(row.generated_text), row
        assert row.again == answer_of(row.generated_text), row


def test_think_and_answer(spark):
    df = spark.createDataFrame([(t,) for t in RESPONSES], "generated_text string")
    for row in X.with_think_answer(df).collect():
        think = tagged(row.generated_text, "think")
        assert row.generated_thinking == think, row
        assert row.generated_answer == (answer_of(row.generated_text) if think is not None else None), row


def test_filter_on_parsed_answer_does_not_copy_the_parser(spark):
    df = spark.createDataFrame([(t,) for t in RESPONSES], "generated_text string")
    plan = X.with_answer(df).where("extracted_answer = 'upregulated'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_critic(spark):
    cases = [
        ("<reasoning> ok </reasoning><evaluation> GOOD\n</evaluation>", "good", "ok"),
        ("<evaluation>[good]</evaluation><reasoning>x</reasoning>", None, "x"),
        ("<evaluation>terrible</evaluation>", "terrible", None),
        ("<reasoning></reasoning>", None, ""),
        ("nothing", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame(cases, "critic_text string, rating string, why string")
    for row in X.with_critic(df).collect():
        assert (row.critic_evaluation, row.critic_reasoning) == (row.rating, row.why)
    shown = spark.createDataFrame([("",), (None,), ("a",)], "x string").select(X.or_not_available(F.col("x")))
    assert [r[0] for r in shown.collect()] == ["N/A", "N/A", "a"]


def test_gene_lists(spark):
    cases = [
        ("<answer>Upregulated: ['A', \"B'1\"]; Downregulated: []</answer>", (["A", "B'1"], [])),
        ("<answer>Upregulated: []\nDownregulated: ['D',]</answer>", ([], ["D"])),
        ("<answer>Downregulated: [ 'D' , 'E' ]</answer>", ([], ["D", "E"])),
        ("<answer>upregulated: ['a']</answer>", ([], [])),
        ("<answer>Upregulated: [A, B]</answer>", None),
        ("<answer>Upregulated: ['A' 'B']</answer>", None),
        ("<answer>Upregulated: ['A',\n'B']</answer>", ([], [])),
        ("no tag", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, generated_text string")
    for row in X.with_gene_lists(df).collect():
        got = tuple(row.gene_lists) if row.gene_lists else None
        assert got == cases[row.i][1], row


def test_python_list(spark):
    values = [[], ["A"], ["A", "B"], ["it's"], ['say "x"'], ["both ' and \""], ["back\\slash"]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<string>")
    for row in df.withColumn("text", X.python_list(F.col("v"))).collect():
        assert row.text == repr(values[row.i])


MESSAGES = [
    [("system", "s"), ("user", "u1"), ("assistant", "a"), ("user", "u2")],
    [("system", ""), ("tool", "t"), ("user", ""), ("user", "late")],
    [("system", "only")],
    [(None, "x"), ("user", None)],
    [],
]


def test_messages(spark):
    schema = f"i int, prompt {X.MESSAGE_TYPE}"
    df = spark.createDataFrame(list(enumerate(MESSAGES)), schema)
    prompt = F.col("prompt")
    rows = df.select(
        "i",
        F.size(X.usable_messages(prompt)).alias("usable"),
        X.first_user(prompt).alias("first"),
        X.last_user_excerpt(prompt).alias("excerpt"),
        X.last_content(prompt).alias("last"),
    ).collect()
    suffix = "... (API Call Failed)"
    assert [tuple(r)[1:] for r in sorted(rows)] == [
        (4, "u1", "u2" + suffix, "u2"),
        (1, "late", "late" + suffix, "late"),
        (1, None, "API_CALL_FAILED" + suffix, ""),
        (0, None, None, ""),
        (0, None, "API_CALL_FAILED" + suffix, ""),
    ]


def test_excerpt_is_cut(spark):
    df = spark.createDataFrame([([("user", "x" * 500)],)], f"prompt {X.MESSAGE_TYPE}")
    got = df.select(X.last_user_excerpt(F.col("prompt"))).first()[0]
    assert got == "x" * 200 + "... (API Call Failed)"


def test_render_chat(spark):
    df = spark.createDataFrame([([("system", "s"), ("user", "u")],)], f"prompt {X.MESSAGE_TYPE}")
    got = [df.select(X.render_chat(F.col("prompt"), s)).first()[0] for s in ("blocks", "joined", "tags")]
    assert got == ["[SYSTEM]\ns\n\n[USER]\nu\n\n", "s u", "<|system|>\ns\n<|user|>\nu"]


TOKENS = (
    ["<answer>", "</answer>", "<Answer>", "</ANSWER>", "<think>", "</think>", "<THINK>", "<answer", "answer>", "</"]
    + ["upregulated", "DOWNregulated", "not differentially expressed", "upregulate", "downregulatedownregulated"]
    + [" ", "\n", "\t", "\x0b", "\x85", "\u2003", "é", "İ", "ß", "𝄞", "x", "'", "[", "]"]
)


def random_texts(seed, n, tokens, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(tokens) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_random_responses(spark):
    texts = random_texts(1, 9000, TOKENS, 14)
    df = spark.createDataFrame([(t,) for t in texts], "generated_text string")
    parsed = 0
    for row in X.with_answer(X.with_think_answer(df)).collect():
        think, answer = tagged(row.generated_text, "think"), answer_of(row.generated_text)
        assert row.generated_thinking == think, row
        assert row.extracted_answer == answer, row
        assert row.generated_answer == (answer if think is not None else None), row
        parsed += answer is not None
    assert parsed > 100


def lists_of(text):
    inner = tagged(text, "answer")
    if inner is None:
        return None
    lists = []
    for key in ("Upregulated", "Downregulated"):
        found = re.search(key + r":\s*(\[.*?\])", inner)
        try:
            value = ast.literal_eval(found.group(1)) if found else []
        except (SyntaxError, ValueError):
            return None
        lists.append(value)
    return tuple(lists)


def test_random_gene_lists(spark):
    tokens = ["Upregulated:", "Downregulated:", "upregulated:", " ", "; ", ", ", "\n", "[]", "['A']", "['A', \"B\"]", "[A]", "['A', ]", "[ 'C' ,'D' ]", "['A'", "]"]
    texts = [f"<answer>{t}</answer>" for t in random_texts(2, 2000, tokens, 8)]
    df = spark.createDataFrame([(t,) for t in texts], "generated_text string")
    seen = 0
    for row in X.with_gene_lists(df).collect():
        got = tuple(row.gene_lists) if row.gene_lists else None
        assert got == lists_of(row.generated_text), row
        seen += got not in (None, ([], []))
    assert seen > 100
