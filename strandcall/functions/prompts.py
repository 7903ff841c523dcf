"""Prompt texts: a small table of templates, filled in by column concatenation.

The wording is this package's own. A template is cut at its placeholders once,
on the driver, and becomes a single ``concat`` of literals and columns.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandcall.functions.text import message, messages

ROLE = (
    "You are a molecular biologist who predicts how silencing one gene with CRISPR interference "
    "changes the expression of another. "
)
THINK = (
    "Reason step by step between <think> and </think>: name the pathways involved, how the two genes "
    "interact, and what is special about the cell line. "
)
CHOOSE = (
    "Finish with exactly one of upregulated, downregulated, not differentially expressed{unsure} "
    "between <answer> and </answer>."
)
CHOOSE_DIRECTION = "Finish with exactly one of upregulated, downregulated between <answer> and </answer>."
SHAPE = "\nLayout: <think>your reasoning</think><answer>your choice</answer>"
SHORT_SHAPE = "\nLayout: <answer>your choice</answer>"
GIVEN = (
    "It is known that after silencing {pert} the gene {gene} is {answer}. "
    "Explain why, as if you had to find this out yourself. "
)
EXAMPLE = (
    "\nFor instance:\n<think>The silenced phosphatase normally keeps a kinase cascade quiet. The target is an early "
    "response gene of that cascade, so it should rise.</think><answer>upregulated</answer>"
)
WORKED_EXAMPLE = (
    "\n\nA reply that a biologist would accept:\n<think>What does silencing ATF4 do to DDIT3 while unfolded proteins "
    "pile up in the endoplasmic reticulum? Stressed cells make ATF4, which binds the promoter of DDIT3 and turns it "
    "on. Other arms of the stress response reach DDIT3 too, but ATF4 is the main one here, so with less of it the "
    "cells make less DDIT3.</think><answer>downregulated</answer>"
)
CHECKLIST = (
    "\n\nBefore you answer, settle three things.\n"
    "Baseline: is the target expressed in this line at all, and what keeps it at that level?\n"
    "Route: write down the shortest chain of known steps from the knockdown to the target, mark each step as "
    "activating or inhibiting, and say which step you trust least.\n"
    "Size: would what reaches the target stand out against cell-to-cell noise, or would a paralogue or a "
    "compensating loop absorb it?\n"
    "If no chain holds up, say so; that speaks for no change."
)
# What the model may say when a lookup tool is at hand.
UNSURE = " (or: I do not know, I want to check pathways and interactions again)"

SYSTEM_TEMPLATES = {
    "default": ROLE + THINK + CHOOSE + SHAPE,
    "o3_synth_data": ROLE + THINK + CHOOSE + SHAPE + EXAMPLE,
    "o3_synth_data_with_ans": ROLE + GIVEN + THINK + CHOOSE + SHAPE + EXAMPLE,
    "o3_test": ROLE + CHOOSE + SHORT_SHAPE,
    "default_with_biologist_gold_solution": ROLE + THINK + CHOOSE + SHAPE + WORKED_EXAMPLE,
    "default_with_biologist_lemmas": ROLE + THINK + CHOOSE + SHAPE + CHECKLIST,
    "ans_with_biologist_lemmas": ROLE + GIVEN + CHECKLIST + "\n" + CHOOSE + SHAPE + EXAMPLE,
    "default_with_biologist_lemmas_and_gold_solution": ROLE + THINK + CHOOSE + SHAPE + CHECKLIST + WORKED_EXAMPLE,
    "direction_test_prompt": ROLE + THINK + CHOOSE + SHAPE,
    "o3_direction_test": ROLE + CHOOSE_DIRECTION + SHORT_SHAPE,
}

QUESTION = "How does silencing {pert} by CRISPR interference affect {gene} in single cells of the {cell_type} line?"
DIRECTION_GIVEN = "The target is known to change. Answer UPREGULATED or DOWNREGULATED, nothing else"
USER_TEMPLATES = {
    "direction_test_prompt": DIRECTION_GIVEN + "; not differentially expressed is not an option.\n" + QUESTION,
    "o3_direction_test": DIRECTION_GIVEN + ".\n" + QUESTION,
}

LIST_FORMAT = (
    "Between <answer> and </answer> write Upregulated: followed by the names in square brackets, then "
    "Downregulated: in the same way, separated by a semicolon and a space; an empty group is []. "
    "Layout: <think>your reasoning</think><answer>Upregulated: []; Downregulated: ['first symbol', 'second symbol']</answer>"
)
LIST_TEMPLATES = {
    "default": (
        "You are a bioinformatician. List the genes that rise and those that fall after a knockdown. " + LIST_FORMAT
    ),
    "synth_data_with_ans": (
        "You are a bioinformatician. Silencing {pert} has this known effect: {payload}. "
        "Explain it from pathways, gene interactions and the cell line. " + LIST_FORMAT
    ),
}
LIST_FALLBACK = "List the genes that rise and those that fall, as asked by the user. " + LIST_FORMAT
LIST_QUESTION = "Which genes rise and which fall when {pert} is silenced in {cell_type} cells?"

UP_DOWN_SYSTEM = ROLE + THINK + "Finish with up or down between <answer> and </answer>." + SHAPE

CRITIC_SYSTEM = (
    "You review how another model reasoned about a gene knockdown. Judge only the reasoning, not the final answer: "
    "is it biologically right, does each step follow, does it fit the cell line?\n"
    "Reply with <reasoning>a short justification</reasoning> and "
    "<evaluation>one of excellent, good, average, bad, terrible</evaluation>."
)
CRITIC_USER = (
    "Question:\n{user_query}\n\nReasoning to review:\n{thinking}\n\n"
    "Give your reasoning and evaluation in the two tags."
)

CONTEXT_LEAD = "\nBackground that may help:\n{context}"

SFT_SYSTEM = {
    "dir": ROLE + THINK + CHOOSE_DIRECTION + SHAPE,
    "dif": ROLE + THINK + CHOOSE.replace("{unsure}", "") + SHAPE,
}


def parts(template: str) -> list[tuple[str, str | None]]:
    """Cut a template into (literal text, placeholder that follows it)."""
    return [(text, field) for text, field, _, _ in Formatter().parse(template)]


def render(template: str, **values: Column) -> Column:
    pieces = []
    for text, field in parts(template):
        if text:
            pieces.append(F.lit(text))
        if field is not None:
            pieces.append(values[field])
    return F.concat(*pieces)


def system_template(mode: str, tool: bool = False) -> str:
    if mode not in SYSTEM_TEMPLATES:
        raise ValueError(f"unknown prompt mode: {mode}")
    return SYSTEM_TEMPLATES[mode].replace("{unsure}", UNSURE if tool else "")


def user_template(mode: str) -> str:
    if mode not in SYSTEM_TEMPLATES:
        raise ValueError(f"unknown prompt mode: {mode}")
    return USER_TEMPLATES.get(mode, QUESTION)


def list_template(mode: str) -> str:
    """An unknown mode falls back to a generic text."""
    return LIST_TEMPLATES.get(mode, LIST_FALLBACK)


def critic_template(checklist: bool = False) -> str:
    return CRITIC_SYSTEM + (CHECKLIST if checklist else "")


def system_prompt(mode: str = "default", tool: bool = False) -> Column:
    """System prompt over columns ``pert``, ``gene``, ``solution``."""
    return render(
        system_template(mode, tool), pert=F.col("pert"), gene=F.col("gene"), answer=F.col("solution")
    )


def user_prompt(mode: str = "default") -> Column:
    """User prompt over columns ``pert``, ``gene``, ``cell_type``."""
    return render(user_template(mode), pert=F.col("pert"), gene=F.col("gene"), cell_type=F.col("cell_type"))


def list_system_prompt(mode: str, payload: Column) -> Column:
    return render(list_template(mode), pert=F.col("pert"), payload=payload)


def list_user_prompt() -> Column:
    return render(LIST_QUESTION, pert=F.col("pert"), cell_type=F.col("cell_type"))


def chat_prompt(system: Column, user: Column) -> Column:
    return messages(message("system", system), message("user", user))


def critic_prompt(user_query: Column, thinking: Column, checklist: bool = False) -> Column:
    return chat_prompt(
        F.lit(critic_template(checklist)), render(CRITIC_USER, user_query=user_query, thinking=thinking)
    )


def add_context(prompt: Column, context: Column) -> Column:
    """Prompt with background appended, unchanged where there is none."""
    lead = render(CONTEXT_LEAD, context=context)
    return F.concat(prompt, F.coalesce(lead, F.lit("")))


def sft_messages(express_type: str, target: str) -> Column:
    """System, user and assistant turn of a training example.

    ``target='cot'`` trains on the whole response, ``'direct'`` on the gold answer.
    """
    if target == "cot":
        reply = F.col("assistant_response")
    elif target == "direct":
        reply = F.concat(F.lit("<answer>"), F.col("true_answer"), F.lit("</answer>"))
    else:
        raise ValueError(f"unknown target: {target}")
    system = SFT_SYSTEM["dir" if express_type == "dir" else "dif"]
    return messages(
        message("system", F.lit(system)), message("user", F.col("user_prompt")), message("assistant", reply)
    )
