"""Parsing of tagged model responses, and chat messages as nested columns.

Small helpers are plain column expressions. Parsers are offered on DataFrames
(``with_*``): a tag is cut out of the long text once, and what is decided about
it afterwards looks at the short tag only (see ``compute_once``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcall.vocab import CLASSES, NO_REASONING, RATINGS, WHITESPACE

# Patterns of the response format.
TAG_PATTERN = r"(?isu)<{tag}>(.*?)</{tag}>"
LIST_PATTERN = r"(?d){key}:\s*(\[.*?\])"
QUOTED = r"""(?:'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")"""
ITEM_PATTERN = f"(?s){QUOTED}"
LIST_BODY_PATTERN = rf"(?s)^\[\s*(?:{QUOTED}\s*(?:,\s*{QUOTED}\s*)*,?\s*)?\]$"
ESCAPED = r"""\\(['"\\])"""


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row, whatever is done with them.

    A filter on an ordinary computed column is pushed below it by copying its
    expression, and a nested expression multiplies with every copy. Filters do
    not move below a generator, so the columns are made by one with one row.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(values)))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def tag_text(col: Column, tag: str) -> Column:
    """Text inside the first ``<tag>…</tag>``, any case, across lines, stripped.

    Null without a match; an empty tag gives an empty string.
    """
    found = F.regexp_extract_all(col, F.lit(TAG_PATTERN.format(tag=tag)), F.lit(1))
    return strip(F.get(found, F.lit(0)))


def first_class_in(text: Column) -> Column:
    """First answer class, in the fixed order, that occurs in a lower-case text."""
    expr = F.lit(None).cast("string")
    for word in reversed(CLASSES):
        expr = F.when(text.contains(word), F.lit(word)).otherwise(expr)
    return expr


def extract_answer(col: Column) -> Column:
    return first_class_in(F.lower(tag_text(col, "answer")))


def _with_answer_tag(df: DataFrame, text: str) -> DataFrame:
    """Add ``_tag``: the lower-cased answer tag, by plain string search.

    Only the lower-cased text matters here, so no regex is needed. The long s is
    the one letter that equals a letter of the tag in any case but this one.
    """
    lowered = F.replace(F.lower(F.col(text)), F.lit("an\u017fwer"), F.lit("answer"))
    opened = F.nullif(F.instr("_tag", "<answer>"), F.lit(0))
    rest = df.withColumn("_tag", lowered).withColumn("_tag", F.substr("_tag", opened + len("<answer>")))
    closed = F.contains(F.col("_tag"), F.lit("</answer>"))
    return compute_once(rest, _tag=F.when(closed, F.substring_index("_tag", "</answer>", 1)))


def with_answer(df: DataFrame, text: str = "generated_text", out: str = "extracted_answer") -> DataFrame:
    """Add the parsed answer class, null when there is none."""
    return _with_answer_tag(df, text).withColumn(out, first_class_in(F.col("_tag"))).drop("_tag")


def with_think_answer(df: DataFrame, text: str = "generated_text") -> DataFrame:
    """Add ``generated_thinking`` and ``generated_answer``.

    Without a think block both are null; an empty block still counts.
    """
    tagged = compute_once(_with_answer_tag(df, text), generated_thinking=tag_text(F.col(text), "think"))
    return (
        tagged.withColumn(
            "generated_answer",
            F.when(F.col("generated_thinking").isNotNull(), first_class_in(F.col("_tag"))),
        )
        .drop("_tag")
    )


def with_critic(df: DataFrame, text: str = "critic_text", reasoning: bool = True) -> DataFrame:
    """Add ``critic_evaluation`` (null unless on the scale) and, if asked for, ``critic_reasoning``."""
    parsed = {"_tag": F.lower(tag_text(F.col(text), "evaluation"))}
    if reasoning:
        parsed = {"critic_reasoning": tag_text(F.col(text), "reasoning"), **parsed}
    tagged = compute_once(df, **parsed)
    return tagged.withColumn("critic_evaluation", F.when(F.col("_tag").isin(*RATINGS), F.col("_tag"))).drop("_tag")


def or_not_available(col: Column) -> Column:
    return F.when(F.length(col) > 0, col).otherwise(F.lit(NO_REASONING))


# --- gene lists -------------------------------------------------------------


def _list_body(answer: Column, key: str) -> Column:
    return F.get(F.regexp_extract_all(answer, F.lit(LIST_PATTERN.format(key=key)), F.lit(1)), F.lit(0))


def _items(body: Column) -> Column:
    quoted = F.regexp_extract_all(body, F.lit(ITEM_PATTERN), F.lit(0))
    return F.transform(quoted, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), ESCAPED, "$1"))


def with_gene_lists(df: DataFrame, text: str = "generated_text", out: str = "gene_lists") -> DataFrame:
    """Add a struct of two gene lists read from the answer tag.

    A missing list is empty; no answer tag, or a list that is not a plain list
    of quoted names, makes the whole struct null.
    """
    empty = F.array().cast("array<string>")
    up, down = F.col("_up"), F.col("_down")

    def readable(body: Column) -> Column:
        return body.isNull() | body.rlike(LIST_BODY_PATTERN)

    def items(body: Column) -> Column:
        return F.when(body.isNull(), empty).otherwise(_items(body))

    tagged = compute_once(df, _tag=tag_text(F.col(text), "answer"))
    bodies = compute_once(
        tagged, _up=_list_body(F.col("_tag"), "Upregulated"), _down=_list_body(F.col("_tag"), "Downregulated")
    )
    return (
        bodies.withColumn(
            out,
            F.when(
                F.col("_tag").isNotNull() & readable(up) & readable(down),
                F.struct(items(up).alias("upregulated"), items(down).alias("downregulated")),
            ),
        )
        .drop("_tag", "_up", "_down")
    )


def python_list(items: Column) -> Column:
    """An array of strings in Python list notation."""

    def quote(item: Column) -> Column:
        escaped = F.replace(item, F.lit("\\"), F.lit("\\\\"))
        single, double = item.contains("'"), item.contains('"')
        return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(items, quote), ", "), F.lit("]"))


def list_payload(up: Column, down: Column) -> Column:
    return F.concat(F.lit("Upregulated: "), python_list(up), F.lit("\nDownregulated: "), python_list(down))


def list_solution(up: Column, down: Column) -> Column:
    return F.concat(F.lit("<answer>"), list_payload(up, down), F.lit("</answer>"))


# --- chat messages ------------------------------------------------------------

MESSAGE_TYPE = "array<struct<role:string,content:string>>"
# Roles a chat message may have.
ROLES = ("system", "user", "assistant")
# Length kept of a failed call's user message, and what follows it.
FAILED_PROMPT_CHARS = 200
FAILED_PROMPT_SUFFIX = "... (API Call Failed)"
FAILED_PROMPT_DEFAULT = "API_CALL_FAILED"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(*turns: Column) -> Column:
    return F.array(*turns)


def usable_messages(msgs: Column) -> Column:
    """Drop messages with an empty role or content, or an unknown role."""
    return F.filter(msgs, lambda m: m["role"].isin(*ROLES) & (F.length(m["content"]) > 0))


def first_user(msgs: Column) -> Column:
    """Content of the first usable user message; null when there is none."""
    users = F.filter(msgs, lambda m: (m["role"] == "user") & (F.length(m["content"]) > 0))
    return F.get(users, F.lit(0))["content"]


def last_user_excerpt(msgs: Column) -> Column:
    """Start of the last user message, as recorded for a failed call."""
    users = F.filter(msgs, lambda m: m["role"] == "user")
    last = F.try_element_at(users, F.lit(-1))["content"]
    shown = F.when(F.size(users) > 0, last).otherwise(F.lit(FAILED_PROMPT_DEFAULT))
    return F.concat(F.substring(shown, 1, FAILED_PROMPT_CHARS), F.lit(FAILED_PROMPT_SUFFIX))


def last_content(msgs: Column) -> Column:
    """Content of the last message, empty when there are fewer than two."""
    last = F.try_element_at(msgs, F.lit(-1))["content"]
    return F.when(F.size(msgs) > 1, F.coalesce(last, F.lit(""))).otherwise(F.lit(""))


def render_chat(msgs: Column, style: str = "tags", cue: bool = False) -> Column:
    """Flatten messages to one text; ``cue`` ends ``tags`` with the line that asks the assistant to go on.

    ``blocks``: ``[ROLE]`` line, content, blank line. ``joined``: contents with a
    space between. ``tags``: ``<|role|>`` line before each content.
    """
    if style == "blocks":
        return F.array_join(
            F.transform(
                msgs, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"], F.lit("\n\n"))
            ),
            "",
        )
    if style == "joined":
        return F.array_join(F.transform(msgs, lambda m: m["content"]), " ")
    if style == "tags":
        turns = F.array_join(
            F.transform(msgs, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n"
        )
        return F.concat(turns, F.lit("\n<|assistant|>\n")) if cue else turns
    raise ValueError(f"unknown chat style: {style}")
