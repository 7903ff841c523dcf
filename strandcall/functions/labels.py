"""Label derivation: conditional expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandcall.vocab import BINARY_TEXT, DOWN, TERNARY_TEXT, UNCHANGED, UP

UNRESOLVED = -1


def raw_label(is_de: Column, direction: Column) -> Column:
    """0 unchanged, 1 down, 2 up; -1 when the call has no usable direction."""
    return (
        F.when(is_de == 0, F.lit(0))
        .when((is_de == 1) & direction.isin(0, 1), direction.cast("int") + 1)
        .otherwise(F.lit(UNRESOLVED))
    )


def repair_label(raw: Column) -> Column:
    """An unresolved label counts as unchanged."""
    return F.when(raw == UNRESOLVED, F.lit(0)).otherwise(raw)


def label_text(label: Column, vocab: str = "ternary") -> Column:
    words = {"ternary": TERNARY_TEXT, "binary": BINARY_TEXT}[vocab]
    expr = F.lit(None).cast("string")
    for code, word in words.items():
        expr = F.when(label == code, F.lit(word)).otherwise(expr)
    return expr


def gold_binary(solution: Column, stage: str) -> Column:
    """Stage ``dif``: changed against unchanged. Stage ``dir``: up against down."""
    if stage == "dif":
        positive, negative = solution.isin(UP, DOWN), solution == UNCHANGED
    elif stage == "dir":
        positive, negative = solution == UP, solution == DOWN
    else:
        raise ValueError(f"unknown stage: {stage}")
    return F.when(positive, F.lit(1)).when(negative, F.lit(0)).otherwise(F.lit(UNRESOLVED))


def gold_trinary(solution: Column) -> Column:
    return (
        F.when(solution == UP, F.lit(1))
        .when(solution == DOWN, F.lit(0))
        .when(solution == UNCHANGED, F.lit(2))
        .otherwise(F.lit(UNRESOLVED))
    )


def pred_score(answer: Column, stage: str) -> Column:
    """Score of a parsed answer; 0.5 when nothing usable was parsed."""
    code = gold_trinary(answer) if stage == "trinary" else gold_binary(answer, stage)
    return F.when(code != UNRESOLVED, code.cast("double")).otherwise(F.lit(0.5))
