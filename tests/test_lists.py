import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandcall.functions import text as X
from strandcall.functions.text import list_solution, with_gene_lists
from strandcall.operators.lists import gene_lists, genes_by_pert, same_lists

SCHEMA = "pert string, gene string, cell_type string, label double"


def make(seed=3):
    rng = random.Random(seed)
    pick = rng.choice
    return [
        (pick(["A", "B", None]), pick(["g1", "g2", "G3", None]), pick(["k", "h"]), pick([0.0, 1.0, 5.0, None]))
        for _ in range(300)
    ] + [("only-missing", None, "k", 1.0), ("other-label", "g1", "k", 7.0)]


def test_gene_lists(spark, rows):
    data = make()
    want = {}
    for pert, gene, cell, label in data:
        if pert is None:
            continue
        up, down = want.setdefault((pert, cell), (set(), set()))
        if gene is not None and label in (0.0, 1.0):
            (up if label == 1.0 else down).add(gene)
    got = gene_lists(spark.createDataFrame(data, SCHEMA))
    assert rows(got) == sorted(((*k, sorted(u), sorted(d)) for k, (u, d) in want.items()), key=repr)


def test_pages_hold_every_copy(spark):
    data = make()
    want = defaultdict(list)
    for pert, gene, _, _ in data:
        if pert is not None:
            want[pert].append(gene)
    df = spark.createDataFrame(data, SCHEMA)
    for size in (1, 7, 1000):
        got, pages = defaultdict(list), defaultdict(list)
        for row in genes_by_pert(df, size).collect():
            assert len(row.genes) == row.n_genes <= size
            got[row.pert] += row.genes
            pages[row.pert].append((row.page, row.n_genes))
        assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
        for numbered in pages.values():
            numbered.sort()
            assert [p for p, _ in numbered] == list(range(len(numbered)))
            assert all(n == size for _, n in numbered[:-1])


def test_gold_list_answers_are_recognised(spark, rows):
    gold = gene_lists(spark.createDataFrame(make(), SCHEMA))
    answers = gold.select(
        "pert", "cell_type", list_solution(F.col("upregulated"), F.col("downregulated")).alias("generated_text")
    )
    assert same_lists(with_gene_lists(answers), gold, ["pert", "cell_type"]).where(~F.col("is_correct")).count() == 0
    wrong = with_gene_lists(answers.withColumn("generated_text", F.lit("<answer>Upregulated: ['?']</answer>")))
    assert same_lists(wrong, gold, ["pert", "cell_type"]).where("is_correct").count() == 0


@pytest.mark.parametrize("names", [["plain"], ["it's"], ['say "x"'], ["a\\b"], ["\\"], ["'\"\\", "x"], []])
def test_solutions_read_back(spark, names):
    df = spark.createDataFrame([(names, list(reversed(names)))], "up array<string>, down array<string>")
    text = df.select("up", "down", X.list_solution(F.col("up"), F.col("down")).alias("generated_text"))
    row = X.with_gene_lists(text).first()
    assert (row.gene_lists.upregulated, row.gene_lists.downregulated) == (row.up, row.down)
