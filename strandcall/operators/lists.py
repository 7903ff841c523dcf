"""Gene lists per perturbation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.operators.ordering import add_hash, run_starts


def gene_lists(directions: DataFrame) -> DataFrame:
    """Sorted distinct up and down genes per perturbation and cell line.

    Genes are made distinct before lists are built, so a hot perturbation is
    spread over its genes first and a list grows with the number of distinct
    genes only. Missing genes are left out, groups without genes stay.
    """
    per_gene = (
        directions.where(F.col("pert").isNotNull())
        .groupBy("pert", "cell_type", "gene")
        .agg(
            F.max(F.coalesce(F.col("label") == 1, F.lit(False))).alias("is_up"),
            F.max(F.coalesce(F.col("label") == 0, F.lit(False))).alias("is_down"),
        )
    )
    return per_gene.groupBy("pert", "cell_type").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_up"), F.col("gene")))).alias("upregulated"),
        F.array_sort(F.collect_list(F.when(F.col("is_down"), F.col("gene")))).alias("downregulated"),
    )


def genes_by_pert(df: DataFrame, page_size: int = 1000, seed: int = 0) -> DataFrame:
    """All genes of a perturbation, duplicates kept, in pages of ``page_size``.

    Equal genes are counted first and placed by the running total of the counts,
    so no task ever holds more than one page of a perturbation, however often a
    gene or a perturbation occurs. The order of placement is a seeded hash of the
    gene; within a page genes are sorted.
    """
    counted = (
        df.where(F.col("pert").isNotNull())
        .groupBy("pert", "gene")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    placed = run_starts(add_hash(counted, seed, ["gene"]), "copies", by=("pert",), ties=("gene",), digits=2)
    first, stop = F.col("_start"), F.col("_start") + F.col("copies")
    pages = placed.withColumn(
        "page",
        F.explode(F.sequence(F.floor(first / page_size), F.floor((stop - 1) / page_size))),
    )
    overlap = F.least(stop, (F.col("page") + 1) * page_size) - F.greatest(first, F.col("page") * page_size)
    return (
        pages.select("pert", "page", "gene", overlap.cast("int").alias("n"))
        .groupBy("pert", "page")
        .agg(
            F.sum("n").cast("bigint").alias("n_genes"),
            F.array_sort(F.collect_list(F.struct("gene", "n"))).alias("runs"),
        )
        .select(
            "pert",
            "page",
            "n_genes",
            F.flatten(F.transform("runs", lambda r: F.array_repeat(r["gene"], r["n"]))).alias("genes"),
        )
    )


def same_lists(answers: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Whether parsed gene lists equal the gold lists, as sorted distinct sets."""

    def norm(col: str):
        return F.array_sort(F.array_distinct(F.col(col)))

    return answers.join(gold, keys, "left").withColumn(
        "is_correct",
        F.coalesce(
            (norm("gene_lists.upregulated") == norm("upregulated"))
            & (norm("gene_lists.downregulated") == norm("downregulated")),
            F.lit(False),
        ),
    )
