"""The operators of this subpackage as queries over stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcall.llm import (
    anchor_lists,
    byte_cnn,
    host_paths,
    license_automaton,
    mixing,
    pair_index,
    phrase_index,
    sentence_spans,
    simhash_trees,
    sketches,
    token_counts,
    url_bloom,
    whitening,
)
from strandcall.llm.common import table
from strandcall.llm.oracles import ORACLES


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.fingerprints(table(spark, sf_dir, "documents"), words=5)
    return found.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketches.as_text("sketch").alias("fingerprint"),
        sketches.as_text("edited_sketch").alias("edited_fingerprint"),
        sketches.likeness("sketch", "edited_sketch").alias("near_edited"),
        sketches.likeness("sketch", "next_sketch").alias("near_next"),
        sketches.containment(F.col("sketch"), F.col("edited_sketch")).alias("inside_edited"),
        sketches.containment(F.col("edited_sketch"), sketches.merged(F.col("sketch"), F.col("next_sketch"))).alias("edited_inside_both"),
    )


def op6_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = phrase_index.contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trees.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3)
    return found.select("doc_id", simhash_trees.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), budget=1.5, most=2)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op2_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_paths.extract(table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that is left of it."""
    found = sentence_spans.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_removed", F.char_length("left").cast("long").alias("n_chars"), F.col("left").alias("text"))


URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op8_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the URLs of pages whose document (the last number of the path) is labelled toxic."""
    pages = table(spark, sf_dir, "pages")
    names = ("host", "path", "verdict")
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in URL_RULES])
    rules = spark.range(1).select(F.inline(each))
    host, path = url_bloom.host_and_path(F.col("url"))
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").cast("string").alias("number"))
    number = F.regexp_extract("path", "0*([0-9]+)(?:\\.html?)?/?$", 1)
    listed = pages.select(host.alias("host"), path.alias("path")).withColumn("number", number).join(toxic, "number", "left_semi")
    return url_bloom.judge(pages, rules, listed).select("row.page_id", "host", "path", "rule", "verdict")


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    scored = byte_cnn.score(docs, net).select("row.doc_id", byte_cnn.held_out("row.doc_id").alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is the largest share of a template that a span covers; a phrase gives 0.9 at least."""
    found = license_automaton.scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("spans.label"))))
    share = F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(share, F.when(F.col("n_base") > 0, 0.9).otherwise(0.0))).alias("score"),
    )


def op11_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and its ids decoded again."""
    found = pair_index.encode(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", decoded=True)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op13_anchor_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return anchor_lists.hard_negatives(rows, anchor=F.col("vec_id") % 50 == 0, label_col=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_host_paths": op2_host_paths,
    "op3_token_counts": op3_token_counts,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_scaled_sketch": op5_scaled_sketch,
    "op6_phrase_index": op6_phrase_index,
    "op7_simhash": op7_simhash,
    "op8_url_bloom": op8_url_bloom,
    "op9_byte_cnn": op9_byte_cnn,
    "op10_license_automaton": op10_license_automaton,
    "op11_pair_index": op11_pair_index,
    "op12_bidiagonal_whitening": op12_bidiagonal_whitening,
    "op13_anchor_lists": op13_anchor_lists,
}
__all__ = ["ORACLES", "QUERIES"]
