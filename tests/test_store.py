"""Example sets side by side, shards on disk, and prompts whose mode is a column."""

import pytest
from pyspark.sql import functions as F

from strandcall.functions import prompt_table
from strandcall.functions import prompts as P
from strandcall.operators.curation import EXAMPLE_COLUMNS
from strandcall.sources import store


def examples(spark, n, word):
    return spark.range(n).select(*[F.concat(F.lit(f"{word} {c} "), F.col("id").cast("string")).alias(c) for c in EXAMPLE_COLUMNS])


def test_a_set_is_replaced_and_others_stay(spark, tmp_path):
    base = str(tmp_path / "store")
    store.store_examples(examples(spark, 5, "old"), base, "m1", "create", "default")
    store.store_examples(examples(spark, 7, "other"), base, "m2", "create", "default")
    store.store_examples(examples(spark, 3, "new"), base, "m1", "create", "default")
    store.store_examples(examples(spark, 3, "new"), base, "m1", "create", "default")
    one = store.stored_examples(spark, base, "m1")
    assert one.count() == 3 and one.where(~F.col("pert").startswith("new")).count() == 0
    assert store.stored_examples(spark, base).groupBy("model").count().orderBy("model").collect() == [("m1", 3), ("m2", 7)]
    assert "PartitionFilters: [isnotnull(model" in one._jdf.queryExecution().toString()
    assert store.stored_examples(spark, base, script="none").count() == 0


@pytest.mark.parametrize("n, world", [(1003, 4), (3, 5)])
def test_shards_have_their_own_folders(spark, tmp_path, n, world):
    rows = spark.range(n).selectExpr("id", "concat('t', id) text")
    store.write_shards(rows, str(tmp_path / "s"), world, 7, ["id"])
    parts = [store.read_shard(spark, str(tmp_path / "s"), k) for k in range(min(n, world))]
    sizes = [p.count() for p in parts]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(n))
    assert parts[0].columns == ["id", "text"]


def test_each_row_has_the_prompt_of_its_mode(spark):
    modes = [*P.SYSTEM_TEMPLATES, "no such mode", None]
    rows = [(k, m, None if k == 0 else f"P{k}", f"G{k}", "k562", "upregulated") for k, m in enumerate(modes)]
    samples = spark.createDataFrame(rows, "id int, mode string, pert string, gene string, cell_type string, solution string")
    templates = prompt_table.template_table(spark)
    found = {r.id: r for r in prompt_table.with_prompts(samples, templates, tool=F.col("id") % 2 == 0).collect()}
    assert len(found) == len(modes)
    for k, mode in enumerate(modes[:-2]):
        want = samples.where(f"id = {k}").select(P.system_prompt(mode, k % 2 == 0).alias("s"), P.user_prompt(mode).alias("u")).first()
        assert (found[k].system, found[k].user, found[k].problem) == (want.s, want.u, None)
    assert [found[k].problem for k in (len(modes) - 2, len(modes) - 1)] == ["unknown prompt mode: no such mode", "unknown prompt mode: none"]
    assert found[len(modes) - 1].system is None


def test_templates_survive_as_rows(spark, rows):
    templates = prompt_table.template_table(spark)
    again = prompt_table.from_rows(prompt_table.piece_rows(templates, "system_pieces").repartition(5), "system_pieces")
    assert rows(again) == rows(templates.select("mode", "tool", "system_pieces"))
