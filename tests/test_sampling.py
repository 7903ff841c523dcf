import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandcall.operators import sampling as S
from strandcall.operators.batching import assign_batches, assign_shard, preview
from strandcall.operators.ordering import number_copies, with_row_index


def md5(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1000).select("id", (F.col("id") % 7).alias("v"))


@pytest.fixture(scope="module")
def copies(spark):
    """A third of the rows are copies of one row; another key has different payloads."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "mixed").otherwise(F.col("id").cast("string")).alias("key"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("payload"),
    )


@pytest.mark.parametrize("fraction", [0.0, 0.001, 0.15, 0.5, 0.9, 1.0])
def test_sample_is_the_head_of_the_hash_order(numbers, fraction):
    size = max(1, int(1000 * fraction))
    want = sorted(range(1000), key=lambda i: md5(88, i))[:size]
    got = S.sample_exact(numbers, fraction, 88, ["id"])
    assert sorted(r.id for r in got.collect()) == sorted(want)
    again = S.sample_exact(numbers.repartition(13, "v"), fraction, 88, ["id"])
    assert sorted(r.id for r in again.collect()) == sorted(want)


def test_rows_are_drawn_where_keys_repeat(spark):
    """100 keys with ten copies each, and one key with 30 % of the rows."""
    rows = spark.range(1000).select((F.col("id") % 100).cast("string").alias("key"), (F.col("id") % 3).alias("v"))
    numbered = number_copies(rows, ["key"])
    assert sorted((r.key, r.occurrence) for r in numbered.collect()) == sorted((str(k), n) for k in range(100) for n in range(10))
    drawn = Counter(r.key for r in S.sample_exact(numbered, 0.15, 88, ["key", "occurrence"]).collect())
    assert sum(drawn.values()) == 150 and len(drawn) > 60 and max(drawn.values()) < 8
    hot = rows.withColumn("key", F.when(F.col("key") < "37", "hot").otherwise(F.col("key")))
    share = hot.where("key = 'hot'").count() / 1000
    drawn = Counter(r.key for r in S.sample_exact(number_copies(hot, ["key"]), 0.5, 88, ["key", "occurrence"]).collect())
    assert abs(drawn["hot"] / 500 - share) < 0.06


def test_minimum(numbers):
    tiny = numbers.where("id < 3")
    assert S.sample_exact(tiny, 0.1, 1, ["id"]).count() == 1
    assert S.sample_exact(tiny, 0.1, 1, ["id"], min_one=False).count() == 0
    assert S.sample_exact(numbers.where("id < 0"), 0.5, 1, ["id"]).count() == 0


@pytest.mark.parametrize("fraction", [0.05, 0.2, 0.34, 0.5, 0.67, 0.8, 0.99])
@pytest.mark.parametrize("keys", [["key"], ["key", "payload"]])
def test_ties_are_divided_exactly(copies, fraction, keys):
    everything = Counter(tuple(r) for r in copies.collect())
    sample = Counter(tuple(r) for r in S.sample_exact(copies, fraction, 5, keys).collect())
    assert sum(sample.values()) == int(900 * fraction)
    assert not sample - everything
    repeat = Counter(tuple(r) for r in S.sample_exact(copies.repartition(5), fraction, 5, keys).collect())
    assert repeat == sample
    split = S.train_val_split(copies, fraction, 5, keys)
    parts = {p: Counter(tuple(r)[:2] for r in split.where(F.col("part") == p).collect()) for p in ("train", "val")}
    assert parts["train"] == sample
    assert parts["train"] + parts["val"] == everything


def test_train_val_split(numbers):
    parts = S.train_val_split(numbers, 0.9, 42, ["id"]).collect()
    train = {r.id for r in parts if r.part == "train"}
    val = {r.id for r in parts if r.part == "val"}
    assert len(train) == 900 and len(val) == 100
    assert train | val == set(range(1000)) and not train & val
    empty = S.train_val_split(numbers.where("id < 1"), 0.9, 42, ["id"]).collect()
    assert [r.part for r in empty] == ["val"]


def test_repeated_samples(numbers, spark):
    runs = S.repeated_samples(numbers, 4, 0.2, 88, ["id"])
    picked = {}
    for row in runs.collect():
        picked.setdefault(row.run, set()).add(row.id)
    assert {r: len(ids) for r, ids in picked.items()} == {1: 200, 2: 200, 3: 200, 4: 200}
    assert len({frozenset(ids) for ids in picked.values()}) == 4
    for run, ids in picked.items():
        assert ids == set(sorted(range(1000), key=lambda i: md5(88, run, i))[:200])


def test_direction_stage_filters_after_sampling(numbers):
    words = F.when(F.col("id") % 2 == 0, "upregulated").otherwise("not differentially expressed")
    df = numbers.withColumn("solution", words)
    whole = S.repeated_samples(df, 2, 0.2, 1, ["id"])
    assert S.repeated_samples(df, 2, 0.2, 1, ["id"], "dir").count() == whole.where(F.col("id") % 2 == 0).count()


def test_sample_is_a_filter(numbers):
    plan = S.sample_exact(numbers, 0.15, 88, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_row_index(numbers):
    want = sorted(range(1000), key=lambda i: md5(9, i))
    got = with_row_index(numbers, 9, ["id"]).orderBy("row_index").collect()
    assert [r.id for r in got] == want
    assert [r.row_index for r in got] == list(range(1000))


def test_row_index_of_copies(copies):
    rows = with_row_index(copies, 9, ["key"]).collect()
    assert sorted(r.row_index for r in rows) == list(range(900))
    assert Counter(tuple(r)[:2] for r in rows) == Counter(tuple(r) for r in copies.collect())


@pytest.mark.parametrize("drop_last", [False, True])
def test_batches(copies, drop_last):
    sizes = Counter(r.batch_id for r in assign_batches(copies, 32, 1, ["key"], drop_last).collect())
    assert sorted(sizes) == list(range(28 if drop_last else 29))
    assert {n for b, n in sizes.items() if b < 28} == {32}
    assert drop_last or sizes[28] == 900 - 28 * 32


def test_shards(copies):
    sizes = Counter(r.shard for r in assign_shard(copies, 7, 1, ["key"]).collect())
    assert sum(sizes.values()) == 900 and max(sizes.values()) - min(sizes.values()) <= 1


def test_preview(numbers):
    assert [r.id for r in preview(numbers, 3, ["v", "id"]).collect()] == [0, 7, 14]
