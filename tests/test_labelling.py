"""Label join and its counted forms against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandcall.operators import labelling as L
from strandcall.operators.splits import in_split

CALLS = "pert string, gene string, cell_type string, label double, split string"
DIRECTIONS = "pert string, gene string, cell_type string, label double"
USED = "pert string, gene string, cell_type string"


def make(seed, n_calls=400, n_directions=300):
    rng = random.Random(seed)
    perts, genes, cells = ["A", "B", "", None], ["x", "y", "z", None], ["k562", "HepG2"]
    pick = lambda: (rng.choice(perts), rng.choice(genes), rng.choice(cells))
    calls = [(*pick(), rng.choice([0.0, 1.0, 1.0, 2.0, None]), rng.choice(["train", "test"])) for _ in range(n_calls)]
    directions = [(*pick(), rng.choice([0.0, 1.0, 1.0, 3.0, None])) for _ in range(n_directions)]
    used = [pick() for _ in range(5)] * 3
    return calls, [d for d in directions if d[:2] != ("A", "x")], used


def brute_samples(calls, directions):
    by_key = {}
    for *key, label in directions:
        by_key.setdefault(tuple(key), []).append(label)
    out = []
    for pert, gene, cell, is_de, split in calls:
        for direction in by_key.get((pert, gene, cell), [None]):
            raw = -1
            if is_de == 0:
                raw = 0
            elif is_de == 1 and direction in (0, 1):
                raw = int(direction) + 1
            out.append((pert, gene, cell, split, raw))
    return out


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    calls, directions, used = make(request.param)
    frames = (
        spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(directions, DIRECTIONS),
        spark.createDataFrame(used, USED),
    )
    return frames, brute_samples(calls, directions), calls, used


def test_rows(case, rows):
    (calls, directions, _), brute, _, _ = case
    got = rows(L.labelled_samples(calls, directions), "pert", "gene", "cell_type", "split", "label")
    assert got == sorted(((*r[:4], max(r[4], 0)) for r in brute), key=repr)


def test_runs_are_cut_and_expanded(case, rows, monkeypatch):
    (calls, directions, _), brute, _, _ = case
    monkeypatch.setattr(L, "RUN_ROWS", 2)
    assert L.collapse_directions(directions).agg(F.max("copies")).first()[0] == 2
    assert L.label_join(calls, directions).count() == len(brute)


def test_counts(case, rows):
    (calls, directions, _), brute, _, _ = case
    want = Counter((r[2], r[4]) for r in brute)
    assert rows(L.label_counts(calls, directions)) == sorted((*k, n) for k, n in want.items())
    fixed = Counter((r[2], max(r[4], 0)) for r in brute)
    assert rows(L.ternary_label_counts(calls, directions)) == sorted((*k, n) for k, n in fixed.items())
    quality = {c: (sum(r[2] == c for r in brute), sum(r[2] == c and r[4] == -1 for r in brute)) for c in {r[2] for r in brute}}
    assert rows(L.label_quality(calls, directions)) == sorted((c, *v) for c, v in quality.items())


def test_exclusion_ignores_missing_keys(case, rows):
    (calls, _, used), _, raw, used_rows = case
    known = {u for u in used_rows if None not in u}
    kept = [r for r in raw if tuple(r[:3]) not in known]
    assert rows(L.exclude_used(calls, used)) == sorted(kept, key=repr)
    skipped = Counter(r[2] for r in raw if tuple(r[:3]) in known)
    assert rows(L.excluded_counts(calls, used)) == sorted(skipped.items())


def test_load_report(case, rows):
    (calls, directions, used), brute, raw, used_rows = case
    known = {u for u in used_rows if None not in u}
    want = []
    for cells in ({"k562"}, {"HepG2"}, {"k562", "HepG2"}):
        before = sum(r[2] in cells for r in raw)
        after = sum(r[2] in cells and r[4] == "train" for r in raw)
        samples = [r for r in brute if r[2] in cells and r[3] == "train"]
        out = sum(tuple(r[:3]) in known for r in samples)
        name = None if len(cells) == 2 else cells.pop()
        want.append((name, before, after, len(samples), out, len(samples) - out, 2 if name is None else 1))
    got = rows(L.load_report(calls, directions, used, in_split(calls, "train")))
    assert got == sorted(want, key=repr)


def test_valid_labels(spark, rows):
    data = [("a", "x", t) for t in ("1", "0", "1.0", " 1 ", "1.5", "2", "x", "NaN", None)]
    clean, rejected = L.valid_labels(spark.createDataFrame(data, "pert string, gene string, label string"))
    assert sorted(r.label for r in clean.collect()) == [0, 1, 1, 1]
    assert clean.schema["label"].dataType.simpleString() == "int"
    assert rows(rejected) == sorted(
        [
            ("1.5", "not 0 or 1", 1),
            ("2", "not 0 or 1", 1),
            ("x", "not a number", 1),
            ("NaN", "not a number", 1),
            (None, "not a number", 1),
        ],
        key=repr,
    )


@pytest.mark.parametrize("form", ["label_join", "exclude_used"])
def test_hot_key_is_split_at_run_time(spark, form):
    """A third of the calls share one key; the join is still cut into several tasks."""
    hot = F.col("id") % 3 == 0
    calls = spark.range(0, 300_000, 1, 16).select(
        F.when(hot, "HOT").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("pert"),
        F.lit("g").alias("gene"),
        F.lit("k562").alias("cell_type"),
        F.lit(1.0).alias("label"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("payload"),
    )
    directions = calls.where(F.col("pert") != "HOT").select("pert", "gene", "cell_type", "label")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        function = L.label_join if form == "label_join" else L.exclude_used
        total = function(calls, directions).agg(F.count(F.lit(1)), F.max("payload"))
        n = total.collect()[0][0]
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
        assert n == (300_000 if form == "label_join" else 100_000)
    finally:
        for key in settings:
            spark.conf.unset(key)

