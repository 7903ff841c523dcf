"""Readers and writers on small hand-written trees."""

import json

import pytest
from pyspark.sql import functions as F

from strandcall.operators import labelling
from strandcall.operators.curation import EXAMPLE_COLUMNS
from strandcall.operators.lists import gene_lists
from strandcall.operators.splits import filter_split
from strandcall.sources import calls as R
from strandcall.sources import sinks as W


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


@pytest.fixture
def tree(tmp_path):
    write(tmp_path, "HepG2-de.csv", "pert,gene,label,split\nA,x,1,train\nA,y,0,test\nB,x,1.0,train\nNA,x,1,train\n")
    write(tmp_path, "HepG2-dir.csv", "label,gene,pert\n1,x,A\n0,x,B\n1,x,NA\n3,q,A\n")
    write(tmp_path, "K562 b+1-de.csv", 'split,label,extra,gene,pert\ntest,1,"a,b",x,A\ntest,1,z,,A\n,1,z,y,\n')
    write(tmp_path, "K562 b+1-dir.csv", "pert,gene,label\nA,x,0\nA,,1\n,y,1\n")
    write(tmp_path, "nosplit-de.csv", "pert,gene,label\nA,x,0\n")
    write(tmp_path, "nosplit-dir.csv", "pert,gene,label\nA,x,0\n")
    write(tmp_path, "alone-de.csv", "pert,gene,label\nA,x,1\n")
    write(tmp_path, "broken-de.csv", "pert,gene\nA,x\n")
    write(tmp_path, "broken-dir.csv", "pert,gene,label\nA,x,1\n")
    write(tmp_path, "badpair-de.csv", "pert,gene,label\nA,x,1\n")
    write(tmp_path, "badpair-dir.csv", "pert,label\nA,1\n")
    write(tmp_path, "notes.csv", "anything\n1\n")
    return tmp_path


def test_manifest(spark, tree):
    got = {r.cell_type: (r.status, r.reason) for r in R.pair_manifest(spark, str(tree)).collect()}
    assert got == {
        "HepG2": ("ok", None),
        "K562 b+1": ("ok", None),
        "nosplit": ("ok", None),
        "alone": ("skipped", "no direction file"),
        "broken": ("skipped", "call file lacks label"),
        "badpair": ("skipped", "direction file lacks gene"),
    }


def test_manifest_lists_directions_without_calls_and_counts_rows(spark, tree):
    write(tree, "late-dir.csv", "pert,gene,label\nA,x,1\n")
    write(tree, "empty-de.csv", "\n")
    write(tree, "empty-dir.csv", "pert,gene,label\n")
    got = {r.cell_type: r for r in R.pair_manifest(spark, str(tree)).collect()}
    assert (got["late"].status, got["late"].reason, got["late"].de_path, got["late"].dir_rows) == ("skipped", "no call file", None, 1)
    assert (got["empty"].reason, got["empty"].de_rows, got["empty"].dir_rows) == ("call file lacks pert, gene, label", 0, 0)
    assert (got["K562 b+1"].de_rows, got["K562 b+1"].de_ragged, got["HepG2"].dir_rows) == (3, 0, 4)
    assert got["K562 b+1"].de_path.endswith("/K562 b+1-de.csv")


RAGGED = 'pert,gene,label,note\n\nA,x,1,"a, ""b"", c"\nA,y,0\nA,z,1,n,more\n"A","w","1","q"\nB,"v, ",,\n"B, u",x,up,"n"\n'


def test_ragged_rows(spark, tmp_path, rows):
    write(tmp_path, "one-de.csv", RAGGED)
    (report,) = R.file_report(spark, str(tmp_path), "de").collect()
    assert (report.cell_type, report.header, report.n_rows, report.n_short, report.n_long) == ("one", ["pert", "gene", "label", "note"], 6, 1, 1)
    kept = rows(R.read_calls(spark, str(tmp_path), "de", ragged="drop"), "pert", "gene", "label")
    assert kept == [("A", "w", 1.0), ("A", "x", 1.0), ("B", "v, ", None), ("B, u", "x", None)]
    assert R.read_calls(spark, str(tmp_path), "de").count() == 6


def test_ragged_rows_of_split_files(spark, tmp_path):
    write(tmp_path, "one-de.csv", "pert,gene,label\n" + "".join(f"A,g{k},1{',x' * (k % 3 == 0)}\n" for k in range(999)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        (report,) = R.file_report(spark, str(tmp_path), "de").collect()
        kept = R.read_calls(spark, str(tmp_path), "de", ragged="drop").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (report.header, report.n_rows, report.n_short, report.n_long, kept) == (["pert", "gene", "label"], 999, 0, 333, 666)


def test_file_report_is_one_query_for_any_number_of_files(spark, tmp_path):
    def jobs(folder):
        spark.sparkContext.setJobGroup(folder.name, "report")
        R.file_report(spark, str(folder), "de").collect()
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(folder.name))

    few, many = tmp_path / "few", tmp_path / "many"
    for folder, n in ((few, 2), (many, 20)):
        folder.mkdir()
        for k in range(n):
            write(folder, f"c{k}-de.csv", "pert,gene,label\nA,x,1\n")
    assert jobs(few) == jobs(many)


def test_read_calls(spark, tree, rows):
    with pytest.warns(UserWarning, match="lacks columns: label"):
        df = R.read_calls(spark, str(tree), "de")
    assert rows(df.where("cell_type = 'HepG2'"), "pert", "gene", "label", "split") == [
        ("A", "x", 1.0, "train"),
        ("A", "y", 0.0, "test"),
        ("B", "x", 1.0, "train"),
        ("NA", "x", 1.0, "train"),
    ]
    assert rows(df.where("cell_type = 'K562 b+1'"), "pert", "gene", "label", "split") == sorted(
        [("A", "x", 1.0, "test"), ("A", None, 1.0, "test"), (None, "y", 1.0, None)], key=repr
    )
    assert {r.cell_type for r in df.select("cell_type").collect()} == {"HepG2", "K562 b+1", "nosplit", "alone", "badpair"}


def test_pairs_to_samples(spark, tree, rows):
    with pytest.warns(UserWarning, match="skipped"):
        calls, directions = R.read_pairs(spark, str(tree), "test")
    samples = labelling.labelled_samples(filter_split(calls, "test"), directions)
    assert rows(samples, "pert", "gene", "cell_type", "label") == sorted(
        [
            ("A", "y", "HepG2", 0),
            ("A", "x", "K562 b+1", 1),
            ("A", None, "K562 b+1", 2),
            ("A", "x", "nosplit", 0),
        ],
        key=repr,
    )


@pytest.mark.filterwarnings("ignore")
def test_holdout_reads_only_its_files(spark, tree):
    for split, cells in (("test", {"HepG2"}), ("train", {"K562 b+1", "nosplit"}), (None, {"HepG2", "K562 b+1", "nosplit"})):
        calls, directions = R.read_pairs(spark, str(tree), split, "hepg2, alone")
        for df in (calls, directions):
            assert {r.cell_type for r in df.select("cell_type").collect()} == cells
        names = " ".join(calls.inputFiles())
        assert ("HepG2" in names) == ("HepG2" in cells)
    nothing, _ = R.read_pairs(spark, str(tree), "other", "hepg2")
    assert nothing.isEmpty()


def test_lists_from_files(spark, tree, rows):
    with pytest.warns(UserWarning):
        directions = R.read_calls(spark, str(tree), "dir")
    got = rows(gene_lists(directions.where("cell_type like 'K562%' or cell_type = 'HepG2'")))
    assert got == [
        ("A", "HepG2", ["x"], []),
        ("A", "K562 b+1", [], ["x"]),
        ("B", "HepG2", [], ["x"]),
        ("NA", "HepG2", ["x"], []),
    ]


def test_cell_lines_with_odd_names(spark, tmp_path):
    names = ["a%41b", "x y", "p+q", "é", "de-de"]
    for name in names:
        write(tmp_path, f"{name}-de.csv", "pert,gene,label\nA,x,1\n")
        write(tmp_path, f"{name}-dir.csv", "pert,gene,label\nA,x,1\n")
    manifest = R.pair_manifest(spark, str(tmp_path)).collect()
    assert sorted(r.cell_type for r in manifest if r.status == "ok") == sorted(names)
    for df in R.read_pairs(spark, str(tmp_path)):
        assert sorted(r.cell_type for r in df.collect()) == sorted(names)


def test_empty_folder(spark, tmp_path):
    with pytest.raises(ValueError, match="no \\*-de.csv"):
        R.read_calls(spark, str(tmp_path), "de")


def test_single_file(spark, tmp_path, rows):
    write(tmp_path, "one.csv", "gene,label,pert,split\nx,1,A,train\ny,1.5,A,test\nz,up,B,test\n")
    write(tmp_path, "two.csv", "gene,label,pert\nx,1,A\n")
    path = str(tmp_path / "one.csv")
    assert rows(R.read_single(spark, path, "test"), "pert", "gene", "label") == [("A", "y", "1.5"), ("B", "z", "up")]
    clean, rejected = labelling.valid_labels(R.read_single(spark, path))
    assert rows(clean, "gene", "label") == [("x", 1)]
    assert rows(rejected, "label") == [("1.5",), ("up",)]
    assert R.read_single(spark, str(tmp_path / "two.csv")).count() == 1
    with pytest.raises(ValueError, match="split"):
        R.read_single(spark, str(tmp_path / "two.csv"), "test")


def test_exclusions(spark, tmp_path, rows):
    write(tmp_path, "used.csv", 'cell_type,text,gene,pert\nk,"two\nlines, ""quoted""",x,A\nk,z,x,A\n')
    assert rows(R.read_exclusions(spark, str(tmp_path / "used.csv"))) == [("A", "x", "k")]
    write(tmp_path, "short.csv", "pert,gene\nA,x\n")
    for name in ("short.csv", "absent.csv"):
        with pytest.warns(UserWarning):
            assert R.read_exclusions(spark, str(tmp_path / name)).isEmpty()


@pytest.fixture
def examples(spark):
    text = 'She said "no"\nand\\or, left; \'so\''
    row = {c: f"{c} value" for c in EXAMPLE_COLUMNS} | {"user_query": None, "assistant_response": text}
    schema = ", ".join(f"{c} string" for c in EXAMPLE_COLUMNS)
    return spark.createDataFrame([tuple(row[c] for c in EXAMPLE_COLUMNS)] * 3, schema)


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_examples_round_trip(spark, tmp_path, examples, rows, format):
    path = W.example_path(str(tmp_path), "model", "critic", "HepG2,K562", True, False, ["good", "excellent"])
    assert path.endswith(
        "model/critic/HepG2,K562_split/generator_lemmas_critic_default_prompt_good,excellent_critic_threshold"
    )
    W.write_examples(examples, path, format)
    back = R.read_examples(spark, path, format)
    assert tuple(back.columns) == EXAMPLE_COLUMNS
    assert rows(back) == rows(examples)
    W.write_examples(examples.limit(1), path, format)
    assert R.read_examples(spark, path, format).count() == 1


def test_default_example_path():
    assert W.example_path("out/", "m", "s") == (
        "out/m/s/default_split/default_generator_prompt_critic_default_prompt_good_critic_threshold"
    )


def test_results_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([("A", None, False), ("B", "é\n", True)], "pert string, extracted_answer string, is_correct boolean")
    for _ in range(2):
        W.write_results(df, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("*.json")) for x in f.read_text("utf-8").splitlines()]
    assert sorted(lines, key=str) == sorted(
        [
            {"pert": "A", "extracted_answer": None, "is_correct": False},
            {"pert": "B", "extracted_answer": "é\n", "is_correct": True},
        ],
        key=str,
    )


def test_report_text_is_ordered(spark, tmp_path):
    df = spark.range(100).select(
        (F.col("id") % 3).alias("section"), F.lpad(F.col("id").cast("string"), 3, "0").alias("position")
    ).withColumn("line", F.concat_ws("/", "section", "position"))
    W.write_report(df, str(tmp_path / "report"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "report").glob("part-*")))
    assert text.splitlines() == sorted(text.splitlines()) and len(text.splitlines()) == 100


def test_trees_are_written_and_counted_without_sorting_lines(spark, tmp_path, monkeypatch):
    """Rows go to files as they come; a file in several blocks, with blank lines first, is counted as a whole."""
    from strandcall.catalog import adapters as A

    cells = spark.range(3000).selectExpr("concat('c', id % 3) cell_type", "concat('S', id, ',P ,\"x, \"\"y\"\"\"') value")
    frame, seen = type(cells), []
    conf, write = "spark.sql.maxConcurrentOutputFileWriters", frame.write.fget
    plan_of = lambda df: df._jdf.queryExecution().toString()
    monkeypatch.setattr(frame, "write", property(lambda df: seen.append(("Sort " in plan_of(df), int(spark.conf.get(conf)) >= 3)) or write(df)))
    monkeypatch.setattr(A, "ragged_lines", lambda spark, sf_dir: cells)
    before = spark.conf.get(conf)
    folder = A.ragged_tree(spark, "", str(tmp_path / "tree"))
    assert seen == [(False, True)] and spark.conf.get(conf) == before
    for k in range(3):
        head, *lines = (tmp_path / "tree" / f"c{k}-de.csv").read_text().splitlines()
        assert head == "pert,gene,label" and sorted(lines) == sorted(f'S{i},P ,"x, ""y"""' for i in range(k, 3000, 3))
    (tmp_path / "tree" / "c9-de.csv").write_text("\n \n" * 900 + "gene,pert,label\n" + "a,b\n" * 500 + "a,b,1\n" * 300 + "a,b,1,2\n" * 40)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1k")
    try:
        report = R.file_report(spark, folder, "de")
        found = {r.cell_type: (r.header, r.n_rows, r.n_short, r.n_long) for r in report.collect()}
    finally:
        spark.conf.set(name, before)
    assert found["c9"] == (["gene", "pert", "label"], 840, 500, 40)
    assert found["c1"] == (["pert", "gene", "label"], 1000, 0, 0)
    plan = report._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "partial_min(place" not in plan and "partial_min(line" in plan
