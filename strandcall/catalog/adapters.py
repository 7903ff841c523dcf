"""The stored tables in the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcall.functions.prompts import user_prompt
from strandcall.functions.text import MESSAGE_TYPE, list_solution
from strandcall.operators.keys import group_packed
from strandcall.vocab import DOWN, SAMPLE_KEYS, UNCHANGED, UP


# Columns in use, so that no file has to be opened to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_discount double, l_returnflag string, l_linestatus string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, event_type string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """Line items (stored or streamed) with the region of their supplier."""
    line = table(spark, sf_dir, "lineitem") if line is None else line
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("cell_type"))
    return (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("pert", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
        .withColumn("gene", F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
        .withColumn("sample_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differential-expression calls."""
    return _cells(spark, sf_dir).select(
        "sample_id",
        "pert",
        "gene",
        "cell_type",
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("label"),
        F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("split"),
    )


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions; line number 7 has none."""
    return (
        _cells(spark, sf_dir)
        .where((F.col("l_returnflag") != "N") & (F.col("l_linenumber") != 7))
        .select("pert", "gene", "cell_type", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    )


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys used for training before."""
    return _cells(spark, sf_dir).where(F.col("l_quantity") > 45).select(*SAMPLE_KEYS)


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose label is text, with values that are not valid."""
    words = {1: "1", 2: "0", 3: "1.0", 4: "x", 5: "2", 7: "0.0"}
    label: Column = F.lit(None).cast("string")
    for number, word in words.items():
        label = F.when(F.col("l_linenumber") == number, F.lit(word)).otherwise(label)
    return _cells(spark, sf_dir).select("pert", "gene", "cell_type", label.alias("label"))


def results(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """Evaluation results at line-item size."""
    text = (
        F.when(F.col("l_discount") >= 0.095, "no tag")
        .when(F.col("l_quantity") <= 15, f"<think>x</think><answer>{UNCHANGED}</answer>")
        .when(F.col("l_returnflag") == "A", "<think>x</think><Answer> Downregulated </Answer>")
        .otherwise(f"<think>x</think><answer>{UP}</answer>")
    )
    gold = F.when(F.col("l_returnflag") == "N", UNCHANGED).when(F.col("l_returnflag") == "A", DOWN).otherwise(UP)
    return _cells(spark, sf_dir, line).select(
        "sample_id", "pert", "gene", "cell_type", gold.alias("solution"), text.alias("generated_text")
    )


def generated(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Generator responses, one per (stored or streamed) document, in all shapes a parser must handle."""
    text, case = F.col("text"), F.col("doc_id") % 9
    think = F.concat(F.lit("<think>"), text, F.lit("</think>"))
    response = (
        F.when(case == 0, F.concat(think, F.lit(f"<answer>{UNCHANGED}</answer>")))
        .when(case == 1, F.concat(think, F.lit("\n<ANSWER>\n DownRegulated \t</ANSWER>")))
        .when(case == 2, F.concat(think, F.lit("<answer>[upregulated]</answer>")))
        .when(case == 3, F.concat(think, F.lit("<answer>downregulated, not upregulated</answer>")))
        .when(case == 4, F.concat(F.lit("<answer>downregulated</answer>"), text))
        .when(case == 5, think)
        .when(case == 6, F.lit("<think></think><answer></answer>"))
        .when(case == 7, F.concat(think, F.lit("<answer>I do not know</answer><answer>downregulated</answer>")))
        .otherwise(text)
    )
    gold = F.when(F.col("doc_id") % 3 == 0, UNCHANGED).when(F.col("doc_id") % 3 == 1, DOWN).otherwise(UP)
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    return (
        documents.select(
            "doc_id",
            F.floor(F.col("doc_id") / 32).alias("batch_id"),
            F.col("source").alias("pert"),
            F.concat(F.lit("G"), (F.col("doc_id") % 97).cast("string")).alias("gene"),
            F.col("lang").alias("cell_type"),
            gold.alias("solution"),
            response.alias("generated_text"),
        )
        .withColumn("user_prompt", user_prompt())
    )


def critic(spark: SparkSession, sf_dir: str, labels: DataFrame | None = None) -> DataFrame:
    """Critic responses to (stored or streamed) labels; documents without a label have none."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    text = (
        F.when(
            good & (F.col("doc_id") % 2 == 0),
            "<reasoning>sound</reasoning><evaluation> Excellent </evaluation>",
        )
        .when(good, "<evaluation>good</evaluation>")
        .when(F.col("quality") == 1, "<reasoning>weak</reasoning><evaluation>average</evaluation>")
        .when(F.col("toxic") == 0, "<evaluation>[bad]</evaluation>")
        .otherwise("no tags")
    )
    labels = table(spark, sf_dir, "labels") if labels is None else labels
    return labels.select("doc_id", text.alias("critic_text"))


def list_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene-list answers, well-formed and not."""
    case = F.col("doc_id") % 5
    text = (
        F.when(
            case == 0,
            F.concat(
                F.lit("<answer>Upregulated: ['A"),
                (F.col("doc_id") % 7).cast("string"),
                F.lit("', 'B']; Downregulated: ['C']</answer>"),
            ),
        )
        .when(case == 1, "<answer>Upregulated: []\nDownregulated: ['D', 'E']</answer>")
        .when(case == 2, "<answer>Upregulated: ['F']</answer>")
        .when(case == 3, "<answer>upregulated: ['lower case key']</answer>")
        .otherwise("none")
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("generated_text"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages around each document, with empty contents and an unknown role."""
    doc = F.col("doc_id")

    def turn(role: Column, content: Column) -> Column:
        return F.struct(role.alias("role"), content.alias("content"))

    msgs = F.array(
        turn(F.lit("system"), F.when(doc % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("lang "), F.col("lang")))),
        turn(F.when(doc % 5 == 0, "tool").otherwise("user"), F.col("text")),
        turn(
            F.when(doc % 3 == 0, "user").otherwise("assistant"),
            F.when(doc % 7 != 0, F.col("source")).otherwise(F.lit("")),
        ),
    ).cast(MESSAGE_TYPE)
    prompt = (
        F.when(doc % 11 == 9, F.lit(None).cast(MESSAGE_TYPE))
        .when(doc % 11 == 10, F.array().cast(MESSAGE_TYPE))
        .otherwise(msgs)
    )
    return table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as rows."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def pert_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background per perturbation, for suppliers in credit."""
    return (
        table(spark, sf_dir, "supplier")
        .where(F.col("s_acctbal") > 0)
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("pert"), F.col("s_name").alias("context"))
    )


def key_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background per sample key: how often it was used before."""
    context = F.concat(F.lit("used "), F.count(F.lit(1)).cast("string"), F.lit(" times")).alias("context")
    return group_packed(_cells(spark, sf_dir).where(F.col("l_quantity") > 45), SAMPLE_KEYS, context)


def with_gaps(df: DataFrame) -> DataFrame:
    """Keys with gaps: no perturbation where the gene ends in 3, no gene where it ends in 8 or 9."""
    tail = F.substring("gene", -1, 1)
    return df.withColumns(
        {"pert": F.when(tail != "3", F.col("pert")), "gene": F.when(~tail.isin("8", "9"), F.col("gene"))}
    )


# Column orders of the files in a tree of calls; Africa has no partner, America lacks a column.
TREE = {
    "de": {
        ("pert", "gene", "label", "split"): ("ASIA", "AFRICA"),
        ("split", "label", "note", "gene", "pert"): ("MIDDLE EAST",),
        ("gene", "label", "pert"): ("EUROPE",),
        ("pert", "label"): ("AMERICA",),
    },
    "dir": {("label", "gene", "pert"): ("ASIA", "MIDDLE EAST", "EUROPE", "AMERICA")},
}


WRITERS, WRITERS_CONF = 64, "spark.sql.maxConcurrentOutputFileWriters"


def write_cells(rows: DataFrame, parts: str, **options: object) -> None:
    """One CSV file for each cell line in a folder of its own.

    A task has the files of up to ``WRITERS`` cell lines open at once and writes rows as they come; else it would have to sort them.
    """
    conf = rows.sparkSession.conf
    before = conf.get(WRITERS_CONF)
    conf.set(WRITERS_CONF, WRITERS)
    try:
        rows.repartition("cell_type").write.partitionBy("cell_type").options(header=True, **options).csv(parts)
    finally:
        conf.set(WRITERS_CONF, before)


def csv_tree(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Write calls and directions as one CSV file per cell line, named after it."""
    tables = {"de": calls(spark, sf_dir).withColumn("note", F.lit('a, "b"')), "dir": directions(spark, sf_dir)}
    hadoop = spark._jvm.org.apache.hadoop.fs
    for kind, orders in TREE.items():
        for number, (columns, cells) in enumerate(orders.items()):
            parts = f"{folder}/parts/{kind}{number}"
            rows = tables[kind].where(F.col("cell_type").isin(*cells))
            write_cells(rows.select("cell_type", *columns), parts, escape='"')
            system = hadoop.Path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
            for cell in cells:
                found = system.globStatus(hadoop.Path(f"{parts}/cell_type={cell}/part-*.csv"))
                target = hadoop.Path(f"{folder}/{cell}-{kind}.csv")
                if len(found) > 1 or any(not system.rename(f.getPath(), target) for f in found):
                    raise OSError(f"{cell}-{kind}.csv is not one file")
    return folder


def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_type, value): calls as CSV lines; those of genes that end in 7 lack a field, in 8 have one too many."""
    tail = F.substring("gene", -1, 1)
    short, whole = F.concat_ws(",", F.coalesce("pert", F.lit("")), F.coalesce("gene", F.lit(""))), F.col("label").cast("string")
    value = F.when(tail == "7", short).when(tail == "8", F.concat_ws(",", short, whole, F.lit('"x, ""y"""'))).otherwise(F.concat_ws(",", short, whole))
    return calls(spark, sf_dir).where("label is not null").select("cell_type", value.alias("value"))


def ragged_tree(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """One file for each cell line with lines of ``ragged_lines`` under a header."""
    lines = ragged_lines(spark, sf_dir)
    plain = {"sep": "\x01", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # lines as they are
    write_cells(lines.select("cell_type", F.col("value").alias("pert,gene,label")), f"{folder}/parts", **plain)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in lines.select("cell_type").distinct().collect():
        found = system.globStatus(hadoop.Path(f"{folder}/parts/cell_type={row.cell_type}/part-*.csv"))
        target = hadoop.Path(f"{folder}/{row.cell_type}-de.csv")
        if len(found) != 1 or not system.rename(found[0].getPath(), target):
            raise OSError(f"{row.cell_type}-de.csv is not one file")
    return folder


def odd_name(gene: Column) -> Column:
    """Gene names with a quote, two kinds of quotes, or a backslash."""
    tail = F.substring(gene, -1, 1)
    return (
        F.when(tail == "1", F.concat(gene, F.lit("'x")))
        .when(tail == "2", F.concat(gene, F.lit("'\"x")))
        .when(tail == "3", F.concat(gene, F.lit("\\x\\")))
        .otherwise(gene)
    )


def list_replies(gold: DataFrame) -> DataFrame:
    """Replies to the gene-list question: right for one region, lists swapped for the others."""
    up, down = F.col("upregulated"), F.col("downregulated")
    right = F.col("cell_type") == "ASIA"
    text = F.when(right, list_solution(up, down)).otherwise(list_solution(down, up))
    return gold.select("pert", "cell_type", text.alias("generated_text"))
