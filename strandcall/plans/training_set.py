"""Entry 3: from accepted examples to training and validation text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.functions.prompts import sft_messages
from strandcall.functions.text import render_chat
from strandcall.operators.ordering import number_copies
from strandcall.operators.sampling import train_val_split
from strandcall.session import stage

# Share and seed of the training part.
TRAIN_SHARE = 0.9
SEED = 42

OCCURRENCE = "occurrence"
ROW = "_row"
BLOCK = 4096  # copies of a row that are written out together


def sft_text(examples: DataFrame, express_type: str = "dif", target: str = "cot") -> DataFrame:
    """Add ``text``: the rendered system, user and assistant turns."""
    return examples.withColumn("text", render_chat(sft_messages(express_type, target)))


def training_set(
    examples: DataFrame,
    keys: tuple[str, ...] = ("pert", "gene", "cell_type"),
    express_type: str = "dif",
    target: str = "cot",
) -> DataFrame:
    """``text`` and ``part`` of every example.

    Rows are split, not keys: examples that share the keys are numbered first. Numbering and
    split see keys and a hash of the row only; texts are shuffled once, by this hash,
    to meet the number of copies that go to either part. ``examples`` is read twice.
    The text is rendered in the last projection.
    """
    named = examples.withColumn(ROW, F.md5(F.to_json(F.struct(*examples.columns))))
    numbered = stage(number_copies(named.select(*keys, ROW), keys, OCCURRENCE), "examples")
    split = train_val_split(numbered, TRAIN_SHARE, SEED, [*keys, OCCURRENCE])
    copies = split.groupBy(ROW, "part").agg(F.count(F.lit(1)).alias("_n"))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(BLOCK).cast("bigint")))
    blocks = copies.select(ROW, "part", "_n", starts.alias("_from"))
    texts = named.dropDuplicates([ROW]).join(blocks, ROW)
    once = sft_text(texts, express_type, target).select(*keys, "text", "part", F.least(F.col("_n") - F.col("_from"), F.lit(BLOCK)).alias("_n"))
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).select(*keys, "text", "part")


def write_training_set(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").partitionBy("part").parquet(path)
