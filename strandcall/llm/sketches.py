"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so its
size follows the text and sketches of very unequal texts compare: what both keep
is a fair sample of what both have. Sketches merge by union: the union is the sketch of both
sets of shingles, whatever their sizes. A short text may be left without a hash; its least
hash, kept beside the sketch, tells it from others then. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from strandcall.llm.common import text_hash
from strandcall.session import stage

SCALE = 2  # one hash in so many is kept
BLANK = " \t\n\x0b\f\r"
PARTS = 8  # for each shuffle partition: tasks get several small parts, and so about as much
NULL_BITS = 8  # rows without an id are dealt out by so many bits of their text's hash


def with_sketch(df: DataFrame, text: str, out: str, words: int = 5, scale: int = SCALE) -> DataFrame:
    """Adds ``out``, the sorted sketch of a text column (array of long), and ``{out}_least``, its least hash at any size.

    A text without words has an empty sketch and no least hash.

    A shingle is ``words`` consecutive words as written; a text of fewer is one
    shingle. Steps are columns of their own, used several times each, so that
    Spark doesn't put one step into another's lambda and repeat it.
    """
    split, hashes, shingles = (f"_{out}_{k}" for k in ("split", "hashes", "shingles"))
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANK))
    least = -(1 << 63) + (1 << 64) // scale
    h, n = F.col(hashes), F.size(hashes)
    several = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
    one = F.array(F.xxhash64(h))
    kept = F.sort_array(F.array_distinct(F.filter(shingles, lambda x: x < least)))  # array_sort makes objects at each comparison
    return (
        df.withColumn(split, F.when(trimmed != "", F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
        .withColumn(hashes, F.transform(split, lambda w: F.xxhash64(w)))
        .withColumn(shingles, F.when(n >= words, several).when(n > 0, one))
        .withColumn(out, F.coalesce(kept, F.array().cast("array<long>")))
        .withColumn(f"{out}_least", F.array_min(shingles))
        .drop(split, hashes, shingles)
    )


def likeness(a: str, b: str) -> Column:
    """Estimated resemblance of two sketches, columns of ``with_sketch``. If both are empty it is 1 or 0, as their least hashes agree."""
    union, same = F.size(F.array_union(a, b)), F.col(f"{a}_least").eqNullSafe(F.col(f"{b}_least"))
    return F.when(union == 0, same.cast("double")).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of ``a`` that is in ``b``; null if the sketch ``a`` is empty, as nothing is known of it."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of the shingles of both texts."""
    return F.sort_array(F.array_union(a, b))


def as_text(sketch: str) -> Column:
    """The least hash, a hyphen and all hashes of a sketch, in hexadecimal; empty for a text without words."""
    return F.lower(F.concat_ws("-", F.hex(f"{sketch}_least"), F.array_join(F.transform(sketch, F.hex), "")))


def _placed(docs: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``: consecutive ranges of the order by descending id, null ids last by the hash of their text.

    Ranges come from quantiles of the ids, so that they are even; only their
    limits, ``parts`` numbers, reach the driver.
    """
    shares = [k / parts for k in range(1, parts)]
    limits = docs.agg(F.percentile_approx("doc_id", shares)).first()[0] if shares else None
    limits = F.array(*map(F.lit, sorted(set(limits or [])))).cast("array<long>")
    above = F.size(F.filter(limits, lambda x: x <= F.col("doc_id")))
    without = F.shiftright("h", 64 - NULL_BITS) + (1 << (NULL_BITS - 1))
    return docs.withColumn("part", F.when(F.col("doc_id").isNull(), without + parts).otherwise(parts - 1 - above).cast("int"))


def in_circle(docs: DataFrame, parts: int) -> tuple[DataFrame, WindowSpec]:
    """Rows in parts of the order by descending id, and the window that gives the row behind.

    Behind the last row comes the first: the first row of each part is also put, as
    ``closing``, at the end of the part before. These rows, one for each part, are
    found without their texts. So texts are shuffled once, by part.
    """
    rows = _placed(docs, parts)
    heads = rows.groupBy("part").agg(F.min(F.struct((-F.col("doc_id")).alias("down"), "h")).alias("head"))
    whole = Window.partitionBy()  # a row for each part
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(whole))
    heads = stage(heads.select(F.col("part").alias("of"), (-F.col("head.down")).alias("head_id"), F.col("head.h").alias("head_h"), before.alias("before")), "heads")
    found = rows.join(
        F.broadcast(heads),  # as many rows as parts
        (rows["part"] == heads["of"]) & rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["h"] == heads["head_h"]),
    )
    closing = found.select(*[F.col("before").alias("part") if c == "part" else F.col(c) for c in rows.columns], F.lit(True).alias("closing"))
    both = rows.withColumn("closing", F.lit(False)).unionByName(closing)
    order = Window.partitionBy("part").orderBy("closing", F.col("doc_id").desc_nulls_last(), "h")
    return both, order


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, scale: int = SCALE) -> DataFrame:
    """(doc_id, text, sketch, edited, edited_sketch, next_sketch) of every row, and the least hash beside each sketch.

    ``edited`` has the last third of the code points replaced by as many from the beginning
    of the next text, in descending order of the ids (numbers; a text that is none counts as
    null; nulls last, ties by the hash of the text). Null texts count as empty. A single row is its own next.
    """
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", text_hash(F.col("text")))
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both, order = in_circle(rows, parts)
    both = with_sketch(both.repartition("part"), "text", "sketch", words, scale)  # behind the shuffle, which moves texts only
    for name, behind in (("text", "next_text"), ("sketch", "next_sketch"), ("sketch_least", "next_sketch_least")):
        both = both.withColumn(behind, F.lead(name).over(order))
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - third), F.substring("next_text", F.lit(1), third))
    found = with_sketch(both.where(~F.col("closing")).withColumn("edited", edited), "edited", "edited_sketch", words, scale)
    sketches = [c for out in ("sketch", "edited_sketch", "next_sketch") for c in (out, f"{out}_least")]
    return found.select("doc_id", "text", "edited", *sketches)
