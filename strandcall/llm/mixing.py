"""Mixing sources to target weights by Pareto order sampling.

Each document gets an expected number of copies, larger for longer documents,
so that a source is expected to give its target. Whole copies are certain; the
fraction ``p`` that is left is the document's inclusion probability. Documents of a
source are ranked by random odds over inclusion odds, ``u / (1 - u) : p / (1 - p)``,
and the sample is the beginning of this order whose words come nearest to what
the fractions add up to: its size in words is fixed, not left to chance. The cut is
found from word counts of ``BUCKETS`` buckets of the order, so that only one bucket
of a source is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcall.llm.common import WHITE, row_key
from strandcall.session import stage

BUCKETS = 1 << 16
WIDE = 1 << 8  # buckets that are counted together first
SEED = "mix"
SOURCE = ["no_source", "source"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def importance(size: Column) -> Column:
    """4 plus the number of binary digits of the size: how copies are weighed within a source."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0) + 4


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """(doc_id, id_key, h, no_source, source, size, grade, u, draw) and ``more``: what the choice depends on, without texts.

    ``u`` in (0, 1) comes from md5 of id and text, so that reruns agree.
    """
    text = F.col(text_col).cast("string")
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary")), 1, 13)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        *[c.alias(k) for k, c in row_key(id_col, text_col).items()],
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        size_of(text).alias("size"),
        ((F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)).alias("u"),
        digits.alias("draw"),
        *more,
    )
    return rows.withColumn("grade", importance(F.col("size")))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Adds ``weight``: ``weights`` in turn over the sources by code point, the missing source last.

    ``sources`` has a row for each source.
    """
    place = (F.row_number().over(Window.orderBy(*SOURCE)) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int") + 1).cast("long"))


def targets(sources: DataFrame, budget: float, most: int) -> DataFrame:
    """Adds ``target``: shares of ``budget`` times all sizes by weight, none above ``most`` times its source.

    What is above is shared again by weight until none is above: sources stop in
    the order of limit over weight, and those behind share what is left.
    """
    order = Window.orderBy(F.col("limit") / F.col("weight"), *SOURCE)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = sources.withColumn("limit", F.col("source_size") * most).select(
        "*",
        (F.sum("source_size").over(whole) * budget).alias("budget"),
        F.coalesce(F.sum("limit").over(upto), F.lit(0)).alias("stopped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("sharing"),
    )
    level = (F.col("budget") - F.col("stopped")) / F.col("sharing")
    open_level = F.min(F.when(level * F.col("weight") <= F.col("limit"), F.struct(F.col("stopped").alias("s"), level.alias("level")))).over(whole)
    return ranked.withColumn("level", open_level["level"]).select(
        *sources.columns, F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")), F.col("limit").cast("double")).alias("target")
    )


def expected_copies(grades: DataFrame, most: int) -> DataFrame:
    """Adds ``copies``, expected copies of a document, to (source, grade, words, target) rows.

    Proportional to the grade and at most ``most``; higher grades reach the limit
    first. Grades of a source are few: one for each power of two.
    """
    by = Window.partitionBy(*SOURCE)
    before = by.orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = grades.select(
        "*",
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("full"),
        (F.sum(F.col("words") * F.col("grade")).over(by) - F.coalesce(F.sum(F.col("words") * F.col("grade")).over(before), F.lit(0))).alias("open"),
    )
    rate = F.when(F.col("open") > 0, (F.col("target") - F.col("full") * most) / F.col("open"))
    found = F.min(F.when(rate * F.col("grade") <= most, F.struct(F.col("full").alias("f"), (-F.col("grade")).alias("g"), rate.alias("rate")))).over(by)
    return ranked.withColumn("found", found["rate"]).select(
        *grades.columns,
        F.when(F.col("target") > 0, F.least(F.coalesce(F.col("found") * F.col("grade"), F.lit(float(most))), F.lit(float(most)))).otherwise(0.0).alias("copies"),
    )


def _crossing(ranges: DataFrame, at: str) -> DataFrame:
    """Of each source the first range at whose end ``rest`` words are reached, with the words ``before`` it.

    A source has at most ``WIDE`` ranges here; ``ahead`` words stand in front of all.
    """
    upto = Window.partitionBy(*SOURCE).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("before", F.col("ahead") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    reached = before.where(F.col("before") + F.col("words") >= F.col("rest"))
    return reached.groupBy(*SOURCE).agg(F.min(F.struct(at, "before", "rest")).alias("cut")).select(*SOURCE, "cut.*")


def _decided(rows: DataFrame, weights: DataFrame | None, budget: float, most: int) -> tuple[DataFrame, DataFrame]:
    """What the rows of ``sized`` take: expected copies of each grade of a source, and where its sample ends."""
    by_grade = stage(rows.groupBy(*SOURCE, "grade").agg(F.sum("size").alias("words")), "grades")
    sources = by_grade.groupBy(*SOURCE).agg(F.sum("words").alias("source_size"))
    if weights is None:
        weighed, rest = cyclic_weights(sources), None
    else:
        name = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
        given = weights.where(F.col("weight") > 0).select(F.col("source").isNull().alias("no_source"), name, F.col("weight").cast("long").alias("weight"))
        weighed, rest = sources.join(given, SOURCE), sources.join(given, SOURCE, "left_anti")
    wanted = targets(weighed, budget, most).drop("weight")
    if rest is not None:
        wanted = wanted.unionByName(rest.withColumn("target", F.lit(0.0)))
    grades = stage(expected_copies(by_grade.join(wanted, SOURCE), most).drop("words"), "copies")
    drawn = _drawn(rows, grades)
    counted = stage(drawn.groupBy(*SOURCE, "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.max("target").alias("target")), "order")
    wide = F.floor(F.col("bucket") / WIDE).alias("wide")
    by_wide = counted.groupBy(*SOURCE, wide).agg(F.sum("words").alias("words"), F.sum("sure").alias("sure"), F.max("target").alias("target"))
    rest = by_wide.withColumn("rest", F.col("target") - F.sum("sure").over(Window.partitionBy(*SOURCE))).where(F.col("wide").isNotNull())
    found = _crossing(rest.withColumn("ahead", F.lit(0)), "wide").withColumnRenamed("before", "ahead")
    fine = counted.withColumn("wide", F.floor(F.col("bucket") / WIDE)).join(found.select(*SOURCE, "wide", "ahead", "rest"), [*SOURCE, "wide"])
    cuts = _crossing(fine, "bucket").select(*SOURCE, F.struct("bucket", "before", "rest").alias("cut"))
    return grades, stage(cuts, "cuts")


def _drawn(rows: DataFrame, grades: DataFrame) -> DataFrame:
    """Adds what each row gets for sure, and its place in the order of its source."""
    part = F.col("copies") - F.floor("copies")
    odds = F.col("u") / (1 - F.col("u")) * ((1 - part) / part)
    drawn = rows.join(grades, [*SOURCE, "grade"])
    drawn = drawn.withColumn("whole", F.floor("copies").cast("long")).withColumn("order", F.when((part > 0) & (F.col("size") > 0), odds / (1 + odds)))
    return drawn.drop("copies").withColumn("bucket", F.floor(F.col("order") * BUCKETS).cast("int"))


def _taken(rows: DataFrame, grades: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``copies``. Rows meet small tables only; those of the bucket at a cut are sorted by source."""
    placed = _drawn(rows, grades).join(cuts, SOURCE, "left")
    at_cut = F.coalesce(F.col("bucket") == F.col("cut.bucket"), F.lit(False))
    below = F.coalesce(F.col("bucket") < F.coalesce("cut.bucket", F.lit(BUCKETS)), F.lit(False))
    inside = Window.partitionBy(*SOURCE).orderBy("order", "draw", "id_key", "h").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("cut.before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    parts = placed.where(~at_cut).withColumn("more", below).unionByName(
        placed.where(at_cut).withColumn("more", middle <= F.col("cut.rest"))
    )
    return parts.withColumn("copies", F.col("whole") + F.col("more").cast("long"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: DataFrame | None = None, budget: float = 1.5, most: int = 2,
) -> DataFrame:
    """(doc_id, id_key, h, source, size, source_size, target, copies long) of every row, copies 0 included.

    ``weights`` has (source, weight); sources without a weight above 0 get no copies, and without ``weights``
    3, 1, 2 repeat. A null source is a source. Texts without words have the size 0:
    they get their whole copies and are not drawn. Rows that repeat id and text draw
    alike and are cut like other ties, one by one. An empty table gives no rows.
    """
    rows = stage(sized(docs, id_col, text_col, source_col), "sizes")
    return _taken(rows, *_decided(rows, weights, budget, most)).select(
        "doc_id", "id_key", "h", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "copies"
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy",
    weights: DataFrame | None = None, budget: float = 1.5, most: int = 2,
) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it; ``copy_col`` numbers the copies of a row from 1.

    A column of that name in ``docs`` is replaced. The row itself goes through the mix, so rows that agree in id
    and text keep their other columns, and texts are not shuffled but at the cuts.
    """
    decided = _decided(stage(sized(docs, id_col, text_col, source_col), "sizes"), weights, budget, most)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != copy_col.lower()]).alias("row")
    taken = _taken(sized(docs, id_col, text_col, source_col, whole), *decided).where(F.col("copies") > 0)
    return taken.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy_col))
