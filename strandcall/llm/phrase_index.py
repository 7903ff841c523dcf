"""Benchmark decontamination with a distributed positional inverted index.

Every item has windows of ``window`` consecutive words (one window if it is
shorter). Word frequencies over the whole corpus, in ``BUCKETS`` hash buckets,
tell which two words of each window are rarest. The postings (word, document,
position) of these words are stored in the shared folder; the lists of an
item's words, each moved back by the word's place in the item, are intersected
per document, and what is left is compared place by place. All of it is DataFrame
code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcall.llm.common import ASCII_GAP, LOWER, UPPER, row_key
from strandcall.session import stage

BUCKETS = 1 << 16
SMALL_TERMS = 100_000  # so many words are sent to all executors at most; more are shuffled
GAPS = f"[{ASCII_GAP}]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """Words in order, as written; at the end may stand one empty string."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{GAPS}", ""), GAPS)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{ASCII_GAP}]+")), F.lit(0)).cast("long")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, place, word, n): an item is a distinct (id, text), null ids are empty strings."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).alias("text")).distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.posexplode(raw_words(F.col("text"))).alias("place", "word"))
    rows = rows.where(F.col("word") != "").withColumn("word", lowered(F.col("word")))
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item")))


def rarest(words: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, n, place, word): the two rarest words of every window of every item."""
    ranked = words.withColumn("bucket", _bucket(F.col("word"))).join(counts, "bucket", "left")
    size = F.least(F.col("n"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - size + 1), F.least(F.col("place"), F.col("n") - size))
    in_windows = ranked.withColumn("start", F.explode(starts))
    by_window = Window.partitionBy("item", "start").orderBy(F.coalesce("count", F.lit(0)), "place")
    return in_windows.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= 2).select("item", "n", "place", "word").distinct()


class PhraseIndex:
    """The postings that the items need, and searches in them.

    Documents are named by ``id_key`` and ``h`` (id and text); rows that repeat both
    are one document here.
    """

    def __init__(
        self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        item_id: str = "item_id", item_text: str = "text", window: int = 13,
    ):
        self.window = window
        self.docs = docs.select(*[c.alias(k) for k, c in row_key(id_col, text_col).items()], F.col(text_col).alias("text"))
        words = self.docs.select(F.explode(raw_words(F.col("text"))).alias("word")).where(F.col("word") != "")
        counts = stage(words.groupBy(_bucket(lowered(F.col("word"))).alias("bucket")).count(), "word-counts")
        self.words = stage(item_words(items, item_id, item_text), "item-words")
        self.anchors = stage(rarest(self.words, counts, window), "anchors")
        terms = self.anchors.select("word").distinct()
        if terms.count() <= SMALL_TERMS:
            terms = F.broadcast(terms)
        spread = self.docs.select("id_key", "h", F.posexplode(raw_words(F.col("text"))).alias("at", "raw"))
        postings = spread.select("id_key", "h", "at", lowered(F.col("raw")).alias("word")).join(terms, "word")
        self.postings = stage(postings.distinct(), "postings")

    def candidates(self) -> DataFrame:
        """(id_key, h, item, n, offset): where two rare words of an item, or its only one, stand as far apart as in the item."""
        return (
            self.postings.join(self.anchors, "word")
            .groupBy("id_key", "h", "item", "n", (F.col("at") - F.col("place")).alias("offset"))
            .agg(F.count(F.lit(1)).alias("met"))
            .where(F.col("met") >= F.least(F.lit(2), F.col("n")))
            .drop("met")
        )

    def exact(self) -> DataFrame:
        """(id_key, h, item_id, start, size): the stretches that occurrences of an item's windows cover, at each offset.

        Every place of a candidate is compared by itself, as a row, so that the work is in proportion to
        the candidates' words: a text is never held beside each of its candidates. Places that agree
        make runs, and a run as long as a window is covered by windows.
        """
        found = stage(self.candidates(), "candidates")
        texts = self.docs.join(found.select("id_key", "h").distinct(), ["id_key", "h"], "left_semi").distinct()
        spread = texts.select("id_key", "h", F.posexplode(raw_words(F.col("text"))).alias("at", "raw"))
        spread = spread.select("id_key", "h", "at", lowered(F.col("raw")).alias("word"))
        phrases = self.words.select("item", "item_id", "place", "word")
        asked = found.join(phrases, "item").withColumn("at", F.col("offset") + F.col("place")).where(F.col("at") >= 0)
        alike = asked.join(spread, ["id_key", "h", "at", "word"], "left_semi")
        one = ["id_key", "h", "item", "item_id", "offset", "n"]
        run = F.col("place") - F.row_number().over(Window.partitionBy(*one).orderBy("place"))
        runs = alike.withColumn("run", run).groupBy(*one, "run").agg(F.min("at").alias("start"), F.count(F.lit(1)).cast("int").alias("size"))
        return runs.where(F.col("size") >= F.least(F.col("n"), F.lit(self.window))).select("id_key", "h", "item_id", "start", "size")

    def near(self, terms: int, span: int) -> DataFrame:
        """(id_key, h, item_id, start, terms): places from which ``span`` words hold so many different rare words of an item, in any order."""
        pairs = self.postings.join(self.anchors.select("item", "word").distinct(), "word")
        ahead = Window.partitionBy("id_key", "h", "item").orderBy("at").rangeBetween(0, span - 1)
        met = pairs.withColumn("terms", F.size(F.collect_set("word").over(ahead))).where(F.col("terms") >= terms)
        names = self.words.select("item", "item_id").distinct()
        return met.join(names, "item").select("id_key", "h", "item_id", F.col("at").alias("start"), "terms")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = 13, part: int = 20,
) -> DataFrame:
    """(row, n_words, n_hit, n_items, item_ids, contaminated): each row of ``docs`` as a struct.

    ``n_hit`` words lie in an occurrence of a window; a document is contaminated if
    these are at least one in ``part``. Null and empty texts have no words, and
    items without words no window. ``item_ids`` are sorted as strings.
    """
    hits = stage(PhraseIndex(docs, items, id_col, text_col, item_id, item_text, window).exact(), "hits")
    covered = hits.select("id_key", "h", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at"))
    words = covered.distinct().groupBy("id_key", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = hits.groupBy("id_key", "h").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = stage(words.join(ids, ["id_key", "h"]), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in row_key(id_col, text_col).items()], word_count(F.col(text_col)).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, ["id_key", "h"], "left").select(
        "row", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * part >= F.col("n_words"))).alias("contaminated"),
    )
