"""Removal of passages that repeat, by sliding spans of sentences.

A run is several consecutive sentences; runs slide by one sentence, and all of them count. Sentences
under a run that stood somewhere before, in the order of (id, text hash, place), are removed whole.

A sentence ends at its punctuation. As a passage may begin or end inside one, a second rule cuts
sentences into parts, which count as sentences: two neighbouring words part where the hash of the pair is the least of
some ``PART`` consecutive ones. Inside a passage both rules see the passage alone, but for ``PART`` words at either end. So
every passage of ``least_words + 2 * PART`` words is found wherever it stands, and at most ``PART`` words stay at
either end of it. For each sentence there is the shortest run of enough sentences and words that
begins with it, and the one that ends with it, so that these cover all longer ones.

Not every run has to be shuffled. The smallest hash of ``SEED`` consecutive words in a run is
its seed; runs of equal words have equal seeds, and about one word in eight begins one. Seeds
are joined globally first, and only runs whose seed stands in another place too are hashed
(128 bits) and joined. This leaves out no run that repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandcall.llm.common import modest_batches, packed, row_key, ship, small_batches, text_hash
from strandcall.session import stage

WORD = re.compile(r"\S+")
PART = 8
SEED = 6
LAST = np.uint64(2**64 - 1)
ENDS = frozenset(".!?:;\u2026\u3002\uff01\uff1f\u0964\u061f")
CLOSERS = "\"')]}\u00bb\u201c\u201d\u2019"
BUCKETS = 1 << 16
HOT = 8
SALTS = 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32))
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Digests(dict):
    """128-bit hashes of words, whose last bit of the second half tells whether a sentence ends."""

    def __missing__(self, word: str) -> bytes:
        digest = bytearray(xxhash.xxh3_128_digest(word.encode("utf-8", "replace")))
        digest[8] = digest[8] & 0xFE | (word.rstrip(CLOSERS)[-1:] in ENDS)
        found = self[word] = bytes(digest)
        return found

    def powers(self, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` powers of a lane's base and of its inverse; those of the longest text yet are kept."""
        held = self.__dict__.setdefault("held", {})
        if lane not in held or len(held[lane][0]) < n:
            held[lane] = [np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (BASES[lane], pow(BASES[lane], -1, 1 << 64))]
        return tuple(x[:n] for x in held[lane])


def word_hashes(text: str, known: Digests) -> np.ndarray:
    """Two 64-bit hashes of each word in lower case."""
    return np.frombuffer(b"".join(map(known.__getitem__, text.lower().split())), np.uint64).reshape(-1, 2)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    found = (a * MIX[0]) ^ b
    found ^= found >> MIX[2]
    found *= MIX[1]
    return found ^ (found >> MIX[2])


def sliding(values: np.ndarray, width: int, which: np.ufunc) -> np.ndarray:
    """The least or largest of every ``width`` consecutive values, of which there are so many at least."""
    step = 1
    while 2 * step <= width:
        values = which(values[:-step], values[step:])
        step *= 2
    more = width - step
    return which(values[: len(values) - more], values[more:]) if more else values


def least_of_some(values: np.ndarray, width: int) -> np.ndarray:
    """Which values are the least of some ``width`` consecutive ones; equal ones all are."""
    if len(values) < width:
        return np.zeros(len(values), bool)
    beside = np.zeros(width - 1, np.uint64)
    return values == sliding(np.concatenate([beside, sliding(values, width, np.minimum), beside]), width, np.maximum)


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the wanted ones, of which there is one at least."""
    wanted = np.sort(wanted)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def sentences(hashes: np.ndarray) -> np.ndarray:
    """The numbers of the words that begin a sentence, and the number of words."""
    ends = (hashes[:-1, 1] & np.uint64(1)).astype(bool)
    ends |= least_of_some(_mixed(hashes[:-1, 0], hashes[1:, 0]), PART)
    return np.concatenate([[0], np.flatnonzero(ends) + 1, [len(hashes)]])


class Spans:
    """Hashes of any runs of words of one text, from sums of its words' hashes at the powers of a base, modulo 2 ** 64."""

    def __init__(self, hashes: np.ndarray, known: Digests) -> None:
        self.hashes, self.known, self.sums = hashes, known, {}

    def _sums(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        powers, back = self.known.powers(lane, len(self.hashes) + 1)
        if lane not in self.sums:
            self.sums[lane] = np.zeros(len(self.hashes) + 1, np.uint64)
            np.cumsum(self.hashes[:, lane] * powers[:-1], out=self.sums[lane][1:])
        return self.sums[lane], back

    def lane(self, lane: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, back = self._sums(lane)
        return _mixed((sums[end] - sums[first]) * back[first], (end - first).astype(np.uint64))

    def every(self, lane: int, width: int) -> np.ndarray:
        """``lane`` of all runs of ``width`` words."""
        sums, back = self._sums(lane)
        return _mixed((sums[width:] - sums[:-width]) * back[:-width], np.uint64(width))


def runs(bounds: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence of every run, and the one behind its last.

    From each sentence the shortest run onwards, and to each the shortest run before it.
    """
    few, at = max(least_sentences, 1), np.arange(len(bounds))
    until = np.maximum(np.searchsorted(bounds, bounds + least_words), at + few)
    since = np.minimum(np.searchsorted(bounds, bounds - least_words, "right") - 1, at - few)
    ahead, behind = until < len(bounds), since >= 0
    pairs = np.sort(np.concatenate([at[ahead] * len(bounds) + until[ahead], since[behind] * len(bounds) + at[behind]]))
    return np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], len(bounds))


def sentence_runs(text: str, known: Digests, least_sentences: int, least_words: int) -> tuple | None:
    """(spans, begins, ends, near, seed) of a text with runs: the words that limit them, hashes of ``SEED`` words, seeds."""
    hashes, least_words = word_hashes(text, known), max(least_words, 1)
    if len(hashes) < least_words:
        return None
    bounds = sentences(hashes)
    first, end = runs(bounds, least_sentences, least_words)
    if not len(first):
        return None
    spans, begins, ends, few = Spans(hashes, known), bounds[first], bounds[end], min(SEED, least_words)
    near = np.append(spans.every(0, few), LAST)
    return spans, begins, ends, near[:-1], np.minimum.reduceat(near, np.stack([begins, ends - few + 1], axis=1).ravel())[::2]


def text_seeds(docs: DataFrame, id_col: str, text_col: str, least_sentences: int, least_words: int) -> DataFrame:
    """(seed, places, id_key, h): the distinct seeds of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            known, where, found, places = Digests(), [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                parts = sentence_runs(text or "", known, least_sentences, least_words)
                if parts:
                    values, near = np.unique(parts[4]), np.sort(parts[3])
                    found.append(values)
                    places.append(np.searchsorted(near, values, "right") - np.searchsorted(near, values))
                    where.append(np.full(len(values), k))
            if found:
                columns = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))]
                rows = batch.select([0, 1]).take(pa.array(np.concatenate(where)))
                yield pa.RecordBatch.from_arrays([*columns, *rows.columns], ["seed", "places", "id_key", "h"])

    texts = docs.select(*[c.alias(k) for k, c in row_key(id_col, text_col).items()], F.col(text_col).cast("string").alias("text"))
    return modest_batches(texts).mapInArrow(run, "seed long, places int, id_key string, h long")


def spans(docs: DataFrame, id_col: str, text_col: str, least_sentences: int, least_words: int) -> DataFrame:
    """(hi, lo, doc_id, h, first, words, again): every run whose seed stands in two places; ``again`` if rows repeat its id and text."""
    found = stage(text_seeds(docs, id_col, text_col, least_sentences, least_words), "seeds")
    key = F.xxhash64("id_key", "h")
    places = found.groupBy("seed").agg(F.min(key).alias("a"), F.max(key).alias("b"), F.max("places").alias("places"))
    repeated = stage(places.where((F.col("a") != F.col("b")) | (F.col("places") > 1)).select("seed"), "repeated-seeds")
    by_doc = found.join(repeated, "seed").groupBy("id_key", "h").agg(F.collect_set("seed").alias("seeds"), F.count(F.lit(1)).alias("n"))
    by_doc = stage(by_doc.select("id_key", "h", "seeds", (F.col("n") > F.size("seeds")).alias("again")), "seeds-by-text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 32):
            known, where, hi, lo, firsts, words = Digests(), [], [], [], [], []
            for k, text in enumerate(batch.column(3).to_pylist()):
                whole, begins, ends, _, seed = sentence_runs(text, known, least_sentences, least_words)
                at = np.flatnonzero(among(seed, np.asarray(batch.column(4)[k].values).view(np.uint64)))
                begins, ends = begins[at], ends[at]
                hi.append(whole.lane(0, begins, ends).view(np.int64))
                lo.append(whole.lane(1, begins, ends).view(np.int64))
                where.append(np.full(len(at), k))
                firsts.append(begins.astype(np.int32))
                words.append((ends - begins).astype(np.int32))
            if where:
                rows = batch.select([0, 1, 2]).take(pa.array(np.concatenate(where)))
                places = [pa.array(np.concatenate(c)) for c in (firsts, words)]
                columns = [*(pa.array(np.concatenate(c)) for c in (hi, lo)), *rows.columns[:2], *places, rows.column(2)]
                yield pa.RecordBatch.from_arrays(columns, ["hi", "lo", "doc_id", "h", "first", "words", "again"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(k) for k, c in row_key(id_col, text_col).items()])
    texts = modest_batches(texts).join(by_doc, ["id_key", "h"]).select("doc_id", "h", "again", "text", "seeds")
    return texts.mapInArrow(run, f"hi long, lo long, doc_id {kind}, h long, first int, words int, again boolean")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = 2, least_words: int = 20
) -> DataFrame:
    """(id_key, h, first, words) of all runs that are not the first of their kind.

    One shuffle deals runs out by hash. Hashes are counted in ``BUCKETS`` buckets
    before; in buckets far above the mean the runs of a hash are first dealt
    over ``SALTS`` tasks, and only the first of each goes on to be compared with the
    other firsts. Rows that repeat id and text are one document. Null ids come last.
    """
    found = stage(spans(docs, id_col, text_col, least_sentences, least_words), "spans")
    found = found.where(~F.col("again")).unionByName(found.where("again").distinct())
    found = found.withColumn("bucket", F.pmod("hi", F.lit(BUCKETS)).cast("int"))
    counts = stage(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "span-counts")
    mean = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > HOT * max(mean / BUCKETS, 100)).select("bucket", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS))).otherwise(0).alias("salt")
    dealt = found.join(F.broadcast(hot), "bucket", "left").select("hi", "lo", salt, "hot", "doc_id", "h", "first", "words")  # hot: BUCKETS rows at most
    place = [F.col("doc_id").asc_nulls_last(), "h", "first"]
    ranked = dealt.withColumn("rank", F.rank().over(Window.partitionBy("hi", "lo", "salt").orderBy(*place)))
    ranked = ranked.where((F.col("rank") > 1) | F.col("hot"))
    hashes = {k: F.when(F.col("hot"), F.col(k)) for k in ("hi", "lo")}  # only hot runs are compared again
    ranked = stage(ranked.withColumns(hashes), "ranked-spans")
    firsts = ranked.where(F.col("rank") == 1).withColumn("rank", F.rank().over(Window.partitionBy("hi", "lo").orderBy(*place)))
    later = ranked.unionByName(firsts).where(F.col("rank") > 1)
    return later.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), "h", "first", "words")


def under(first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of the words under any of these runs."""
    turns = np.zeros(int(max(np.add(first, words))) + 1, np.int64)
    np.add.at(turns, first, 1)
    np.add.at(turns, np.add(first, words), -1)
    return np.flatnonzero(np.cumsum(turns) > 0)


def without(text: str, covered: list[int] | np.ndarray) -> str:
    """The text without the words of these numbers and the white space after them."""
    starts = [p.start() for p in WORD.finditer(text)]
    gone = np.zeros(len(starts), bool)
    gone[covered] = True
    turns = np.flatnonzero(np.diff(gone)) + 1
    limits = [*(starts[k] for k in [0, *turns.tolist()]), len(text)]
    left = "".join(text[limits[k] : limits[k + 1]] for k in range(int(gone[0]), len(limits) - 1, 2))
    return text[: starts[0]] + (left.rstrip() if gone[-1] else left)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = 2, least_words: int = 20
) -> DataFrame:
    """(row, n_removed long, left string): each row of ``docs`` as a struct, and its text without repeated sentences.

    ``n_removed`` counts words. Rows that repeat id and text, null ids included, are one document: all of them
    keep what stands first there. Texts that are null, empty or shorter than a run are left as they are.
    ``left`` is the text itself where nothing repeats (null stays null) and may
    become empty; no row is dropped.
    """
    found = repeated_spans(docs, id_col, text_col, least_sentences, least_words)
    by_doc = stage(found.groupBy("id_key", "h").agg(F.collect_set(F.struct("first", "words")).alias("found")), "repeats-by-text")
    text = F.col(f"row.{text_col}").cast("string")

    @F.pandas_udf("n long, left string")
    def cut(texts: pd.Series, firsts: pd.Series, words: pd.Series) -> pd.DataFrame:
        rows = []
        for t, first, size in zip(texts, firsts, words):
            covered = under(first, size) if len(first) else []
            rows.append((len(covered), t if t is None or not len(covered) else without(t, covered)))
        return pd.DataFrame(rows, columns=["n", "left"])

    rows = modest_batches(packed(docs, **row_key(id_col, text_col))).join(by_doc, ["id_key", "h"], "left")
    places = [F.coalesce(F.col("found")[c], F.array().cast("array<int>")) for c in ("first", "words")]
    changed = cut(F.when(F.col("found").isNotNull(), text), *places)
    rows = rows.withColumn("cut", changed)
    return rows.select("row", F.col("cut.n").alias("n_removed"), F.coalesce("cut.left", text).alias("left"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; ``n_chars``, if there, is counted anew."""
    new = {text_col: F.col("left"), "n_chars": F.char_length("left").cast("long")}
    found = remove_repeats(docs, id_col, text_col, **how)
    columns = [new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns)


ship(__name__)
