"""URL filters: a blocked Bloom filter before an exact hash join.

Rules (host, path) fit a host with its subdomains and every path that begins with
theirs; listed URLs fit exactly. A URL's candidates, each suffix of its host and beginning
of its path with as many labels and characters as some rule's, are looked up in a Bloom filter whose bits
for one key all lie in one block of ``WORDS`` words. The filter has ``KEY_BITS`` to twice as many
bits for each key, so that its rate of false positives, below 1 %, doesn't rise with the list. It is
staged: Spark sends it to all executors if it is small, else both sides meet by block. What
passes is joined exactly, which takes false positives away. All of it is DataFrame code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcall.llm.common import LOWER, UPPER
from strandcall.session import stage

WORDS = 8
KEY_BITS = 16
PROBES = 6
SALT = "bloom"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: then to ``?``, ``#`` or the end.

    Both are empty for null or without ``://``.
    """
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    found = [F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2)]
    return F.translate(found[0], UPPER, LOWER), found[1]


def blocks_for(n: int) -> int:
    """Blocks of a filter for ``n`` keys: a power of two."""
    return 1 << max(n * KEY_BITS // (64 * WORDS), 1).bit_length()


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _probes(key: Column) -> list[tuple[Column, Column]]:
    """(word, bit) of every probe: nine bits of a second hash each."""
    bits = F.xxhash64(key, F.lit(SALT))
    found = []
    for k in range(PROBES):
        at = F.shiftrightunsigned(bits, 9 * k).bitwiseAND(F.lit(511))
        found.append((F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")))
    return found


def build_filter(keys: DataFrame, blocks: int, key_col: str = "key") -> DataFrame:
    """(block, w0 .. w7): those of the blocks that have bits."""
    masks = [(word, F.expr("shiftleft(1L, bit)")) for word in range(WORDS)]
    probes = keys.select(_block(F.col(key_col), blocks).alias("block"), F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _probes(F.col(key_col))])).alias("p"))
    probes = probes.select("block", "p.word", "p.bit")
    return probes.groupBy("block").agg(*[F.bit_or(F.when(F.col("word") == w, m).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w, m in masks])


def possible(keys: DataFrame, bloom: DataFrame, blocks: int, key_col: str = "key") -> DataFrame:
    """Rows whose key may be in the filter; none that is in it is lost."""
    rows = keys.withColumn("_block", _block(F.col(key_col), blocks)).join(bloom, F.col("_block") == F.col("block"))
    words = F.array(*[F.col(f"w{k}") for k in range(WORDS)])
    hits = [F.getbit(F.get(words, w), b) == 1 for w, b in _probes(F.col(key_col))]
    return rows.where(reduce(Column.__and__, hits)).select(*keys.columns)


def _labels(host: str) -> Column:
    return F.char_length(host) - F.char_length(F.replace(F.col(host), F.lit("."))) + 1


def candidates(urls: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """(host, path, key) of distinct urls: ``r`` keys for rules with so many (labels, characters), one ``u`` key for the list."""
    fitting = [
        F.when((_labels("host") >= k) & (F.char_length("path") >= n), F.concat(F.lit("r"), F.substring_index("host", ".", -k), F.substring("path", 1, n)))
        for k, n in sizes
    ]
    rules = F.array_compact(F.array(*fitting)) if sizes else F.array().cast("array<string>")
    listed = F.array(F.concat(F.lit("u"), "host", "path"))
    return urls.select("host", "path", F.explode(F.array_distinct(F.concat(rules, listed))).alias("key"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(row, host, path, rule, listed boolean, verdict): each row of ``pages`` as a struct.

    ``rules`` has (host, path, verdict), ``listed`` (host, path). The longest rule that
    fits gives the verdict, of equally long ones that with the longer host, then
    ``block``; without a rule a listed URL is blocked, any other gets
    ``otherwise``. Hosts and paths are those of ``host_and_path``; distinct ones are
    judged once, so that a frequent URL costs one row.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    named = rules.select(F.concat(F.lit("r"), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), F.char_length("host").alias("host_length"), F.col("verdict").alias("ruled"))
    exact = named.unionByName(
        listed.select(F.concat(F.lit("u"), "host", "path").alias("key")).distinct(), allowMissingColumns=True
    )
    exact = stage(exact, "exact-keys")
    sizes = sorted(tuple(r) for r in rules.select(_labels("host"), F.char_length("path")).distinct().collect())  # sizes of rules, not rules
    asked = candidates(rows.select("host", "path").distinct(), sizes)
    blocks = blocks_for(exact.count())
    hits = possible(asked, stage(build_filter(exact.select("key"), blocks), "bloom"), blocks).join(exact, "key")
    rank = F.when(F.col("rule").isNotNull(), F.struct(F.char_length("rule").alias("size"), "host_length", (F.col("ruled") == "block").alias("blocks"), "rule", "ruled"))
    judged = hits.groupBy("host", "path").agg(F.max(rank).alias("best"), F.max(F.col("rule").isNull()).alias("listed"))
    is_listed = F.coalesce("listed", F.lit(False))
    return rows.join(judged, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"), is_listed.alias("listed"),
        F.coalesce(F.col("best.ruled"), F.when(is_listed, "block").otherwise(otherwise)).alias("verdict"),
    )
