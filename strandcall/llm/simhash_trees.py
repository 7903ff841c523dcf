"""SimHash near-duplicates through vantage-point trees.

A fingerprint has 64 bits. If two of them differ in at most ``r`` bits, then in
the low or in the high 32 bits they differ in at most ``r // 2``. So there are
two trees, one for each half. A level of a tree looks at one block of four bits
and partitions fingerprints by the Hamming distance of that block to a vantage
point. Distances of two blocks to the same point can't differ by more than the
blocks do (triangle bound), and the blocks share the radius: a search goes to a
shell ``s`` steps away only with ``s`` less to spend. Paths through all eight
levels name the shards. Every fingerprint lives in one shard of each tree, and
visits those shards that its ball overlaps; of two fingerprints only the one
whose path must go down in the first place visits the other, so that a pair
meets in one shard of a tree. Levels, blocks and points are the same at
every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcall.llm.common import as_bytes, modest_batches, packed, row_key, ship, small_batches
from strandcall.llm.components import components
from strandcall.session import stage

SEED = 42
BLOCK = 4
LEVELS = 8
DIGIT = 3  # bits of a path for one level: distances 0 to 4
POINTS = (0x5A93C6F01E7842BD, 0)  # vantage points: half and block cut out what a level compares with
SHARD_ROWS = 4096
SLICE = 1 << 18
PAIRS = 1 << 20


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), SLICE):
        part = np.ascontiguousarray(hashes[start : start + SLICE]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of all word shingles of a text, repeats included."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    size = min(words, len(found))
    shingles = map(b" ".join, zip(*[found[k:] for k in range(size)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(found) - size + 1)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64 bits: those set in over half the shingle hashes. A text without words has none set."""
    hashes = shingle_hashes(text, words)
    bits = (2 * _ones(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, id_key, h, fp long) of every row. A null text counts as empty, a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t, words) for t in as_bytes(batch.column(3))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(fps.view(np.int64))], ["doc_id", "id_key", "h", "fp"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    columns = [c.alias(k) for k, c in row_key(id_col, text_col).items()]
    texts = docs.select(F.col(id_col).alias("doc_id"), *columns, F.col(text_col).cast("string").alias("text"))
    return modest_batches(texts).mapInArrow(run, f"doc_id {kind}, id_key string, h long, fp long")


def _shifts(radius: int) -> list[tuple[int, ...]]:
    """Moves of at most ``radius`` steps over the levels, the first of them downward."""
    found: list[tuple[int, ...]] = [()]
    for _ in range(LEVELS):
        found = [
            (*s, k)
            for s, k in product(found, range(-radius, radius + 1))
            if sum(map(abs, s)) + abs(k) <= radius and not (k > 0 and not any(s))
        ]
    return [s for s in found if any(s)]


def _paths(fp: Column, tree: int, radius: int) -> Column:
    """The home shard and the visited shards of a fingerprint in one tree; null where there is no such shell."""
    levels = []
    for k in range(LEVELS):
        at = tree * 32 + k * BLOCK
        mask = ((1 << BLOCK) - 1) << at
        mask, point = (m - (1 << 64) if m >> 63 else m for m in (mask, POINTS[0] & mask))
        levels.append(F.bit_count(fp.bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(point))).cast("long"))
    home = sum((d * (1 << (DIGIT * k)) for k, d in enumerate(levels)), F.lit(tree << (DIGIT * LEVELS)).cast("long"))
    found = [F.struct(home.alias("shard"), F.lit(True).alias("home"))]
    for s in _shifts(radius):
        fits = F.lit(True)
        for d, k in zip(levels, s):
            fits = fits & (d + k).between(0, BLOCK) if k else fits
        moved = home + F.lit(sum(k * (1 << (DIGIT * j)) for j, k in enumerate(s)))
        found.append(F.when(fits, F.struct(moved.alias("shard"), F.lit(False).alias("home"))))
    return F.array(*found)


def _group_links(fps: np.ndarray, home: np.ndarray, starts: np.ndarray, stops: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected in each group of rows; fewer than rows.

    In a group, rows that live there come first. Each of them is compared with all
    rows after it, ``PAIRS`` comparisons at a time, and a link is kept if it joins
    two parts that no earlier link has joined.
    """
    first, stop = np.repeat(starts, stops - starts), np.repeat(stops, stops - starts)
    rows = np.flatnonzero(home)
    partners = stop[rows] - rows - 1
    rows, partners = rows[partners > 0], partners[partners > 0]
    part, kept = np.arange(len(fps)), []
    done = np.cumsum(partners)
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        left = np.repeat(rows[at:upto], partners[at:upto])
        ends = np.cumsum(partners[at:upto])
        right = left + 1 + np.arange(len(left)) - np.repeat(ends - partners[at:upto], partners[at:upto])
        near = np.flatnonzero(np.bitwise_count(fps[left] ^ fps[right]) <= bits)
        left, right, at = left[near], right[near], upto
        cuts = np.flatnonzero(np.diff(left)) + 1
        for i, others in zip(left[np.r_[0, cuts]] if len(left) else (), np.split(right, cuts)):
            roots, where = np.unique(part[others], return_index=True)
            new = roots != part[i]
            if new.any():
                kept += [(int(fps[i]), int(fps[others[j]])) for j in where[new]]
                group = part[first[i] : stop[i]]
                group[np.isin(group, [*roots.tolist(), part[i]])] = min(int(roots.min()), int(part[i]))
    return kept


def _linker(bits: int):
    """Rows come sorted by shard and pair, those at home first; a group that goes on in the next batch is held."""

    def out(rows: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts, stops = np.r_[0, cuts], np.r_[cuts, len(rows)]
        found = _group_links(rows[:, 2].view(np.uint64), rows[:, 3] > 0, starts, stops, bits)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4), np.int64)
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.ascontiguousarray(np.concatenate([held, rows]))
            others = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1)) if len(rows) else ()
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                yield out(rows[:cut])
            held = rows[cut:]
        if len(held):
            yield out(held)

    return run


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b) long: enough links between distinct fingerprints to connect all that differ in ``bits`` or fewer.

    A shard of more than ``SHARD_ROWS`` fingerprints is dealt out over tasks as
    pairs of blocks, so that no task holds more than two blocks.
    """
    placed = fps.select("fp", F.explode(F.concat(*[_paths(F.col("fp"), t, bits // 2) for t in (0, 1)])).alias("at"))
    placed = placed.where(F.col("at").isNotNull()).select("fp", "at.*")
    large = (
        placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS)
        .select("shard", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("blocks"))
    )
    large = stage(large, "large-shards")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.least(own, k) * blocks.cast("long") + F.greatest(own, k),
    )
    dealt = placed.join(large, "shard", "left").select("shard", F.explode(pairs).alias("pair"), "fp", F.col("home").cast("long").alias("home"))
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(tasks, "shard", "pair")
        .sortWithinPartitions("shard", "pair", F.desc("home"))
        .mapInArrow(_linker(bits), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3
) -> DataFrame:
    """(doc_id, id_key, h, fp long, component_id, first boolean) of every row of ``docs``.

    Rows are linked if their fingerprints differ in ``bits`` or fewer; the
    component's id is the smallest id that links lead to, the own one included.
    ``first`` marks the row with this id; if rows repeat it, those with the
    smallest text hash (alike, unless hashes collide). Null and empty texts have
    the fingerprint zero and are linked like any other. Rows with equal
    fingerprints, repeated rows too, are one node, so a group of copies costs one
    row. A null id is never the smallest, unless a component has no other; its
    component's id is null then.
    """
    rows = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h").alias("rank")
    nodes = stage(rows.groupBy("fp").agg(F.min(rank).alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), bits))
    members = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    winners = members.join(roots.select("root").distinct(), "root").groupBy("root").agg(F.min("least").alias("winner"))
    named = members.join(winners, "root", "left").select("fp", F.coalesce("winner", "least").alias("winner"))
    return rows.join(named, "fp").select(
        "doc_id", "id_key", "h", "fp",
        F.col("winner.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("h") == F.col("winner.h"))).alias("first"),
    )


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component, the ``first`` one; other columns may have any names."""
    found = near_duplicates(docs, id_col, text_col, words, bits)
    kept = found.where("first").select("id_key", "h").distinct()
    rows = packed(docs, **row_key(id_col, text_col)).join(kept, ["id_key", "h"], "left_semi")
    return rows.dropDuplicates(["id_key", "h"]).select("row.*")


ship(__name__)
