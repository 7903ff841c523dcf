"""Hard negatives from candidate lists that the anchors of a cluster share.

Anchors are clustered by direction. For an anchor in a cluster of angular radius r,
the inner product with a candidate at angle t from the centroid is at most |anchor| |candidate|
cos(max(0, t - r)); so |candidate| cos(max(0, t - r)) orders all candidates once for all
members. Spark sorts each list by this bound, dealt into shards, and a task streams it: every
member walks the list until its worst kept score is above the bound of all that is left. Positives are
found first; their scores give the range of the negatives, and candidates whose bound
is below the lowest of a cluster's ranges never enter its list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcall.llm.common import ship
from strandcall.llm.whitening import usable
from strandcall.session import stage

SCALE = 256
SAMPLE = 4096  # anchors that centroids are learnt from
MEMBERS = 2048  # anchors that walk a list together; a larger cluster has several lists
SHARD = 16_384  # candidates of a shard of a list, in the mean
BLOCK = 512  # candidates that are compared at once
SLACK = 1e-7  # of the candidate's length: above all rounding of angles
ROW = "list int, shard int, bound double, id long, label long, vector binary, wanted array<long>"
FOUND = "id long, label long, vector binary, positive int, score long, other long"
NO_ID = np.iinfo(np.int64).max  # stands for a null id, behind all others


def quantised(vector: Column) -> Column:
    """floor(256 x) of each entry as a long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long"))


def packed(vectors: pa.Array) -> list[bytes]:
    """Each list of longs as bytes."""
    values, ends = np.asarray(vectors.flatten(), "<i8"), np.asarray(vectors.offsets)
    ends = ends - ends[0]
    return [values[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def unpacked(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where these hold them, else in whole numbers of any size."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = a.astype(object) @ b.astype(object).T
    if max(abs(v) for v in out.ravel()) > NO_ID // 100:
        raise ArithmeticError("an inner product that no long holds")
    return out.astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x.astype(np.float64), axis=1)


@dataclass
class Clusters:
    """Centroids of unit length, the angular radius of each cluster, how many lists it has, and the least bound that matters."""

    centroids: np.ndarray
    radius: np.ndarray | None = None
    lists: np.ndarray | None = None
    floor: np.ndarray | None = None

    def angles(self, x: np.ndarray) -> np.ndarray:
        """To every centroid; a zero vector is at angle 0 of all."""
        size = norms(x)
        cosine = x.astype(np.float64) @ self.centroids.T / np.where(size > 0, size, 1)[:, None]
        return np.arccos(np.clip(np.where(size[:, None] > 0, cosine, 1), -1, 1))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For every cluster: no unit vector in it has a larger inner product with the row."""
        return norms(x)[:, None] * (np.cos(np.maximum(0, self.angles(x) - self.radius)) + SLACK)


def learn(anchors: DataFrame, count: int) -> np.ndarray:
    """``count`` centroids by spherical k-means over at most ``SAMPLE`` anchors, picked by a hash of their ids.

    Any centroids give right results; these only make bounds tight.
    """
    picked = anchors.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).select("vector").collect()
    x = np.array([list(r["vector"]) for r in picked], np.float64)
    x /= np.maximum(norms(x), 1e-300)[:, None]
    centroids = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(10):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        size = norms(sums)
        centroids = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-300)[:, None], centroids)
    return centroids


class Walk:
    """The anchors of a list, and the best candidates that each has met so far.

    An anchor has one ``slot`` for its positives (``most`` rows of its own label), or one
    for each score in ``wanted`` (``most`` rows of other labels, whose scores lie between
    the two shares of that score).
    """

    def __init__(self, id_: np.ndarray, label: np.ndarray, x: np.ndarray, wanted: list[list[int]] | None, most: int, shares: tuple[int, int]):
        slots = [1] * len(x) if wanted is None else [len(w) for w in wanted]
        self.owner = np.repeat(np.arange(len(x)), slots)
        self.positive = np.concatenate([np.arange(k) for k in slots]) if slots else np.zeros(0, int)
        self.id, self.label, self.x, self.most = id_[self.owner], label[self.owner], x, most
        self.size = norms(x)[self.owner]
        self.same = wanted is None
        scores = np.array([s for w in wanted or [] for s in w], np.int64)
        self.low, self.high = scores * shares[0], scores * shares[1]
        self.score = np.full((len(self.owner), most), np.iinfo(np.int64).min)
        self.other = np.full((len(self.owner), most), NO_ID)
        self.met = np.zeros((len(self.owner), most), bool)
        self.open = np.ones(len(self.owner), bool) if self.same else self.low <= self.high

    def certify(self, bound: float) -> None:
        """Close the slots that nothing of at most this bound can change."""
        best = self.size * bound
        full = self.met[:, -1] & (self.score[:, -1] > best)
        self.open &= ~(full if self.same else full | (self.low > 100 * best))

    def meet(self, id_: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        """Compare the open slots with some candidates."""
        slots = np.flatnonzero(self.open)
        if not len(slots):
            return
        rows, back = np.unique(self.owner[slots], return_inverse=True)
        scores = products(self.x[rows], x)[back]
        alike = self.label[slots][:, None] == label
        if self.same:
            fits = alike & (self.id[slots][:, None] != id_)
        else:
            fits = ~alike & (100 * scores >= self.low[slots][:, None]) & (100 * scores <= self.high[slots][:, None])
        fits &= (scores >= self.score[slots, -1][:, None]) | ~self.met[slots, -1][:, None]
        for k in np.flatnonzero(fits.any(axis=1)):
            slot, new = slots[k], np.flatnonzero(fits[k])
            held = self.met[slot]
            score = np.concatenate([self.score[slot][held], scores[k, new]])
            other = np.concatenate([self.other[slot][held], id_[new]])
            order = np.lexsort((other, -score))[: self.most]
            self.score[slot, : len(order)], self.other[slot, : len(order)], self.met[slot, : len(order)] = score[order], other[order], True

    def found(self, label: np.ndarray, id_: np.ndarray, vectors: list[bytes]) -> pa.RecordBatch:
        """A row for each candidate that was kept."""
        slot, place = np.nonzero(self.met)
        owner = self.owner[slot]
        other = self.other[slot, place]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(id_[owner]), pa.array(label[owner]), pa.array([vectors[o] for o in owner], pa.binary()),
                pa.array(self.positive[slot].astype(np.int32)), pa.array(self.score[slot, place]), pa.array(other, mask=other == NO_ID),
            ],
            ["id", "label", "vector", "positive", "score", "other"],
        )


def _walk(batches: Iterator[pa.RecordBatch], most: int, shares: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """Stream sorted lists: the members of a list's shard stand in front of its candidates."""
    key, members, walk = None, [], None

    def begin() -> tuple[Walk, tuple]:
        ids = np.array([m[0] for m in members], np.int64)
        labels = np.array([m[1] for m in members], np.int64)
        vectors = [m[2] for m in members]
        wanted = [m[3] for m in members] if shares else None
        return Walk(ids, labels, unpacked(vectors), wanted, most, shares or (0, 0)), (labels, ids, vectors)

    told: tuple = ()
    for batch in batches:
        lists, shards = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(lists) != 0) | (np.diff(shards) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if (lists[a], shards[a]) != key:
                if walk is not None:
                    yield walk.found(*told)
                key, members, walk = (lists[a], shards[a]), [], None
            part = batch.slice(a, b - a)
            leading = int(np.count_nonzero(np.isinf(part.column(2).to_numpy())))
            if leading:
                names = [part.column(i).slice(0, leading).to_pylist() for i in (3, 4, 5, 6)]
                members += list(zip(*names))
            if leading == part.num_rows or not members:
                continue
            if walk is None:
                walk, told = begin()
            for start in range(leading, part.num_rows, BLOCK):
                block = part.slice(start, BLOCK)
                walk.certify(block.column(2)[0].as_py())
                if not walk.open.any():
                    break
                ids = np.asarray(block.column(3).fill_null(NO_ID))
                walk.meet(ids, np.asarray(block.column(4)), unpacked(block.column(5).to_pylist()))
    if walk is not None:
        yield walk.found(*told)


def _entries(rows: DataFrame, clusters: Clusters, shards: int) -> DataFrame:
    """The rows of all lists: each candidate in every list that its bound lets it enter."""
    first = np.r_[0, np.cumsum(clusters.lists)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                vectors = packed(batch.column(3))
                bounds = clusters.bounds(unpacked(vectors))
                for c in range(len(clusters.lists)):
                    rows_in = np.flatnonzero(bounds[:, c] >= clusters.floor[c])
                    for number in range(first[c], first[c + 1]) if len(rows_in) else ():
                        taken = batch.take(pa.array(rows_in))
                        columns = [
                            pa.array(np.full(len(rows_in), number, np.int32)), taken.column(2), pa.array(bounds[rows_in, c]),
                            taken.column(0), taken.column(1), pa.array([vectors[i] for i in rows_in], pa.binary()),
                            pa.nulls(len(rows_in), pa.list_(pa.int64())),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROW.split(", ")])

    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")  # repeated rows are dealt too
    return rows.select("id", "label", shard.alias("shard"), "vector").mapInArrow(run, ROW)


def _members(anchors: DataFrame, clusters: Clusters, wanted: Column, shards: int) -> DataFrame:
    """The anchors in front of every shard of their list."""
    starts = F.array(*[F.lit(int(s)) for s in np.r_[0, np.cumsum(clusters.lists)[:-1]]])
    counts = F.array(*[F.lit(int(n)) for n in clusters.lists])
    at = (F.col("cluster") + 1).cast("int")
    number = F.element_at(starts, at) + F.pmod(F.xxhash64("id", "label", "packed"), F.element_at(counts, at).cast("long"))
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    return anchors.select(
        number.cast("int").alias("list"), shard.alias("shard"), F.lit(float("inf")).alias("bound"),
        "id", "label", F.col("packed").alias("vector"), wanted.alias("wanted"),
    )


def _best(anchors: DataFrame, rows: DataFrame, clusters: Clusters, wanted: Column, shards: int, most: int, shares: tuple[int, int] | None = None) -> DataFrame:
    """(id, label, vector, positive, score, other, rank): the first ``most`` of every slot, over all shards."""
    lists = int(clusters.lists.sum())
    parts = max(1, min(lists * shards, 20_000))
    both = _members(anchors, clusters, wanted, shards).unionByName(_entries(rows, clusters, shards))
    sorted_lists = both.repartition(parts, "list", "shard").sortWithinPartitions("list", "shard", F.desc("bound"))
    found = sorted_lists.mapInArrow(lambda batches: _walk(batches, most, shares), FOUND)
    by = Window.partitionBy("id", "label", "vector", "positive").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def _placed(anchors: DataFrame, clusters: Clusters) -> DataFrame:
    """Anchors with their nearest cluster, the angle to its centroid, their length and packed vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = packed(batch.column(2))
            if not vectors:
                continue
            x = unpacked(vectors)
            angles = clusters.angles(x)
            nearest = np.argmin(angles, axis=1)
            columns = [
                batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), pa.array(nearest.astype(np.int32)),
                pa.array(angles[np.arange(len(x)), nearest]), pa.array(norms(x)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "packed", "cluster", "angle", "size"])

    return anchors.mapInArrow(run, "id long, label long, packed binary, cluster int, angle double, size double")


def _clustered(anchors: DataFrame, count: int) -> tuple[DataFrame, Clusters]:
    """(placed anchors, their clusters): as many lists as the members of a cluster need."""
    clusters = Clusters(learn(anchors, count))
    placed = stage(_placed(anchors, clusters), "anchors")
    told = {r["cluster"]: r for r in placed.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    each = range(len(clusters.centroids))
    clusters.radius = np.array([told[c]["radius"] if c in told else 0.0 for c in each])
    clusters.lists = np.array([-(-told[c]["n"] // MEMBERS) if c in told else 0 for c in each])
    clusters.floor = np.full(len(clusters.centroids), -np.inf)
    return placed, clusters


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, clusters: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score long).

    Rows that meet the condition ``anchor`` (on the columns of ``rows``) are anchors. A score is the inner
    product of the vectors' floor(256 x); higher scores come first, then smaller ids, null ids last. An
    anchor's ``positives`` are its first rows of the same label under another id; for each
    of them the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent of the
    positive's are returned (none, if that score is negative). Labels are whole numbers.

    Rows with a null label, or whose vector is null or empty, has null or non-finite entries or another length than
    most, take no part. Repeated rows each count as positives and negatives; anchors that
    repeat id, label and vector are one anchor. Zero vectors score 0 with everything. No rows
    and no anchors give no rows. Scores that no long holds are an error. ``clusters``, of anchors, only changes the speed.
    """
    whole, _ = usable(rows, vector_col)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    narrow = whole.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), quantised(F.col(vector_col)).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    ).where(F.col("label").isNotNull())
    narrow = stage(narrow, "vectors")
    anchors = stage(narrow.where("is_anchor").select("id", "label", "vector").distinct(), "asked")
    asked, n = anchors.count(), narrow.count()
    out = ("id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    if not asked:
        return narrow.limit(0).selectExpr("id anchor_id", *[f"cast(null as {'int' if c == 'rank' else 'long'}) {c}" for c in out[1:]])
    placed, found = _clustered(anchors, clusters or max(1, min(64, round(asked**0.5 / 4))))
    shards = -(-n // SHARD)
    key = ["id", "label", "vector"]
    near = stage(_best(placed, narrow, found, F.lit(None).cast("array<long>"), shards, positives), "positives")
    near = near.select(*key, (F.col("rank") - 1).alias("positive"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    gathered = F.array_sort(F.collect_list(F.struct("positive", "positive_score")))["positive_score"]
    wanting = near.withColumnRenamed("vector", "packed").groupBy("id", "label", "packed").agg(gathered.alias("scores"))
    asking = stage(placed.join(wanting, ["id", "label", "packed"]), "asking")
    least = F.filter("scores", lambda s: s >= 0)
    floor = F.when(F.col("size") > 0, F.array_min(least) * F.lit(low / 100) / F.col("size")).when(F.size(least) > 0, float("-inf"))
    floors = {r["cluster"]: r["floor"] for r in asking.groupBy("cluster").agg(F.min(floor).alias("floor")).collect()}
    told = [floors.get(c) for c in range(len(found.centroids))]
    found.floor = np.array([np.inf if f is None else f * (1 - 1e-9) for f in told])
    far = _best(asking, narrow, found, F.col("scores"), shards, negatives, (low, high))
    far = far.withColumnRenamed("other", "negative_id").withColumnRenamed("score", "negative_score")
    return far.join(near, [*key, "positive"]).select(F.col("id").alias("anchor_id"), *out[1:])


ship(__name__)
