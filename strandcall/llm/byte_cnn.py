"""Text quality from a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover it whole. In every
chunk each learned filter (``WIDTH`` bytes) is slid over all places and
max-pooled; one more channel has the share of bytes that equal the byte a lag
before, pooled over lags, which single bytes can't show. The pools of a
document's chunks are averaged and combined into one probability. Training
takes a bounded sample of labelled documents on the driver; scoring is one
pass over the documents on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcall.llm.common import as_bytes, modest_batches, packed, ship, small_batches, text_hash

CHUNK = 1024
OVERLAP = 64
STEP = CHUNK - OVERLAP
WIDTH = 4
LAGS = tuple(range(1, 41))
PAD = b"\xff"  # no byte of UTF-8
SCALE = 10.0  # so that the share weighs as much as a filter's pool
SEGMENT = 64  # chunks that are laid out together
BLOCK = 1 << 18  # bytes that are scored together


@dataclass(frozen=True)
class Network:
    """Filters (WIDTH, 256, filters), their biases, and the weights that combine the pools."""

    filters: np.ndarray
    biases: np.ndarray
    weights: np.ndarray
    constant: float


def chunk_count(size: int) -> int:
    return max(1, -(-(size - OVERLAP) // STEP))


def segments(text: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Laid out bytes with the starts and ends of their chunks; results don't depend on the division.

    In front of a segment stand the bytes that the longest lag reaches, behind it those of a filter.
    """
    before, after, count = max(LAGS), WIDTH - 1, chunk_count(len(text))
    for first in range(0, count, SEGMENT):
        starts = np.arange(first, min(count, first + SEGMENT)) * STEP
        ends = np.minimum(starts + CHUNK, len(text))
        low, high = int(starts[0]), int(ends[-1])
        laid = text[max(0, low - before) : low].rjust(before, PAD) + text[low : high + after].ljust(high - low + after, PAD)
        yield laid, starts - low + before, np.maximum(ends, starts + 1) - low + before


def _ranges(values: np.ndarray, how: np.ufunc, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``how`` over ranges that may overlap; the values must go on behind the last."""
    return how.reduceat(values, np.stack([starts, ends], axis=1).ravel())[::2]


def repetition(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each chunk the largest share, over lags, of bytes that equal the byte a lag before; times ``SCALE``."""
    best = np.zeros(len(starts))
    equal = np.zeros(len(data), np.uint8)
    for lag in LAGS:
        equal[lag:] = data[lag:] == data[:-lag]
        total = np.cumsum(equal, dtype=np.int32)
        best = np.maximum(best, total[ends - 1] - total[starts - 1])
    return SCALE * best / (ends - starts)


class Scorer:
    """A network with its filters summed to tables over pairs of bytes: half as many look-ups."""

    def __init__(self, net: Network):
        f = net.filters.astype(np.float32)
        self.net = net
        self.pairs = [
            np.ascontiguousarray((f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1).T) for k in range(0, WIDTH, 2)
        ]

    def pools(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(chunks, filters + 1)."""
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        size = len(pair) - (WIDTH - 2)
        out = np.empty((len(starts), len(self.net.biases) + 1), np.float32)
        for f in range(len(self.net.biases)):
            values = self.pairs[0][f].take(pair[:size])
            for k in range(1, WIDTH // 2):
                values += self.pairs[k][f].take(pair[2 * k : 2 * k + size])
            out[:, f] = np.maximum(_ranges(values, np.maximum, starts, ends) + self.net.biases[f], 0)
        out[:, -1] = repetition(data, starts, ends)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, block by block; a long text goes through several blocks."""
        total = np.zeros((len(texts), len(self.net.weights)))
        counts = np.array([chunk_count(len(t)) for t in texts], np.int64)
        laid: list[bytes] = []
        starts, ends, owners, size = [], [], [], 0

        def flush() -> None:
            nonlocal size
            data = np.frombuffer(b"".join([*laid, PAD * WIDTH]), np.uint8)
            pools = self.pools(data, np.concatenate(starts), np.concatenate(ends))
            np.add.at(total, np.concatenate(owners), pools)
            for held in (laid, starts, ends, owners):
                held.clear()
            size = 0

        for i, text in enumerate(texts):
            for part, first, last in segments(text):
                laid.append(part)
                starts.append(first + size)
                ends.append(last + size)
                owners.append(np.full(len(first), i))
                size += len(part)
                if size > BLOCK:
                    flush()
        if laid:
            flush()
        logits = total / counts[:, None] @ self.net.weights + self.net.constant
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def train(
    chunks: list[list[bytes]], labels: np.ndarray, filters: int = 8, epochs: int = 12, rate: float = 0.02, seed: int = 7
) -> Network:
    """A network for documents given as lists of chunks; both classes weigh the same.

    Adam over small lots of documents; a filter learns at the place where it was largest.
    """
    rng = np.random.default_rng(seed)
    owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
    flat = [c for doc in chunks for c in doc]
    data = np.frombuffer(b"".join(c.ljust(CHUNK + WIDTH - 1, PAD) for c in flat), np.uint8).reshape(len(flat), -1)
    sizes = np.array([max(1, len(c)) for c in flat])
    at = np.arange(len(flat)) * (CHUNK + WIDTH - 1 + max(LAGS)) + max(LAGS)
    spaced = np.full((len(flat), max(LAGS) + CHUNK + WIDTH - 1), 255, np.uint8)
    spaced[:, max(LAGS) :] = data
    repeats = repetition(np.r_[spaced.ravel(), np.full(WIDTH, 255, np.uint8)], at, at + sizes)
    count = np.bincount(owner, minlength=len(chunks))
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    p = {
        "filters": rng.normal(0, 0.1, (WIDTH, 256, filters)),
        "biases": np.zeros(filters),
        "weights": np.r_[rng.normal(0, 0.3, filters), 0.0],
        "constant": np.zeros(1),
    }
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by_doc = np.split(np.arange(len(flat)), np.cumsum(count)[:-1])
    places = np.arange(CHUNK)
    step = 0
    for _ in range(epochs):
        for lot in np.array_split(rng.permutation(len(chunks)), max(1, len(chunks) // 32)):
            own = np.concatenate([by_doc[i] for i in lot])
            rank = np.repeat(np.arange(len(lot)), count[lot])
            x, inside = data[own], places[None, :] < sizes[own][:, None]
            top = np.empty((len(own), filters), np.int64)
            pool = np.empty((len(own), filters + 1))
            for f in range(filters):
                values = sum(p["filters"][k, :, f].take(x[:, k : k + CHUNK]) for k in range(WIDTH))
                values[~inside] = -np.inf
                top[:, f] = values.argmax(axis=1)
                pool[:, f] = values[np.arange(len(own)), top[:, f]] + p["biases"][f]
            live = pool[:, :filters] > 0
            pool[:, :filters] *= live
            pool[:, -1] = repeats[own]
            mean = np.zeros((len(lot), filters + 1))
            np.add.at(mean, rank, pool / count[lot][rank][:, None])
            logit = np.clip(mean @ p["weights"] + p["constant"][0], -60, 60)
            error = (1 / (1 + np.exp(-logit)) - labels[lot]) * weight[lot] / len(lot)
            back = (error / count[lot])[rank][:, None] * p["weights"][None, :filters] * live
            g = {k: np.zeros_like(a) for k, a in p.items()}
            for k in range(WIDTH):
                for f in range(filters):
                    np.add.at(g["filters"][k, :, f], x[np.arange(len(own)), top[:, f] + k], back[:, f])
            g["biases"] = back.sum(axis=0)
            g["weights"] = mean.T @ error + 1e-4 * p["weights"]
            g["constant"] = np.array([error.sum()])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(p["filters"], p["biases"], p["weights"], float(p["constant"][0]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 800,
    sample_chunks: int = 16,
    **how: float,
) -> Network:
    """Train on at most ``sample_rows`` labelled documents of each class, ``sample_chunks`` chunks of each.

    The sample is the first in a hash order of the ids; chunks are spread evenly
    over the whole text. Of rows that repeat an id that of the smallest text hash is taken. Held-out ids, null and contradictory labels are not
    learnt. Without documents of both classes the score is the same for all: the share of
    label 1, or 1 if nothing is labelled.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min(label_col).alias("label"), F.max(label_col).alias("most"))
        .where(F.col("label") == F.col("most")).select("doc_id", "label")
        .join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    )
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id"]
    picked = [r for k in (0, 1) for r in known.where(F.col("label") == k).orderBy(*order).limit(sample_rows).collect()]
    if len({r.label for r in picked}) < 2:
        share = picked[0].label if picked else 1
        return Network(np.zeros((WIDTH, 256, 1)), np.zeros(1), np.zeros(2), 60.0 if share else -60.0)
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, int(r.label)) for r in picked], known.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [t or b"" for t in as_bytes(batch.column(2))]
            starts = [np.unique(np.linspace(0, chunk_count(len(t)) - 1, sample_chunks).astype(int)) * STEP for t in texts]
            parts = [[t[a : a + CHUNK] for a in s] for t, s in zip(texts, starts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(parts, pa.list_(pa.binary()))], ["doc_id", "label", "h", "chunks"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    texts = modest_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")  # 2 * sample_rows rows at most
        .select("doc_id", F.col("label").cast("int"), "text", text_hash(F.col("text")).alias("h"))
        .mapInArrow(cut, f"doc_id {kind}, label int, h long, chunks array<binary>")
        .groupBy("doc_id", "label").agg(F.min(F.struct("h", "chunks")).alias("least"))
        .select("doc_id", "label", "least.chunks")
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.chunks))
    return train([[bytes(c) for c in r.chunks] for r in rows], np.array([r.label for r in rows]), **how)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, score double): each row of ``docs`` as a struct. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in small_batches(batches):
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(texts))], ["row", "score"])

    rows = packed(docs).select("row", F.col(f"row.{text_col}").cast("string").alias("text"))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema
    return modest_batches(rows).mapInArrow(run, schema)


ship(__name__)
