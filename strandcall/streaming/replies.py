"""Requests and model replies as streams: a batch is closed when all its replies are in.

Three streams meet: requests, generator replies and critic replies, in any order. They are
parsed where they are read, so that only short events reach the state, which is
kept for one batch of requests at a time. A batch that is complete writes a row for each of its
requests; one that waits too long is closed with its missing replies as failed calls. What arrives
for a closed batch is dropped and counted.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandcall.operators.metrics import percent

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the state function travels with the query; executors need no copy of the package

EVENT = "batch_id long, sample_id string, kind string, batch_size long, wants_critic boolean, failed boolean, answer string, solution string, excerpt string"
CLOSED = "batch_id long, sample_id string, kind string, api_error boolean, extracted_answer string, solution string, excerpt string"
STATE = "held string, closed boolean, late long"
ANSWERED, LATE = "answered", "late"


def _event(df: DataFrame, kind: str, batch: str, sample: str, **values: Column) -> DataFrame:
    fields = [tuple(f.split(" ")) for f in EVENT.split(", ")]
    given = {"batch_id": F.col(batch), "sample_id": F.col(sample), "kind": F.lit(kind), **values}
    return df.select(*[given.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in fields])


def request_events(requests: DataFrame, batch: str, sample: str, size: Column, solution: Column, excerpt: Column, wants_critic: Column | None = None) -> DataFrame:
    """Requests with the size of their batch; without ``wants_critic`` every one expects a critic's reply."""
    wants = F.lit(True) if wants_critic is None else wants_critic
    return _event(requests, "request", batch, sample, batch_size=size, wants_critic=wants, solution=solution, excerpt=excerpt)


def reply_events(replies: DataFrame, kind: str, batch: str, sample: str, failed: Column, answer: Column | None = None) -> DataFrame:
    """Replies of the ``generator`` (with the parsed answer) or the ``critic``."""
    return _event(replies, kind, batch, sample, failed=failed, **({} if answer is None else {"answer": answer}))


def _complete(held: dict) -> bool:
    """Whether every request of the batch is known and has all replies that it waits for."""
    requests = held.get("request", {})
    if not requests or len(requests) < next(iter(requests.values()))["batch_size"]:
        return False
    generator, critic = held.get("generator", {}), held.get("critic", {})
    return all(s in generator and (not r["wants_critic"] or s in critic) for s, r in requests.items())


def _rows(batch: int, held: dict) -> pd.DataFrame:
    """The result of a batch: one failed or missing reply fails all its rows."""
    requests, generator, critic = (held.get(k, {}) for k in ("request", "generator", "critic"))
    replies = [generator.get(s) for s in requests] + [critic.get(s) for s, r in requests.items() if r["wants_critic"]]
    error = any(r is None or r["failed"] for r in replies)
    names = [f.split(" ")[0] for f in CLOSED.split(", ")]
    rows = [
        (batch, s, ANSWERED, error, None if error else generator[s]["answer"], r["solution"], r["excerpt"] if error else None)
        for s, r in requests.items()
    ]
    return pd.DataFrame(rows, columns=names)


def _late(batch: int, samples: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({"batch_id": batch, "sample_id": samples, "kind": LATE})
    return out.reindex(columns=[f.split(" ")[0] for f in CLOSED.split(", ")])


def _fold(key: tuple, events: Iterator[pd.DataFrame], state: GroupState, patience_ms: int) -> Iterator[pd.DataFrame]:
    batch = int(key[0])
    held, closed, late = state.get if state.exists else ("{}", False, 0)
    if state.hasTimedOut:
        if not closed and "request" in (waiting := json.loads(held)):
            yield _rows(batch, waiting)
            state.update(("{}", True, late))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + patience_ms + 1)
        else:  # a closed batch that nothing has come for, or replies to nothing
            state.remove()
        return
    waiting, seen = json.loads(held), 0
    for part in events:
        seen = max(seen, int(part["at_ms"].max()))
        if closed:
            late += len(part)
            yield _late(batch, part["sample_id"].tolist())
            continue
        told = part.astype(object).where(part.notna(), None)
        for event in told.to_dict("records"):
            waiting.setdefault(event["kind"], {}).setdefault(event["sample_id"], _kept(event))  # a first reply stands
    if not closed and _complete(waiting):
        yield _rows(batch, waiting)
        waiting, closed = {}, True
    state.update((json.dumps(waiting), closed, late))
    state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + patience_ms + 1)


KEPT = {"request": ("batch_size", "wants_critic", "solution", "excerpt"), "generator": ("failed", "answer"), "critic": ("failed",)}


def _kept(event: dict) -> dict:
    plain = {"batch_size": int, "wants_critic": bool, "failed": bool}
    return {k: plain[k](event[k]) if k in plain and event[k] is not None else event[k] for k in KEPT[event["kind"]]}


def closed_batches(*streams: DataFrame, patience: int = 3600) -> DataFrame:
    """(batch_id, sample_id, kind, api_error, extracted_answer, solution, excerpt) from streams of events.

    ``kind`` is ``answered`` for a row of a closed batch and ``late`` for a reply that came after its batch was
    closed. The state holds the short events of open batches, as JSON, and a mark for closed ones until
    nothing has come for ``patience`` seconds; an open batch is then closed with what is there. Time is
    that of the micro-batch, so a replayed one does the same, and it passes with the micro-batches. Of
    replies that repeat a sample the first stands; two in one micro-batch are taken in any order.
    """
    both = streams[0]
    for stream in streams[1:]:
        both = both.unionByName(stream)

    def fold(key: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _fold(key, events, state, patience * 1000)

    timed = both.withColumn("arrived", F.current_timestamp()).withColumn("at_ms", F.unix_millis("arrived")).withWatermark("arrived", "0 seconds")
    return timed.groupBy("batch_id").applyInPandasWithState(fold, CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def progress(closed: DataFrame) -> DataFrame:
    """Closed batches so far: rows, failed rows, late replies and the failed share in percent."""
    answered = F.col("kind") == ANSWERED
    return closed.agg(
        F.count_if(answered).alias("processed"),
        F.count_if(answered & F.col("api_error")).alias("failed"),
        F.count_if(F.col("kind") == LATE).alias("late"),
    ).withColumn("failed_pct", percent(F.col("failed"), F.col("processed")))
