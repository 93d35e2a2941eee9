"""Alerts on price zones: a keyed state machine over a stream of prices."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

APPROACH, BUFFER, RESET = 0.01, 0.002, 0.015
EVENTS = "zone_id string, episode int, event_type string, ts timestamp, close double, lower double, upper double, confirmed boolean, idempotency_key string"
STATE = "relation string, episode int, emitted string, invalidated boolean"


class Zone(NamedTuple):
    zone_id: str
    lower: float
    upper: float
    invalidated: bool = False


class Update(NamedTuple):
    ts: Any
    close: float
    high: float | None = None
    low: float | None = None
    closed: bool = True


@dataclass
class State:
    relation: str = "unknown"
    episode: int = 0
    emitted: set[str] = field(default_factory=set)
    invalidated: bool = False


def key(zone_id: str, episode: int, event: str) -> str:
    return hashlib.sha1(f"{zone_id}:{episode}:{event}".encode()).hexdigest()


def evaluate(zone: Zone, state: State, update: Update) -> list[tuple[str, bool]]:
    """Events of one update as (type, confirmed), each once in an episode; ``state`` is brought up to date.

    Crossings within an open bar are provisional, breaks need a closed one.  An episode ends when the price stays far
    away on one side without news.  An invalidated zone says so once and is silent after.
    """
    out: list[tuple[str, bool]] = []

    def emit(event: str, confirmed: bool = False) -> None:
        if event not in state.emitted:
            state.emitted.add(event)
            out.append((event, confirmed))

    if state.invalidated:
        return out
    if zone.invalidated:
        state.invalidated = True
        emit("invalidated", True)
        return out
    close, before, crossed = update.close, state.relation, "crossed_intrabar" in state.emitted
    high, low = close if update.high is None else update.high, close if update.low is None else update.low
    relation = "below" if close < zone.lower else "above" if close > zone.upper else "inside"
    away = max(zone.lower - close, close - zone.upper, 0.0)
    if relation != "inside" and away <= APPROACH * max(close, 1e-12):
        emit("approaching")
    if high >= zone.lower and low <= zone.upper:
        emit("touched")
    over, under = close > zone.upper * (1 + BUFFER), close < zone.lower * (1 - BUFFER)
    if update.closed:
        if over and (before != "above" or crossed):
            emit("breakout", True)
        elif under and (before != "below" or crossed):
            emit("breakdown", True)
    elif (over and before != "above") or (under and before != "below"):
        emit("crossed_intrabar")
    far = close > zone.upper * (1 + RESET) or close < zone.lower * (1 - RESET)
    if far and before == relation and not out:
        state.episode += 1
        state.emitted.clear()
    state.relation = relation
    return out


def _advance(zone_id: str, rows: pd.DataFrame, state: State) -> list[tuple]:
    out = []
    for r in rows.sort_values("ts", kind="stable").itertuples(index=False):
        high, low = (None if pd.isna(x) else float(x) for x in (r.high, r.low))
        for event, confirmed in evaluate(Zone(zone_id, r.lower, r.upper, bool(r.invalidated)), state, Update(r.ts, float(r.close), high, low, bool(r.closed))):
            out.append((zone_id, state.episode, event, r.ts, float(r.close), float(r.lower), float(r.upper), confirmed, key(zone_id, state.episode, event)))
    return out


def _run(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state = State()
    if held.exists:
        relation, episode, emitted, invalidated = held.get
        state = State(relation, episode, set(filter(None, emitted.split(","))), invalidated)
    events = _advance(keys[0], pd.concat(list(batches)), state)
    held.update((state.relation, state.episode, ",".join(sorted(state.emitted)), state.invalidated))
    yield pd.DataFrame(events, columns=[x.split()[0] for x in EVENTS.split(", ")])


def alert_stream(updates: DataFrame) -> DataFrame:
    """Events of a stream of (zone_id, ts, close, high, low, closed, lower, upper, invalidated); state survives restarts in the checkpoint."""
    return updates.groupBy("zone_id").applyInPandasWithState(_run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


ORDERED_STATE = STATE + ", latest long, pending string"
UPDATE = ("at_ms", "ts", "close", "high", "low", "closed", "lower", "upper", "invalidated")


def ordered_alert_stream(updates: DataFrame, delay: str = "10 minutes", silence_days: int = 30) -> DataFrame:
    """Events as ``alert_batch`` tells them, whatever order and micro-batch the updates come in, if none is later than ``delay``.

    A zone's updates wait in its state until the watermark has passed them and are judged in order of time; updates behind
    the watermark are dropped.  A zone that has been silent for ``silence_days`` of event time leaves no state and starts
    anew.  So the state holds one delay of updates of the zones that still move.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, latest, waiting = State(), 0, []
        if held.exists:
            relation, episode, emitted, invalidated, latest, pending = held.get
            state, waiting = State(relation, episode, set(filter(None, emitted.split(","))), invalidated), json.loads(pending)
        seen = held.getCurrentWatermarkMs()
        for rows in batches:
            for r in rows[list(UPDATE)].itertuples(index=False):
                high, low = (None if pd.isna(x) else float(x) for x in (r.high, r.low))
                waiting.append([int(r.at_ms), r.ts.isoformat(), float(r.close), high, low, bool(r.closed), float(r.lower), float(r.upper), bool(r.invalidated)])
        waiting.sort(key=lambda x: (x[0], x[1]))
        due = [x for x in waiting if x[0] <= seen]
        waiting = waiting[len(due) :]
        told = pd.DataFrame(due, columns=UPDATE).assign(ts=[pd.Timestamp(x[1]) for x in due])
        events = _advance(keys[0], told, state)
        latest = max([latest, *(x[0] for x in due)])
        end = latest + silence_days * 86_400_000
        if waiting or not latest or end > seen:
            held.update((state.relation, state.episode, ",".join(sorted(state.emitted)), state.invalidated, latest, json.dumps(waiting)))
            held.setTimeoutTimestamp(waiting[0][0] if waiting else max(end, seen + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(events, columns=[x.split()[0] for x in EVENTS.split(", ")])

    timed = updates.withWatermark("ts", delay).withColumn("at_ms", F.unix_millis("ts"))
    return timed.groupBy("zone_id").applyInPandasWithState(run, EVENTS, ORDERED_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def alert_batch(updates: DataFrame) -> DataFrame:
    """The same over a finished table."""

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_advance(keys[0], rows, State()), columns=[x.split()[0] for x in EVENTS.split(", ")])

    return updates.groupBy("zone_id").applyInPandas(run, EVENTS)


def append_new(batch: DataFrame, path: str) -> None:
    """Write events whose key the table at ``path`` lacks.

    The table is partitioned by the events' day, and an event's key belongs to one day, so a batch looks at the days it
    has itself and not at the whole history.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["idempotency_key"]).withColumn("day", F.to_date("ts"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(path).join(F.broadcast(fresh.select("day").distinct()), "day", "left_semi")  # the days of one batch
        fresh = fresh.join(known.select("idempotency_key"), "idempotency_key", "left_anti").select(*batch.columns, "day")
    fresh.write.mode("append").partitionBy("day").parquet(path)


def list_events(events: DataFrame, zone_id: str | None = None, n: int = 100) -> DataFrame:
    """The latest events, of one zone or of all."""
    chosen = events if zone_id is None else events.where(F.col("zone_id") == zone_id)
    return chosen.orderBy(F.desc("ts"), "zone_id", "idempotency_key").limit(n)


def sink(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events to a table, each once."""
    return events.writeStream.foreachBatch(lambda batch, _: append_new(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
