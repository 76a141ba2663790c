"""Job states kept by the stream itself: a value a clip in the state store, and a timer for each lease.

Only clips with events or lapsed leases are touched by a batch. The transitions are those of the batch engine's fold, in plain
Python, as a stateful processor gets rows; tests hold the two against each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from frameloom.operators import jobstate as Z

STATE = StructType([StructField(k, {"string": StringType(), "int": IntegerType(), "double": DoubleType()}[t]) for k, t in Z.STATE.items()])
OUTCOME = "run_id string, clip_id long, seq long, op string, result string, status string, worker string, attempt int, lease double"
LAPSED = "lease_lapsed"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

State = dict[str, Any]


def initial() -> State:
    return dict.fromkeys(Z.STATE) | {"status": Z.PENDING, "attempt": 0, "claimed": 0, "refused": 0, "rejected": 0}


def claimed(s: State, e: dict, now: float, strict: bool, lease_seconds: float, max_attempts: int) -> State:
    """The state after a claim: taken, refused with a reason, or given up on after the last attempt."""
    refuse = lambda why, **more: s | {"refused": s["refused"] + 1, "last_result": why} | more
    running, spent, lease = s["status"] == Z.RUNNING, s["attempt"] >= max_attempts, s["lease"]
    if strict:
        lapsed = running and lease is not None and lease < now
        live, free = running and (lease or 0.0) >= now, (s["status"] in (Z.PENDING, Z.RETRYABLE) or lapsed) and not spent
    else:
        lapsed = False
        live = running and lease is not None and lease > now and s["worker"] != e["worker"]
        free = s["status"] not in (Z.SUCCEEDED, Z.FINAL) and not live and (not spent or running)
    if free:
        return s | {"status": Z.RUNNING, "worker": e["worker"], "attempt": s["attempt"] + 1, "lease": now + lease_seconds, "started": now if s["started"] is None else s["started"], "completed": None, "error": None, "claimed": s["claimed"] + 1, "last_result": "claimed"}
    if s["status"] in (Z.SUCCEEDED, Z.FINAL):
        return refuse("already_succeeded" if s["status"] == Z.SUCCEEDED else "final_failed")
    if live:
        return refuse("leased_by_another_worker")
    if not spent:
        return refuse("claim_condition_failed")
    if not strict:
        return refuse("max_attempts_reached", status=Z.FINAL)
    if running and lease is None:
        return refuse("max_attempts_reached")
    given_up = not running or lapsed
    return refuse("max_attempts_reached", status=Z.FINAL if given_up else s["status"], worker=None if given_up else s["worker"], lease=None if given_up else lease, completed=now, error="MAX_ATTEMPTS_REACHED")


def advance(s: State, e: dict, dialect: str = "strict", lease_seconds: float = 7200, max_attempts: int = 3) -> State:
    """The state after event e(op, worker, now, retryable, error)."""
    strict = dialect == "strict"
    now = float(math.floor(e["now"])) if strict else float(e["now"])
    if e["op"] == "claim":
        return claimed(s, e, now, strict, lease_seconds, max_attempts)
    if e["op"] not in ("renew", "succeed", "fail"):
        return s
    if s["status"] != Z.RUNNING or s["worker"] != e["worker"]:
        return s | {"rejected": s["rejected"] + 1, "last_result": "not_owner"}
    if e["op"] == "renew":
        return s | {"lease": now + lease_seconds, "last_result": "renewed"}
    if e["op"] == "succeed":
        return s | {"status": Z.SUCCEEDED, "completed": now, "lease": None, "error": None, "last_result": "succeeded"}
    status = Z.RETRYABLE if e["retryable"] and s["attempt"] < max_attempts else Z.FINAL
    error = e["error"][: Z.MAX_ERROR] if strict and e["error"] is not None else e["error"]
    return s | {"status": status, "completed": now, "lease": None, "error": error, "last_result": status}


class LeaseKeeper(StatefulProcessor):
    """A clip's state and the timer of its lease. ttl_seconds after its last event a clip's state is dropped, if that is asked for."""

    def __init__(self, dialect: str, lease_seconds: float, max_attempts: int, ttl_seconds: float | None):
        self.rules, self.ttl = (dialect, lease_seconds, max_attempts), ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE, None if self.ttl is None else int(self.ttl * 1000))

    def held(self) -> State:
        return dict(zip(Z.STATE, self.state.get())) if self.state.exists() else initial()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        s = self.held()
        for r in sorted(rows, key=lambda r: r["seq"]):
            s = advance(s, r.asDict(), *self.rules)
            yield self.told(key, s, r["seq"], r["op"], s["last_result"])
        self.state.update(tuple(s[k] for k in Z.STATE))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if s["status"] == Z.RUNNING and s["lease"] is not None:
            self.handle.registerTimer(max(int(s["lease"] * 1000), timerValues.getCurrentProcessingTimeInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        s = self.held()
        if s["status"] == Z.RUNNING:  # who claims the clip next takes it over
            yield self.told(key, s, None, None, LAPSED)

    def close(self) -> None:
        pass

    @staticmethod
    def told(key: tuple, s: State, seq: int | None, op: str | None, result: str | None) -> Row:
        return Row(run_id=key[0], clip_id=key[1], seq=seq, op=op, result=result, status=s["status"], worker=s["worker"], attempt=s["attempt"], lease=s["lease"])


def keep_leases(events: DataFrame, dialect: str = "strict", lease_seconds: float = 7200, max_attempts: int = 3, ttl_seconds: float | None = None) -> DataFrame:
    """A stream of events(run_id, clip_id, seq long, op, worker, now, retryable, error) -> OUTCOME: a row an event, and a row a lapsed lease.

    Events of a batch are taken in the order of seq; a clip that isn't known is pending. The session's state store must be
    RocksDB (with_rocks).
    """
    asked = events.select("run_id", F.col("clip_id").cast("long").alias("clip_id"), F.col("seq").cast("long").alias("seq"), "op", "worker", F.col("now").cast("double").alias("now"), "retryable", "error")
    return asked.groupBy("run_id", "clip_id").transformWithState(LeaseKeeper(dialect, lease_seconds, max_attempts, ttl_seconds), StructType.fromDDL(OUTCOME), "Update", "ProcessingTime")


def with_rocks(spark: SparkSession) -> SparkSession:
    """The session with the state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def stored_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(run_id, clip_id, STATE) as the state store of a stopped or running stream holds them."""
    df = spark.read.format("statestore").option("stateVarName", "job").load(checkpoint)
    return df.select("key.*", "value.*")
