"""Lease-based job states: one transition function, folded over each clip's events in order.

Two dialects differ in the cases that matter when workers race: ``strict`` has whole seconds, blocks a worker's own
live lease, fails an expired lease at the last attempt and needs the row to exist; ``local`` doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, RUNNING, RETRYABLE, SUCCEEDED, FINAL = "PENDING", "RUNNING", "RETRYABLE_FAILED", "SUCCEEDED", "FINAL_FAILED"
STATE = {"status": "string", "worker": "string", "attempt": "int", "lease": "double", "started": "double", "completed": "double", "error": "string", "claimed": "int", "refused": "int", "rejected": "int", "last_result": "string"}
MAX_ERROR = 4000


def state(**values: Column) -> Column:
    return F.struct(*[values[k].cast(t).alias(k) for k, t in STATE.items()])


def initial() -> Column:
    none = F.lit(None)
    return state(status=F.lit(PENDING), worker=none, attempt=F.lit(0), lease=none, started=none, completed=none, error=none, claimed=F.lit(0), refused=F.lit(0), rejected=F.lit(0), last_result=none)


def step(s: Column, e: Column, dialect: str = "strict", lease_seconds: float = 7200, max_attempts: int = 3) -> Column:
    """The state after event e(op, worker, now, retryable, error): claim, renew, succeed or fail."""
    strict = dialect == "strict"
    now = F.floor(e["now"]).cast("double") if strict else e["now"].cast("double")
    status, worker, attempt, lease = s["status"], s["worker"], s["attempt"], s["lease"]
    running, mine = status == RUNNING, worker.eqNullSafe(e["worker"])
    keep = {k: s[k] for k in STATE}
    after = lambda **v: state(**(keep | v))
    none, one = F.lit(None), F.lit(1)

    done = status.isin(SUCCEEDED, FINAL)
    spent = attempt >= max_attempts
    if strict:
        live = running & (F.coalesce(lease, F.lit(0.0)) >= now)
        free = (status.isin(PENDING, RETRYABLE) | (running & (lease < now))) & ~spent
        exhausted = after(status=F.when(~running | (lease < now), FINAL).otherwise(status), worker=F.when(running & ~(lease < now), worker), lease=F.when(running & ~(lease < now), lease), completed=now, error=F.lit("MAX_ATTEMPTS_REACHED"), refused=s["refused"] + one, last_result=F.lit("max_attempts_reached"))
        exhausted = F.when(running & lease.isNull(), after(refused=s["refused"] + one, last_result=F.lit("max_attempts_reached"))).otherwise(exhausted)
    else:
        live = running & (lease > now) & ~mine
        free = ~done & ~live & (~spent | running)
        exhausted = after(status=F.lit(FINAL), refused=s["refused"] + one, last_result=F.lit("max_attempts_reached"))
    refuse = lambda why: after(refused=s["refused"] + one, last_result=F.lit(why))
    taken = after(status=F.lit(RUNNING), worker=e["worker"], attempt=attempt + one, lease=now + lease_seconds, started=F.coalesce(s["started"], now), completed=none, error=none, claimed=s["claimed"] + one, last_result=F.lit("claimed"))
    claim = F.when(F.coalesce(free, F.lit(False)), taken).when(status == SUCCEEDED, refuse("already_succeeded")).when(status == FINAL, refuse("final_failed")).when(F.coalesce(live, F.lit(False)), refuse("leased_by_another_worker")).when(spent, exhausted).otherwise(refuse("claim_condition_failed"))

    owned = running & mine
    lost = after(rejected=s["rejected"] + one, last_result=F.lit("not_owner"))
    renew = F.when(owned, after(lease=now + lease_seconds, last_result=F.lit("renewed"))).otherwise(lost)
    succeed = F.when(owned, after(status=F.lit(SUCCEEDED), completed=now, lease=none, error=none, last_result=F.lit("succeeded"))).otherwise(lost)
    error = F.substring(e["error"], 1, MAX_ERROR) if strict else e["error"]
    next_status = F.when(e["retryable"] & (attempt < max_attempts), RETRYABLE).otherwise(FINAL)
    fail = F.when(owned, after(status=next_status, completed=now, lease=none, error=error, last_result=next_status)).otherwise(lost)
    return F.when(e["op"] == "claim", claim).when(e["op"] == "renew", renew).when(e["op"] == "succeed", succeed).when(e["op"] == "fail", fail).otherwise(s)


def fold(events: DataFrame, dialect: str = "strict", lease_seconds: float = 7200, max_attempts: int = 3, states: DataFrame | None = None, trace: bool = False) -> DataFrame:
    """events(run_id, clip_id, seq, op, worker, now, retryable, error) -> the last state of each clip; a row a clip.

    Without states all clips start as pending. With states(run_id, clip_id, STATE) these are gone on from: clips without
    events stay as they are; one without a state is inserted by the local dialect, and has none of its events heeded by
    the strict one (no row comes of it). trace adds what came of each event: results(seq, op, result, status, attempt).
    """
    one = F.struct("seq", "op", "worker", F.col("now").cast("double").alias("now"), "retryable", "error")
    clips = events.groupBy("run_id", "clip_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    start = initial()
    if states is not None:
        clips = clips.join(states.select("run_id", "clip_id", F.struct(*[F.col(k).cast(t).alias(k) for k, t in STATE.items()]).alias("s0")), ["run_id", "clip_id"], "full_outer")
        if dialect == "strict":
            clips = clips.where("s0 is not null")
        clips = clips.withColumn("e", F.coalesce("e", F.array().cast(clips.schema["e"].dataType)))
        start = F.coalesce("s0", initial())
    move = lambda s, e: step(s, e, dialect, lease_seconds, max_attempts)
    if not trace:
        return clips.select("run_id", "clip_id", F.aggregate("e", start, move).alias("s")).select("run_id", "clip_id", "s.*")
    seq = events.schema["seq"].dataType.simpleString()
    none = F.array().cast(f"array<struct<seq:{seq},op:string,result:string,status:string,attempt:int>>")

    def traced(acc, e):
        s = move(acc["s"], e)
        came = F.struct(e["seq"].alias("seq"), e["op"].alias("op"), s["last_result"].alias("result"), s["status"].alias("status"), s["attempt"].alias("attempt"))
        return F.struct(s.alias("s"), F.array_append(acc["r"], came).alias("r"))

    out = clips.select("run_id", "clip_id", F.aggregate("e", F.struct(start.alias("s"), none.alias("r")), traced).alias("x"))
    return out.select("run_id", "clip_id", "x.s.*", F.col("x.r").alias("results"))


def succeeded_ids(states: DataFrame, run_id: str) -> DataFrame:
    return of_run(states, run_id, ("clip_id",), (SUCCEEDED,)).distinct()


def of_run(states: DataFrame, run_id: str, columns: tuple[str, ...] | None = None, statuses: tuple[str, ...] = ()) -> DataFrame:
    """A run's rows, only columns and of statuses if asked for: both reach the scan, whose folders are runs if it was written by write_states."""
    out = states.where(F.col("run_id") == run_id)
    out = out.where(F.col("status").isin(*statuses)) if statuses else out
    return out.select(*columns) if columns else out


def state_of(states: DataFrame, run_id: str, clip_id: int) -> DataFrame:
    return states.where((F.col("run_id") == run_id) & (F.col("clip_id") == clip_id))


def write_states(states: DataFrame, path: str) -> None:
    """A folder a run, so that a run's scan reads only its own."""
    states.write.mode("overwrite").partitionBy("run_id").parquet(path)


def stale(states: DataFrame, now: float) -> DataFrame:
    """Running clips whose lease has run out: those that a claim takes over."""
    return states.where((F.col("status") == RUNNING) & (F.col("lease") < now))


def initialise(states: DataFrame, clips: DataFrame) -> DataFrame:
    """states with a pending row for each of clips(run_id, clip_id) that has none."""
    new = clips.select("run_id", "clip_id").distinct().join(states, ["run_id", "clip_id"], "left_anti")
    return states.unionByName(new.withColumn("s", initial()).select("run_id", "clip_id", "s.*"), allowMissingColumns=True)


def import_successes(states: DataFrame, done: DataFrame, now: float, dialect: str = "strict") -> DataFrame:
    """states with done(run_id, clip_id) as succeeded; a completion time that is there stays; strict drops the worker."""
    d = done.select("run_id", "clip_id").distinct().withColumn("_done", F.lit(True))
    out = states.join(d, ["run_id", "clip_id"], "full_outer")
    hit = F.col("_done").eqNullSafe(True)
    return out.withColumns(
        {
            "attempt": F.coalesce("attempt", F.lit(0)),
            "completed": F.when(hit, F.coalesce("completed", F.lit(now))).otherwise(F.col("completed")),
            "worker": F.when(hit & F.lit(dialect == "strict"), F.lit(None)).otherwise(F.col("worker")),
            "lease": F.when(hit, F.lit(None)).otherwise(F.col("lease")),
            "error": F.when(hit, F.lit(None)).otherwise(F.col("error")),
            "status": F.when(hit, SUCCEEDED).otherwise(F.col("status")),
        }
    ).drop("_done")


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("run_id", "status").agg(F.count("*").alias("n"))


def delete_run(states: DataFrame, run_id: str) -> tuple[DataFrame, int]:
    """states without the run, and how many rows it had."""
    return states.where(~F.col("run_id").eqNullSafe(run_id)), states.where(F.col("run_id") == run_id).count()
