"""Job states kept by the stream, versioned tables, retries of a worker, and one-pass reading."""

import time

import pytest
from pyspark.sql import functions as F

from frameloom.operators import inference as I
from frameloom.operators import jobstate as Z
from frameloom.operators import shards as R
from frameloom.sources import jsonl as S
from frameloom.sources import snapshots as N
from frameloom.streaming import leases as L

EVENT = "run_id string, clip_id long, seq long, op string, worker string, now double, retryable boolean, error string"


def events(n=60, clips=5):
    ops = ("claim", "renew", "claim", "fail", "claim", "succeed", "nothing", "fail")
    return [("r", i * 7 % clips, i, ops[(i * 5 + i // 3) % 8], "ab"[i * 3 % 4 // 2], 100.0 + i * 9.5, i % 5 != 0, f"E{i}") for i in range(n)]


@pytest.mark.parametrize("dialect", ["strict", "local"])
def test_transitions_are_those_of_the_fold(spark, dialect):
    rows = events(400, 9)
    names = [x.split(" ")[0] for x in EVENT.split(", ")]
    states = {}
    for r in rows:
        states[r[1]] = L.advance(states.get(r[1], L.initial()), dict(zip(names, r)), dialect, 40, 4)
    want = {r.clip_id: tuple(r[k] for k in Z.STATE) for r in Z.fold(spark.createDataFrame(rows, EVENT), dialect, 40, 4).collect()}
    assert {c: tuple(s[k] for k in Z.STATE) for c, s in states.items()} == want


def test_states_and_timers_of_a_stream(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    L.with_rocks(spark)
    try:
        rows, now = events(30, 3), time.time()
        rows += [("r", 50, 100, "claim", "w", now, True, None), ("r", 51, 101, "claim", "w", now + 3600, True, None)]
        files, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
        told = []

        def run(total):
            source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(files)
            out = L.keep_leases(source, "strict", 1, 4).writeStream.outputMode("update").foreachBatch(lambda b, _: told.extend(b.collect()))
            query = out.option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()  # with timers there is always another batch
            try:
                until = time.time() + 100
                while len([r for r in told if r.result != L.LAPSED]) < total and time.time() < until and query.isActive:
                    time.sleep(0.5)
            finally:
                query.stop()

        for part in (rows[:15], rows[15:]):
            spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").json(files)
        run(len(rows))
        time.sleep(1.5)
        more = [("r", 52, 102, "claim", "w", now, True, None)]
        spark.createDataFrame(more, EVENT).coalesce(1).write.mode("append").json(files)
        run(len(rows) + 1)
        want = Z.fold(spark.createDataFrame(rows + more, EVENT), "strict", 1, 4)
        got = L.stored_states(spark, checkpoint)
        assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
        assert len([r for r in told if r.result != L.LAPSED]) == len(rows) + 1
        lapsed = {r.clip_id for r in told if r.result == L.LAPSED}
        assert 50 in lapsed and 51 not in lapsed
    finally:
        spark.conf.set(provider, before)


def test_competing_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("01", "a", 1)], "run_id string, status string, n int")
    assert N.commit(one, path, None) == 0
    first, version = N.read(spark, path)
    assert N.commit(first.selectExpr("run_id", "status", "n + 1 AS n"), path, version) == 1
    with pytest.raises(N.Conflict):
        N.commit(first.selectExpr("run_id", "status", "n + 10 AS n"), path, version)
    assert N.update(spark, path, lambda df: df.selectExpr("run_id", "status", "n + 10 AS n")) == 2
    assert [tuple(r) for r in N.read(spark, path)[0].collect()] == [("01", "a", 12)] and [tuple(r) for r in N.read(spark, path, 1)[0].collect()] == [("01", "a", 2)]
    tried = []

    def late(df):
        if not tried:
            tried.append(N.commit(df.selectExpr("run_id", "status", "n + 100 AS n"), path, 2))
        return df.selectExpr("run_id", "status", "n + 1000 AS n")

    assert N.update(spark, path, late) == 4 and N.read(spark, path)[0].first().n == 1112
    plan = N.read(spark, path)[0].where("run_id = 'x' and status = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert N.drop_old(spark, path, 2) == 3 and N.versions(spark, path) == [3, 4] and N.read(spark, path)[1] == 4
    with pytest.raises(FileNotFoundError):
        N.read(spark, path, 0)


def test_a_retry_by_the_same_worker_succeeds(spark, tmp_path):
    frame = "struct<frame_order: int, timestamp_sec: double, combined_score: double, image_path: string>"
    manifest = spark.createDataFrame([(i, [(0, 0.0, 1.0, "p")]) for i in range(3)], f"clip_id int, selected_frames array<{frame}>")
    nothing = spark.createDataFrame([], "clip_id int, error string, json_parse_ok boolean")
    states = spark.createDataFrame([("r", i) for i in range(3)], "run_id string, clip_id int").withColumn("s", Z.initial()).select("run_id", "clip_id", "s.*")
    log = str(tmp_path / "log")

    def failing():
        def model(record, frames):
            raise RuntimeError("not yet")

        return model

    for attempt in (1, 2):
        outputs, states = I.run_claimed(manifest, nothing, states, failing, "w", "r", log, 100.0 * attempt)
        assert {(r.status, r.attempt, r.last_result) for r in states.collect()} == {(Z.RETRYABLE, attempt, Z.RETRYABLE)} and outputs.count() == 3
    outputs, states = I.run_claimed(manifest, nothing, states, lambda: lambda record, frames: '{"clip_id": 1}', "w", "r", log, 300.0)
    assert {(r.status, r.attempt, r.last_result) for r in states.collect()} == {(Z.SUCCEEDED, 3, "succeeded")}
    assert outputs.count() == 3 and spark.read.parquet(log).count() == 9


def test_strict_reading_scans_once(spark, tmp_path):
    path = str(tmp_path / "m")
    S.write_jsonl(spark.range(5000).select(F.col("id").alias("clip_id")), path, ["clip_id"])
    out = S.read_strict(spark, path, "clip_id long")
    assert [r.clip_id for r in out.collect()] == list(range(5000)) and out.columns == ["file", "clip_id"]
    text = spark.read.text(path)
    S.write_jsonl(spark.range(3).select(F.lit(1).alias("clip_id")), str(tmp_path / "twice"))
    with pytest.raises(S.BadLine, match=r"repeated clip_id: \[1\]"):
        S.read_strict(spark, str(tmp_path / "twice"), "clip_id long")
    assert text.count() == 5000 and S.read_strict(spark, str(tmp_path / "twice"), "clip_id long", unique=False).count() == 3
    (tmp_path / "e").mkdir()
    (tmp_path / "e/x.jsonl").write_text("\n \n")
    for bad, why in ((str(tmp_path / "e"), "no lines"), (str(tmp_path / "none"), "no lines")):
        with pytest.raises(S.BadLine, match=why):
            S.read_strict(spark, bad, "clip_id long")


def test_buckets_join_without_an_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(200).select(F.col("id").alias("clip_id"))
        attempts = ids.where("clip_id % 3 = 0").withColumn("error", F.lit(None).cast("string")).withColumn("json_parse_ok", F.col("clip_id") % 2 == 0)
        left = R.remaining(R.bucketed(ids, str(tmp_path / "m"), 4), R.bucketed(attempts, str(tmp_path / "a"), 4))
        assert sorted(r.clip_id for r in left.collect()) == [i for i in range(200) if i % 6]
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan and "LeftAnti" in plan
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
