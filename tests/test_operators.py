"""Selection, timeline, shards, merging, evaluation and job states: golden rows and independent re-implementations."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frameloom.operators import evaluation as E
from frameloom.operators import jobstate as Z
from frameloom.operators import merge as M
from frameloom.operators import selection as K
from frameloom.operators import shards as R
from frameloom.operators import timeline as T

FRAME = "clip_id int, frame_index int, timestamp_sec double, combined_score double"


def picked(df):
    return [(r.clip_id, r.frame_index, r.selected_reason) for r in df.orderBy("clip_id", "frame_order").collect()]


def slow_selection(frames, n, gap, duration):
    """A plain version of the choice, for one clip; frames in order of time."""
    if len(frames) <= n:
        return [(i, "all_candidates_used") for i, _, _ in frames]
    taken = {}
    for target, why in ((0.0, "temporal_anchor_start"), (duration / 2, "temporal_anchor_middle"), (max(0.0, duration - 0.2), "temporal_anchor_end")):
        free = [f for f in frames if f[0] not in taken]
        if len(taken) < n and free:
            best = min(free, key=lambda f: (abs(f[1] - target), f[1]))
            taken[best[0]] = (best[1], why)
    for why, near in (("high_content_score", gap), ("high_content_score_gap_relaxed", None)):
        for i, t, _ in sorted(frames, key=lambda f: (-f[2], f[1])):
            if len(taken) < n and i not in taken and (near is None or all(abs(t - x) >= near for x, _ in taken.values())):
                taken[i] = (t, why)
    return [(i, why) for i, (t, why) in sorted(taken.items(), key=lambda x: x[1][0])]


def test_selection_against_plain_version(spark):
    r = random.Random(1)
    clips = {c: sorted((round(r.uniform(0, 12), 2), round(r.random(), 2)) for _ in range(r.choice([0, 3, 8, 9, 40]))) for c in range(40)}
    rows = [(c, i, t, s) for c, fs in clips.items() for i, (t, s) in enumerate(fs)]
    rows = [x for x in rows if len({t for t, _ in clips[x[0]]}) == len(clips[x[0]])]
    got = picked(K.select_keyframes(spark.createDataFrame(rows, FRAME), min_gap_sec=1.5))
    want = []
    for c in sorted({x[0] for x in rows}):
        frames = [(i, t, s) for k, i, t, s in rows if k == c]
        want += [(c, i, why) for i, why in slow_selection(frames, 8, 1.5, max(t for _, t, _ in frames))]
    assert got == want


def test_selection_golden_rows(spark):
    few = spark.createDataFrame([(1, i, float(i), 0.5) for i in range(3)], FRAME)
    assert picked(K.select_keyframes(few)) == [(1, i, "all_candidates_used") for i in range(3)]
    gap = spark.createDataFrame([(1, 0, 1.0, 0.9), (1, 1, 1.5, 0.8), (1, 2, 5.0, 0.7)], FRAME)
    none = {"anchor_start": False, "anchor_middle": False, "anchor_end": False}
    assert [i for _, i, _ in picked(K.select_keyframes(gap, num_frames=2, **none))] == [0, 2]
    near = spark.createDataFrame([(1, i, i / 10, 1 - i / 10) for i in range(4)], FRAME)
    assert picked(K.select_keyframes(near, num_frames=2, **none))[1][2] == "high_content_score_gap_relaxed"
    dark = spark.createDataFrame([(1, i, float(i), 0.0 if i == 2 else 1.0) for i in range(5)], FRAME)
    assert (1, 2, "temporal_anchor_middle") in picked(K.select_keyframes(dark, num_frames=3))
    v1 = gap.withColumn("brightness", F.when(F.col("frame_index") == 0, 1.0).otherwise(50.0))
    assert [i for _, i, _ in picked(K.select_keyframes_v1(v1, num_frames=2))] == [1, 2]
    assert [r.frame_index for r in K.choose_keyframes(dark.withColumn("frame_order", F.col("frame_index")), 2).orderBy("position").collect()] == [0, 1]


def test_timeline_and_positions(spark):
    clips = spark.createDataFrame([(3, 0, 20.0), (1, 1, 20.0), (2, 2, 19.5), (4, 3, None)], "clip_id int, line int, duration_sec double")
    assert [r.start_sec for r in T.running_starts(clips).orderBy("clip_id").collect()] == [0.0, 20.0, 39.5, 59.5]
    many = spark.range(500).select((F.col("id") * 7 % 503).cast("int").alias("clip_id"), F.col("id").cast("int").alias("line"), (F.col("id") % 13).cast("double").alias("duration_sec"))
    key = lambda df: sorted((r.clip_id, r.start_sec, r.end_sec) for r in df.collect())
    assert key(T.running_starts(many)) == key(T.running_starts(many, ranges=8))
    assert sorted((r.clip_id, r.position) for r in R.positions(many).collect()) == sorted((r.clip_id, r.position) for r in R.positions(many, ranges=8).collect())
    shard = R.assigned(spark.createDataFrame([(5,), (9,), (11,)], "clip_id int"), 2, 0)
    assert sorted(r.clip_id for r in shard.collect()) == [5, 11]


def test_checks_and_completeness(spark):
    records = spark.createDataFrame([(1,), (2,), (2,)], "clip_id int")
    with pytest.raises(R.MissingClips, match="2"):
        R.checked(records)
    with pytest.raises(R.MissingClips, match="7"):
        R.requested(records, spark.createDataFrame([(7,)], "clip_id int"))
    done = spark.createDataFrame([(1, None), (2, "x")], "clip_id int, error string")
    say = lambda ids: R.step_complete(spark.createDataFrame([(i,) for i in ids], "clip_id int"), done).first().reason
    assert (say([1]), say([1, 2]), say([1, 2, 3]), say([])) == ("complete", "1 failed", "1 missing", "no clips")
    log = spark.createDataFrame([(1, 0, None, True), (1, 3, None, True), (2, 1, "e", True), (3, 2, None, None)], "clip_id int, line int, error string, json_parse_ok boolean")
    assert [r.clip_id for r in R.remaining(records, log).distinct().collect()] == [2]
    assert [(r.clip_id, r.line) for r in R.latest_success(log).collect()] == [(1, 3)]


def test_merge_ranking(spark):
    rows = [(1, None, True, "2024-01-01T09:00:00", 1, "a"), (1, "e", False, "2024-01-02T09:00:00", 2, "a"), (2, None, True, "2024-01-01T10:00:00+05:00", 1, "a"), (2, None, True, "2024-01-01T09:00:00Z", 2, "a"), (3, None, True, "junk", 1, "b"), (3, None, True, None, 1, "a")]
    df = spark.createDataFrame(rows, "clip_id int, error string, json_parse_ok boolean, f string, line int, file string").withColumn("finished", M.finished_time(F.col("f")))
    best = {r.clip_id: r for r in M.best_records(df).collect()}
    assert best[1].error is None and best[2].line == 1 and best[3].file == "a" and best[3].finished == datetime(1, 1, 1)
    s = M.merge_summary(df, M.best_records(df), spark.createDataFrame([(1,), (2,), (9,)], "clip_id int")).first()
    assert (s.duplicate_ids, s.missing_ids, s.unexpected_ids, s.complete, s.selected) == ([1, 2, 3], [9], [], False, 2)
    planned = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, size int, digest string")
    there = spark.createDataFrame([("a", 1, "x"), ("b", 2, "q"), ("c", 9, "z")], "path string, size int, digest string")
    assert sorted((r.path, r.reuse) for r in M.reusable(planned, there).collect()) == [("a", True), ("b", False), ("c", False)]
    assert sorted(r.path for r in M.reusable(planned, there, verify=False).where("reuse").collect()) == ["a", "b"]
    assert sorted(r.path for r in M.to_upload(planned, there).collect()) == ["c"]
    assert M.without_internal(df.withColumn("_aggregation_line", F.lit(1))).columns == df.columns


def test_quality_and_coverage(spark):
    f = spark.createDataFrame([(1, None, None, None, 0.99), (2, 79.9, 4.2, 25.0, 0.96), (3, 80.0, 4.1, 236.0, 0.5), (4, None, 5.0, 100.0, None)], "id int, sharpness double, entropy double, brightness double, similarity double")
    got = {r.id: (r.blurry, r.low_entropy, r.dark_or_bright, r.duplicate, r.low_info, r.low_info_reason) for r in E.with_flags(f).collect()}
    assert got == {1: (1, 1, 1, 0, 1, "missing image"), 2: (1, 0, 0, 1, 1, "blurry; near duplicate"), 3: (0, 1, 1, 0, 1, "low entropy; too dark/bright"), 4: (0, 0, 0, 0, 0, "")}
    events = spark.createDataFrame([(1, 3.0), (1, 9.0)], "clip_id int, timestamp double")
    keys = spark.createDataFrame([(1, 4.0), (2, 1.0)], "clip_id int, timestamp double")
    assert {r.clip_id: (r.n_events, r.n_covered, r.coverage) for r in E.motion_coverage(events, keys).collect()} == {1: (2, 1, 0.5), 2: (0, 0, None)}
    flat = spark.createDataFrame([(1, 5.0)] * 4, "clip_id int, score double")
    assert E.motion_events(flat).count() == 4
    v = spark.createDataFrame([(1, 1.0, "a", [1.0, 0.0]), (1, 2.0, "b", None), (1, 3.0, "c", [2.0, 0.0])], "clip_id int, timestamp double, frame_id string, vector array<double>")
    assert [r.similarity for r in E.with_similarity(v).orderBy("timestamp").collect()] == [0.0, 0.0, 1.0]
    assert E.comparison(spark.createDataFrame([("fixed", 1.0)], "version string, m double"), ["m"]).count() == 0


EVENTS = "run_id string, clip_id long, seq long, op string, worker string, now double, retryable boolean, error string"


def fold(spark, events, dialect="strict", attempts=3, lease=100.0):
    rows = [("r", 1, i, op, w, float(now), bool(retry), "x" * 5000) for i, (op, w, now, retry) in enumerate(events)]
    return Z.fold(spark.createDataFrame(rows, EVENTS), dialect, lease, attempts).first()


def test_job_state_scenario(spark):
    s = fold(spark, [("claim", "a", 0, 0), ("claim", "b", 1, 0), ("fail", "a", 2, 1), ("claim", "b", 3, 0), ("succeed", "b", 4, 0), ("claim", "a", 5, 0)])
    assert (s.status, s.attempt, s.claimed, s.refused, s.last_result, s.started, s.error) == ("SUCCEEDED", 2, 2, 2, "already_succeeded", 0.0, None)
    s = fold(spark, [("claim", "a", 0, 0), ("fail", "a", 1, 1), ("claim", "a", 2, 0), ("fail", "a", 3, 1)], attempts=2)
    assert s.status == "FINAL_FAILED" and len(s.error) == 4000
    assert fold(spark, [("claim", "a", 0, 0), ("succeed", "b", 1, 0)]).last_result == "not_owner"


@pytest.mark.parametrize(
    "events, attempts, strict, local",
    [
        ([("claim", "a", 0, 0), ("claim", "a", 1, 0)], 3, ("leased_by_another_worker", 1), ("claimed", 2)),
        ([("claim", "a", 0, 0), ("claim", "b", 100, 0)], 3, ("leased_by_another_worker", 1), ("claimed", 2)),
        ([("claim", "a", 0, 0), ("claim", "b", 200, 0)], 1, ("max_attempts_reached", 1), ("claimed", 2)),
        ([("claim", "a", 0, 0), ("claim", "b", 200, 0)], 3, ("claimed", 2), ("claimed", 2)),
    ],
)
def test_job_state_dialects(spark, events, attempts, strict, local):
    for dialect, want in (("strict", strict), ("local", local)):
        s = fold(spark, events, dialect, attempts)
        assert (s.last_result, s.attempt) == want


def slow_step(s, op, worker, now, retryable, lease_seconds, max_attempts):
    """The strict dialect by hand, on a dict; says what came of the event."""
    now = float(int(now // 1))
    live = s["status"] == "RUNNING" and (s["lease"] or 0) >= now
    if op == "claim":
        expired = s["status"] == "RUNNING" and s["lease"] is not None and s["lease"] < now
        if (s["status"] in ("PENDING", "RETRYABLE_FAILED") or expired) and s["attempt"] < max_attempts:
            s.update(status="RUNNING", worker=worker, attempt=s["attempt"] + 1, lease=now + lease_seconds, started=s["started"] if s["started"] is not None else now)
            return "claimed"
        if s["status"] in ("SUCCEEDED", "FINAL_FAILED"):
            return "already_succeeded" if s["status"] == "SUCCEEDED" else "final_failed"
        if live:
            return "leased_by_another_worker"
        if s["attempt"] >= max_attempts:
            if s["status"] != "RUNNING" or expired:
                s.update(status="FINAL_FAILED", worker=None, lease=None)
            return "max_attempts_reached"
        return "claim_condition_failed"
    if s["status"] != "RUNNING" or s["worker"] != worker:
        return "not_owner"
    if op == "renew":
        s["lease"] = now + lease_seconds
        return "renewed"
    if op == "succeed":
        s.update(status="SUCCEEDED", lease=None)
        return "succeeded"
    s.update(status="RETRYABLE_FAILED" if retryable and s["attempt"] < max_attempts else "FINAL_FAILED", lease=None)
    return s["status"]


def test_fold_against_single_steps(spark):
    r = random.Random(3)
    rows = [("r", c, i, r.choice(["claim", "claim", "renew", "succeed", "fail"]), r.choice("ab"), float(i * 40), r.random() < 0.7, "e") for c in range(30) for i in range(25)]
    got = {x.clip_id: (x.status, x.attempt, x.last_result) for x in Z.fold(spark.createDataFrame(rows, EVENTS), "strict", 100.0, 3).collect()}
    for c in range(30):
        s = {"status": "PENDING", "worker": None, "attempt": 0, "lease": None, "started": None}
        for _, k, _, op, w, now, retry, _ in rows:
            if k == c:
                last = slow_step(s, op, w, now, retry, 100.0, 3)
        assert got[c] == (s["status"], s["attempt"], last)


def test_states_tables(spark):
    clips = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, clip_id long")
    empty = Z.fold(spark.createDataFrame([], EVENTS))
    states = Z.initialise(empty, clips)
    assert Z.initialise(states, clips).count() == 2
    done = Z.import_successes(states, spark.createDataFrame([("r", 2), ("r", 3)], "run_id string, clip_id long"), 5.0)
    assert sorted((r.clip_id, r.status, r.completed) for r in done.collect()) == [(1, "PENDING", None), (2, "SUCCEEDED", 5.0), (3, "SUCCEEDED", 5.0)]
    assert {r.status: r.n for r in Z.status_counts(done).collect()} == {"PENDING": 1, "SUCCEEDED": 2}
    left, n = Z.delete_run(done, "r")
    assert (left.count(), n) == (0, 3)
