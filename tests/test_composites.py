"""Signals, model calls, workers and composed pipelines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators.flow import polynomial_flow
from frameloom import config
from frameloom.operators import inference as I
from frameloom.operators import signals as G
from frameloom.plans import composites as P


def slow_sharpness(g):
    p = np.pad(g.astype(float), 1, mode="reflect")
    return (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var()


def test_signals_against_numpy(spark):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (5, 7)) for _ in range(3)]
    df = spark.createDataFrame([(1, i, g.ravel().tolist(), 5, 7) for i, g in enumerate(images)], "clip_id int, frame_index int, gray array<int>, height int, width int")
    for r in G.with_frame_signals(df).collect():
        g = images[r.frame_index]
        assert r.brightness == pytest.approx(g.mean()) and r.sharpness == pytest.approx(slow_sharpness(g))
        if r.frame_index:
            before = images[r.frame_index - 1]
            a, b = (np.histogram(x, 64, (0, 256))[0] for x in (g, before))
            assert r.frame_diff == pytest.approx(np.abs(g - before).mean())
            assert r.hist_diff == pytest.approx(np.sqrt(1 - np.sqrt(a * b).sum() / np.sqrt(a.sum() * b.sum())))
        else:
            assert r.frame_diff == r.hist_diff == 0
    a, b = [1.0, 2.0, 4.0], [2.0, 1.0, 7.0]
    d = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(G.correlation_distance(F.col("a"), F.col("b"))).first()[0]
    assert d == pytest.approx(1 - np.corrcoef(a, b)[0, 1])


def test_flow_finds_shifts(spark):
    y, x = np.mgrid[:48, :64].astype(float)
    scene = lambda dy, dx: 128 + 60 * np.sin((x - dx) / 5) * np.cos((y - dy) / 7) + 40 * np.sin((x - dx + y - dy) / 9)
    dx, dy = polynomial_flow(scene(0, 0), scene(1.5, 2.5))
    assert abs(np.median(dx) - 2.5) < 0.2 and abs(np.median(dy) - 1.5) < 0.2
    rows = [(1, i, float(i), np.rint(scene(i, 2 * i)).astype(int).ravel().tolist(), 48, 64) for i in range(3)]
    df = spark.createDataFrame(rows, "clip_id int, frame_index int, timestamp double, gray array<int>, height int, width int")
    got = {r.timestamp: r.score for r in G.motion_scores(df).collect()}
    assert got[0.0] == 0 and abs(got[1.0] - np.hypot(1, 2)) < 0.3 and abs(got[2.0] - np.hypot(1, 2)) < 0.3
    assert all(r.flow.mean < 0.3 for r in G.with_flow(df).collect())  # the camera's motion is left out
    one = spark.createDataFrame([(bytearray([0, 0, 255] * 3 + [10, 10, 10]), 2, 2)], "data binary, h int, w int")
    hist = one.select(G.hue_saturation_histogram("data", "h", "w")).first()[0]
    assert len(hist) == 960 and hist[31] == 1.0 and hist[0] == pytest.approx(1 / 3)


@pytest.fixture
def loader():
    def load():
        def model(record, frames):
            if record["clip_id"] == 2 and len(frames) > 2:
                raise MemoryError("too many")
            if record["clip_id"] == 3:
                raise RuntimeError("broken")
            return f'```json\n{{"clip_id": {record["clip_id"]}, "summary": "{",".join(frames)}"}}\n```'

        return model

    return load


def test_worker_resumes_and_recovers(spark, loader):
    frame = "array<struct<frame_order:int,timestamp_sec:double,combined_score:double,image_path:string>>"
    rows = [(c, [(i, float(9 - i), i / 10, f"p{i}") for i in range(4)] if c < 5 else []) for c in range(1, 6)]
    manifest = spark.createDataFrame(rows, f"clip_id int, selected_frames {frame}")
    none = spark.createDataFrame([], "clip_id int, error string, json_parse_ok boolean")
    raw = I.infer(manifest.select("clip_id", F.col("selected_frames.image_path").alias("frames")), loader, fewer=2)
    first = {r.clip_id: r for r in raw.collect()}
    assert (first[2].frames_used, first[2].note, first[3].error_type, first[5].error) == (2, "retried with 2 frames", "RuntimeError", "no usable frames")
    out = I.run_worker(manifest, none, loader, "w", most_frames=3)
    got = {r.clip_id: r for r in out.collect()}
    assert got[1].json_parse_ok and got[1].parsed_json.summary == "p3,p2,p1" and not got[3].json_parse_ok and got[3].parsed_json is None
    again = I.run_worker(manifest, out, loader, "w")
    assert sorted(r.clip_id for r in again.select("clip_id").collect()) == [2, 3, 5]
    half = I.run_worker(manifest, none, loader, "w", shards=2, shard=1)
    assert sorted(r.clip_id for r in half.select("clip_id").collect()) == [2, 4]
    review = I.review_rows(out).where("clip_id = 1").first()
    assert review.model_summary == "p3,p2,p1" and review.human_notes == ""


def test_manifest_and_cloud_run(spark):
    frame = "array<struct<timestamp_sec:double,image_path:string>>"
    records = spark.createDataFrame([("clip_0002.mp4", 0, 19.5, [(1.5, "a/b.jpg")]), ("clip_0001.mp4", 1, 20.0, [(0.0, "c.jpg"), (2.0, "s3://x/y.jpg")]), ("odd.mp4", 7, None, None)], f"clip_file string, line int, duration_sec double, selected_frames {frame}")
    m = P.build_manifest(records)
    got = {r.clip_id: r for r in m.collect()}
    assert got[2].actual_start_time == "00:00:20.000" and got[2].selected_frames[0].global_timestamp == "00:00:21.500" and got[7].selected_frame_count == 0 and got[7].start_sec == got[7].end_sec == 39.5
    moved, uploads, counts = P.prepare_cloud_run(m, "s3://run", spark.createDataFrame([("s3://run/clip_0001/00_c.jpg",)], "target string"))
    assert [tuple(r) for r in uploads.collect()] == [("a/b.jpg", "s3://run/clip_0002/00_b.jpg")] and tuple(counts.first()) == (3, 3)
    assert [r.clip_id for r in P.remaining_manifest(m, spark.createDataFrame([(2, None, True)], "clip_id int, error string, json_parse_ok boolean")).collect()] == [1, 7]
    files = spark.createDataFrame([("a/config.json", 1, "x")], "path string, size int, digest string")
    assert P.bundle_plan(files, files).first().reuse
    with pytest.raises(ValueError):
        P.bundle_plan(files, files, "missing")


def test_evaluations(spark):
    keys = spark.createDataFrame([("c1", "f1", 1.0, "p1"), ("c1", "f2", 2.0, "p2"), ("c1", "f3", 3.0, "gone"), ("c2", "f1", 1.0, "p1"), (None, "f", 1.0, "p1"), ("c3", "f1", 1.0, "p1")], "clip_id string, frame_id string, timestamp double, frame_path string")
    gray = [int(x) for x in np.random.default_rng(2).integers(0, 256, 64)]
    images = spark.createDataFrame([("p1", gray, 8, 8), ("p2", gray, 8, 8)], "frame_path string, gray array<int>, height int, width int")
    got = {(r.clip_id, r.frame_id): r for r in P.evaluate_keyframes(keys, images, "fixed").collect()}
    assert len(got) == 5 and got["c1", "f2"].duplicate == 1 and got["c1", "f1"].duplicate == 0 and got["c1", "f3"].low_info_reason == "missing image"
    motion = spark.createDataFrame([("c1", 1.5, 5.0), ("c1", 8.0, 5.0), ("c2", 9.0, 1.0)], "clip_id string, timestamp double, score double")
    paths = spark.createDataFrame([("c1",), ("c3",)], "clip_id string")
    out = {r.clip_id: (r.n_events, r.n_covered, r.coverage, r.note) for r in P.evaluate_motion_coverage(keys.where("clip_id is not null"), motion, paths, "fixed").collect()}
    assert out == {"c1": (2, 1, 0.5, ""), "c2": (None, None, None, "clip video not found"), "c3": (0, 0, None, "no motion data")}


def test_config():
    c = config.WorkerConfig(run_id="r", shards=2, shard=1).checked()
    assert c.worker_id == "r-shard-1-of-2" and c.output_path() == "out/worker_1_of_2.jsonl"
    for bad in ({"shards": 0}, {"shard": 1}, {"lease_seconds": 0}, {"shared_state": True, "force": True, "run_id": "r"}, {"shared_state": True}):
        with pytest.raises(ValueError):
            config.WorkerConfig(**bad).checked()
    env = {"FL_SHARDS": "3", "AWS_BATCH_JOB_ARRAY_INDEX": "2", "FL_SHARED_STATE": "Yes", "FL_FORCE": "no", "FL_OUTPUT": " "}
    c = config.from_text(config.WorkerConfig, env, "FL_", run_id="r")
    assert (c.shards, c.shard, c.shared_state, c.force, c.output, c.run_id) == (3, 2, True, False, "out", "r")
    assert config.from_text(config.WorkerConfig, env, "FL_", shard=0).shard == 0

    @config.dataclass(frozen=True)
    class Needs:
        name: "str"
        size: "int" = 1

    with pytest.raises(ValueError, match="NAME"):
        config.from_text(Needs, {"NAME": ""})
    assert config.from_text(Needs, {"NAME": "x", "SIZE": "4"}) == Needs("x", 4)
