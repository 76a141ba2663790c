"""Readers, listings, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from frameloom.sources import files as L
from frameloom.sources import jsonl as S
from frameloom.streaming import jobs

RECORD = "clip_id int, error string"


def test_jsonl_readers(spark, tmp_path):
    p = tmp_path / "worker_0.jsonl"
    p.write_text('﻿{"clip_id": 2, "error": null}\n\n{"clip_id": 1} junk\nnot json\n{"error": "x"}\n{"clip_id": 1, "error": "e"}\n')
    records, counts = S.read_tolerant(spark, str(p), RECORD)
    assert sorted((r.file, r.line_num, r.clip_id, r.error) for r in records.collect()) == [("worker_0.jsonl", 1, 2, None), ("worker_0.jsonl", 6, 1, "e")]
    assert tuple(counts.first()) == (2, 3)
    with pytest.raises(S.BadLine):
        S.read_strict(spark, str(p), RECORD)
    good = tmp_path / "m.jsonl"
    good.write_text('{"clip_id": 2}\n{"clip_id": 1}\n')
    assert [r.clip_id for r in S.read_strict(spark, str(good), RECORD).collect()] == [1, 2]
    good.write_text('{"clip_id": 2}\n{"clip_id": 2}\n')
    with pytest.raises(S.BadLine, match="repeated"):
        S.read_strict(spark, str(good), RECORD)
    assert S.read_tolerant(spark, str(tmp_path / "none"), RECORD)[1].first().valid == 0


def test_jsonl_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é")], RECORD)
    S.write_jsonl(df, str(tmp_path / "o"), ["clip_id"])
    text = next((tmp_path / "o").glob("part-*")).read_text()
    assert [json.loads(x) for x in text.splitlines()] == [{"clip_id": 1, "error": "é"}, {"clip_id": 2, "error": None}] and "é" in text
    for _ in range(2):
        S.append_attempts(df.withColumn("shard", F.lit(0)), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    S.write_tables({"a": df, "b": df}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/b")).count() == 2
    L.write_csv(df, str(tmp_path / "c"), ["clip_id"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["clip_id"]
    log = spark.createDataFrame([(1, 0, None, True), (1, 1, None, True), (2, 0, "e", False)], "clip_id int, line int, error string, json_parse_ok boolean")
    S.compact_successes(log, str(tmp_path / "k"))
    assert [(r.clip_id, r.line) for r in spark.read.json(str(tmp_path / "k")).collect()] == [(1, 1)]


def test_listings(spark, tmp_path):
    for name in ("b/clip_002.mp4", "a/ep01-clip-0001.MOV", "a/x.txt", "k/clip_7/frame_2_t1.5.jpg", "k/clip_7/frame_1_t0.5.png", ".cache/y.bin", "a/.cache/z.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    assert [r.clip_id for r in L.scan_clips(spark, str(tmp_path)).collect()] == ["clip_002", "ep01_clip_0001"]
    assert [(r.clip_id, r.frame_id, r.timestamp) for r in L.scan_keyframes(spark, str(tmp_path / "k")).collect()] == [("clip_7", "frame_00001", 0.5), ("clip_7", "frame_00002", 1.5)]
    assert L.find_videos(spark, str(tmp_path / "b")).count() == 1 and L.listing(spark, str(tmp_path / "none")).count() == 0
    bundle = {r.relative_path: (r.size_bytes, len(r.sha256)) for r in L.bundle_manifest(spark, str(tmp_path)).collect()}
    assert bundle["a/x.txt"] == (7, 64) and not any(".cache" in p for p in bundle)


def test_summaries(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"clip_id": "clip-01", "summary": "one"}, {"clip_id": 0, "id": "clip_7", "caption": "c"}, {"clip": "0", "summary": ""}, {"summary": "lost"}, "text"]')
    (tmp_path / "map.json").write_text('{"clip_02": {"summary": "two"}, "clip_03": "three"}')
    (tmp_path / "l.jsonl").write_text('{"video_path": "/x/clip_05.mp4", "output": "o"}\nbad\n[1]\n')
    (tmp_path / "s.csv").write_text('﻿Clip_ID,Summary\nclip_08,"a, b"\nclip_06,\n')
    (tmp_path / "d").mkdir()
    (tmp_path / "d/clip_09.txt").write_text("  text \n")
    read = lambda name, kind: [tuple(r) for r in L.scan_summaries(spark, str(tmp_path / name), kind).collect()]
    assert read("list.json", "json") == [("0", ""), ("clip_01", "one"), ("clip_7", "c")]
    assert read("map.json", "json") == [("clip_02", "two"), ("clip_03", "three")]
    assert read("l.jsonl", "jsonl") == [("clip_05", "o")]
    assert read("s.csv", "csv") == [("clip_06", ""), ("clip_08", "a, b")]
    assert read("d", "folder") == [("clip_09", "text")]
    with pytest.raises(ValueError):
        read("d", "other")
    assert L.read_csv(spark, str(tmp_path / "s.csv"), ("Clip_ID",)).columns == ["Clip_ID", "Summary"]
    with pytest.raises(ValueError):
        L.read_csv(spark, str(tmp_path / "s.csv"), ("none",))


def test_job_state_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "run_id string, clip_id long, seq long, op string, worker string, now double, retryable boolean"
    write = lambda name, rows: (src / name).write_text("\n".join(json.dumps(dict(zip(("run_id", "clip_id", "seq", "op", "worker", "now", "retryable"), r))) for r in rows))
    write("1.json", [("r", 1, 0, "claim", "a", 0.0, False), ("r", 1, 1, "claim", "b", 1.0, False), ("r", 2, 2, "claim", "b", 1.0, False)])
    write("2.json", [("r", 1, 3, "fail", "a", 2.0, True), ("r", 1, 4, "claim", "b", 3.0, False), ("r", 1, 5, "succeed", "b", 4.0, False)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    kept = str(tmp_path / "kept")
    for _ in range(2):
        q = stream.writeStream.foreachBatch(jobs.state_keeper(kept)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {r.seq: (r.result, r.status, r.attempt) for r in jobs.results(spark, kept).collect()}
        assert got[0] == ("claimed", "RUNNING", 1) and got[1][0] == "leased_by_another_worker" and got[2][0] == "claimed"
        write("3.json", [("r", 2, 6, "claim", "c", 1e6, False)])
    states = {r.clip_id: (r.status, r.attempt, r.worker) for r in jobs.current_states(spark, kept).collect()}
    assert got[5] == ("succeeded", "SUCCEEDED", 2) and states == {1: ("SUCCEEDED", 2, "b"), 2: ("RUNNING", 2, "c")}
