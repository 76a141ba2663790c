"""Queries on tables larger than the smallest, or of larger keys: results against SQL, and what one task or one call holds."""

import os

import duckdb
import pytest
from held import DATA, TABLES, assert_same

from frameloom.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def tables(folder, **changed):
    """DATA in a folder of its own, some tables made anew from SELECT ... FROM t."""
    con = duckdb.connect()
    for t in TABLES:
        if t in changed:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
            con.sql(f"COPY ({changed[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{DATA}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def test_extracted_json_of_five_digit_ids(spark, tmp_path):
    data = tables(tmp_path, conversations="SELECT * REPLACE (conv_id + 9990 AS conv_id) FROM conversations")
    for name in ("q_json_extract", "q_json_ok", "q_stringify_events"):
        assert_same(spark, registry.QUERIES[name], registry.ORACLES[name], data)


def test_lines_are_written_by_several_tasks_and_numbered_through(spark, tmp_path):
    from frameloom.plans import files
    from frameloom.sources import jsonl as S

    data = tables(tmp_path, orders="SELECT * REPLACE (o_orderkey + 1500 * i AS o_orderkey) FROM orders, range(40) r(i)")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        found = files.lines(spark, data)
    finally:
        spark.conf.unset(setting)
    parts = spark.read.text(found).select("_metadata.file_name").distinct().count()
    assert parts > 1  # no task has sorted all of them
    last = lambda together: [r[0] for r in S.read_lines(spark, found, together).groupBy("file").agg({"line_num": "max"}).select("max(line_num)").collect()]
    assert len(last(True)) == len(last(False)) == parts and max(last(False)) < max(last(True)) <= 60000
    for name in ("q_line_numbers", "q_jsonl_tolerant", "q_jsonl_counts"):
        assert_same(spark, registry.QUERIES[name], registry.ORACLES[name], data)


def test_clips_are_made_once_for_their_running_starts(spark):
    from pyspark.sql import functions as F

    from frameloom.operators import timeline as T

    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    clips = spark.range(0, 5000, 1, 2).select(F.col("id").alias("clip_id"), F.col("id").alias("line"), F.lit(2.0).alias("duration_sec")).mapInArrow(passed, "clip_id long, line long, duration_sec double")
    out = T.running_starts(clips, 16)
    assert out.where("start_sec = clip_id * 2").count() == 5000
    assert seen.value == 10000  # ids and durations, then the clips themselves


def test_small_ranges_of_videos_share_a_task():
    from frameloom.sources.video import Range, together

    ranges = [Range(f"v/{i // 3}", 1500, 500 * (i % 3), 500 * (i % 3) + 500) for i in range(3000)]
    parts = together(ranges, 32 << 20)
    assert len(parts) < 30 and [r for p in parts for r in p.found] == ranges
    large = [Range("v", 1 << 30, i << 25, (i + 1) << 25) for i in range(32)]
    assert [p.found for p in together(large, 32 << 20)] == [[r] for r in large]


def test_vectors_come_in_small_batches(spark):
    import numpy as np

    from frameloom.operators import resample as R

    gray = np.random.default_rng(1).integers(0, 256, (700, 64)).astype(np.uint8)
    rows = [(i, None if i == 300 else gray[i].tobytes(), 8, 8) for i in range(700)]
    out = R.with_vectors(spark.createDataFrame(rows, "id long, gray binary, height int, width int").coalesce(1))
    assert out.columns == ["id", "vector"]
    for r in out.collect():
        assert r.vector is None if r.id == 300 else r.vector == R.similarity_vector(gray[r.id].reshape(8, 8)).tolist()


def test_a_sheet_is_not_held_whole():
    import tracemalloc

    import numpy as np

    from frameloom.operators import images as I

    pages = [np.full((8, 8), k % 256, np.uint8) for k in range(240)]
    tracemalloc.start()
    made = I.png_of_bands(*I.sheet_bands(pages, 320))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # the sheet is of 29 MB
    assert np.array_equal(I.png_picture(made)[0], I.contact_sheet(pages, 320))


def test_paths_of_frames_are_dealt_by_their_number(spark):
    from pyspark.sql import functions as F

    from frameloom.operators import timeline as T

    path = lambda i: F.when(i % 10 > 0, F.concat(F.lit("p"), (i / 2).cast("int")))
    manifest = spark.range(1000).select(F.array(*[F.struct(path(F.col("id") * 4 + k).alias("image_path")) for k in range(4)]).alias("selected_frames"))
    present = spark.range(3000).select(path(F.col("id")).alias("image_path"))
    out = T.frame_sources(manifest, present, 700)
    assert "hashpartitioning(image_path#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan  # 7000 rows
    assert tuple(out.first()) == (4000, 2000, 400 + 900)  # null is no path and isn't there
    assert tuple(T.frame_sources(manifest.where("false"), present).first()) == (0, 0, 0)


def test_names_of_keyframes_are_made_once(spark):
    from frameloom.sources import files as L

    rows = [("/d/Keyframe_7_t3.5.jpg",), ("/d/img-9_2.50s.png",), ("/d/time3_t2.png",), ("/d/a/b_ts4.png",), ("/d/image12.png",)]
    out = L.keyframe_rows(spark.createDataFrame(rows, "path string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count(r"[^.]*$") <= 2  # in clip_id and for all numbers
    got = {r.frame_path: (r.frame_id, r.timestamp) for r in out.collect()}
    assert [got[p] for (p,) in rows] == [("frame_00007", 3.5), ("frame_00009", 2.5), ("frame_00001", 2.0), ("frame_00001", 4.0), ("frame_00012", 1.0)]


def test_few_answers_are_held_at_once(spark):
    from frameloom.operators import inference as I

    def loader():
        import gc

        # answers that are still alive when the model is asked
        return lambda record, frames: str(sum(isinstance(x, tuple) and len(x) == 9 and x[5:6] == (None,) for x in gc.get_objects()))

    rows = [(i, ["f"]) for i in range(2000)]
    out = I.infer(spark.createDataFrame(rows, "clip_id int, frames array<string>").coalesce(1), loader).collect()
    assert sorted(r.clip_id for r in out) == [i for i, _ in rows] and max(int(r.raw_output) for r in out) < 600
