"""Video files, pixels in other sizes, flow, written pictures: against plain Python, with files that are broken or writers that fail."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import flow as W
from frameloom.operators import images as I
from frameloom.operators import resample as R
from frameloom.operators.scan import ScanSettings, with_signals
from frameloom.plans import composites as P
from frameloom.sources import staged as D
from frameloom.sources import video as V

FRAME = "video string, frame_index long, gray binary, height int, width int"


def scene(dy, dx, h=72, w=96):
    y, x = np.mgrid[:h, :w].astype(float)
    r, out = np.random.default_rng(5), np.zeros((h, w))
    for _ in range(60):
        fy, fx, p, a = r.normal(0, 0.15), r.normal(0, 0.15), r.uniform(0, 6.3), r.uniform(0.3, 1)
        out += a * np.sin(fy * (y - dy) + fx * (x - dx) + p)
    return np.clip(128 + 14 * out, 0, 255).round().astype(np.uint8)


def frames(spark, n=20, videos=("a", "b/c"), h=72, w=96):
    rows = [(v, i, bytearray(scene(i * (1 + k), -i, h, w).tobytes()), h, w) for k, v in enumerate(videos) for i in range(n)]
    return spark.createDataFrame(rows, FRAME)


def test_headers():
    h = V.parsed_header(b"YUV4MPEG2 W6 H5 F30000:1001 Ip A1:1 C420jpeg XYSCSS=420JPEG\nFRAME\n")
    assert (h.width, h.height, h.colour, h.first, h.step) == (6, 5, "420", 0, 6 + 30 + 2 * 3 * 3) and h.fps == pytest.approx(29.97003)
    assert V.parsed_header(V.header_line(3, 4, 29.97, 7)).first == 7 and V.parsed_header(b"YUV4MPEG2 W1 H1\n").rate == 0
    for bad in (b"", b"RIFF", b"YUV4MPEG2 W6 H5", b"YUV4MPEG2 H5 F1:1\n", b"YUV4MPEG2 W0 H5 F1:1\n", b"YUV4MPEG2 Wx H5 F1:1\n", b"YUV4MPEG2 W6 H5 F1:1 C420p10\n"):
        with pytest.raises(V.BrokenVideo):
            V.parsed_header(bad)


@pytest.mark.parametrize("segment,task", [(None, 10_000), (6, 1 << 20), (7, 20_000)])
def test_frames_round_trip(spark, tmp_path, segment, task, capsys):
    df, path = frames(spark), str(tmp_path / "v")
    V.write_frames(df, path, 12.5, segment)
    got = V.read_frames(spark, path, task_bytes=task)
    assert got.select(*df.columns).exceptAll(df).count() == 0 and got.count() == df.count()
    assert {r.timestamp_sec for r in got.collect()} == {i / 12.5 for i in range(20)}
    assert [(r.video, r.frame_count, r.fps, r.duration_sec, r.error) for r in V.read_metadata(spark, path).orderBy("video").collect()] == [(v, 20, 12.5, 1.6, None) for v in ("a", "b/c")]
    some = V.read_frames(spark, path, ("video", "frame_index"), task_bytes=task).where("frame_index > 3 and frame_index <= 9 and frame_index in (2, 4, 9, 11)")
    some.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(frame_index,3)" in plan and "LessThanOrEqual(frame_index,9)" in plan and "gray" not in plan
    assert sorted(tuple(r) for r in some.collect()) == [(v, i) for v in ("a", "b/c") for i in (4, 9)]
    every = V.read_frames(spark, path, ("frame_index",), candidate_fps=5.0, task_bytes=task)  # 12.5 / 5 is half way: 2
    assert sorted(r.frame_index for r in every.collect()) == sorted([*range(0, 20, 2)] * 2)


def test_colour_video_and_broken_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    planes = [(rng.integers(0, 256, 30, np.uint8).tobytes(), rng.integers(0, 256, 18, np.uint8).tobytes()) for _ in range(5)]
    path = tmp_path / "v"
    path.mkdir()
    (path / "x.y4m").write_bytes(b"YUV4MPEG2 W6 H5 F25:1 C420jpeg\n" + b"".join(b"FRAME\n" + y + uv for y, uv in planes) + b"FRAME\nhalf")
    (path / "empty.y4m").write_bytes(b"YUV4MPEG2 W6 H5 F25:1 Cmono\n")
    got = V.read_frames(spark, str(path)).orderBy("frame_index").collect()
    assert [(r.video, bytes(r.gray)) for r in got] == [("x", y) for y, _ in planes]
    (path / "bad.y4m").write_bytes(b"no video")
    said = {r.video: r for r in V.read_metadata(spark, str(path)).collect()}
    assert said["x"].frame_count == 5 and said["empty"].frame_count == 0 and sum(r.error is not None for r in said.values()) == 1
    with pytest.raises(Exception, match="no header"):
        V.read_frames(spark, str(path)).count()
    (path / "bad.y4m").write_bytes(b"YUV4MPEG2 W6 H5 F0:1 Cmono\n" + b"FRAME\n" + b"x" * 30)
    with pytest.raises(Exception, match="no frame rate"):
        V.read_frames(spark, str(path), candidate_fps=1.0).count()
    assert V.read_frames(spark, str(path), candidate_fps=1.0, missing_fps=24.0).where("video = 'bad'").first().fps == 24


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    path = tmp_path / "v"
    with pytest.raises(Exception, match="doesn't follow"):
        V.write_frames(frames(spark).where("frame_index <> 5"), str(path), 25.0)
    assert not path.exists() or os.listdir(path) == []
    files = spark.createDataFrame([("a/1", bytearray(b"x")), ("b", bytearray(b"yy"))], "path string, content binary")
    D.write_files(files, str(path))
    for bad in (files, files.unionByName(files), files.selectExpr("'../' || path AS path", "content")):
        with pytest.raises(Exception):
            D.write_files(bad.selectExpr("path", "content"), str(path))
        assert sorted(os.listdir(path)) == [D.DONE, "a", "b"] and (path / "a/1").read_bytes() == b"x"
    D.write_files(files.limit(1).selectExpr("'c' AS path", "content"), str(path), overwrite=True)
    assert sorted(os.listdir(path)) == [D.DONE, "c"]


def test_resampling():
    p = np.arange(48).reshape(6, 8)
    assert (R.resample(p, 3, 4, "area") == np.rint(p.reshape(3, 2, 4, 2).mean(axis=(1, 3)))).all()
    for kind in ("area", "linear", "cubic"):
        assert (R.resample(p, 6, 8, kind) == p).all() and (R.resample(np.full((7, 5), 9), 11, 3, kind) == 9).all()
    up = R.resample(np.array([[0, 100]]), 1, 4, "linear")
    assert up.tolist() == [[0, 25, 75, 100]]
    step = R.resample(np.array([[0] * 4 + [200] * 4] * 8), 16, 16, "cubic")
    assert step[0, 0] == 0 and step[0, -1] == 200 and (np.diff(step[3].astype(int)) >= -20).all()
    assert R.kept_shape(1080, 1920, 384) == (216, 384) and R.kept_shape(0, 0, 5) == (0, 0)
    assert abs(np.linalg.norm(R.similarity_vector(p)) - 1) < 1e-9 and not R.similarity_vector(np.full((4, 4), 3)).any()


@pytest.mark.parametrize("shift", [(0, 0), (0.5, 0.25), (1.5, 2.5), (4, -3)])
def test_flow_of_shifts(shift):
    dx, dy = W.polynomial_flow(scene(0, 0, 120, 160), scene(*shift, 120, 160))
    inner = (slice(15, -15),) * 2
    assert np.abs(dx[inner] - shift[1]).mean() < 0.05 and np.abs(dy[inner] - shift[0]).mean() < 0.05
    flat = np.full((40, 40), 7)
    assert not np.any(W.polynomial_flow(flat, flat))


def test_expansion_is_exact_on_quadratics():
    y, x = np.mgrid[-12:13, -12:13].astype(float)
    f = 3 + 2 * x - y + 0.5 * x * x - 0.25 * y * y + 0.125 * x * y
    c = W.expansion(f)[12, 12]
    assert np.allclose(c, [3, 2, -1, 0.5, -0.25, 0.125])


def test_signals_across_segments(spark):
    df = frames(spark, 9)
    whole = {(r.video, r.frame_index): r for r in with_signals(df, ScanSettings(flow_width=96)).collect()}
    parts = {(r.video, r.frame_index): r for r in with_signals(df, ScanSettings(flow_width=96), segment=2).collect()}
    assert whole == parts and len(whole) == 18
    assert whole["a", 0].frame_diff == whole["a", 0].flow_mean == whole["a", 0].flow_score == 0
    assert all(whole["a", i].frame_diff == pytest.approx(np.abs(scene(i, -i).astype(float) - scene(i - 1, 1 - i)).mean()) for i in range(1, 9))
    still = with_signals(df, ScanSettings(flow_width=96, camera=False), F.col("frame_index")).where("video = 'b/c' and frame_index = 4").first()
    assert abs(still.flow_mean - np.hypot(2, 1)) < 0.2 and whole["b/c", 4].flow_mean < 0.2  # the camera's motion is left out


def test_png():
    for shape in ((1, 1), (5, 3), (40, 64)):
        p = np.random.default_rng(3).integers(0, 256, shape, np.uint8)
        back, notes = I.png_picture(I.png(p, "é | note"))
        assert (back == p).all() and notes == "é | note"
    for bad in (b"", b"x" * 30, I.png(p)[:-20], I.png(p).replace(b"IHDR", b"IHDX")):
        with pytest.raises(I.BrokenImage):
            I.png_picture(bad)
    sheet = I.contact_sheet([np.full((9, 16), k * 10, np.uint8) for k in range(5)], 32)
    assert sheet.shape == (40 + 2 * (18 + 58), 128) and sheet[40, 32] == 10 and sheet[40 + 76, 0] == 40 and sheet[0, 0] == 255


def test_sampler_from_files_to_files(spark, tmp_path):
    V.write_frames(frames(spark, 30), str(tmp_path / "v"), 10.0, 8)
    out = P.sample_videos(spark, str(tmp_path / "v"), str(tmp_path / "o"), 5.0, scan=ScanSettings(flow_width=96), num_frames=4, min_gap_sec=0.2, sheet_width=48)
    got = {r.clip_id: r for r in out.collect()}
    assert {c: (r.num_candidates, r.selected_count) for c, r in got.items()} == {"a": (15, 4), "b/c": (15, 4)}
    for clip, r in got.items():
        folder = tmp_path / "o" / clip
        names = [f.image_file for f in r.selected_frames]
        assert sorted(os.listdir(folder)) == sorted([*names, "selected_frames.json", f"{clip[-1]}_contact_sheet.png"])
        k = 1 if clip == "a" else 2
        for f, name in zip(r.selected_frames, names):
            assert (I.png_picture((folder / name).read_bytes())[0] == scene(f.frame_index * k, -f.frame_index)).all()
    fixed = P.write_fixed_keyframes(spark, str(tmp_path / "v"), str(tmp_path / "f"), 5)
    assert {r.clip_id: r.n_frames for r in fixed.collect()} == {"a": 5, "b/c": 5}
