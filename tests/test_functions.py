"""Golden rows of scalar functions, JSON cleaning and paths."""

import pytest
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.functions import jsontext as J
from frameloom.operators import evaluation as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("seconds, text", [(0.0005, "00:00:00.000"), (0.0015, "00:00:00.002"), (360000.0, "100:00:00.000"), (3661.2345, "01:01:01.234"), (0.0, "00:00:00.000")])
def test_format_time(spark, seconds, text):
    assert one(spark, C.format_time(F.lit(seconds))) == text


def test_scales(spark):
    assert one(spark, C.clip_scale(F.lit(60.0), 40.0)) == 1.0 and one(spark, C.clip_scale(F.lit(-1.0), 40.0)) == 0.0
    assert one(spark, C.min_max(F.lit(5.0), F.lit(5.0), F.lit(5.0))) == 0.0
    assert one(spark, C.brightness_score(F.lit(17.9))) == 0.0
    assert one(spark, C.brightness_score(F.lit(18.0))) == pytest.approx(1 - 92 / 110)
    assert one(spark, C.combined_score(*[F.lit(1.0)] * 3, 0.25, F.lit(1.0), F.lit(1.0), F.lit(10.0))) == pytest.approx(0.2)
    assert one(spark, C.flow_score(F.lit(80.0), F.lit(80.0), F.lit(1.0))) == 1.0
    assert [one(spark, C.adaptive_flow_weight(F.lit(x)).getField("label")) for x in (0.19, 0.2, 0.45)] == ["static_or_dialogue_heavy", "moderately_dynamic", "motion_heavy"]


@pytest.mark.parametrize(
    "path, clip, frame, time",
    [
        ("D:\\x\\EP01-Clip-0007\\00_t003.250_f78.jpg", "ep01_clip_0007", "frame_00001", 3.25),
        ("/a/clip_003/frame_12.jpg", "clip_003", "frame_00012", 1.0),
        ("/a/Some.Video.mp4", "some.video", "frame_00001", 1.0),
        ("/a/img-9_2.5s.png", "img-9_2.5s", "frame_00009", 2.5),
        ("/a/.hidden", ".hidden", "frame_00001", 1.0),
    ],
)
def test_paths(spark, path, clip, frame, time):
    p = F.lit(path)
    assert one(spark, C.normalize_clip_id(p)) == clip
    slashed = F.lit(path.replace("\\", "/"))
    assert one(spark, C.frame_id(slashed, F.lit(1))) == frame and one(spark, C.path_timestamp(slashed, F.lit(1))) == time


def test_small_helpers(spark):
    assert one(spark, C.percent(F.lit(0.0025))) == "0.2%" and one(spark, C.percent(F.lit(None).cast("double"))) == "N/A" and one(spark, C.percent(F.lit(float("nan")))) == "N/A"
    assert one(spark, C.parse_clip_ids(F.lit("1, 3,,7 "))) == [1, 3, 7]
    assert one(spark, C.store_uri(F.lit("S3://b/k/x.jpg"))).asDict() == {"bucket": "b", "key": "k/x.jpg"} and one(spark, C.store_uri(F.lit("s3://b/"))) is None
    assert one(spark, C.clip_number(F.lit("ep_clip-0012.mp4"), F.lit(5))) == 12 and one(spark, C.clip_number(F.lit("x.mp4"), F.lit(5))) == 5
    assert one(spark, C.number_before_suffix(F.lit("ab12.mp4"))) == 12
    assert one(spark, C.frame_file_name(F.lit(3), F.lit(3.25), F.lit(78))) == "03_t003.250_f78.jpg"
    assert one(spark, C.evenly_spaced(F.lit(5), 3)) == [0, 2, 4] and one(spark, C.evenly_spaced(F.lit(5), 1)) == [2] and one(spark, C.evenly_spaced(F.lit(2), 4)) == [0, 0, 1, 1]
    assert one(spark, C.thinning_step(F.lit(25.0), 2.0)) == 12 and one(spark, C.thinning_step(F.lit(0.5), 2.0)) == 1
    assert one(spark, C.kept_rows(F.lit(100), 0.12)) == 88 and one(spark, C.kept_rows(F.lit(1), 0.9)) == 1
    v = F.array(F.lit(3.0), F.lit(5.0))
    assert one(spark, C.centred(v)) == pytest.approx([-(0.5**0.5), 0.5**0.5]) and one(spark, C.centred(F.array(F.lit(2.0), F.lit(2.0)))) == [0.0, 0.0]
    assert one(spark, C.cosine(v, v)) == pytest.approx(1.0) and one(spark, C.cosine(v, F.lit(None).cast("array<double>"))) == 0.0
    assert one(spark, E.entropy(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)))) == pytest.approx(-2 * (0.5 * 256 / 255) * __import__("math").log2(0.5 * 256 / 255))


@pytest.mark.parametrize(
    "raw, text, ok",
    [
        ('```json\n{"a": 1}\n``` and so on', '{"a": 1}', True),
        ('{"a":1} and }', '{"a":1} and }', False),
        ('{"a":1,"b":[1,2', '{"a":1,"b":[1,2', False),
        (' {"a": NaN} ', '{"a": NaN}', True),
        ("no braces", "no braces", False),
        ("} {", "} {", False),
    ],
)
def test_model_json(spark, raw, text, ok):
    df = spark.createDataFrame([(raw,)], "raw string").select(J.brace_bounded(F.col("raw")).alias("t"))
    r = df.select("t", J.json_ok("t").alias("ok")).first()
    assert (r.t, r.ok) == (text, ok)


def test_texts_of_nested_values(spark):
    df = spark.createDataFrame([(1,)], "id int").select(F.from_json(F.lit('{"events": [{"action": "a", "objects": ["x", "y"]}, null, {"scene": "s"}]}'), J.MODEL_JSON).alias("j"))
    assert df.select(J.stringify_events(F.col("j.events")).alias("x")).first().x == "action=a; objects=x, y; scene= | action=; objects=; scene=s"
    assert spark.range(1).select(J.stringify_events(F.lit(None).cast(f"array<{J.EVENT}>")).alias("x")).first().x == ""
    frames = F.array(F.struct(F.lit("00:00:01.000").alias("local_timestamp"), F.lit(None).cast("string").alias("global_timestamp"), F.lit("anchor").alias("selected_reason"), F.lit(None).cast("double").alias("combined_score"), F.lit("p.jpg").alias("image_path")))
    assert one(spark, J.frame_lines(frames)) == "Frame 00: local_time=00:00:01.000, global_time=, selection_reason=anchor, content_score=unknown"
    parts = one(spark, J.messages(frames, F.lit("prompt")))
    assert [(p.type, p.image, p.text) for p in parts] == [("image", "p.jpg", None), ("text", None, "prompt")]
