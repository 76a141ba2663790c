"""Queries on video files, pixels and written pictures: embeddings are images of 8 x 8, a label's images a video."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.operators import evaluation as E
from frameloom.operators import flow as W
from frameloom.operators import images as I
from frameloom.operators.resample import pixels_of, resized_pixels, with_vectors
from frameloom.operators.scan import ScanSettings, with_signals
from frameloom.plans import composites as P
from frameloom.plans.workers import LAPLACE, PIXELS, pixels
from frameloom.sources import video as V
from frameloom.sources.folders import scratch
from frameloom.sources.staged import write_files

QUERIES, ORACLES = {}, {}


def query(sql: str, views: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH RECURSIVE {VIDEO}{', ' + views if views else ''} {sql}"
        return f

    return add


VIDEO = (
    PIXELS
    + """, vf AS (SELECT printf('clip_%04d', clip_id) AS video, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY vec_id) - 1 AS BIGINT) AS i, 24 + 6 * (clip_id % 3) AS fps, vec_id, g, b FROM g1),
pv AS (SELECT video, i, fps, vec_id, y, x, g[y * 8 + x + 1] AS px FROM vf, range(8) a(y), range(8) c(x))"""
)


def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame_index, gray binary, height, width, fps, vec_id)."""
    p = pixels(spark, sf_dir)
    place = (F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_index")) - 1).cast("long")
    gray = F.unhex(F.array_join(F.transform("gray", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return p.select(F.format_string("clip_%04d", "clip_id").alias("video"), place.alias("frame_index"), gray.alias("gray"), "height", "width", (24 + 6 * (F.col("clip_id") % 3)).alias("fps"), F.col("frame_index").alias("vec_id"))


def written(spark: SparkSession, sf_dir: str, segment: int | None = 16, fps=None) -> str:
    path = f"{scratch(spark, 'video')}/v"
    V.write_frames(video_frames(spark, sf_dir), path, F.col("fps") if fps is None else fps, segment)
    return path


def total(gray: str = "gray") -> F.Column:
    """The sum of a picture's bytes, each by its place from 1: from its hex digits."""
    h = F.hex(gray)
    at = lambda k: F.conv(F.substring(h, 2 * k + F.lit(1), F.lit(2)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.octet_length(gray) - 1), F.lit(0).cast("long"), lambda s, k: s + (k + 1) * at(k))


SUM = "CAST(list_sum(list_transform(range(64), lambda k: (k + 1) * g[k + 1])) AS BIGINT)"


@query(f"SELECT video, i AS frame_index, round(i / fps::DOUBLE, 6) AS timestamp_sec, CAST(8 AS INTEGER) AS height, {SUM} AS total FROM vf")
def q_video_frames(spark, sf_dir):
    f = V.read_frames(spark, written(spark, sf_dir), task_bytes=512)
    return f.select("video", "frame_index", F.round("timestamp_sec", 6).alias("timestamp_sec"), "height", total().alias("total"))


@query("SELECT video, CAST(any_value(fps) AS DOUBLE) AS fps, CAST(count(*) AS BIGINT) AS frame_count, 8 AS width, round(count(*) / any_value(fps)::DOUBLE, 6) AS duration_sec FROM vf GROUP BY 1")
def q_video_headers(spark, sf_dir):
    return V.read_metadata(spark, written(spark, sf_dir)).select("video", "fps", "frame_count", "width", F.round("duration_sec", 6).alias("duration_sec"))


@query(f"SELECT video, i AS frame_index, round(i / fps::DOUBLE, 6) AS timestamp_sec, {SUM} AS total FROM vf WHERE i % CAST(greatest(1, round_even(fps / 5e0, 0)) AS BIGINT) = 0")
def q_video_candidates(spark, sf_dir):
    """Every step-th frame, step by each video's own rate."""
    f = V.read_frames(spark, written(spark, sf_dir), candidate_fps=5.0)
    return f.select("video", "frame_index", F.round("timestamp_sec", 6).alias("timestamp_sec"), total().alias("total"))


@query("SELECT video, i AS frame_index, round(i / 25e0, 6) AS timestamp_sec FROM vf WHERE i % 12 = 0")
def q_video_missing_fps(spark, sf_dir):
    """Files that tell no frame rate: another stands in for it."""
    f = V.read_frames(spark, written(spark, sf_dir, None, 0.0), ("video", "frame_index", "timestamp_sec"), 2.0, 25.0)
    return f.select("video", "frame_index", F.round("timestamp_sec", 6).alias("timestamp_sec"))


@query(f"SELECT video, i AS frame_index, {SUM} AS total FROM vf WHERE i BETWEEN 10 AND 29")
def q_video_range(spark, sf_dir):
    """A range of frames, which the reader seeks to."""
    f = V.read_frames(spark, written(spark, sf_dir, None), ("video", "frame_index", "gray"), task_bytes=1024)
    return f.where("frame_index between 10 and 29").select("video", "frame_index", total().alias("total"))


# --- other sizes


@query("""SELECT vec_id, CAST(sum((j * 5 + k + 1) * v) AS BIGINT) AS total FROM (SELECT vec_id, j, k, round_even(sum(px * greatest(0, least((j + 1) * 8, (y + 1) * 3) - greatest(j * 8, y * 3)) * greatest(0, least((k + 1) * 8, (x + 1) * 5) - greatest(k * 8, x * 5))) / 64e0, 0) AS v
FROM pv, range(3) r(j), range(5) s(k) GROUP BY ALL) GROUP BY 1""")
def q_resized_area(spark, sf_dir):
    f = video_frames(spark, sf_dir)
    return f.select("vec_id", resized_pixels("gray", "height", "width", 3, 5, "area").alias("small")).select("vec_id", total("small").alias("total"))


def linear_axis(n: int) -> str:
    """(k, tap, w): the two taps of n values made of 8, in parts of 2 n."""
    at = f"((2 * k + 1) * 8 - {n})"
    low = f"CAST(floor({at} / {2 * n}e0) AS BIGINT)"
    return f"SELECT k, greatest(0, least(7, {low} + t)) AS tap, CASE t WHEN 0 THEN {2 * n} - ({at} - {low} * {2 * n}) ELSE {at} - {low} * {2 * n} END AS w FROM range({n}) r(k), range(2) s(t)"


LINEAR = f"""ax AS ({linear_axis(160)}), ay AS ({linear_axis(90)}), hx AS (SELECT vec_id, y, k, sum(px * w) AS s FROM pv JOIN ax ON x = tap GROUP BY ALL),
big AS (SELECT vec_id, hx.k AS x, ay.k AS y, round_even(sum(s * w) / {4 * 160 * 90}e0, 0) AS v FROM hx JOIN ay ON hx.y = tap GROUP BY ALL), od AS (SELECT vec_id, video, i FROM vf)"""


@query(
    """SELECT o.video, o.i AS frame_index, round(coalesce(avg(abs(n.v - p.v)), 0), 6) AS frame_diff FROM od o LEFT JOIN od q ON q.video = o.video AND q.i = o.i - 1
LEFT JOIN big n ON n.vec_id = o.vec_id LEFT JOIN big p ON p.vec_id = q.vec_id AND p.x = n.x AND p.y = n.y GROUP BY ALL""",
    LINEAR,
)
def q_diff_160x90(spark, sf_dir):
    """The first sampler's difference of frames, in 160 x 90."""
    f = with_signals(video_frames(spark, sf_dir).drop("fps", "vec_id"), ScanSettings(flow=False, diff_shape=(90, 160)), segment=7)
    return f.select("video", "frame_index", F.round("frame_diff", 6).alias("frame_diff"))


CUBIC = """cr AS (SELECT k, i, abs(i - ((k + 0.5) * 0.25) + 0.5) AS d FROM range(32) r(k), range(8) s(i) WHERE i >= greatest(0, trunc((k + 0.5) * 0.25 - 1.5)) AND i < least(8, trunc((k + 0.5) * 0.25 + 2.5))),
cw AS (SELECT k, i AS tap, floor(c / sum(c) OVER (PARTITION BY k) * 4194304 + 0.5) AS w FROM (SELECT k, i, CASE WHEN d < 1 THEN (1.5e0 * d - 2.5e0) * d * d + 1 WHEN d < 2 THEN ((-0.5e0 * d + 2.5e0) * d - 4) * d + 2 ELSE 0e0 END AS c FROM cr)),
c1 AS (SELECT vec_id, y, k, greatest(0, least(255, floor(sum(px * w) / 4194304 + 0.5))) AS s FROM pv JOIN cw ON x = tap GROUP BY ALL),
c2 AS (SELECT vec_id, c1.k AS x, cw.k AS y, greatest(0, least(255, floor(sum(s * w) / 4194304 + 0.5))) AS v FROM c1 JOIN cw ON c1.y = tap GROUP BY ALL),
ls AS (SELECT vec_id, list(v ORDER BY y, x) AS v FROM c2 GROUP BY 1)"""


@query("SELECT vec_id, CAST(sum((y * 32 + x + 1) * v) AS BIGINT) AS total FROM c2 GROUP BY 1", CUBIC)
def q_resized_cubic(spark, sf_dir):
    f = video_frames(spark, sf_dir)
    return f.select("vec_id", resized_pixels("gray", "height", "width", 32, 32, "cubic").alias("large")).select("vec_id", total("large").alias("total"))


@query(
    """SELECT video, i AS frame_index, round(CASE WHEN p.v IS NULL THEN 0e0 ELSE coalesce((SELECT corr(a, c) FROM (SELECT unnest(n.v) AS a, unnest(p.v) AS c)), 0e0) END, 6) AS similarity
FROM vf o JOIN ls n USING (vec_id) LEFT JOIN (SELECT video, i + 1 AS i, v FROM vf JOIN ls USING (vec_id)) p USING (video, i)""",
    CUBIC,
)
def q_near_dup_pixels(spark, sf_dir):
    """Likeness of frames to the one before, from their pixels in 32 x 32."""
    f = video_frames(spark, sf_dir).select(F.col("video").alias("clip_id"), F.col("frame_index").cast("double").alias("timestamp"), F.col("frame_index").cast("string").alias("frame_id"), "gray", "height", "width")
    f = with_vectors(f)
    out = E.with_similarity(f)
    return out.select(F.col("clip_id").alias("video"), F.col("timestamp").cast("long").alias("frame_index"), F.round("similarity", 6).alias("similarity"))


EXPANSION = """gs AS (SELECT t, exp(-t * t / 2.88e0) / sum(exp(-t * t / 2.88e0)) OVER () AS w FROM range(-5, 6) r(t)), mm AS (SELECT sum(w * t * t) AS m2, sum(w * t * t * t * t) AS m4 FROM gs),
mo AS (SELECT vec_id, y, x, sum(v) AS m00, sum(v * t1) AS m10, sum(v * t2) AS m01, sum(v * t1 * t1) AS m20, sum(v * t2 * t2) AS m02, sum(v * t1 * t2) AS m11
FROM (SELECT vec_id, y, x, ga.t AS t1, gb.t AS t2, ga.w * gb.w * g[greatest(0, least(7, y + gb.t)) * 8 + greatest(0, least(7, x + ga.t)) + 1] AS v FROM vf, range(8) p(y), range(8) q(x), gs ga, gs gb) GROUP BY ALL),
co AS (SELECT vec_id, y * 8 + x + 1 AS p, m10 / m2 AS lx, m01 / m2 AS ly, m11 / (m2 * m2) AS xy, (m20 - m2 * m00) / (m4 - m2 * m2) AS xx, (m02 - m2 * m00) / (m4 - m2 * m2) AS yy FROM mo, mm)"""


@query("SELECT vec_id, round(sum(p * lx), 3) AS lx, round(sum(p * ly), 3) AS ly, round(sum(p * xx), 3) AS xx, round(sum(p * yy), 3) AS yy, round(sum(p * xy), 3) AS xy FROM co GROUP BY 1", EXPANSION)
def q_expansion(spark, sf_dir):
    """Quadratic fits around each pixel, which optical flow is solved from."""

    def sums(g):
        place = np.arange(1, 65)
        rows = [[float(place @ W.expansion(pixels_of(x, 8, 8))[..., k].ravel()) for k in range(1, 6)] for x in g]
        return pd.DataFrame(rows, columns=["lx", "ly", "xx", "yy", "xy"])

    f = video_frames(spark, sf_dir).select("vec_id", F.pandas_udf(sums, "lx double, ly double, xx double, yy double, xy double")("gray").alias("e"))
    return f.select("vec_id", *[F.round(f"e.{c}", 3).alias(c) for c in ("lx", "ly", "xx", "yy", "xy")])


@query(f"""SELECT video, i AS frame_index, round(list_avg(g), 6) AS brightness, CAST(round(list_aggregate({LAPLACE}, 'var_pop') * 4096, 0) AS BIGINT) AS sharpness, round(CASE WHEN b IS NULL THEN 0 ELSE list_avg(list_transform(range(64), lambda i: abs(g[i + 1] - b[i + 1]))) END, 6) AS frame_diff,
round(CASE WHEN b IS NULL THEN 0 ELSE sqrt(greatest(0, 1 - list_sum(list_transform(range(64), lambda k: sqrt(len(list_filter(g, lambda v: v // 4 = k)) * len(list_filter(b, lambda v: v // 4 = k))))) / 64)) END, 6) AS hist_diff FROM vf""")
def q_scanned_video(spark, sf_dir):
    """Signals of every frame, from the file, in segments of ten frames."""
    frames = V.read_frames(spark, written(spark, sf_dir), ("video", "frame_index", "gray", "height", "width"))
    f = with_signals(frames, ScanSettings(flow=False), segment=10)
    return f.select("video", "frame_index", F.round("brightness", 6).alias("brightness"), F.round(F.col("sharpness") * 4096).cast("long").alias("sharpness"), F.round("frame_diff", 6).alias("frame_diff"), F.round("hist_diff", 6).alias("hist_diff"))


# --- written pictures


def read_pictures(spark: SparkSession, path: str, names: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("clip"), F.element_at(F.split("path", "/"), -1).alias("name"), I.decoded("content").alias("p"))


CHOSEN = "ch AS (SELECT *, CAST(row_number() OVER (PARTITION BY video ORDER BY i) - 1 AS INTEGER) AS o FROM vf WHERE i % 5 = 0)"


def chosen(spark, sf_dir):
    f = video_frames(spark, sf_dir).where("frame_index % 5 = 0")
    order = (F.row_number().over(Window.partitionBy("video").orderBy("frame_index")) - 1).cast("int")
    return f.select(F.col("video").alias("clip_id"), order.alias("frame_order"), F.col("frame_index").cast("int").alias("frame_index"), (F.col("frame_index") / F.col("fps")).alias("timestamp_sec"), F.lit("chosen").alias("selected_reason"), (1 / (1 + F.col("frame_index"))).alias("combined_score"), "gray", "height", "width")


@query(f"SELECT video AS clip, printf('%02d_t%07.3f_f%d.png', o, round_even(i / fps::DOUBLE, 3), i) AS name, 8 AS height, {SUM} AS total FROM ch", CHOSEN)
def q_written_pictures(spark, sf_dir):
    path = scratch(spark, "pictures")
    write_files(I.keyframe_files(chosen(spark, sf_dir)), path)
    return read_pictures(spark, path, "*_t*_f*.png").select("clip", "name", "p.height", total("p.gray").alias("total"))


@query("""SELECT clip, columns * 8 AS width, 40 + rows * 66 AS height, n AS labels, CAST(255 * (columns * 8 * (40 + rows * 66) - 64 * n) + total AS BIGINT) AS total
FROM (SELECT video AS clip, least(4, count(*)) AS columns, CAST(ceil(count(*) / least(4, count(*))) AS BIGINT) AS rows, count(*) AS n, sum(list_sum(g)) AS total FROM ch GROUP BY 1)""", CHOSEN)
def q_contact_sheets(spark, sf_dir):
    path = scratch(spark, "sheets")
    write_files(I.keyframe_files(chosen(spark, sf_dir), width=8), path)
    p = read_pictures(spark, path, "*_contact_sheet.png").select("clip", "p.*")
    value = F.aggregate(F.split(F.regexp_replace(F.hex("gray"), "(..)(?!$)", "$1 "), " "), F.lit(0).cast("long"), lambda s, x: s + F.conv(x, 16, 10).cast("long"))
    return p.select("clip", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.size(F.split("notes", "\n")).cast("long").alias("labels"), value.alias("total"))


@query("""SELECT video AS clip_id, count(*) AS num_candidates, CAST(least(8, count(*)) AS INTEGER) AS selected_count, 'no_optical_flow' AS dynamic_category, least(8, count(*)) + 2 AS n_files FROM vf WHERE i % CAST(greatest(1, round_even(fps / 12e0, 0)) AS BIGINT) = 0 GROUP BY 1""")
def q_sampled_videos(spark, sf_dir):
    """From files to files: candidates read, scanned and chosen, their pictures, sheets and records written."""
    out = scratch(spark, "sampled")
    clips = P.sample_videos(spark, written(spark, sf_dir), out, 12.0, scan=ScanSettings(flow=False), min_gap_sec=0.1, sheet_width=16)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,json}").load(out)
    count = files.groupBy(F.element_at(F.split("path", "/"), -2).alias("clip_id")).agg(F.count("*").alias("n_files"))
    return clips.join(count, "clip_id").select("clip_id", "num_candidates", "selected_count", "dynamic_category", "n_files")


@query("""SELECT video AS clip_id, CAST(count(*) AS INTEGER) AS n_frames FROM (SELECT video, max(i) + 1 AS n FROM vf GROUP BY 1), range(8) r(k) GROUP BY 1""")
def q_fixed_pictures(spark, sf_dir):
    return P.write_fixed_keyframes(spark, written(spark, sf_dir, None), scratch(spark, "fixed"))
