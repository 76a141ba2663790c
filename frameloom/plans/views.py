"""The driver's tables seen as frames, clips and attempts: as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a clip's frames, a day played in a second."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), "event_id", F.col("event_type").alias("kind"), "value", micros("ts").alias("us"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    first = F.min("us").over(Window.partitionBy("clip_id"))
    index = F.row_number().over(Window.partitionBy("clip_id").orderBy("us", "event_id")) - 1
    e = e.withColumns({"timestamp_sec": (F.col("us") - first) / F.lit(8.64e10), "frame_index": index})
    return e.select("clip_id", "event_id", "kind", "value", "timestamp_sec", "frame_index", (F.col("value") % 256).alias("brightness"), (F.col("value") * 2).alias("sharpness"), (F.col("k") / 100).alias("flow_score"), (F.col("k") / 200).alias("motion_area"))


FRAMES = """
r0 AS (SELECT user_id AS clip_id, event_id, event_type AS kind, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
raw AS (SELECT clip_id, event_id, kind, value, (us - min(us) OVER (PARTITION BY clip_id)) / 8.64e10 AS timestamp_sec,
        CAST(row_number() OVER (PARTITION BY clip_id ORDER BY us, event_id) - 1 AS INTEGER) AS frame_index,
        value % 256 AS brightness, value * 2 AS sharpness, k / 100 AS flow_score, k / 200 AS motion_area FROM r0),
f AS (SELECT *, coalesce(abs(value - lag(value) OVER w), 0.0) AS frame_diff, CASE WHEN kind <> lag(kind) OVER w THEN 0.5e0 ELSE 0.0e0 END AS hist_diff
      FROM raw WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index)),
sc AS (SELECT *, least(greatest(frame_diff, 0e0), 40e0) / 40e0 AS motion_score, least(greatest(hist_diff, 0e0), 0.8e0) / 0.8e0 AS hist_diff_score,
       least(greatest(sharpness, 0e0), 800e0) / 800e0 AS sharpness_score,
       CASE WHEN brightness < 18 THEN 0e0 ELSE greatest(0e0, 1 - least(abs(brightness - 110e0) / 110e0, 1e0)) END AS brightness_score FROM f),
dy0 AS (SELECT clip_id, 0.35e0 * quantile_cont(flow_score, 0.75) + 0.25e0 * avg(flow_score) + 0.20e0 * avg(motion_area) + 0.10e0 * least(greatest(avg(frame_diff) / 35e0, 0e0), 1e0) + 0.10e0 * least(greatest(avg(hist_diff) / 0.5e0, 0e0), 1e0) AS d FROM f GROUP BY clip_id),
dy AS (SELECT clip_id, least(greatest(d, 0e0), 1e0) AS dynamic_score,
       CASE WHEN d < 0.20e0 THEN 0.05e0 WHEN d < 0.45e0 THEN 0.15e0 ELSE 0.25e0 END AS weight,
       CASE WHEN d < 0.20e0 THEN 'static_or_dialogue_heavy' WHEN d < 0.45e0 THEN 'moderately_dynamic' ELSE 'motion_heavy' END AS label FROM dy0),
co AS (SELECT sc.*, weight, (0.30e0 * hist_diff_score + 0.25e0 * motion_score + weight * flow_score + 0.10e0 * sharpness_score + 0.10e0 * brightness_score) * CASE WHEN brightness < 18 THEN 0.2e0 ELSE 1e0 END AS combined_score
       FROM sc JOIN dy USING (clip_id))
"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clips: as long as the quantities of their lines, line by line a frame."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id")).agg(F.sum("l_quantity").alias("duration_sec"), F.count("*").alias("n_frames"))
    return lines.withColumn("line", F.col("clip_id"))


CLIPS = "cl AS (SELECT l_orderkey AS clip_id, sum(l_quantity) AS duration_sec, count(*) AS n_frames FROM lineitem GROUP BY 1)"


def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as frames: the line's place as order, a quarter second for each unit of its tax and discount as time."""
    li = table(spark, sf_dir, "lineitem")
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return li.select(
        F.col("l_orderkey").alias("clip_id"), order.alias("frame_order"), (F.col("l_partkey") % 1000).cast("int").alias("frame_index"), F.round(F.col("l_quantity") / 4, 3).alias("timestamp_sec"), F.col("l_returnflag").alias("selected_reason"),
        F.round(F.col("l_discount") * 5 + F.col("l_tax"), 6).alias("combined_score"), F.format_string("frames/clip-%d/%02d_t%07.3f.jpg", "l_orderkey", "l_linenumber", F.col("l_quantity")).alias("image_path"),
    )


CLIP_FRAMES = """
cf AS (SELECT l_orderkey AS clip_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS frame_order,
       CAST(l_partkey % 1000 AS INTEGER) AS frame_index, round(l_quantity / 4, 3) AS timestamp_sec, l_returnflag AS selected_reason, round(l_discount * 5 + l_tax, 6) AS combined_score,
       l_linenumber, l_quantity FROM lineitem)
"""


def attempts(spark: SparkSession, sf_dir: str, clips: int = 400) -> DataFrame:
    """Events as attempts of shards: purchases succeed, errors fail, views didn't parse; others aren't told."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error", "view"))
    return e.select(
        (F.col("event_id") % clips).cast("int").alias("clip_id"), F.col("event_id").alias("line"), F.format_string("worker_%d.jsonl", F.col("user_id") % 4).alias("file"), F.when(F.col("event_type") == "error", "RuntimeError").alias("error"),
        (F.col("event_type") != "view").alias("json_parse_ok"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("finished"), "value",
    )


ATTEMPTS = """
att AS (SELECT CAST(event_id % 400 AS INTEGER) AS clip_id, event_id AS line, 'worker_' || (user_id % 4) || '.jsonl' AS file, CASE WHEN event_type = 'error' THEN 'RuntimeError' END AS error,
       event_type <> 'view' AS json_parse_ok, date_trunc('hour', ts) AS finished, value FROM events WHERE event_type IN ('purchase', 'error', 'view'))
"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what workers do to a clip."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("view", "click"), "claim").when(F.col("event_type") == "signup", "renew").when(F.col("event_type") == "purchase", "succeed").otherwise("fail")
    return e.select(
        F.lit("run").alias("run_id"), F.col("user_id").alias("clip_id"), F.struct(micros("ts"), "event_id").alias("seq"), op.alias("op"), F.format_string("w%d", F.col("event_id") % 2).alias("worker"), (micros("ts") / F.lit(1e6)).alias("now"), (F.col("value") < 80).alias("retryable"), F.lit("RuntimeError").alias("error")
    )
