"""Queries on frames: sampling, scores, selection, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.operators import evaluation as E
from frameloom.operators import sampling as S
from frameloom.operators import selection as K
from frameloom.plans.views import FRAMES, raw_frames, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, views: str = FRAMES):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {views.strip().rstrip(',')}{sql}" if views else sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_lag_signals(raw_frames(spark, sf_dir))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored(frames(spark, sf_dir))


@query("SELECT clip_id, frame_index, round(timestamp_sec, 6) AS timestamp_sec FROM raw WHERE frame_index % 3 = 0")
def q_thin_frames(spark, sf_dir):
    return S.thin(raw_frames(spark, sf_dir), 3).select("clip_id", "frame_index", *r6("timestamp_sec"))


@query("SELECT clip_id, frame_index, round(frame_diff, 6) AS frame_diff, hist_diff FROM f")
def q_lag_signals(spark, sf_dir):
    return frames(spark, sf_dir).select("clip_id", "frame_index", *r6("frame_diff"), "hist_diff")


@query("SELECT clip_id, frame_index, round(motion_score, 6) AS motion_score, round(hist_diff_score, 6) AS hist_diff_score, round(sharpness_score, 6) AS sharpness_score FROM sc")
def q_norm_clip(spark, sf_dir):
    return S.with_scores(frames(spark, sf_dir)).select("clip_id", "frame_index", *r6("motion_score", "hist_diff_score", "sharpness_score"))


@query("""SELECT clip_id, frame_index, round(CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (frame_diff - lo) / (hi - lo) END, 6) AS motion_score
FROM (SELECT *, min(frame_diff) OVER (PARTITION BY clip_id) AS lo, max(frame_diff) OVER (PARTITION BY clip_id) AS hi FROM f)""")
def q_norm_minmax(spark, sf_dir):
    return S.with_min_max_scores(frames(spark, sf_dir)).select("clip_id", "frame_index", *r6("motion_score"))


@query("SELECT clip_id, frame_index, round(brightness_score, 6) AS brightness_score FROM sc")
def q_brightness_score(spark, sf_dir):
    return S.with_scores(frames(spark, sf_dir)).select("clip_id", "frame_index", *r6("brightness_score"))


@query("SELECT clip_id, frame_index, round(combined_score, 8) AS combined_score FROM co")
def q_combined_score(spark, sf_dir):
    return combined(spark, sf_dir).select("clip_id", "frame_index", F.round("combined_score", 8).alias("combined_score"))


V1 = """, mm AS (SELECT *, CASE WHEN max(frame_diff) OVER w - min(frame_diff) OVER w < 1e-8 THEN 0 ELSE (frame_diff - min(frame_diff) OVER w) / (max(frame_diff) OVER w - min(frame_diff) OVER w) END AS m,
  CASE WHEN max(hist_diff) OVER w - min(hist_diff) OVER w < 1e-8 THEN 0 ELSE (hist_diff - min(hist_diff) OVER w) / (max(hist_diff) OVER w - min(hist_diff) OVER w) END AS h,
  CASE WHEN max(sharpness) OVER w - min(sharpness) OVER w < 1e-8 THEN 0 ELSE (sharpness - min(sharpness) OVER w) / (max(sharpness) OVER w - min(sharpness) OVER w) END AS s,
  CASE WHEN max(brightness) OVER w - min(brightness) OVER w < 1e-8 THEN 0 ELSE (brightness - min(brightness) OVER w) / (max(brightness) OVER w - min(brightness) OVER w) END AS b FROM f WINDOW w AS (PARTITION BY clip_id)),
v1 AS (SELECT clip_id, frame_index, timestamp_sec, brightness, round(0.40e0 * m + 0.35e0 * h + 0.15e0 * s + 0.10e0 * b - CASE WHEN brightness < 18 THEN 0.45e0 ELSE 0e0 END, 8) AS score FROM mm)
"""


def v1_frames(spark, sf_dir):
    f = S.with_min_max_scores(frames(spark, sf_dir))
    score = C.combined_score_v1(F.col("motion_score"), F.col("hist_diff_score"), F.col("sharpness_score"), F.col("brightness_score"), F.col("brightness"))
    return f.select("clip_id", "frame_index", "timestamp_sec", "brightness", F.round(score, 8).alias("combined_score"))


@query(V1 + "SELECT clip_id, frame_index, score AS combined_score FROM v1")
def q_combined_score_v1(spark, sf_dir):
    return v1_frames(spark, sf_dir).select("clip_id", "frame_index", "combined_score")


@query("SELECT clip_id, frame_index, round(least(greatest(0.5e0 * least(value / 8, 1) + 0.3e0 * least(flow_score / 8, 1) + 0.2e0 * motion_area, 0), 1), 6) AS flow FROM raw")
def q_flow_score(spark, sf_dir):
    return raw_frames(spark, sf_dir).select("clip_id", "frame_index", F.round(C.flow_score(F.col("flow_score"), F.col("value"), F.col("motion_area")), 6).alias("flow"))


@query("SELECT clip_id, round(dynamic_score, 6) AS dynamic_score FROM dy")
def q_clip_dynamic(spark, sf_dir):
    return S.clip_dynamics(frames(spark, sf_dir)).select("clip_id", *r6("dynamic_score"))


@query("SELECT clip_id, weight, label FROM dy")
def q_adaptive_weight(spark, sf_dir):
    return S.clip_dynamics(frames(spark, sf_dir)).select("clip_id", "weight", "label")


@query(""", t AS (SELECT clip_id, unnest([0e0, max(timestamp_sec) / 2, greatest(0, max(timestamp_sec) - 0.2e0)]) AS target FROM raw GROUP BY 1)
SELECT DISTINCT clip_id, round(target, 6) AS target_sec, arg_min(frame_index, (abs(timestamp_sec - target), timestamp_sec)) AS frame_index FROM t JOIN raw USING (clip_id) GROUP BY clip_id, target""")
def q_anchor_nearest(spark, sf_dir):
    f = raw_frames(spark, sf_dir)
    last = F.max("timestamp_sec")
    targets = f.groupBy("clip_id").agg(F.array(F.lit(0.0), last / 2, F.greatest(F.lit(0.0), last - 0.2)).alias("t")).select("clip_id", F.explode("t").alias("target_sec"))
    return K.nearest_frame(f, targets).select("clip_id", *r6("target_sec"), "frame_index").distinct()


def greedy_sql(n: int, gap: float, source: str, reasons: tuple[str, str]) -> str:
    """Greedy passes as steps over ranked candidates: taken lists are carried from rank to rank."""
    return f"""
rk AS (SELECT clip_id, frame_index AS pos, timestamp_sec AS t, score, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, timestamp_sec, frame_index) AS k, count(*) OVER (PARTITION BY clip_id) AS n FROM {source}),
s1 AS (SELECT clip_id, 0::BIGINT AS k, taken FROM anchors UNION ALL
  SELECT s1.clip_id, rk.k, CASE WHEN len(taken) < {n} AND len(list_filter(taken, lambda x: x.pos = rk.pos OR abs(x.t - rk.t) < {gap}e0)) = 0
    THEN list_append(taken, {{'pos': rk.pos, 't': rk.t, 'reason': '{reasons[0]}'}}) ELSE taken END FROM s1 JOIN rk ON s1.clip_id = rk.clip_id AND rk.k = s1.k + 1),
e1 AS (SELECT clip_id, arg_max(taken, k) AS taken FROM s1 GROUP BY 1),
s2 AS (SELECT clip_id, 0::BIGINT AS k, taken FROM e1 UNION ALL
  SELECT s2.clip_id, rk.k, CASE WHEN len(taken) < {n} AND len(list_filter(taken, lambda x: x.pos = rk.pos)) = 0
    THEN list_append(taken, {{'pos': rk.pos, 't': rk.t, 'reason': '{reasons[1]}'}}) ELSE taken END FROM s2 JOIN rk ON s2.clip_id = rk.clip_id AND rk.k = s2.k + 1),
e2 AS (SELECT clip_id, arg_max(taken, k) AS taken FROM s2 GROUP BY 1)
"""


def selection_sql(n: int, gap: float) -> str:
    anchor = lambda name, before, target, reason: f"""{name} AS (SELECT b.clip_id, list_append(any_value(b.taken), {{'pos': arg_min(c.frame_index, (abs(c.timestamp_sec - {target}), c.timestamp_sec)), 't': arg_min(c.timestamp_sec, (abs(c.timestamp_sec - {target}), c.timestamp_sec)), 'reason': '{reason}'}}) AS taken
  FROM {before} b JOIN sr c ON b.clip_id = c.clip_id AND len(list_filter(b.taken, lambda x: x.pos = c.frame_index)) = 0 GROUP BY b.clip_id),"""  # noqa: E731
    return (
        ", sr AS (SELECT clip_id, frame_index, timestamp_sec, round(combined_score, 8) AS score, max(timestamp_sec) OVER (PARTITION BY clip_id) AS last FROM co),\n"
        "a0 AS (SELECT DISTINCT clip_id, CAST([] AS STRUCT(pos INTEGER, t DOUBLE, reason VARCHAR)[]) AS taken FROM sr),\n"
        + anchor("a1", "a0", "0e0", "temporal_anchor_start") + anchor("a2", "a1", "c.last / 2", "temporal_anchor_middle") + anchor("anchors", "a2", "greatest(0e0, c.last - 0.2e0)", "temporal_anchor_end")
        + greedy_sql(n, gap, "sr", ("high_content_score", "high_content_score_gap_relaxed"))
        + f""", out AS (SELECT clip_id, unnest(taken) AS x FROM e2 WHERE clip_id IN (SELECT clip_id FROM rk WHERE n > {n})
  UNION ALL SELECT clip_id, {{'pos': pos, 't': t, 'reason': 'all_candidates_used'}} FROM rk WHERE n <= {n})
SELECT out.clip_id, CAST(row_number() OVER (PARTITION BY out.clip_id ORDER BY x.t, x.pos) - 1 AS INTEGER) AS frame_order, x.pos AS frame_index, round(x.t, 6) AS timestamp_sec, x.reason AS selected_reason, sr.score AS combined_score
FROM out JOIN sr ON sr.clip_id = out.clip_id AND sr.frame_index = x.pos"""
    )


def selected(spark, sf_dir, **how):
    f = combined(spark, sf_dir).withColumn("combined_score", F.round("combined_score", 8))
    return K.select_keyframes(f, **how).withColumn("timestamp_sec", F.round("timestamp_sec", 6))


@query(selection_sql(8, 1.0))
def q_select_keyframes(spark, sf_dir):
    return selected(spark, sf_dir)


@query(selection_sql(8, 4.0))
def q_select_keyframes_relaxed(spark, sf_dir):
    return selected(spark, sf_dir, min_gap_sec=4.0)


def v1_sql(n: int, gap: float) -> str:
    pick = lambda target: f"arg_min({{'pos': frame_index, 't': timestamp_sec}}, (brightness < 18, abs(timestamp_sec - {target}), frame_index))"
    return (
        V1.rstrip() + f""",
an AS (SELECT clip_id, {pick('0e0')} AS s, {pick('last * 0.5e0')} AS m, {pick('greatest(0e0, last - 0.05e0)')} AS e FROM (SELECT *, max(timestamp_sec) OVER (PARTITION BY clip_id) AS last FROM v1) GROUP BY 1),
anchors AS (SELECT clip_id, list_concat(list_concat([{{'pos': s.pos, 't': s.t, 'reason': 'temporal_anchor_start'}}],
   CASE WHEN m.pos = s.pos THEN [] ELSE [{{'pos': m.pos, 't': m.t, 'reason': 'temporal_anchor_middle'}}] END),
   CASE WHEN e.pos = s.pos OR e.pos = m.pos THEN [] ELSE [{{'pos': e.pos, 't': e.t, 'reason': 'temporal_anchor_end'}}] END) AS taken FROM an),
""" + greedy_sql(n, gap, "v1", ("high_content_score", "fill_remaining_best_score"))
        + f""", out AS (SELECT clip_id, unnest(taken) AS x FROM e2 WHERE clip_id IN (SELECT clip_id FROM rk WHERE n > {n})
  UNION ALL SELECT clip_id, {{'pos': pos, 't': t, 'reason': 'all_candidates_kept'}} FROM rk WHERE n <= {n})
SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY x.t, x.pos) - 1 AS INTEGER) AS frame_order, x.pos AS frame_index, round(x.t, 6) AS timestamp_sec, x.reason AS selected_reason FROM out"""
    )


@query(v1_sql(12, 1.0))
def q_select_keyframes_v1(spark, sf_dir):
    return K.select_keyframes_v1(v1_frames(spark, sf_dir)).select("clip_id", "frame_order", "frame_index", *r6("timestamp_sec"), "selected_reason")


@query("""SELECT clip_id, frame_index, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY timestamp_sec, frame_index) - 1 AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(combined_score, 8) DESC, frame_index) AS r FROM co) WHERE r <= 8)""")
def q_choose_topn(spark, sf_dir):
    f = combined(spark, sf_dir).withColumn("combined_score", F.round("combined_score", 8)).withColumn("frame_order", F.col("frame_index"))
    return K.choose_keyframes(f, 8).select("clip_id", "frame_index", "position")


@query("SELECT clip_id, frame_index FROM raw QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY timestamp_sec, frame_index) <= 5")
def q_limit_per_clip(spark, sf_dir):
    f = raw_frames(spark, sf_dir).select("clip_id", "frame_index", F.col("timestamp_sec").alias("timestamp"), F.col("frame_index").alias("frame_id"))
    return K.limit_frames(f, 5).select("clip_id", "frame_index")


@query(""", n AS (SELECT clip_id, max(frame_index) + 1 AS n FROM raw GROUP BY 1), g AS (SELECT clip_id, i AS position, CAST(round_even(i * (n - 1) / 7e0, 0) AS INTEGER) AS frame_index FROM n, range(8) t(i))
SELECT clip_id, CAST(position AS INTEGER) AS position, frame_index, event_id FROM g JOIN raw USING (clip_id, frame_index)""")
def q_fixed_indices(spark, sf_dir):
    out = S.fixed_frames(raw_frames(spark, sf_dir), 8)
    return out.select("clip_id", "position", F.col("frame_index").cast("int").alias("frame_index"), "event_id")


@query("SELECT clip_id, frame_index, round(value, 6) AS value FROM (SELECT *, quantile_cont(value, 0.8) OVER (PARTITION BY clip_id) AS q FROM raw) WHERE value >= q")
def q_motion_events(spark, sf_dir):
    return E.motion_events(raw_frames(spark, sf_dir).withColumn("score", F.col("value"))).select("clip_id", "frame_index", *r6("value"))


def events_of(spark, sf_dir):
    return E.motion_events(raw_frames(spark, sf_dir).select("clip_id", "frame_index", F.col("timestamp_sec").alias("timestamp"), F.col("value").alias("score"))).select("clip_id", "timestamp")


COVER = """, ev AS (SELECT clip_id, timestamp_sec AS t FROM (SELECT *, quantile_cont(value, 0.8) OVER (PARTITION BY clip_id) AS q FROM raw) WHERE value >= q),
nn AS (SELECT clip_id, max(frame_index) + 1 AS n FROM raw GROUP BY 1), gg AS (SELECT DISTINCT clip_id, CAST(round_even(i * (n - 1) / 7e0, 0) AS INTEGER) AS frame_index FROM nn, range(8) t(i)),
fx AS (SELECT clip_id, timestamp_sec AS k FROM gg JOIN raw USING (clip_id, frame_index)),
cv AS (SELECT clip_id, count(*) AS n_events, count(*) FILTER (EXISTS (SELECT 1 FROM fx WHERE fx.clip_id = ev.clip_id AND abs(fx.k - ev.t) <= 1e0)) AS n_covered FROM ev GROUP BY 1)
"""


def coverage_of(spark, sf_dir, keys):
    return E.motion_coverage(events_of(spark, sf_dir), keys.select("clip_id", F.col("timestamp_sec").alias("timestamp")))


@query(COVER + "SELECT clip_id, n_events, n_covered, round(n_covered / n_events, 6) AS coverage FROM cv")
def q_motion_coverage(spark, sf_dir):
    out = coverage_of(spark, sf_dir, S.fixed_frames(raw_frames(spark, sf_dir), 8))
    return out.select("clip_id", "n_events", "n_covered", *r6("coverage"))


FLAGS = """, q AS (SELECT clip_id, frame_index, CASE WHEN frame_index % 17 = 0 THEN NULL ELSE sharpness END AS sharpness, CASE WHEN frame_index % 17 = 0 THEN NULL ELSE flow_score * 10 END AS entropy,
  CASE WHEN frame_index % 17 = 0 THEN NULL ELSE brightness END AS brightness, value / 200 AS similarity FROM raw),
fl0 AS (SELECT *, brightness IS NULL AS gone FROM q),
fl AS (SELECT *, CASE WHEN gone OR sharpness < 80 THEN 1 ELSE 0 END AS blurry, CASE WHEN gone OR entropy < 4.2e0 THEN 1 ELSE 0 END AS low_entropy, CASE WHEN gone OR brightness < 25 OR brightness > 235 THEN 1 ELSE 0 END AS dark_or_bright,
  CASE WHEN NOT gone AND similarity >= 0.96e0 THEN 1 ELSE 0 END AS duplicate FROM fl0)
"""


def flagged(spark, sf_dir):
    gone = F.col("frame_index") % 17 == 0
    f = raw_frames(spark, sf_dir).select("clip_id", "frame_index", F.when(~gone, F.col("sharpness")).alias("sharpness"), F.when(~gone, F.col("flow_score") * 10).alias("entropy"), F.when(~gone, F.col("brightness")).alias("brightness"), (F.col("value") / 200).alias("similarity"))
    return E.with_flags(f)


@query(FLAGS + """SELECT clip_id, frame_index, blurry, low_entropy, dark_or_bright, duplicate, greatest(blurry, low_entropy, dark_or_bright, duplicate) AS low_info,
CASE WHEN gone THEN 'missing image' ELSE concat_ws('; ', CASE WHEN blurry = 1 THEN 'blurry' END, CASE WHEN low_entropy = 1 THEN 'low entropy' END, CASE WHEN dark_or_bright = 1 THEN 'too dark/bright' END, CASE WHEN duplicate = 1 THEN 'near duplicate' END) END AS low_info_reason FROM fl""")
def q_quality_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("clip_id", "frame_index", "blurry", "low_entropy", "dark_or_bright", "duplicate", "low_info", "low_info_reason")


@query("SELECT clip_id, count(*) AS generated, count(*) FILTER (brightness >= 18) AS valid_frames, CASE WHEN count(*) < 60 OR count(*) FILTER (brightness >= 18) < 60 THEN 1 ELSE 0 END AS failed FROM raw GROUP BY 1")
def q_sampler_failures(spark, sf_dir):
    return E.sampler_failures(raw_frames(spark, sf_dir).withColumn("valid", F.col("brightness") >= 18), 60)


METRICS = FLAGS.rstrip() + COVER.rstrip() + """,
ver AS (SELECT *, CASE WHEN clip_id % 2 = 0 THEN 'fixed' ELSE 'improved' END AS version FROM fl),
su AS (SELECT version, count(DISTINCT clip_id) AS n_clips, count(*) AS n_frames, round(avg(greatest(blurry, low_entropy, dark_or_bright, duplicate)), 6) AS low_info_ratio, round(avg(blurry), 6) AS blurry_ratio, round(avg(low_entropy), 6) AS low_entropy_ratio,
  round(avg(dark_or_bright), 6) AS dark_or_bright_ratio, round(avg(duplicate), 6) AS duplicate_ratio FROM ver GROUP BY 1),
fa AS (SELECT CASE WHEN clip_id % 2 = 0 THEN 'fixed' ELSE 'improved' END AS version, CAST(sum(failed) AS BIGINT) AS n_failed FROM (SELECT clip_id, CASE WHEN count(*) < 60 OR count(*) FILTER (brightness >= 18) < 60 THEN 1 ELSE 0 END AS failed FROM raw GROUP BY 1) GROUP BY 1),
ca AS (SELECT CASE WHEN clip_id % 2 = 0 THEN 'fixed' ELSE 'improved' END AS version, round(avg(n_covered / n_events), 6) AS mean_coverage FROM cv GROUP BY 1),
me AS (SELECT * FROM su LEFT JOIN fa USING (version) LEFT JOIN ca USING (version))
"""


def metrics(spark, sf_dir):
    version = F.when(F.col("clip_id") % 2 == 0, "fixed").otherwise("improved")
    f = flagged(spark, sf_dir).withColumn("version", version)
    failures = q_sampler_failures(spark, sf_dir).withColumn("version", version)
    coverage = coverage_of(spark, sf_dir, S.fixed_frames(raw_frames(spark, sf_dir), 8)).withColumn("version", version)
    return E.summary(f, failures, coverage)


@query(METRICS + "SELECT * FROM me")
def q_metrics_summary(spark, sf_dir):
    return metrics(spark, sf_dir)


@query(METRICS + """SELECT a.metric, a.value AS fixed, b.value AS improved, round(b.value - a.value, 6) AS change FROM
(UNPIVOT (SELECT version, low_info_ratio, blurry_ratio, duplicate_ratio, mean_coverage FROM me) ON low_info_ratio, blurry_ratio, duplicate_ratio, mean_coverage INTO NAME metric VALUE value) a
JOIN (UNPIVOT (SELECT version, low_info_ratio, blurry_ratio, duplicate_ratio, mean_coverage FROM me) ON low_info_ratio, blurry_ratio, duplicate_ratio, mean_coverage INTO NAME metric VALUE value) b ON a.metric = b.metric AND a.version = 'fixed' AND b.version = 'improved'""")
def q_metric_compare(spark, sf_dir):
    return E.comparison(metrics(spark, sf_dir), ["low_info_ratio", "blurry_ratio", "duplicate_ratio", "mean_coverage"]).withColumn("change", F.round("change", 6))


@query("""WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT label, vec_id, list_transform(e, lambda x: x - list_sum(e) / len(e)) AS m, vec_id % 7 = 0 AS gone FROM v),
u AS (SELECT label, vec_id, CASE WHEN gone THEN NULL ELSE m END AS m FROM c),
p AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM u)
SELECT label AS clip_id, vec_id, round(CASE WHEN m IS NULL OR b IS NULL THEN 0 ELSE list_inner_product(m, b) / sqrt(list_inner_product(m, m)) / sqrt(list_inner_product(b, b)) END, 5) AS similarity FROM p""", views="")
def q_near_dup(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    f = v.select(F.col("label").alias("clip_id"), "vec_id", F.col("vec_id").cast("double").alias("timestamp"), F.col("vec_id").alias("frame_id"), F.when(F.col("vec_id") % 7 != 0, C.centred(F.col("embedding"))).alias("vector"))
    return E.with_similarity(f).select("clip_id", "vec_id", F.round("similarity", 5).alias("similarity"))


@query("""WITH h AS (SELECT user_id AS clip_id, CAST(floor(value) AS INTEGER) % 256 AS b, count(*) AS c FROM events GROUP BY 1, 2),
s AS (SELECT *, c / sum(c) OVER (PARTITION BY clip_id) * (256e0 / 255e0) AS p FROM h) SELECT clip_id, round(-sum(p * log2(p)), 6) AS entropy FROM s GROUP BY 1""", views="")
def q_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), (F.floor("value") % 256).alias("b")).groupBy("clip_id", "b").count()
    return e.groupBy("clip_id").agg(F.collect_list(F.col("count").cast("double")).alias("h")).select("clip_id", F.round(E.entropy(F.col("h")), 6).alias("entropy"))


@query("SELECT b.version, b.clip_id, count(*) AS n FROM (SELECT clip_id, 'raw' AS version FROM raw UNION ALL SELECT clip_id, 'limited' FROM raw WHERE frame_index < 8) b GROUP BY ALL")
def q_version_counts(spark, sf_dir):
    f = raw_frames(spark, sf_dir)
    both = f.select("clip_id", F.lit("raw").alias("version")).unionByName(f.where("frame_index < 8").select("clip_id", F.lit("limited").alias("version")))
    return both.groupBy("version", "clip_id").agg(F.count("*").alias("n"))


@query("SELECT clip_id, round(min(timestamp_sec), 6) AS first_sec, round(max(timestamp_sec), 6) AS last_sec, count(*) AS n_frames, list_sort(list(frame_index)) AS indices FROM raw WHERE frame_index % 10 = 0 GROUP BY 1")
def q_collect_frames(spark, sf_dir):
    f = S.thin(raw_frames(spark, sf_dir), 10)
    return f.groupBy("clip_id").agg(F.round(F.min("timestamp_sec"), 6).alias("first_sec"), F.round(F.max("timestamp_sec"), 6).alias("last_sec"), F.count("*").alias("n_frames"), F.array_sort(F.collect_list("frame_index")).alias("indices"))


@query("SELECT clip_id, frame_index, coalesce(list(frame_index) OVER (PARTITION BY clip_id ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS history FROM raw")
def q_bounded_history(spark, sf_dir):
    by = Window.partitionBy("clip_id").orderBy("frame_index").rowsBetween(-3, -1)
    return raw_frames(spark, sf_dir).select("clip_id", "frame_index", F.collect_list("frame_index").over(by).alias("history"))
