"""Queries on model calls, records, pixels and composed pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.functions import jsontext as J
from frameloom.operators import evaluation as E
from frameloom.operators import inference as I
from frameloom.operators import jobstate as Z
from frameloom.operators import merge as M
from frameloom.operators import sampling as S
from frameloom.operators import shards as R
from frameloom.operators import signals as G
from frameloom.operators import timeline as T
from frameloom.plans import composites as P
from frameloom.plans.clips import FMT, TL
from frameloom.plans.views import ATTEMPTS, CLIP_FRAMES, CLIPS, FRAMES, attempts, clip_frames, clips, job_events, raw_frames, table
from frameloom.sources import snapshots as N
from frameloom.sources.folders import scratch

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, views: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {views.strip().rstrip(',')} {sql}" if views else sql
        return f

    return add


# --- scalar functions


@query("SELECT o_orderkey AS id, printf('%02d:%02d:%02d', o_orderkey // 3600, o_orderkey // 60 % 60, o_orderkey % 60) AS t FROM orders")
def q_format_seconds(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.format_seconds(F.col("o_orderkey")).alias("t"))


NAMES = "nm AS (SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'ep01_clip_' || o_custkey || '.mp4' WHEN 1 THEN 'clip-' || o_custkey || '.mov' WHEN 2 THEN 'scene' || o_custkey || '.mp4' ELSE 'other.mp4' END AS name FROM orders)"


@query(r"SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(name, 'clip[_-](\d+)', 1), '') AS INTEGER), pos) AS clip_id, TRY_CAST(nullif(regexp_extract(name, '(\d+)\.mp4$', 1), '') AS INTEGER) AS number FROM nm", NAMES)
def q_clip_number(spark, sf_dir):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("ep01_clip_"), c, F.lit(".mp4"))).when(k == 1, F.concat(F.lit("clip-"), c, F.lit(".mov"))).when(k == 2, F.concat(F.lit("scene"), c, F.lit(".mp4"))).otherwise("other.mp4")
    o = R.positions(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), name.alias("name")))
    return o.select(F.col("clip_id").alias("id"), C.clip_number(F.col("name"), F.col("position")).alias("clip_id"), C.number_before_suffix(F.col("name")).alias("number"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, printf('%02d_t%07.3f_f%d.jpg', l_linenumber, round_even(l_extendedprice / 7, 3), l_partkey) AS name FROM lineitem")
def q_frame_file_name(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), C.frame_file_name(F.col("l_linenumber"), F.col("l_extendedprice") / 7, F.col("l_partkey")).alias("name"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || ', ' || conv_id WHEN 1 THEN role ELSE '' END AS text FROM conversations")
def q_text_of(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k = F.col("turn") % 3
    value = F.when(k == 0, F.to_json(F.array(F.col("role"), F.col("conv_id").cast("string")))).when(k == 1, F.concat(F.lit('"'), "role", F.lit('"')))
    return c.select("conv_id", "turn", J.text_of(F.parse_json(value)).alias("text"))


@query("""SELECT conv_id, turn, '{' || CASE turn % 3 WHEN 0 THEN '"fps":' || turn WHEN 1 THEN '"fps":[' || turn || ',' || conv_id || ']' ELSE '"fps":' || turn || ',"frames":[1,2]' END || '}' AS kwargs FROM conversations""")
def q_cleaned_kwargs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k, one = F.col("turn") % 3, F.col("turn").cast("long")
    many = F.when(k == 1, F.array(one, F.col("conv_id").cast("long"))).otherwise(F.array(one))
    frames = F.when(k == 2, F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).otherwise(F.array().cast("array<bigint>"))
    return c.select("conv_id", "turn", J.cleaned_kwargs(F.create_map(F.lit("fps"), many, F.lit("frames"), frames)).alias("kwargs"))


@query("SELECT clip_id, line, finished FROM att", ATTEMPTS)
def q_finished_time(spark, sf_dir):
    a = attempts(spark, sf_dir)
    text = F.date_format("finished", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("line") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("line") % 3 == 1, F.concat(text, F.lit("+05:00"))).otherwise(text)
    given = a.select("clip_id", "line", F.when(F.col("line") % 2 == 0, zone).otherwise("").alias("finished_at"), zone.alias("_aggregation_time"), F.lit(1).alias("_aggregation_x"))
    out = given.withColumn("finished", M.finished_time(F.col("finished_at"), F.col("_aggregation_time")).cast("timestamp_ntz"))
    return M.without_internal(out.select("clip_id", "line", "finished", "_aggregation_x"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN CAST(least(ceil(c_acctbal / 20), 40) AS BIGINT) ELSE 0 END AS n FROM customer")
def q_expected_clips(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), C.expected_clips(F.col("c_acctbal"), 20.0, 40).alias("n"))


# --- prompts and records

LINE = f"printf('Frame %02d: local_time=', frame_order) || {FMT('timestamp_sec')} || ', global_time=, selection_reason=' || selected_reason || ', content_score=' || printf('%.3f', round_even(combined_score, 3))"


def chosen(spark, sf_dir):
    one = F.struct("frame_order", C.format_time(F.col("timestamp_sec")).alias("local_timestamp"), F.lit("").alias("global_timestamp"), "selected_reason", "combined_score", "image_path")
    return clip_frames(spark, sf_dir).groupBy("clip_id").agg(F.array_sort(F.collect_list(one)).alias("f"))


PROMPT = f"""pr AS (SELECT clip_id, count(*) AS n, list('frames/clip-' || clip_id || printf('/%02d_t%07.3f.jpg', l_linenumber, l_quantity) ORDER BY frame_order) AS images,
'Clip metadata:' || chr(10) || 'clip_id: ' || clip_id || chr(10) || 'clip_file: clip_' || clip_id || '.mp4' || chr(10) || 'duration_sec: None' || chr(10) || 'selected_keyframe_count: ' || count(*) || chr(10) || chr(10) || 'Keyframe order and timestamps:' || chr(10) || string_agg({LINE}, chr(10) ORDER BY frame_order) || chr(10) || chr(10) || 'Describe.' AS prompt FROM cf GROUP BY 1)"""


def prompts(spark, sf_dir):
    facts = {"clip_id": F.col("clip_id"), "clip_file": F.format_string("clip_%d.mp4", "clip_id"), "duration_sec": F.lit(None)}
    return chosen(spark, sf_dir).withColumn("prompt", J.prompt(facts, F.col("f"), "Describe."))


@query("SELECT clip_id, prompt FROM pr", CLIP_FRAMES.strip() + ", " + PROMPT)
def q_prompt(spark, sf_dir):
    return prompts(spark, sf_dir).select("clip_id", "prompt")


@query("SELECT clip_id, CAST(i - 1 AS INTEGER) AS part, CASE WHEN i <= n THEN 'image' ELSE 'text' END AS type, images[i] AS image, CASE WHEN i > n THEN prompt END AS text, CASE WHEN i <= n THEN 7 END AS min_pixels FROM (SELECT *, unnest(range(1, n + 2)) AS i FROM pr)", CLIP_FRAMES.strip() + ", " + PROMPT)
def q_messages(spark, sf_dir):
    m = prompts(spark, sf_dir).select("clip_id", F.posexplode(J.messages(F.col("f"), F.col("prompt"), 7, 9)).alias("part", "m"))
    return m.select("clip_id", "part", "m.type", "m.image", "m.text", "m.min_pixels")


def stub():
    """A model of fixed answers: clips divisible by 5 fail, by 3 answer no JSON; over 3 frames are too many for those divisible by 7."""

    def model(record, frames):
        c = record["clip_id"]
        if c % 7 == 0 and len(frames) > 3:
            raise MemoryError("too many")
        if c % 5 == 0:
            raise (FileNotFoundError if c % 2 == 0 else RuntimeError)(f"no {c}")
        return f'```json\n{{"clip_id": {c}, "summary": "{len(frames)} frames"}}\n```' if c % 3 else f'{{"clip_id": {c}, '

    return model


def model_input(spark, sf_dir):
    """Clips of up to five frames each; some customers have no orders and so no frames."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey"))
    top = o.withColumn("r", F.row_number().over(Window.partitionBy("clip_id").orderBy("o_orderkey"))).where("r <= 5")
    one = F.struct((F.col("r") - 1).alias("frame_order"), F.col("r").cast("double").alias("timestamp_sec"), (1 / F.col("r")).alias("combined_score"), F.format_string("p%d", "o_orderkey").alias("image_path"))
    nested = top.groupBy("clip_id").agg(F.array_sort(F.collect_list(one)).alias("selected_frames"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("clip_id"))
    return c.join(nested, "clip_id", "left").withColumn("selected_frames", F.coalesce("selected_frames", F.array().cast(nested.schema["selected_frames"].dataType)))


INFER = """mi AS (SELECT c_custkey AS c, CAST(least(5, count(o_orderkey)) AS INTEGER) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
inf AS (SELECT CAST(c AS INTEGER) AS clip_id, n, n = 0 OR c % 5 = 0 AS failed, CASE WHEN n = 0 THEN 'RuntimeError' WHEN c % 5 = 0 THEN CASE WHEN c % 2 = 0 THEN 'FileNotFoundError' ELSE 'RuntimeError' END END AS error_type,
  CASE WHEN n = 0 THEN 'no usable frames' WHEN c % 5 = 0 THEN 'no ' || c END AS error, CASE WHEN n = 0 OR c % 5 = 0 THEN 0 WHEN c % 7 = 0 THEN least(3, n) ELSE n END AS used, CASE WHEN n > 3 AND c % 5 <> 0 AND c % 7 = 0 THEN 'retried with 3 frames' END AS note FROM mi)"""


@query("SELECT clip_id, used AS frames_used, error_type, error, note, CASE WHEN failed THEN NULL WHEN clip_id % 3 = 0 THEN '{\"clip_id\": ' || clip_id || ', ' ELSE '```json' || chr(10) || '{\"clip_id\": ' || clip_id || ', \"summary\": \"' || used || ' frames\"}' || chr(10) || '```' END AS raw_output FROM inf", INFER)
def q_infer(spark, sf_dir):
    asked = model_input(spark, sf_dir).select("clip_id", F.col("selected_frames.image_path").alias("frames"))
    return I.infer(asked, stub, fewer=3).select("clip_id", "frames_used", "error_type", "error", "note", "raw_output")


@query("SELECT 'v5' AS version, 'content_aware_keyframes_as_images' AS input_mode, 1 AS shard_index, 2 AS num_shards, clip_id, used AS selected_frame_count, CASE WHEN NOT failed AND clip_id % 3 <> 0 THEN used || ' frames' END AS summary, NOT failed AND clip_id % 3 <> 0 AS json_parse_ok, CASE WHEN failed THEN '' ELSE 'x' END AS any_output, error_type, 27 AS n_columns FROM inf", INFER)
def q_output_record(spark, sf_dir):
    given = model_input(spark, sf_dir)
    raw = I.infer(given.select("clip_id", F.col("selected_frames.image_path").alias("frames")), stub, fewer=3)
    frames = F.transform("selected_frames", lambda f: f.withField("local_timestamp", F.lit("a")).withField("global_timestamp", F.lit("b")).withField("selected_reason", F.lit("c")))
    none = F.lit(None).cast("string")
    asked = given.select("clip_id", none.alias("clip_file"), none.alias("actual_start_time"), none.alias("actual_end_time"), F.lit(20.0).alias("duration_sec"), frames.alias("chosen"), F.array().cast("array<string>").alias("missing"))
    out = I.full_records(raw, asked, I.ModelSettings(version="v5", worker_id="w", shard=1, shards=2))
    same = F.size("selected_frames_used") == F.col("selected_frame_count")
    return out.where(same).select("version", "input_mode", "shard_index", "num_shards", "clip_id", "selected_frame_count", F.col("parsed_json.summary").alias("summary"), "json_parse_ok", F.when(F.col("raw_output") != "", "x").otherwise("").alias("any_output"), "error_type", F.lit(len(out.columns)).alias("n_columns"))


@query("SELECT clip_id, NOT failed AND clip_id % 3 <> 0 AS json_parse_ok, CASE WHEN NOT failed AND clip_id % 3 <> 0 THEN used || ' frames' ELSE '' END AS model_summary, '' AS human_notes FROM inf", INFER.replace("least(3, n)", "n"))
def q_review_rows(spark, sf_dir):
    asked = model_input(spark, sf_dir).select("clip_id", F.col("selected_frames.image_path").alias("frames"))
    out = I.review_rows(I.output_records(I.infer(asked, stub, fewer=5), "w", "1"))
    return out.select("clip_id", "json_parse_ok", "model_summary", "human_notes")


# all frames of a clip divisible by 7 but not by 5 are too many for fewer=5: a memory error is its outcome
ORACLES["q_review_rows"] = ORACLES["q_review_rows"].replace("n = 0 OR c % 5 = 0 AS failed", "n = 0 OR c % 5 = 0 OR (c % 7 = 0 AND n > 3) AS failed")


@query("SELECT clip_id, NOT failed AND clip_id % 3 <> 0 AS json_parse_ok, error_type FROM inf WHERE clip_id % 4 <> 0 AND clip_id % 3 = 1", INFER)
def q_worker(spark, sf_dir):
    given = model_input(spark, sf_dir)
    done = given.where("clip_id % 4 = 0").select("clip_id", F.lit(None).cast("string").alias("error"), F.lit(True).alias("json_parse_ok"))
    # ids from 0 in a row: the place modulo 3 is that of the id
    return I.run_worker(given, done, stub, "w", 3, 1, most_frames=3).select("clip_id", "json_parse_ok", "error_type")


def worker_states(spark, sf_dir):
    """(clips, states): some are held by another worker, some failed twice, some have no state."""
    given = model_input(spark, sf_dir)
    k, none = F.col("clip_id"), F.lit(None)
    s = Z.state(**({c: none for c in Z.STATE} | {"status": F.when(k % 11 == 0, "RUNNING").when(k % 2 == 0, "RETRYABLE_FAILED").otherwise("PENDING"), "worker": F.when(k % 11 == 0, "other"), "attempt": F.when(k % 11 == 0, 1).when(k % 2 == 0, 2).otherwise(0), "lease": F.when(k % 11 == 0, 500.0)}))
    states = given.where("clip_id % 13 <> 0 or clip_id % 2 = 0 or clip_id % 11 = 0").select(F.lit("r").alias("run_id"), "clip_id", s.alias("s")).select("run_id", "clip_id", "s.*")
    return given, states


@query("""SELECT CAST(clip_id AS INTEGER) AS clip_id, CASE WHEN clip_id % 11 = 0 THEN 'RUNNING' WHEN NOT failed AND clip_id % 3 <> 0 THEN 'SUCCEEDED' WHEN error_type = 'FileNotFoundError' OR clip_id % 2 = 0 THEN 'FINAL_FAILED' ELSE 'RETRYABLE_FAILED' END AS status,
CAST(CASE WHEN clip_id % 11 = 0 THEN 1 WHEN clip_id % 2 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempt, CASE WHEN clip_id % 11 = 0 THEN 'other' ELSE 'w' END AS worker FROM inf""", INFER)
def q_worker_states(spark, sf_dir):
    given, states = worker_states(spark, sf_dir)
    nothing = spark.createDataFrame([], "clip_id int, error string, json_parse_ok boolean")
    out = I.run_claimed(given, nothing, states, stub, "w", "r", scratch(spark, "log"), 100.0, most_frames=3)[1]
    return out.select("clip_id", "status", "attempt", "worker")


def calm():
    """A model that always answers."""
    return lambda record, frames: f'{{"clip_id": {record["clip_id"]}, "summary": "{len(frames)} frames"}}'


@query("""SELECT CAST(clip_id AS INTEGER) AS clip_id, CASE WHEN clip_id % 11 = 0 THEN 'RUNNING' WHEN n = 0 AND clip_id % 2 = 1 THEN 'RETRYABLE_FAILED' WHEN (NOT failed AND clip_id % 3 <> 0) OR clip_id % 2 = 1 THEN 'SUCCEEDED' ELSE 'FINAL_FAILED' END AS status,
CAST(CASE WHEN clip_id % 11 = 0 THEN 1 WHEN clip_id % 2 = 0 THEN 3 WHEN failed OR clip_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt, CASE WHEN clip_id % 11 = 0 OR clip_id % 2 = 1 AND NOT failed AND clip_id % 3 <> 0 OR clip_id % 2 = 0 THEN 0 ELSE 1 END AS n_second FROM inf""", INFER)
def q_worker_retry(spark, sf_dir):
    """What failed and may be tried again is claimed again by the same worker, whose log has the rows of both attempts."""
    given, states = worker_states(spark, sf_dir)
    nothing, log = spark.createDataFrame([], "clip_id int, error string, json_parse_ok boolean"), scratch(spark, "log")
    first = I.run_claimed(given, nothing, states, stub, "w", "r", log, 100.0, most_frames=3)[1]
    outputs, out = I.run_claimed(given, nothing, first, calm, "w", "r", log, 200.0, most_frames=3)
    again = outputs.groupBy("clip_id").agg(F.count("*").cast("int").alias("n_second"))
    return out.join(again, "clip_id", "left").select("clip_id", "status", "attempt", F.coalesce("n_second", F.lit(0)).alias("n_second"))


@query("""SELECT c_custkey AS clip_id, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'RUNNING' ELSE 'PENDING' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'a' WHEN c_custkey % 3 = 0 THEN 'b' END AS worker,
CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS refused, 2 AS version, 1 AS n_conflicts FROM customer""")
def q_conditional_commits(spark, sf_dir):
    """Two workers claim clips from the same version: the later one is refused and claims again on what the first has made."""
    path = scratch(spark, "states")
    c = table(spark, sf_dir, "customer").select(F.lit("r").alias("run_id"), F.col("c_custkey").alias("clip_id"))
    N.commit(c.select("run_id", "clip_id", Z.initial().alias("s")).select("run_id", "clip_id", "s.*"), path, None)
    event = lambda rows, worker: rows.select("run_id", "clip_id", F.lit(0).alias("seq"), F.lit("claim").alias("op"), F.lit(worker).alias("worker"), F.lit(10.0).alias("now"), F.lit(False).alias("retryable"), F.lit(None).cast("string").alias("error"))
    claims = lambda worker, k: lambda states: Z.fold(event(c.where(F.col("clip_id") % k == 0), worker), states=states)
    early, version = N.read(spark, path)
    N.update(spark, path, claims("a", 2))
    conflicts = 0
    try:
        N.commit(claims("b", 3)(early), path, version)
    except N.Conflict:
        conflicts = 1
        N.update(spark, path, claims("b", 3))
    out, version = N.read(spark, path)
    return out.select("clip_id", "status", "worker", "refused", F.lit(version).alias("version"), F.lit(conflicts).alias("n_conflicts"))


@query("SELECT c_custkey AS clip_id, c_name AS clip_file FROM customer WHERE c_custkey NOT IN (SELECT clip_id FROM att WHERE error IS NULL AND json_parse_ok)", ATTEMPTS)
def q_bucketed_remaining(spark, sf_dir):
    """What is left to do, from a manifest and attempts in buckets of the clip."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"), F.col("c_name").alias("clip_file"))
    a = attempts(spark, sf_dir).select(F.col("clip_id").cast(c.schema["clip_id"].dataType).alias("clip_id"), "error", "json_parse_ok")
    path = scratch(spark, "buckets")
    return R.remaining(R.bucketed(c, f"{path}/manifest", 8), R.bucketed(a, f"{path}/attempts", 8))


# --- job states gone on from


@query()
def q_state_resume(spark, sf_dir):
    events = job_events(spark, sf_dir)
    half = events.groupBy("clip_id").agg(F.percentile_approx("now", 0.5).alias("mid"))
    both = events.join(half, "clip_id")
    first = Z.fold(both.where("now < mid").drop("mid"), "strict", 21600, 4)
    out = Z.fold(both.where("now >= mid").drop("mid"), "strict", 21600, 4, Z.initialise(first, events))
    return out.select("clip_id", "status", "attempt", "claimed", "refused", "rejected")


def _resume_sql() -> str:
    from frameloom.plans.clips import fold_sql

    body = fold_sql("strict")
    head, last = body.rsplit("\nSELECT ", 1)
    return f"WITH RECURSIVE {head}\nSELECT clip_id, status, attempt, claimed, refused, rejected" + last[last.index(" FROM st") :]


ORACLES["q_state_resume"] = _resume_sql()


# --- pixels: vectors as images of 8 x 8

PIXELS = """g0 AS (SELECT vec_id, label AS clip_id, list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 1000) AS INTEGER) % 256) AS g, embedding AS e FROM embeddings),
g1 AS (SELECT *, lag(g) OVER (PARTITION BY clip_id ORDER BY vec_id) AS b FROM g0)"""
SIDE = "list_transform(range(64), lambda i: {body})"


def pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    gray = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int"))
    return e.select(F.col("label").alias("clip_id"), F.col("vec_id").alias("frame_index"), gray.alias("gray"), F.lit(8).alias("height"), F.lit(8).alias("width"), "embedding")


AT = lambda dy, dx: f"g[abs(7 - abs(7 - abs(i // 8 + {dy}))) * 8 + abs(7 - abs(7 - abs(i % 8 + {dx}))) + 1]"
LAPLACE = f"list_transform(range(64), lambda i: {AT(-1, 0)} + {AT(1, 0)} + {AT(0, -1)} + {AT(0, 1)} - 4 * {AT(0, 0)})"


@query(f"""SELECT vec_id AS frame_index, round(list_avg(g), 6) AS brightness, CAST(round(list_aggregate({LAPLACE}, 'var_pop') * 4096, 0) AS BIGINT) AS sharpness, round(CASE WHEN b IS NULL THEN 0 ELSE list_avg(list_transform(range(64), lambda i: abs(g[i + 1] - b[i + 1]))) END, 6) AS frame_diff,
round(CASE WHEN b IS NULL THEN 0 ELSE sqrt(greatest(0, 1 - list_sum(list_transform(range(64), lambda k: sqrt(len(list_filter(g, lambda v: v // 4 = k)) * len(list_filter(b, lambda v: v // 4 = k))))) / 64)) END, 6) AS hist_diff FROM g1""", PIXELS)
def q_frame_signals(spark, sf_dir):
    f = G.with_frame_signals(pixels(spark, sf_dir))
    return f.select("frame_index", F.round("brightness", 6).alias("brightness"), F.round(F.col("sharpness") * 4096).cast("long").alias("sharpness"), F.round("frame_diff", 6).alias("frame_diff"), F.round("hist_diff", 6).alias("hist_diff"))


@query("SELECT vec_id AS frame_index, CASE WHEN b IS NULL THEN 0e0 ELSE round(greatest(0, 1 - (SELECT corr(x, y) FROM (SELECT unnest(g) AS x, unnest(b) AS y))), 6) END AS distance FROM g1", PIXELS)
def q_correlation(spark, sf_dir):
    f = pixels(spark, sf_dir)
    before = F.lag("gray").over(Window.partitionBy("clip_id").orderBy("frame_index"))
    f = f.withColumn("before", before)
    return f.select("frame_index", F.round(G.correlation_distance("gray", "before"), 6).alias("distance"))


@query("""SELECT vec_id AS frame_index, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.9), 6) AS p90, round(avg(CASE WHEN m > 0.1 THEN 1e0 ELSE 0e0 END), 6) AS area FROM (
SELECT vec_id, sqrt(power(x - median(x) OVER (PARTITION BY vec_id), 2) + power(y - median(y) OVER (PARTITION BY vec_id), 2)) AS m FROM (SELECT vec_id, unnest(e[1:32])::DOUBLE AS x, unnest(e[33:64])::DOUBLE AS y FROM g0)) GROUP BY 1""", PIXELS)
def q_flow_summary(spark, sf_dir):
    half = lambda start: F.slice("embedding", start, 32).cast("array<double>")
    f = pixels(spark, sf_dir).select("frame_index", G.flow_summary(half(1), half(33), 0.1).alias("f"))
    return f.select("frame_index", *[F.round(f"f.{c}", 6).alias(c) for c in ("mean", "p90", "area")])


@query("SELECT vec_id AS frame_index, round_even(0.114e0 * g[1] + 0.587e0 * g[2] + 0.299e0 * g[3], 0)::INTEGER AS first, len(g) // 4 AS n FROM g0", PIXELS)
def q_gray_pixels(spark, sf_dir):
    f = pixels(spark, sf_dir).withColumn("data", F.unhex(F.array_join(F.transform("gray", lambda v: F.lpad(F.hex(v), 2, "0")), "")))
    gray = f.select("frame_index", G.gray_pixels("data", F.lit(4), F.lit(4), F.lit(4)).alias("g"))
    return gray.select("frame_index", F.col("g")[0].alias("first"), F.size("g").cast("long").alias("n"))


FLAGS = f"""ke AS (SELECT vec_id, clip_id, vec_id % 6 = 0 AS gone, list_avg(g) AS bright, list_aggregate({LAPLACE}, 'var_pop') AS sharp, g FROM g0),
en AS (SELECT vec_id, -sum(h * log2(h)) AS entropy FROM (SELECT vec_id, count(*) / 64e0 * (256e0 / 255) AS h FROM (SELECT vec_id, unnest(g) AS v FROM g0) GROUP BY vec_id, v) GROUP BY 1)"""


@query("""SELECT vec_id AS id, CASE WHEN gone THEN 1 ELSE (sharp < 80)::INTEGER END AS blurry, CASE WHEN gone THEN 1 ELSE (entropy < 4.2)::INTEGER END AS low_entropy, CASE WHEN gone THEN 1 ELSE (bright < 25 OR bright > 235)::INTEGER END AS dark_or_bright, 'fixed' AS version FROM ke JOIN en USING (vec_id)""", PIXELS + ", " + FLAGS)
def q_evaluate_keyframes(spark, sf_dir):
    p = pixels(spark, sf_dir)
    keys = p.select("clip_id", F.col("frame_index").cast("string").alias("frame_id"), F.col("frame_index").cast("double").alias("timestamp"), F.col("frame_index").cast("string").alias("frame_path"))
    images = p.where("frame_index % 6 <> 0").select(F.col("frame_index").cast("string").alias("frame_path"), "gray", "height", "width")
    out = P.evaluate_keyframes(keys, images, "fixed")
    return out.select(F.col("frame_id").cast("long").alias("id"), "blurry", "low_entropy", "dark_or_bright", "version")


# --- composed pipelines

RECORDS = "rc AS (SELECT *, CAST(clip_id AS INTEGER) AS c FROM cl)"


def records(spark, sf_dir):
    """What a sampler said of each clip: file, duration, chosen frames."""
    one = F.struct("frame_order", "frame_index", "timestamp_sec", "selected_reason", "combined_score", "image_path")
    f = clip_frames(spark, sf_dir).groupBy("clip_id").agg(F.array_sort(F.collect_list(one)).alias("selected_frames"))
    c = clips(spark, sf_dir).join(f, "clip_id")
    return c.select(F.format_string("ep01_clip_%04d.mp4", "clip_id").alias("clip_file"), F.col("clip_id").cast("int").alias("line"), F.when(F.col("clip_id") % 9 != 0, F.col("duration_sec")).alias("duration_sec"), "selected_frames")


MANIFEST = f"""d AS (SELECT clip_id, CASE WHEN clip_id % 9 <> 0 THEN duration_sec ELSE 0e0 END AS duration_sec, n_frames FROM cl),
m AS (SELECT *, coalesce(sum(duration_sec) OVER (ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS start_sec FROM d)"""


@query(f"SELECT CAST(clip_id AS INTEGER) AS clip_id, {FMT('start_sec')} AS actual_start_time, {FMT('(start_sec + duration_sec)')} AS actual_end_time, CAST(n_frames AS INTEGER) AS selected_frame_count FROM m", CLIPS + ", " + MANIFEST)
def q_build_manifest(spark, sf_dir):
    return P.build_manifest(records(spark, sf_dir)).select("clip_id", "actual_start_time", "actual_end_time", "selected_frame_count")


@query("SELECT count(*) AS n_references, count(DISTINCT printf('%d/%d/%d', clip_id, frame_order, 0)) AS n_targets, count(*) FILTER (frame_order > 0) AS n_uploads FROM cf", CLIP_FRAMES)
def q_cloud_run(spark, sf_dir):
    path = f"{scratch(spark, 'manifest')}/m"
    P.build_manifest(records(spark, sf_dir)).write.parquet(path)
    m = spark.read.parquet(path)
    moved = P.prepare_cloud_run(m, "s3://b/run", spark.createDataFrame([], "target string"))[0]
    there = moved.select(F.col("selected_frames")[0]["image_path"].alias("target"))
    _, uploads, counts = P.prepare_cloud_run(m, "s3://b/run", there)
    return counts.crossJoin(uploads.agg(F.count("*").alias("n_uploads")))  # single rows


@query("SELECT CAST(clip_id AS INTEGER) AS clip_id, frame_order, printf('/cache/frames/clip_%04d/%02d_', clip_id, frame_order) || printf('%02d_t%07.3f.jpg', l_linenumber, l_quantity) AS image_path FROM cf", CLIP_FRAMES)
def q_local_frames(spark, sf_dir):
    m = T.with_cloud_paths(P.build_manifest(records(spark, sf_dir)), "s3://b/run")
    # a store's name begins with the frame's place, which the cache names again
    bare = m.withColumn("selected_frames", F.transform("selected_frames", lambda f: f.withField("image_path", F.regexp_replace(f["image_path"], r"/\d\d_(\d\d_t)", "/$1"))))
    out = P.local_frames(bare, "/cache/")
    return out.select("clip_id", F.explode("selected_frames").alias("f")).select("clip_id", "f.frame_order", "f.image_path")


@query("SELECT c_custkey AS clip_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT clip_id FROM att WHERE error IS NULL AND json_parse_ok)", ATTEMPTS)
def q_remaining_manifest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"))
    return P.remaining_manifest(c, attempts(spark, sf_dir), c.where("clip_id % 2 = 0"))


@query("SELECT p_partkey || '/x' AS path, p_partkey % 2 = 0 AS reuse FROM part WHERE p_partkey <> 1 UNION ALL SELECT '1/config.json', false")
def q_bundle_plan(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.concat(k.cast("string"), F.when(k == 1, "/config.json").otherwise("/x")).alias("path"), F.col("p_size").alias("size"), F.col("p_name").alias("digest"), k.alias("k"))
    return P.bundle_plan(p.select("path", "size", "digest"), p.where("k % 2 = 0").select("path", "size", "digest")).select("path", "reuse")


@query("SELECT count(*) = count(*) FILTER (n_frames > 1) AS complete, CASE WHEN count(*) FILTER (n_frames <= 1) > 0 THEN count(*) FILTER (n_frames <= 1) || ' missing' ELSE 'complete' END AS reason, count(*) AS n, count(*) FILTER (n_frames <= 1) AS missing FROM cl", CLIPS)
def q_manifest_complete(spark, sf_dir):
    m = P.build_manifest(records(spark, sf_dir))
    short = m.withColumn("selected_frame_count", F.when(F.col("selected_frame_count") > 1, F.col("selected_frame_count")))
    return P.manifest_complete(m, short)


@query("""SELECT CAST(clip_id AS INTEGER) AS clip_id, frame_order, CAST(frame_order // k AS INTEGER) AS row, CAST(frame_order % k AS INTEGER) AS column, CAST(frame_order % k * 320 AS INTEGER) AS left, CAST(ceil(n / k) AS INTEGER) AS rows FROM (SELECT clip_id, frame_order, n, least(4, n) AS k FROM (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM cf))""", CLIP_FRAMES)
def q_contact_grid(spark, sf_dir):
    f = clip_frames(spark, sf_dir).select(F.col("clip_id").cast("int").alias("clip_id"), "frame_order")
    return P.contact_grid(f).select("clip_id", "frame_order", "row", "column", "left", "rows")


COVERAGE = """ev AS (SELECT clip_id, timestamp_sec AS t, value AS s, clip_id % 5 = 0 AS lost, clip_id % 7 = 0 AS still FROM raw),
th AS (SELECT clip_id, quantile_cont(s, 0.8) AS q FROM ev WHERE NOT still GROUP BY 1),
me AS (SELECT ev.clip_id, t FROM ev JOIN th USING (clip_id) WHERE NOT still AND s >= q),
kf AS (SELECT clip_id, timestamp_sec AS k FROM raw WHERE frame_index % 9 = 0),
cv AS (SELECT clip_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM kf WHERE kf.clip_id = me.clip_id AND abs(kf.k - me.t) <= 1)) AS c FROM me GROUP BY 1)"""


@query("""SELECT clip_id, CASE WHEN clip_id % 5 <> 0 THEN coalesce(n, 0) END AS n_events, CASE WHEN clip_id % 5 <> 0 THEN coalesce(c, 0) END AS n_covered, CASE WHEN clip_id % 5 = 0 THEN 'clip video not found' WHEN n IS NULL THEN 'no motion data' ELSE '' END AS note FROM (SELECT DISTINCT clip_id FROM kf) LEFT JOIN cv USING (clip_id)""", FRAMES.strip() + ", " + COVERAGE)
def q_coverage_notes(spark, sf_dir):
    f = raw_frames(spark, sf_dir)
    keys = f.where("frame_index % 9 = 0").select("clip_id", F.col("timestamp_sec").alias("timestamp"))
    motion = f.where("clip_id % 7 <> 0").select("clip_id", F.col("timestamp_sec").alias("timestamp"), F.col("value").alias("score"))
    known = f.where("clip_id % 5 <> 0").select("clip_id").distinct()
    return P.evaluate_motion_coverage(keys, motion, known, "fixed").select("clip_id", "n_events", "n_covered", "note")


@query("SELECT co.clip_id, count(*) AS num_candidates, 8 AS selected_count, any_value(label) AS dynamic_category, round(any_value(co.weight), 6) AS flow_weight FROM co JOIN dy USING (clip_id) GROUP BY 1", FRAMES)
def q_sampler(spark, sf_dir):
    out = P.sample_clips(raw_frames(spark, sf_dir))
    names = F.forall("selected_frames", lambda f: f["image_file"].rlike(r"^\d\d_t\d{3}\.\d{3}_f\d+\.jpg$"))
    return out.where(names).select("clip_id", "num_candidates", "selected_count", "dynamic_category", F.round("flow_weight", 6).alias("flow_weight"))
