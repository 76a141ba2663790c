"""Mixing sources to target weights by entropy balancing.

The rates r nearest to 1 in entropy (sum r log r - r) whose words meet each source's target, held at ``most``
copies, are r = min(most, exp(lambda n / m)): n a document's words, m its source's mean. The dual in lambda is
convex with a diagonal Hessian, as a document counts for one source, and is solved by Newton steps (kept inside
a bracket): each step is one distributed sum over the histogram of (source, size), which was added up before.
Rates become copies: floor(r), and one more where u - frac(r) is under its source's threshold, u a hash of the
id. The threshold, near 0, is found exactly, as the prefix of documents in that order which still fits: by two
levels of 4096 ranges, summed before they are shuffled, so only a 2**-24th of a source is ever sorted together.
What is left is made up by single documents, a copy more or
less, whichever comes nearest, in a few rounds. The driver holds a few numbers a source.

Edge cases: a null text has 0 words and is taken 0 times; a null source is a source, the last; sources without
words have target 0; an empty table gives no rows; rows with repeated ids are documents of their own; equal
documents tie by id. Reruns agree, as nothing is drawn but hashes of ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import BROADCAST_BYTES, WORD, cut, fits, row_of, table

RANGES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_targets(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """total dealt by weight, at most most x size each; what is above is dealt anew until nothing is."""
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / w
            break
        for i in full:
            targets[i] = most * sizes[i]
            open_.discard(i)
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
    return targets


def small(spark: SparkSession, **columns) -> DataFrame:
    """A few values a source, as a table that may be broadcast."""
    frame = pd.DataFrame(columns)
    df = spark.createDataFrame(frame)
    return F.broadcast(df) if frame.memory_usage().sum() < BROADCAST_BYTES else df


def rate(lam: Column, size: Column, mean: Column, most: float) -> Column:
    return F.when(lam * size / mean >= math.log(most), F.lit(float(most))).otherwise(F.exp(F.least(lam * size / mean, F.lit(math.log(most)))))


def balance(histogram: DataFrame, sums: np.ndarray, targets: np.ndarray, means: np.ndarray, most: float = 2.0, steps: int = 80) -> np.ndarray:
    """The dual's solution: lambda of each source. histogram(sid, size, n) holds documents by size."""
    spark, k = histogram.sparkSession, len(sums)
    lam = np.log(np.maximum(targets, 1e-9) / np.maximum(sums, 1e-9))
    lo, hi = np.full(k, -np.inf), np.full(k, np.inf)
    done = (sums <= 0) | (targets >= most * sums * (1 - 1e-12)) | (targets <= 0)
    lam[(sums > 0) & (targets >= most * sums * (1 - 1e-12))] = 1e9
    lam[targets <= 0] = -1e9
    for _ in range(steps):
        if done.all():
            break
        at = small(spark, sid=np.flatnonzero(~done), lam=lam[~done], mean=means[~done])
        r = rate(F.col("lam"), F.col("size"), F.col("mean"), most)
        slope = F.when(r < most, r * F.col("size") / F.col("mean")).otherwise(0.0)
        got = histogram.join(at, "sid").groupBy("sid").agg(F.sum(F.col("n") * F.col("size") * r).alias("f"), F.sum(F.col("n") * F.col("size") * slope).alias("g")).collect()
        for row in got:
            i, gap = row.sid, row.f - targets[row.sid]
            if abs(gap) <= max(0.25, 1e-9 * targets[i]):
                done[i] = True
                continue
            lo[i], hi[i] = (lam[i], hi[i]) if gap < 0 else (lo[i], lam[i])
            step = lam[i] - gap / row.g if row.g > 0 else math.inf * -gap
            if not lo[i] < step < hi[i]:
                step = (lo[i] + hi[i]) / 2 if np.isfinite(lo[i] + hi[i]) else (lam[i] + (1 + abs(lam[i])) * (1 if gap < 0 else -1))
            lam[i] = step
            if hi[i] - lo[i] < 1e-13 * (1 + abs(lam[i])):
                done[i] = True
    return lam


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, fill_rounds: int = 6) -> DataFrame:
    """docs(doc_id, source, size) -> (doc_id, source, size, source_size, target, rate, copies, taken), a row for each of docs."""
    spark = docs.sparkSession
    docs = cut(docs.select("doc_id", "source", "size", F.monotonically_increasing_id().alias("rid")))
    rows = docs.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.when(F.col("size") > 0, 1)).alias("n")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sums, counts = np.array([float(r.s or 0) for r in rows]), np.array([r.n for r in rows], float)
    if not rows:
        return docs.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"))
    targets = np.array(shared_targets(sums.tolist(), [weights[i % len(weights)] for i in range(len(rows))], share * sums.sum(), most))
    means = np.where(counts > 0, sums / np.maximum(counts, 1), 1.0)
    names = spark.createDataFrame([(i, r.source) for i, r in enumerate(rows)], "sid int, name string")
    if sum(len(r.source or "") + 40 for r in rows) < BROADCAST_BYTES:
        names = F.broadcast(names)
    meta = docs.join(names, docs.source.eqNullSafe(names.name)).select("rid", "doc_id", "sid", "size")
    histogram = cut(meta.where("size > 0").groupBy("sid", "size").agg(F.count("*").alias("n")))
    lam = balance(histogram, sums, targets, means, most)

    sids = np.arange(len(rows))
    r = F.when(F.col("size") > 0, rate(F.col("lam"), F.col("size"), F.col("mean"), most)).otherwise(0.0)
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "size"), 11) / float(1 << 53)  # by size too, as ids may be null
    meta = meta.join(small(spark, sid=sids, lam=lam, mean=means), "sid").withColumn("rate", r).withColumn("base", F.floor("rate").cast("int"))
    meta = meta.withColumn("k", u - (F.col("rate") - F.col("base"))).withColumn("x", (F.col("k") + 1) / 2 * RANGES)
    meta = meta.withColumn("x1", F.least(F.floor("x"), F.lit(RANGES - 1)).cast("int")).withColumn("x2", F.least(F.floor((F.col("x") - F.col("x1")) * RANGES), F.lit(RANGES - 1)).cast("int"))
    meta = cut(meta.select("rid", "doc_id", "sid", "size", "rate", "base", "k", "x1", "x2"))
    by_base = {x.sid: x.t for x in meta.groupBy("sid").agg(F.sum(F.col("size") * F.col("base")).alias("t")).collect()}
    left = targets - np.array([float(by_base.get(i) or 0) for i in sids])
    more = meta.where((F.col("base") < most) & (F.col("size") > 0))

    def threshold(at: DataFrame, by: str, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each source the first range that no longer fits whole, and what is left before it."""
        run = Window.partitionBy("sid").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        sums = at.groupBy("sid", by).agg(F.sum("size").alias("t")).withColumn("upto", F.sum("t").over(run))
        over = sums.join(small(spark, sid=sids, left=left), "sid").withColumn("fits", F.col("upto") <= F.col("left"))
        got = over.groupBy("sid").agg(F.min(F.when(~F.col("fits"), F.col(by))).alias("edge"), F.max(F.when(F.col("fits"), F.col("upto"))).alias("whole")).collect()
        edge, rest = np.full(len(sids), RANGES), left.copy()
        for x in got:
            edge[x.sid] = RANGES if x.edge is None else x.edge
            rest[x.sid] -= x.whole or 0
        return edge, rest

    edge1, left1 = threshold(more, "x1", left)
    edges = small(spark, sid=sids, edge1=edge1)
    edge2, left2 = threshold(more.join(edges, "sid").where("x1 = edge1"), "x2", left1)
    edges = small(spark, sid=sids, edge1=edge1, edge2=edge2, left2=left2)
    order = Window.partitionBy("sid").orderBy("k", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    last = more.join(edges, "sid").where("x1 = edge1 and x2 = edge2").withColumn("upto", F.sum("size").over(order)).where("upto <= left2").select("rid", "sid", "size", F.lit(1).alias("fit"))
    last = cut(last)
    used = {x.sid: x.t for x in last.groupBy("sid").agg(F.sum("size").alias("t")).collect()}
    gap = left2 - np.array([float(used.get(i) or 0) for i in sids])
    chosen = meta.join(edges, "sid").join(last.select("rid", "fit"), "rid", "left")
    under = (F.col("x1") < F.col("edge1")) | ((F.col("x1") == F.col("edge1")) & (F.col("x2") < F.col("edge2"))) | F.col("fit").isNotNull()
    can = (F.col("base") < most) & (F.col("size") > 0)
    chosen = cut(chosen.select("rid", "doc_id", "sid", "size", "rate", "base", "k", F.when(can & under, 1).otherwise(0).alias("extra")))
    # what is left is made up by single copies, more or fewer, whichever comes nearest
    picked: dict[int, int] = {}
    for _ in range(fill_rounds):
        rest = chosen.where(can).join(small(spark, sid=sids, gap=gap), "sid")
        if picked:
            rest = rest.join(small(spark, rid=np.array([*picked])), "rid", "left_anti")
        turn = F.when((F.col("gap") > 0) & (F.col("extra") == 0), 1).when((F.col("gap") < 0) & (F.col("extra") == 1), -1)
        rest = rest.withColumn("turn", turn).withColumn("off", F.abs(F.col("gap") - F.col("turn") * F.col("size"))).where("off < abs(gap)")
        got = rest.groupBy("sid").agg(F.min(F.struct("off", F.abs("k").alias("k"), F.coalesce("doc_id", F.lit(0)).alias("d"), "rid", "size", "turn")).alias("m")).collect()
        if not got:
            break
        for x in got:
            picked[x.m.rid] = x.m.turn
            gap[x.sid] -= x.m.turn * x.m.size
    if picked:
        chosen = chosen.join(small(spark, rid=np.array([*picked]), turn=np.array([*picked.values()], np.int32)), "rid", "left")
        chosen = chosen.withColumn("extra", F.col("extra") + F.coalesce("turn", F.lit(0)))
    out = chosen.join(small(spark, sid=sids, source_size=sums.astype(np.int64), target=targets), "sid").withColumn("copies", (F.col("base") + F.col("extra")).cast("int"))
    out = out.join(names, "sid").withColumnRenamed("name", "source")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


MIXED = ("size", "source_size", "target", "rate", "copies", "taken")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs(doc_id, text, source, ...) with all their columns and MIXED, which replace columns of these names.

    Rows equal in id, source and size share their copies out among them, the fewest to the least hash of the text.
    """
    keys = {"k1": F.col("doc_id").cast("long"), "k2": F.col("source").cast("string"), "k3": n_words(F.col("text").cast("string"))}
    held = docs.select(row_of(docs).alias("row"), *[v.alias(k) for k, v in keys.items()], F.xxhash64(F.col("text").cast("string")).alias("h"))  # any names may be there
    made = mix(held.select(F.col("k1").alias("doc_id"), F.col("k2").alias("source"), F.col("k3").alias("size")), **how)
    facts = made.groupBy("doc_id", "source", "size", "source_size", "target", "rate", "copies").agg(F.count("*").alias("n"))
    # a key's rows have one or two numbers of copies: floor of the rate and one more, or one off for the sum's sake
    few = F.struct("copies", "n")
    facts = cut(facts.groupBy("doc_id", "source", "size").agg(F.array_sort(F.collect_list(few)).alias("c"), *[F.first(x).alias(x) for x in ("source_size", "target", "rate")]))
    join = lambda f: held.join(f, F.col("k1").eqNullSafe(f.doc_id) & F.col("k2").eqNullSafe(f.source) & (F.col("k3") == f["size"]))
    one = join(facts.where("size(c) = 1")).withColumn("copies", F.col("c")[0]["copies"])
    rank = F.row_number().over(Window.partitionBy("k1", "k2", "k3").orderBy("h"))
    upto = F.transform("c", lambda x, i: F.struct(x["copies"].alias("copies"), F.aggregate(F.slice("c", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("upto")))
    shared = cut(facts.where("size(c) > 1"))
    several = join(F.broadcast(shared) if fits(shared, 256) else shared).withColumns({"rank": rank, "upto": upto})
    several = several.withColumn("copies", F.filter("upto", lambda x: F.col("rank") <= x["upto"])[0]["copies"])
    kept = [c for c in docs.columns if c not in MIXED]
    columns = [*[F.col("row")[c].alias(c) for c in kept], F.col("k3").alias("size"), "source_size", "target", "rate", F.col("copies").cast("int").alias("copies"), (F.col("k3") * F.col("copies")).alias("taken")]
    return one.select(*columns) if shared.isEmpty() else one.select(*columns).unionByName(several.select(*columns))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", "taken")


QUERIES = {"op5_mix": op5_mix}
ORACLES: dict[str, str] = {}
