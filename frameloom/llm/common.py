"""What the corpus operators share: tables, the shared folder, byte-level helpers and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.sources.folders import scratch, shared_dir

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: What one side of a join may weigh to be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_of(docs: DataFrame, **changed: Column) -> Column:
    """All columns of docs, of any names, as one struct; some of them changed."""
    return F.struct(*[changed.get(c, docs[quoted(c)]).alias(c) for c in docs.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is made and run inside leaves no shuffle files behind once it has run."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession, most: int = 1 << 20) -> None:
    """From now on Python gets and gives batches of about most bytes in this session (Spark's own bound is 64 MB, with buffers that double).

    It stays set, as a stage's last step runs only when its result is written; a smaller bound that is set already stays too.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(str(spark.conf.get(name)).rstrip("b"))
    if not 0 < held <= most:
        spark.conf.set(name, str(most))


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and cut off from how it was made."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows, of row_bytes each, may be broadcast. Counts df, so df should be cut or cheap."""
    most = limit // row_bytes + 1
    return df.limit(most).count() < most


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (the public murmur3 constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most bytes each; a larger row makes a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Forest:
    """Union-find over 0..n-1; joins that were new are kept as edges."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges; component is the least node reachable.

    Alternating large-star and small-star rounds; each round is cut in the shared folder. Nodes are longs.
    """
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    e = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    e = cut(e.select(pair(F.col("x"), F.col("y")).alias("p")).select("p.*").distinct())
    state = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        # every node hangs on one root, and no root hangs on another
        if state == tuple(now):
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string")) % folds
