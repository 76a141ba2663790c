"""Exact top-k inner products by multi-resolution segment statistics.

Vectors become integers floor(scale * x). For unit u of a resolution (a vector cut into 1, 4, 16 segments) a
vector keeps each segment's mean and deviation; with lengths l, means m and deviations s, the squared distance
of q and x is at least sum l ((mq - mx)^2 + (sq - sx)^2), and as |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, the inner
product is at most sum l (mq mx + sq sx). Pairs are tested coarse to fine against the k-th best exact score
that the query has so far; only what survives every resolution is scored exactly, in integers.

Layout: one pass packs rows into blocks of at most ``block`` vectors of one dimension; the query blocks are
packed from them. Blocks are dealt out over a grid: a cell holds a part of the query blocks and a group of candidate
blocks, and a query block hands its thresholds from one candidate block of the group to the next; a candidate block
whose longest vector can't reach any of them is passed over whole. A query yields k rows a group, and there are as
many groups as the cluster needs to be busy, not as the table has blocks. No row is ever paired as a row.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; only vectors of the
query's dimension are its candidates; rows with a null id are candidates but no queries and rank after equal
scores of other ids; a row is told from a repeated row by where it is packed, so copies of a query's row (same
id) are candidates; an empty table gives no rows. Components are exact integers of any size: scores that doubles can't
hold are added up as 64-bit integers, those beyond as whole numbers; only what is beyond a long is held at its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import cut, table

RESOLUTIONS = (1, 4, 16)
NO_ID = np.iinfo(np.int64).max
BLOCK = "block long, dim int, n int, wide boolean, ids binary, rows binary, vectors binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]
TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
LEAST = np.iinfo(np.int64).min


class Packer:
    """Collects (ids, places, vectors) by dimension and width and gives blocks of them. Wide vectors are kept unscaled."""

    def __init__(self, most: int):
        self.part, self.made, self.most = TaskContext.get().partitionId(), 0, most
        self.held: dict[tuple[int, bool], list] = {}

    def add(self, wide: bool, ids: np.ndarray, rows: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = (v.shape[1], wide)
        self.held.setdefault(key, []).append((ids, rows, v))
        while sum(len(x[0]) for x in self.held[key]) >= self.most:
            yield self.block(key, self.most)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for key in sorted(self.held):
            while sum(len(x[0]) for x in self.held[key]):
                yield self.block(key, self.most)

    def block(self, key: tuple[int, bool], n: int) -> pa.RecordBatch:
        ids, rows, vs = (np.concatenate(x) for x in zip(*self.held[key]))
        self.held[key] = [(ids[n:], rows[n:], vs[n:])]
        self.made += 1
        row = [self.part << 32 | self.made, key[0], len(ids[:n]), key[1], ids[:n].tobytes(), rows[:n].tobytes(), vs[:n].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TYPES)], NAMES)


def packed(frame: DataFrame, scale: float, block: int) -> DataFrame:
    """(id, v array<double>) -> blocks; rows holds each vector's place, the number of its partition and of the row in it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(block), 0
        for b in batches:
            ids = np.array(b.column(0).fill_null(NO_ID), np.int64)
            lists = b.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.array(lists.flatten().fill_null(np.nan), np.float64)
            start = np.r_[0, np.cumsum(sizes)]
            for dim in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dim)
                v = flat[start[at][:, None] + np.arange(dim)]
                ok = np.isfinite(v).all(axis=1)
                at, v = at[ok], v[ok]
                wide = (np.abs(v) >= 2.0**30 / scale).any(axis=1)
                for w, x in ((False, np.floor(scale * v[~wide]).astype(np.int32)), (True, v[wide])):
                    if len(x):
                        yield from packer.add(w, ids[at[wide == w]], (packer.part << 40) + seen + at[wide == w], x)
            seen += b.num_rows
        yield from packer.rest()

    return frame.mapInArrow(pack, BLOCK)


def unpack(row: dict, at: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.float64 if row[f"{at}wide"] else np.int32
    return np.frombuffer(row[f"{at}ids"], np.int64), np.frombuffer(row[f"{at}rows"], np.int64), np.frombuffer(row[f"{at}vectors"], kind).reshape(-1, row["dim"])


def whole(v: np.ndarray, wide: bool, scale: float) -> np.ndarray:
    """Components as Python integers: floor(scale * x) of what is unscaled, exactly."""
    if not wide:
        return v.astype(object)
    part = lambda x: int(x) * int(scale) if abs(x) >= 2.0**53 and scale == int(scale) else math.floor(x * scale)
    return np.array([[part(x) for x in row] for row in v.tolist()], object)


def stats(v: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(l) m and sqrt(l) s for each segment: their inner products bound those of the vectors."""
    cuts = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).round().astype(int)
    length = np.diff(cuts)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / length
    square = np.add.reduceat(v * v, cuts[:-1], axis=1)
    rest = np.sqrt(np.maximum(square - length * mean * mean, 0))
    return np.hstack([mean * np.sqrt(length), rest])


class Best:
    """The k best candidates of the queries of a block so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.score, self.ids, self.rows = (np.empty(0, np.int64),) * 4
        self.floor = np.full(n, LEAST)  # the k-th best score of each query

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        q, s, i, r = np.r_[self.query, query], np.r_[self.score, score], np.r_[self.ids, ids], np.r_[self.rows, rows]
        order = np.lexsort((r, i, ~s, q))  # ~s falls as s rises
        q, s, i, r = q[order], s[order], i[order], r[order]
        nth = np.arange(len(q)) - np.searchsorted(q, np.arange(self.n))[q]
        top = nth < self.k
        self.query, self.score, self.ids, self.rows = q[top], s[top], i[top], r[top]
        last = nth == self.k - 1
        self.floor[q[last]] = s[last]


def update(best: Best, q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, step: int = 512) -> None:
    """Adds a block's candidates to best. Components are below 2**30; scores are exact."""
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    exact = np.abs(qf).max(initial=1) * np.abs(cf).max(initial=1) * q.shape[1] < 2**53  # then doubles hold every sum
    size, reach = np.linalg.norm(qf, axis=1), np.linalg.norm(cf, axis=1)
    slack = 1e-9 * (1 + size) * (1 + reach.max(initial=0))
    low = np.where(best.floor > LEAST, best.floor.astype(np.float64) - slack - 1e-9 * np.abs(best.floor.astype(np.float64)), -np.inf)
    if (size * reach.max(initial=0) < low).all():
        return
    order = np.lexsort((c_ids, -reach))  # longest first: good scores come early
    c, cf, c_ids, c_rows = c[order], cf[order], c_ids[order], c_rows[order]
    levels = [(stats(qf, s), stats(cf, s)) for s in RESOLUTIONS if s <= q.shape[1]]
    for at in range(0, len(c), step):
        to = slice(at, at + step)
        low = np.where(best.floor > LEAST, best.floor.astype(np.float64) - slack - 1e-9 * np.abs(best.floor.astype(np.float64)), -np.inf)
        alive = levels[0][0] @ levels[0][1][to].T >= low[:, None]
        i, j = np.nonzero(alive)
        for a, b in levels[1:]:
            if len(i) > 0.2 * alive.size:
                alive &= a @ b[to].T >= low[:, None]
                i, j = np.nonzero(alive)
            else:
                ok = np.einsum("ij,ij->i", a[i], b[to][j]) >= low[i]
                i, j = i[ok], j[ok]
        if len(i) > 0.2 * len(q) * len(c[to]):
            full = (qf @ cf[to].T).astype(np.int64) if exact else q.astype(np.int64) @ c[to].astype(np.int64).T
            score = full[i, j]
        else:
            score = np.einsum("ij,ij->i", qf[i], cf[to][j]).astype(np.int64) if exact else np.einsum("ij,ij->i", q[i].astype(np.int64), c[to][j].astype(np.int64))
        ok = (q_rows[i] != c_rows[to][j]) & (score >= best.floor[i])
        i, j, score = i[ok], j[ok], score[ok]
        best.add(i, score, c_ids[to][j], c_rows[to][j])


def update_whole(best: Best, q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, step: int = 256) -> None:
    """The same of whole numbers of any size, without bounds; scores beyond a long are held at its ends."""
    for at in range(0, len(c), step):
        to = slice(at, at + step)
        score = np.clip(q @ c[to].T, LEAST + 1, -(LEAST + 1)).astype(np.int64)
        i, j = np.nonzero((q_rows[:, None] != c_rows[to][None, :]) & (score >= best.floor[:, None]))
        best.add(i, score[i, j], c_ids[to][j], c_rows[to][j])


def top_k(frame: DataFrame, id_col: str, vector_col: str, every: int = 20, k: int = 20, scale: float = 64.0, block: int = 4096, query_block: int = 2048, cells: int | None = None) -> DataFrame:
    """The k highest integer inner products of each query (id divisible by every) with all other rows: (query_id, rank, vec_id, score).

    cells says into how many tasks the pairs of blocks are dealt, four a core if it isn't given.
    """
    rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    blocks = cut(packed(rows, scale, block))

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(query_block)
        for b in batches:
            for row in b.to_pylist():
                ids, places, v = unpack(row)
                ok = (ids % every == 0) & (ids != NO_ID)
                yield from packer.add(row["wide"], ids[ok], places[ok], v[ok])
        yield from packer.rest()

    n_blocks, asked, weight = blocks.agg(F.count("*"), F.sum("n"), F.sum(F.length("vectors"))).first()
    q = cut(blocks.repartition(max(1, -(-(asked or 0) // (every * query_block))), "block").mapInArrow(queries, BLOCK))
    # the grid that moves least: a candidate is sent to each part, a query to each group with k rows (some four times
    # its own weight) sent back, and a group's blocks fit in a task
    cells = cells or 4 * frame.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(n_blocks, max(math.isqrt(cells * every // 4), (weight or 0) >> 28)))
    parts = max(1, min(q.count(), -(-cells // groups)))
    to = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    of = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    asking = q.select("dim", F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("wide", "ids", "rows", "vectors")], of("block", parts, "part"), to(groups, "group"))
    pairs = asking.join(blocks.select("*", of("block", groups, "group"), to(parts, "part")).hint("shuffle_merge"), ["dim", "part", "group"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, asked = None, None, None

        def out() -> pa.RecordBatch:
            ids, places = asked[0], asked[1]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[best.query], places[best.query], best.ids, best.rows, best.score)], ["query_id", "query_row", "vec_id", "vec_row", "score"])

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if (row["q_block"], row["group"]) != key:  # a query block's rows come one after the other
                    if best:
                        yield out()
                    key, asked = (row["q_block"], row["group"]), unpack(row, "q_")
                    best = Best(len(asked[0]), k)
                ids, places, v = unpack(row)
                if row["wide"] or row["q_wide"]:
                    update_whole(best, whole(asked[2], row["q_wide"], scale), asked[1], whole(v, row["wide"], scale), ids, places)
                else:
                    update(best, asked[2], asked[1], v, ids, places)
        if best:
            yield out()

    return merged(pairs.mapInArrow(scored, "query_id long, query_row long, vec_id long, vec_row long, score long"), k)


def merged(best: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all groups; at most k rows came from each."""
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    out = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS y FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.y, c.y) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.y) = len(c.y) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op4_topk": op4_topk}
ORACLES = {"op4_topk": ORACLE}
