"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight bytes, so
they share at least five positional bytes. The inverted index posts each distinct fingerprint under eight
triples of byte positions, all triples inside either half: any five of eight positions hold three of one
half, so every pair within reach meets in a posting list of 24 bits. In a list, pairs are tallied by the
positional bytes they share, those with five or more are verified bit by bit. No pair leaves a task: a list
yields only a spanning forest of its links, at most one row a member. Lists of over ``block`` members are
dealt out as pairs of blocks of at most about that size.

Edge cases: a null text has no words (fingerprint zero); null ids take part but never name a component, which
is null if all its ids are; repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import components, cut, fits, table

#: The eight triples of byte positions: any five of the eight positions hold one of them.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
MIN_SHARED_BYTES = 5


def fingerprint(text: str | bytes | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of the word shingles of a text or its UTF-8, as an unsigned integer."""
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, "doc_id long, fp long")


def near(f: np.ndarray, g: np.ndarray, most: int) -> np.ndarray:
    """Which of the fingerprints f and g link: the tally of shared positional bytes, then the bits of those that reach it."""
    x = f ^ g
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= MIN_SHARED_BYTES
    ok[ok] = np.bitwise_count(x[ok]) <= most
    return ok


def list_links(key: np.ndarray, fp: np.ndarray, most: int, short: int = 8) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of whole posting lists, sorted by key: all of lists up to short, spanning forests of longer ones."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    size = np.repeat(sizes, sizes)
    left, right = [], []
    for lag in range(1, short):
        i = np.flatnonzero((key[lag:] == key[:-lag]) & (size[lag:] <= short))
        i = i[near(fp[i], fp[i + lag], most)]
        left.append(fp[i])
        right.append(fp[i + lag])
    for s, n in zip(starts[sizes > short], sizes[sizes > short]):
        rest = fp[s : s + n]
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                f = front.pop()
                hit = near(np.full(len(rest), f), rest, most)
                new, rest = rest[hit], rest[~hit]
                left.append(np.full(len(new), f))
                right.append(new)
                front += new.tolist()
                front = [np.uint64(x) for x in front]
    return left, right


def links(fps: DataFrame, most: int = 3, block: int = 4096) -> DataFrame:
    """fps(fp), distinct -> (a, b): links that connect what lies within most bits, by posting list."""
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255)
    keys = [sum((byte(p) * (1 << 8 * j) for j, p in enumerate(t)), F.lit(n << 24).cast("long")) for n, t in enumerate(TRIPLES)]
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = cut(posted.groupBy("key").count().where(F.col("count") > block))
    few = fits(hot, 16)
    posted = posted.join(F.broadcast(hot) if few else hot, "key", "left")
    parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    posted = posted.select("fp", "key", parts.alias("parts"), mine.alias("mine")).select("fp", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    posted = posted.select("fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(k, f):
            a, b = list_links(k, f, most)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy().view(np.uint64)]
            n = np.searchsorted(key, key[-1]) if len(key) else 0  # the last list may go on
            if n:
                yield out(key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
        if len(key):
            yield out(key, fp)

    return posted.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(linked, "a long, b long").distinct()


def simhash_components(docs: DataFrame, width: int = 3, seed: int = 42, most: int = 3, block: int = 4096) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id), a row for each of docs; see the module for edge cases."""
    fps = cut(fingerprints(docs, width, seed))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(classes.select("fp"), most, block))
    named = classes.join(linked, classes.fp == linked.node, "left").select(classes.fp, "least", F.coalesce("component", classes.fp).alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
