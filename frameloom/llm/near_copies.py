"""Near copies of documents by SimHash and by MinHash banding, verified by the exact Jaccard similarity of five-word shingles.

A document's set are its ``width``-word shingles, lower-cased (ASCII); one of fewer words has all its words as one
shingle, one of no words has none. Documents of equal sets are one class. Bands of ``rows`` minimum hashes are tuned
as in op6: the fewest whose miss rate at the threshold is below ``miss``. Fingerprints are those of op7_simhash, linked by
its index of byte positions, its tally and its three bits: classes whose fingerprints are linked share a band of their own.
At the threshold two fingerprints differ in some ten bits, so neither way stands in for the other. Only classes that share
a band are shingled again; what meets in a band is verified exactly and yields spanning links, not pairs (see op6_paragraphs).

Removal is by row: of each component one row stays, that of the least id (null ids last, then by the text's hashes;
of rows equal in id and text any one). Texts without words are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.chunks import Chunk
from frameloom.llm.common import components, cut, fits, mix64, pieces, row_of
from frameloom.llm.op6_paragraphs import tuned, verified_links
from frameloom.llm.op7_simhash import fingerprint, links

STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingles of each text, one text after the other, in order of hash."""
    n_texts = len(texts)
    c = Chunk(b"", np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(texts).lower())  # ASCII letters only
    data = c.data
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[c.starts] = True
    at = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1]))
    word = c.prints(at, np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1 - at)
    doc = np.searchsorted(c.starts, at, "right") - 1
    words = np.bincount(doc, minlength=n_texts)
    m = max(0, len(at) - width + 1)
    h = np.zeros(m, np.uint64)
    for j in range(width):
        h = h * STEP + word[j : j + m]
    whole = doc[:m] == doc[len(at) - m :]
    # texts of fewer words: one shingle of all of them
    short = np.flatnonzero((words > 0) & (words < width))
    first = np.searchsorted(doc, short)
    x = np.zeros(len(short), np.uint64)
    for j in range(width - 1):
        on = words[short] > j
        x[on] = x[on] * STEP + word[first[on] + j]
    h = np.r_[mix64(h[whole]), mix64(x ^ mix64(words[short].astype(np.uint64)))]
    d = np.r_[doc[:m][whole], short]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.empty(0, bool)
    return h[new], np.bincount(d[new], minlength=n_texts)


def set_bands(h: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, bands): what tells a set from others, and a row of bands for each set that isn't empty."""
    ends = np.cumsum(sizes)
    total = np.r_[np.uint64(0), np.cumsum(mix64(h + np.uint64(1)))]
    unit = mix64(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))
    starts = (ends - sizes)[sizes > 0]
    out = np.empty((len(starts), bands), np.uint64)
    rng = np.random.default_rng(11)
    for b in range(bands):
        x = np.full(len(starts), b + 1, np.uint64)
        for _ in range(rows):
            v = mix64(h ^ np.uint64(rng.integers(0, 1 << 63)))
            x = mix64(x * STEP + np.minimum.reduceat(v, starts)) if len(starts) else x
        out[:, b] = x
    return unit, out


def text_sets(batch: pa.RecordBatch, column: int, width: int, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, hashes, sizes) of ranges of a batch's texts."""
    texts = [t.as_py() or b"" for t in batch.column(column)]
    for s, e in pieces([len(t) for t in texts], most):
        yield s, e, *shingle_sets(texts[s:e], width)


def sketches(keyed: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """keyed(h1, h2, doc_id, text binary) -> (h1, h2, doc_id, unit, fp, bands), a row for each; fp is op7's fingerprint."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, h, sizes in text_sets(b, 3, width):
                unit, made_bands = set_bands(h, sizes, bands, rows)
                fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(3).slice(s, e - s)), np.uint64, e - s)
                offsets = np.r_[0, np.cumsum((sizes > 0) * bands)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made_bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(s, e - s) for k in range(3)), pa.array(unit.view(np.int64)), pa.array(fp.view(np.int64)), lists], ["h1", "h2", "doc_id", "unit", "fp", "bands"])

    return keyed.mapInArrow(made, "h1 long, h2 long, doc_id long, unit long, fp long, bands array<long>")


def print_bands(held: DataFrame) -> DataFrame:
    """held(unit, fp, bands) -> (unit, band): classes whose fingerprints op7 links, near or far, share a band."""
    prints = held.where(F.size("bands") > 0).select("unit", "fp").distinct()
    linked = components(links(prints.select("fp").distinct()))
    return prints.join(linked, prints.fp == linked.node, "left").select("unit", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("band")).distinct()


def shingled(classes: DataFrame, width: int) -> DataFrame:
    """classes(unit, bands, text binary) -> (unit, bands, shingles)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, h, sizes in text_sets(b, 2, width):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), lists], ["unit", "bands", "shingles"])

    return classes.mapInArrow(made, "unit long, bands array<long>, shingles array<long>")


def without_near_copies(docs: DataFrame, threshold: float = 0.8, width: int = 5, rows: int = 4, miss: float = 1e-4, block: int = 2048) -> DataFrame:
    """docs(doc_id, text, ...) less all rows but one of each component of near copies; see the module."""
    text = F.col("text").cast("string")
    hashes = {"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit("text"), text)}
    keyed = docs.select(hashes["_h1"].alias("h1"), hashes["_h2"].alias("h2"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    held = cut(sketches(keyed, width, tuned(threshold, miss, rows), rows))
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    classes = cut(held.groupBy("unit").agg(F.min(head).alias("head"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    each = classes.select("unit", F.explode("bands").alias("band")).unionByName(print_bands(held))
    shared = cut(each.groupBy("band").count().where("count > 1").select("band"))
    shared = F.broadcast(shared) if fits(shared, 16) else shared
    near = each.join(shared, "band", "left_semi").groupBy("unit").agg(F.collect_list("band").alias("shared"))
    near = cut(classes.join(near, "unit").select("unit", F.col("shared").alias("bands"), F.col("head.doc_id").alias("k3"), F.col("head.h1").alias("k1"), F.col("head.h2").alias("k2")))
    near = F.broadcast(near) if fits(near, 256) else near
    texts = keyed.join(near, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("k3"))).select("unit", "bands", "text")
    linked = components(verified_links(cut(shingled(texts, width).dropDuplicates(["unit"])), threshold, block))
    # classes of more than one row, or with near copies: what else there is stays
    named = classes.join(linked, classes.unit == linked.node, "left").where("n > 1 or component is not null")
    named = cut(named.select("unit", "head", F.coalesce("component", "unit").alias("component")))
    best = named.groupBy("component").agg(F.min("head").alias("best"))
    named = cut(named.join(best, "component").select("unit", "best"))
    named = F.broadcast(named) if fits(named, 64) else named
    alike = held.groupBy("unit", "h1", "h2", "doc_id").agg(F.count("*").alias("c")).join(named, "unit")
    stays = head == F.col("best")
    odd = cut(alike.where(~stays | (F.col("c") > 1)).select(F.col("h1").alias("_k1"), F.col("h2").alias("_k2"), F.col("doc_id").alias("_k3"), stays.alias("_stays")))
    tied = not odd.where("_stays").isEmpty()
    odd = F.broadcast(odd) if fits(odd, 64) else odd
    packed = docs.select(row_of(docs).alias("row"), *[v.alias(k) for k, v in hashes.items()], F.col("doc_id").cast("long").alias("_id"))  # any names may be there
    out = packed.join(odd, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")) & F.col("_id").eqNullSafe(F.col("_k3")), "left")
    kept = out.where("_stays is null").select("row.*")
    return kept.unionByName(out.where("_stays").dropDuplicates(["_k1", "_k2", "_k3"]).select("row.*")) if tied else kept
