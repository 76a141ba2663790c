"""Repeated and nearly repeated passages by paragraph MinHash banding.

Units are the paragraphs (lines) of a document with ``least`` words or more. A paragraph's set are its five-word
shingles, lower-cased; one of fewer words has all of them as one shingle. Bands of r minimum hashes are tuned for high
recall: the fewest bands whose miss rate at the threshold is below ``miss``. Paragraphs that share a band with another
one are joined, verified by their exact Jaccard similarity, and clustered into components; of each component the first
unit by (doc_id, start) stays, the others go.

Passages also repeat inside longer paragraphs and over several. Of two passages of n words whose similarity is 0.8 or
more at most (n - 4) / 45 words differ in their place, as each takes five shingles from both, so from 50 words on they
have 24 words in a row in common. So windows of ``window`` words are units too, from winnowed anchors: of any ``span``
places in a row the one with the smallest shingle hash is an anchor, so window + span - 1 = 24 equal words in a row
hold a window in common. Windows overlap, so they are joined as equals (similarity 1), which loses no such passage.

Bands are told apart from those nobody shares before anything is joined: chunks of documents send each block of
hashes their distinct ones and get a bit back for each (see op8_suffix). Equal units are one class from then on. A
band's classes are compared in a task that yields spanning links only, not pairs: a class within reach of a leader
joins it; one whose distance to the leader is more than twice the reach can't link to what joined, by the triangle
inequality of Jaccard distance; those between are compared with what is far enough out. Bands of over ``block``
classes are dealt out as pairs of blocks.

Edge cases: null and empty texts have no units; ids are taken as they are, null ids come first; repeated rows repeat
each other; positions are bytes of the UTF-8 text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.chunks import BITS, NO_ID, Chunk, bits_table, by_block, each_chunk, pack, shared_bits, with_flags
from frameloom.llm.common import BROADCAST_BYTES, Forest, components, cut, fits, mix64, scratch, table, tidy

WIDTH = 5


def tuned(threshold: float, miss: float, rows: int = 2) -> int:
    """The fewest bands of rows minimum hashes that miss a pair at threshold with less than miss."""
    return int(np.ceil(np.log(miss) / np.log(1 - threshold**rows)))


class Units:
    """The units of a chunk: documents, byte ranges, shingles and bands."""

    def __init__(self, row: dict, least: int, window: int, span: int, bands: int, rows: int):
        low = row["bytes"].lower()  # ASCII letters only: lengths stay
        c = Chunk(row["ids"], row["sizes"], low)
        data = c.data
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(len(data) + 1, bool)
        edge[c.starts] = True
        first = ~blank & (np.r_[True, blank[:-1]] | edge[:-1])
        at = np.flatnonzero(first)
        last = ~blank & (np.r_[blank[1:], True] | edge[1:])
        size = np.flatnonzero(last) + 1 - at
        word = c.prints(at, size)
        doc = np.searchsorted(c.starts, at, "right") - 1
        line = np.cumsum(data == 10)[at] if len(at) else at
        n = len(at)
        self.ids = c.ids
        m = max(0, n - WIDTH + 1)
        h = np.zeros(m, np.uint64)
        for j in range(WIDTH):
            h = h * np.uint64(0x9E3779B97F4A7C15) + word[j : j + m]
        self.h = mix64(h)
        # paragraphs: runs of words of one line of one document
        new = np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])] if n else np.empty(0, bool)
        s = np.flatnonzero(new)
        e = np.r_[s[1:], n].astype(np.int64)
        ok = e - s >= least
        s, e = s[ok], e[ok]
        # a paragraph of fewer words has all of them as one shingle, after those of places
        few = np.flatnonzero(e - s < WIDTH)
        x = np.zeros(len(few), np.uint64)
        for j in range(WIDTH - 1):
            on = (e - s)[few] > j
            x[on] = x[on] * np.uint64(0x9E3779B97F4A7C15) + word[s[few][on] + j]
        self.h = np.r_[self.h, mix64(x ^ mix64((e - s)[few].astype(np.uint64)))]
        lo, hi = s.copy(), e - WIDTH + 1
        lo[few] = m + np.arange(len(few))
        hi[few] = lo[few] + 1
        # windows: from the least shingle of each run of places within a document
        w = self.anchors(doc, n, window, span)
        self.s = np.r_[s, w].astype(np.int64)
        self.e = np.r_[e, w + window].astype(np.int64)
        self.lo, self.hi = np.r_[lo, w].astype(np.int64), np.r_[hi, w + window - WIDTH + 1].astype(np.int64)
        self.window = np.r_[np.zeros(len(s), bool), np.ones(len(w), bool)]
        self.doc = doc[self.s] if len(self.s) else np.empty(0, np.int64)
        self.start = at[self.s] - c.starts[self.doc] if len(self.s) else self.s
        self.end = at[self.e - 1] + size[self.e - 1] - c.starts[self.doc] if len(self.s) else self.s
        # paragraphs come first in s and e; only they have bands
        mins = np.empty((bands * rows, len(s)), np.uint64)
        rng = np.random.default_rng(7)
        cuts = np.stack([lo, hi], axis=1).ravel() if len(s) else np.empty(0, np.int64)
        for k in range(bands * rows):
            v = mix64(self.h ^ np.uint64(rng.integers(0, 1 << 63)))
            if len(s):
                mins[k] = np.minimum.reduceat(np.r_[v, np.uint64(0)], cuts)[::2]
        self.bands = np.empty((bands, len(s)), np.uint64)
        for b in range(bands):
            x = np.full(len(s), b + 1, np.uint64)
            for r in range(rows):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + mins[b * rows + r])
            self.bands[b] = x
        # equal units have equal shingles in order
        total = np.r_[np.uint64(0), np.cumsum(mix64(self.h + np.uint64(1)))]
        self.whole = mix64(total[self.hi] - total[self.lo] + (2 * (self.e - self.s) + self.window).astype(np.uint64)) if len(self.s) else np.empty(0, np.uint64)

    def anchors(self, doc: np.ndarray, n: int, window: int, span: int) -> np.ndarray:
        m = n - window + 1  # places where a window fits
        if m <= 0:
            return np.empty(0, np.int64)
        fits_in = doc[:m] == doc[window - 1 :]
        v = np.where(fits_in, self.h[:m], np.uint64(0xFFFFFFFFFFFFFFFF))
        padded = np.concatenate([v, np.full(-m % span + span, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, span)
        before, after = np.minimum.accumulate(padded, axis=1).ravel(), np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(after[:m], before[span - 1 : span - 1 + m])  # of the span from each place
        picked = np.zeros(m, bool)
        # a place is an anchor if it has the least value of some span within its document, the span cut off at the document's end
        place = np.arange(m)
        new = np.r_[True, doc[1:m] != doc[: m - 1]]
        starts = np.flatnonzero(new)
        begin = starts[np.cumsum(new) - 1]
        for lag in range(span):
            i = place[: m - lag]
            picked[lag:] |= fits_in[lag:] & (v[lag:] == low[: m - lag]) & (begin[lag:] <= i)
        return np.flatnonzero(picked)

    def shingles(self, i: int) -> np.ndarray:
        return np.unique(self.h[self.lo[i] : self.hi[i]])


def keys_of(u: Units, blocks: int) -> tuple[np.ndarray, ...]:
    """Distinct (band, unit) of a chunk in the order of block and band: low halves, blocks, and where each band of each unit is."""
    bands = u.bands.ravel()
    whole = np.tile(u.whole[: u.bands.shape[1]], len(u.bands))
    block = (bands >> np.uint64(32)) % np.uint64(blocks)
    order = np.lexsort((whole, bands & np.uint64(0xFFFFFFFF), block))
    b, w, o = bands[order], whole[order], block[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (w[1:] != w[:-1])] if len(b) else np.empty(0, bool)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return b[new].astype(np.uint32), (w[new] >> np.uint64(32)).astype(np.uint32), o[new].astype(np.int64), where.reshape(u.bands.shape)


def wholes_of(u: Units, blocks: int) -> tuple[np.ndarray, ...]:
    """Distinct units of a chunk in the order of block: low halves, blocks, where each unit is and how often it occurs."""
    block = (u.whole >> np.uint64(32)) % np.uint64(blocks)
    key, where, n = np.unique(block << np.uint64(32) | u.whole & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
    return key.astype(np.uint32), (key >> np.uint64(32)).astype(np.int64), where, n


def shared_units(chunks: DataFrame, blocks: int, units) -> DataFrame:
    """Bits for each chunk: phase 0, whether another unit is in a band; phase 1, whether another chunk has the same unit."""

    def sent(batches):
        for row in each_chunk(batches):
            u = units(row)
            low, whole, of, _ = keys_of(u, blocks)
            out = [(2 * b, row["chunk"], low[s].tobytes(), whole[s].tobytes()) for b, s in by_block(of)]
            low, of, _, _ = wholes_of(u, blocks)
            out += [(2 * b + 1, row["chunk"], low[s].tobytes(), b"") for b, s in by_block(of)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["block", "chunk", "keys", "wholes"])

    def told(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        keys = [np.frombuffer(k.as_py(), np.uint32) for k in group.column("keys")]
        every, sizes = np.concatenate(keys), np.cumsum([len(k) for k in keys])[:-1]
        hit = np.zeros(len(every), bool)
        if block % 2:
            order = np.argsort(every, kind="stable")
            same = every[order][1:] == every[order][:-1]
            hit[order] = np.r_[False, same] | np.r_[same, False]
        else:
            whole = np.concatenate([np.frombuffer(k.as_py(), np.uint32) for k in group.column("wholes")])
            order = np.argsort(every.astype(np.uint64) << np.uint64(32) | whole, kind="stable")
            k, w = every[order], whole[order]
            head = np.r_[True, k[1:] != k[:-1]]
            run = np.cumsum(head) - 1
            varied = np.zeros(run[-1] + 1 if len(run) else 0, bool)
            varied[run[1:][(k[1:] == k[:-1]) & (w[1:] != w[:-1])]] = True
            hit[order] = varied[run]
        rows = [(c, block % 2, block // 2, np.packbits(x).tobytes()) for c, x in zip(group.column("chunk").to_pylist(), np.split(hit, sizes)) if x.any()]
        return bits_table(rows)

    return chunks.mapInArrow(sent, "block int, chunk long, keys binary, wholes binary").groupBy("block").applyInArrow(told, BITS)


FOUND = "chunk long, row int, doc_id long, start long, end long, words int, is_window boolean, unit long, bands array<long>, shingles array<long>"


def found_units(chunks: DataFrame, blocks: int, units) -> DataFrame:
    """The units that share a band with another one or occur again; the first of equal ones in a chunk brings its bands and shingles."""

    def found(batches):
        for row in each_chunk(batches):
            u = units(row)
            _, _, of, where = keys_of(u, blocks)
            near = np.zeros((len(u.bands), len(u.s)), bool)
            near[:, : u.bands.shape[1]] = shared_bits(row["flags"], 0, of)[where] if u.bands.size else False
            _, of, where, n = wholes_of(u, blocks)
            again = (shared_bits(row["flags"], 1, of) | (n > 1))[where]
            at = np.flatnonzero(near.any(axis=0) | again)
            if not len(at):
                continue
            lead = np.zeros(len(u.s), bool)
            lead[at[np.unique(u.whole[at], return_index=True)[1]]] = True
            lead &= near.any(axis=0)
            bands = [u.bands[near[:, i], i].view(np.int64) if lead[i] else None for i in at]
            shingles = [u.shingles(i).view(np.int64) if lead[i] else None for i in at]
            ids = u.ids[u.doc[at]]
            for s in range(0, len(at), 4096):
                x = slice(s, s + 4096)
                columns = [pa.array(np.full(len(at[x]), row["chunk"], np.int64)), pa.array(u.doc[at[x]].astype(np.int32)), pa.array(ids[x], mask=ids[x] == NO_ID), pa.array(u.start[at[x]]), pa.array(u.end[at[x]]), pa.array((u.e - u.s)[at[x]].astype(np.int32)), pa.array(u.window[at[x]]), pa.array(u.whole[at[x]].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v[x], pa.list_(pa.int64())) for v in (bands, shingles))], ["chunk", "row", "doc_id", "start", "end", "words", "is_window", "unit", "bands", "shingles"])

    return chunks.mapInArrow(found, FOUND)


def band_links(sets: list[frozenset], threshold: float) -> list[tuple[int, int]]:
    """Links that join what is joined by similarities of threshold or more, exactly; see the module."""
    reach = 1 - threshold + 1e-12
    forest = Forest(len(sets))
    leaders: list[tuple[int, list[tuple[float, int]]]] = []

    def apart(a: int, b: int) -> float:
        both = len(sets[a] & sets[b])
        return 1 - both / (len(sets[a]) + len(sets[b]) - both)

    for q in range(len(sets)):
        home = None
        for lead, members in leaders:
            d = apart(q, lead)
            if d <= reach:
                forest.join(q, lead)
                home = home or (d, members)
            elif d <= 2 * reach:
                for out, p in members:
                    if out >= d - reach and forest.root(p) != forest.root(q) and apart(q, p) <= reach:
                        forest.join(q, p)
        if home:
            home[1].append((home[0], q))
        else:
            leaders.append((q, []))
    return forest.edges


def verified_links(classes: DataFrame, threshold: float, block: int, most: int = 1 << 18) -> DataFrame:
    """classes(unit, bands, shingles), distinct units -> (a, b). Blocks hold about block classes or most shingles."""
    each = classes.select("unit", "shingles", F.explode("bands").alias("band"))
    hot = each.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("shingles")) / most)).alias("parts"))
    hot = cut(hot.where("parts > 1"))
    each = each.join(F.broadcast(hot) if fits(hot, 16) else hot, "band", "left")
    parts = F.coalesce("parts", F.lit(1)).cast("int")
    each = each.select("unit", "shingles", "band", parts.alias("parts"), F.pmod(F.xxhash64("unit"), parts).cast("int").alias("mine"))
    each = each.select("unit", "shingles", "band", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    each = each.select(F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "unit", "shingles")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, frozenset]] = []

        def out() -> pa.RecordBatch:
            edges = band_links([x[2] for x in held], threshold)
            return pa.RecordBatch.from_arrays([pa.array([held[e[k]][1] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            keys, ids, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            for i, key in enumerate(keys):
                if held and held[0][0] != key:
                    if len(held) > 1:
                        yield out()
                    held = []
                held.append((key, ids[i], frozenset(lists[i].as_py())))
        if len(held) > 1:
            yield out()

    return each.repartition("key").sortWithinPartitions("key", "unit").select("key", "unit", "shingles").mapInArrow(linked, "a long, b long").distinct()


def packed_and_found(docs: DataFrame, threshold: float, least: int, window: int, span: int, rows: int, miss: float, chunk: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, units): units in a component of two or more, with chunk and row, the document's place in it."""
    spark = docs.sparkSession
    bands = tuned(threshold, miss, rows)
    units = lambda row: Units(row, least, window, span, bands, rows)
    path = scratch(spark, "passages")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    with tidy(spark):
        pack(texts, chunk).write.parquet(f"{path}/chunks", compression="zstd")
    chunks = spark.read.parquet(f"{path}/chunks")
    total = chunks.agg(F.sum(F.length("bytes"))).first()[0] or 0
    blocks = max(12, total // (20 << 20))
    flags = shared_units(chunks, blocks, units)
    with tidy(spark):
        found_units(with_flags(chunks, flags), blocks, units).write.parquet(f"{path}/units", compression="zstd")
    found = spark.read.parquet(f"{path}/units")
    light = found.groupBy("unit").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("d"), "start")).alias("first"))
    classes = found.where(F.col("bands").isNotNull()).groupBy("unit").agg(F.first("bands").alias("bands"), F.first("shingles").alias("shingles"))
    linked = components(verified_links(classes, threshold, block))
    classes = cut(light.join(linked, light.unit == linked.node, "left").select("unit", "n", "first", F.coalesce("component", "unit").alias("component")).where(F.col("component").isNotNull()))
    whole = classes.groupBy("component").agg(F.sum("n").alias("n_units"), F.min("first").alias("head")).where("n_units > 1")
    named = cut(classes.join(whole, "component").select("unit", "n_units", "head"))
    named = F.broadcast(named) if fits(named, 64, BROADCAST_BYTES // 2) else named
    mine = F.struct(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("d"), "start")
    out = found.drop("bands", "shingles").join(named, "unit")
    return chunks, out.withColumns({"component_id": F.when(F.col("head.d") != int(NO_ID), F.col("head.d")), "component_start": F.col("head.start"), "removed": mine != F.col("head")})


def repeated_passages(docs: DataFrame, threshold: float = 0.8, least: int = 1, window: int = 16, span: int = 9, rows: int = 2, miss: float = 0.003, chunk: int = 1 << 20, block: int = 2048) -> DataFrame:
    """docs(doc_id, text) -> a row for each unit that is in a component of two or more.

    (doc_id, start, end, words, is_window, component_id, component_start, n_units, removed): start and end in bytes;
    component_id and component_start say which unit is first, and so stays; n_units is the component's size.
    """
    out = packed_and_found(docs, threshold, least, window, span, rows, miss, chunk, block)[1]
    return out.select("doc_id", "start", "end", "words", "is_window", "component_id", "component_start", "n_units", "removed")


def without_passages(docs: DataFrame, passage: int = 24, threshold: float = 0.8, least: int = 1, window: int = 16, span: int = 9, rows: int = 2, miss: float = 0.003, chunk: int = 1 << 20, block: int = 2048) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, n_short, spans, short), a row for each of docs.

    spans are the runs of bytes (start, end) that go as repeated windows or lines of passage words or more, n_removed
    their bytes; short are those of removed shorter lines, so far as they lie outside spans, n_short their bytes.
    """
    chunks, found = packed_and_found(docs, threshold, least, window, span, rows, miss, chunk, block)
    gone = found.where("removed").select("chunk", F.struct("row", "start", "end", (F.col("is_window") | (F.col("words") >= passage)).alias("long")).alias("u"))
    gone = cut(gone.groupBy("chunk").agg(F.collect_list("u").alias("gone")))  # units of about a megabyte of text

    def runs(on: np.ndarray) -> list[dict]:
        step = np.diff(np.r_[0, on.view(np.int8), 0])
        return [{"start": s, "end": e} for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())]

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_chunk(batches):
            ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
            starts = np.r_[0, np.cumsum(sizes)]
            edges = np.zeros((2, starts[-1] + 1), np.int32)
            for u in row["gone"] or []:
                at = starts[u["row"]]
                edges[int(not u["long"]), at + u["start"]] += 1
                edges[int(not u["long"]), at + u["end"]] -= 1
            long, short = np.cumsum(edges[:, :-1], axis=1) > 0
            short &= ~long
            out = []
            for i, s, n in zip(ids.tolist(), starts.tolist(), sizes.tolist()):
                a, b = runs(long[s : s + n]), runs(short[s : s + n])
                out.append((None if i == NO_ID else i, n, int(long[s : s + n].sum()), len(a), int(short[s : s + n].sum()), a, b))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(),) * 5 + (spans,) * 2)], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_short", "spans", "short"])

    pair = "array<struct<start:long,end:long>>"
    joined = chunks.select("chunk", "ids", "sizes").join(gone.hint("shuffle_merge"), "chunk", "left")
    return joined.mapInArrow(applied, f"doc_id long, n_bytes long, n_removed long, n_spans long, n_short long, spans {pair}, short {pair}")


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_paragraphs": op6_paragraphs}
ORACLES: dict[str, str] = {}
