"""Removal of repeated byte strings by difference-cover blockwise suffix construction.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier: in a smaller doc_id, or
earlier in the same document. That is a question to the suffix array, read to that depth: of suffixes that agree on
``length`` bytes all but the first by (doc_id, start) mark theirs. The array is built a bucket at a time, and exactly:
bytes are compared, hashes only say what need not be.

Dealing out. Of each string's eight- to thirty-two-byte grams the one with the least hash, the first of equals, is its
lead. Equal strings have equal leads in the same place, and the strings of one lead start side by side, so a *stretch* (a lead
with all strings that it leads, some 130 bytes) is dealt out in one piece, to the bucket of suffixes that begin like
its lead; about a byte in 35 is a lead. A lead whose hash nobody shares has no equal strings, and its stretch goes
nowhere: chunks send the distinct hashes of their leads, one row each, and get back those that another chunk has.

A bucket (a range of leading bytes) is cut between leads into blocks of about ``block`` bytes. A block sorts the
suffixes of its text by difference cover: positions at COVER modulo PERIOD are sorted first, to ``length`` bytes, with their
longest common prefixes, so each has a rank for any depth. All others are sorted by PERIOD bytes; ties are
resolved by the ranks of cover samples, as any two positions have a common shift below PERIOD that brings both onto
samples. A lead with over ``hot`` stretches isn't collected: its strings are grouped one by one, added up before they
are shuffled. Stretches that repeat within a chunk are answered there.

Texts are packed by a first pass into chunks of about ``chunk`` bytes, written to the shared folder. Documents that
repeat an earlier one whole (by SHA-256) are not packed but answered from their digests.

Edge cases: a null text is empty; texts shorter than ``length`` keep everything; rows with equal doc_id are documents of
their own, none of them earlier than another; null ids come before all others; an empty table
gives no rows; a document of any length is looked at in pieces of PIECE bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.chunks import NO_ID, each_chunk, pack
from frameloom.llm.common import cut, fits, mix64, scratch, table, tidy

#: A perfect difference cover: any difference modulo PERIOD is one of two members of COVER.
PERIOD = 13
COVER = (0, 1, 3, 9)
#: Starts that are looked at together.
PIECE = 1 << 20
STRETCH = "lead int, n int, ctx binary, id long, chunk long, doc int, at long"
MARK = "chunk long, at long, n int, bits binary"
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Chunk:
    """The documents of a chunk, in the order of doc_id, as one run of bytes."""

    def __init__(self, row: dict):
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.bytes = row["bytes"]
        self.starts = np.r_[0, np.cumsum(self.sizes)]


def words_at(data: bytes, n: int) -> np.ndarray:
    """The eight bytes from each of the first n positions, as big-endian integers; data has seven bytes more."""
    return np.ndarray((n,), ">u8", data, 0, (1,)).astype(np.uint64)


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of the gram bytes (8, 16 or 32) from each position that has as many."""
    h, step = words_at(data, len(data) - 7), 8
    while step < gram:
        h *= K1
        h ^= h >> np.uint64(32)
        h = h[:-step] * K2 ^ h[step:]
        step *= 2
    return mix64(h)


def least_of_span(key: np.ndarray, span: int) -> np.ndarray:
    """The least key of each span of keys."""
    m = len(key) - span + 1
    padded = np.concatenate([key, np.full(-len(key) % span, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, span)
    before, after = np.minimum.accumulate(padded, axis=1).ravel(), np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[span - 1 : span - 1 + m])


def gram_of(length: int) -> int:
    return next((g for g in (32, 16) if 3 * g <= length), 8)


def stretches(c: Chunk, length: int) -> tuple[np.ndarray, ...]:
    """(first string, how many, lead, lead's hash) of the stretches of a chunk, in the order of place."""
    gram, out = gram_of(length), []
    for s in range(0, len(c.bytes), PIECE):
        piece = c.bytes[s : s + PIECE + length - 1]
        n = len(piece) - length + 1
        if n <= 0:
            continue
        h = gram_hashes(piece, gram)
        low = least_of_span(h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        lead = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.zeros(n + 1, np.int32)  # strings lie within documents
        ok = c.sizes >= length
        np.add.at(edge, np.clip(c.starts[:-1][ok] - s, 0, n), 1)
        np.add.at(edge, np.clip(c.starts[:-1][ok] + c.sizes[ok] - length + 1 - s, 0, n), -1)
        lead[np.cumsum(edge[:-1]) == 0] = -1
        first = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
        size = np.diff(np.r_[first, n])
        on = lead[first] >= 0
        first, size, lead = first[on], size[on], lead[first][on]
        out.append((first + s, size, lead + s, h[lead]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)


def shared_here(h: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order] = np.r_[False, same] | np.r_[same, False] if len(h) else False
    return out


def held_in(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which hashes are in held, which is sorted."""
    return held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h if len(held) else np.zeros(len(h), bool)


def known_here(c: Chunk, length: int, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of the stretches at: which repeat an earlier one of the chunk whole, and their bytes."""
    seen: dict[bytes, tuple[int, int]] = {}  # rows of the first and of the last one so far
    rows = (np.searchsorted(c.starts, first[at], "right") - 1).tolist()
    ids, known, texts = c.ids.tolist(), np.zeros(len(at), bool), []
    for i, (s, n, row) in enumerate(zip(first[at].tolist(), size[at].tolist(), rows)):
        text = c.bytes[s : s + n + length - 1]
        texts.append(text)
        if text in seen:
            head, last = seen[text]
            known[i] = ids[row] > ids[head] or row == last
            seen[text] = head, row
        else:
            seen[text] = row, row
    return known, texts


def shared_leads(chunks: DataFrame, length: int) -> DataFrame:
    """(chunk, flags): hashes of leads that a chunk shares with another one. The commonest hash has a row a chunk."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_chunk(batches):
            h = np.sort(stretches(Chunk(row), length)[3])
            h = h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), row["chunk"], np.int64))], ["h", "chunk"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in the order of h; the last one of a batch waits for the next
        h, chunk, before = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            h, chunk = np.r_[h, b.column(0).to_numpy()], np.r_[chunk, b.column(1).to_numpy()]
            if len(h) < 2:
                continue
            same = h[1:] == h[:-1]
            hit = np.r_[h[0] == before, same[:-1]] | same
            yield pa.RecordBatch.from_arrays([pa.array(chunk[:-1][hit]), pa.array(h[:-1][hit])], ["chunk", "h"])
            before, h, chunk = h[-2], h[-1:], chunk[-1:]
        if len(h) and h[0] == before:
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(h)], ["chunk", "h"])

    rows = chunks.mapInArrow(sent, "h long, chunk long").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(told, "chunk long, h long").groupBy("chunk").agg(F.collect_list("h").alias("flags"))


def with_flags(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """chunks with the flags of each. These grow with the chunks, so they are never broadcast."""
    return chunks.join(flags.hint("shuffle_merge"), "chunk", "left")


def dealt_stretches(chunks: DataFrame, length: int) -> DataFrame:
    """The stretches of chunks with flags that may have equal strings elsewhere. Those that are answered within their chunk, as they start earlier there, have no bytes."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_chunk(batches):
            c = Chunk(row)
            first, size, lead, h = stretches(c, length)
            elsewhere = held_in(h, np.sort(np.array(row["flags"] or [], np.int64).view(np.uint64)))
            at = np.flatnonzero(elsewhere | shared_here(h))
            known, texts = known_here(c, length, first, size, at)
            told = known.copy()
            told[~known] = elsewhere[at][~known] | shared_here(h[at][~known])
            at, texts = at[told], [None if k else t for t, k, r in zip(texts, known.tolist(), told.tolist()) if r]
            doc = np.searchsorted(c.starts, first[at], "right") - 1
            for s in range(0, len(at), 8192):
                x = slice(s, s + 8192)
                i = at[x]
                columns = [(lead[i] - first[i]).astype(np.int32), size[i].astype(np.int32), pa.array(texts[x], pa.binary()), c.ids[doc[x]], np.full(len(i), row["chunk"], np.int64), doc[x].astype(np.int32), first[i]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["lead", "n", "ctx", "id", "chunk", "doc", "at"])

    return chunks.mapInArrow(sent, STRETCH)


def dense(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(key)
    rank, held = np.empty(len(key), np.uint64), key[order]
    rank[order] = np.cumsum(np.r_[False, held[1:] != held[:-1]]) if len(key) else 0
    return rank


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks by (a, b), ranks both."""
    return dense(a << np.uint64(32) | b)


class Suffixes:
    """The suffixes of a block's text, in the order of their first length bytes, by difference cover."""

    def __init__(self, text: bytes, length: int):
        n = len(text)
        self.length, self.words = length, words_at(text + bytes(length + 16), n + length + 8)
        on = np.zeros(PERIOD, bool)
        on[list(COVER)] = True
        self.on = on
        at = np.flatnonzero(np.resize(on, n))
        self.place = np.full(n + 1, -1, np.int64)
        self.place[at] = np.arange(len(at))
        # samples by PERIOD bytes, then by twice as many, as whole periods lead from sample to sample
        rank, depth = self.by_period(at), PERIOD
        while depth < length:
            after = np.r_[rank + np.uint64(1), np.uint64(0)]  # 0: beyond the text
            rank = paired(rank, after[self.place[np.minimum(at + depth, n)]])
            depth *= 2
        order = np.argsort(rank)
        self.order, self.common = order, self.prefixes(at[order])

    def by_period(self, at: np.ndarray) -> np.ndarray:
        """Ranks of positions by the PERIOD bytes from them."""
        return paired(dense(self.words[at]), dense(self.words[at + PERIOD - 8]))

    def prefixes(self, at: np.ndarray) -> np.ndarray:
        """How many bytes, at most length, each of the sorted positions has in common with the one before."""
        common = np.full(max(0, len(at) - 1), self.length, np.int64)
        open_ = np.arange(len(common))
        for d in range(0, self.length, 8):
            x = self.words[at[open_ + 1] + d] ^ self.words[at[open_] + d]
            differs = x != 0
            common[open_[differs]] = d + sum((x[differs] < np.uint64(1 << (64 - 8 * t))).astype(np.int64) for t in range(1, 8))
            open_ = open_[~differs]
        return np.r_[0, common] if len(at) else common

    def classes(self, at: np.ndarray) -> np.ndarray:
        """For each of the positions at the first of at whose length bytes are equal."""
        out, tie, residue = np.arange(len(at)), self.by_period(at) << np.uint64(32), at % PERIOD
        rank = np.empty(len(self.order), np.uint64)
        for k in range(PERIOD):
            mine = np.flatnonzero(self.on[(residue + k) % PERIOD])
            # rank of samples by the bytes that are left after a shift of k
            rank[self.order] = np.cumsum(self.common < self.length - k)
            key = tie[mine] | rank[self.place[at[mine] + k]]
            order = np.argsort(key)
            key, mine = key[order], mine[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
            if len(heads):
                out[mine] = np.repeat(np.minimum.reduceat(out[mine], heads), np.diff(np.r_[heads, len(mine)]))
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., sizes[0] of them, then the same of the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def later_strings(block: dict[str, list], length: int) -> pa.RecordBatch:
    """MARK rows of a block: which strings of its stretches also start earlier, by bits."""
    seen: dict[bytes, int] = {}
    of = np.array([seen.setdefault(t, len(seen)) for t in block["ctx"]])
    size, ids = np.array(block["n"]), np.array(block["id"], np.int64)
    texts = list(seen)
    begin = np.r_[0, np.cumsum([len(t) for t in texts])][:-1]
    count = np.array([len(t) - length + 1 for t in texts])
    where = np.r_[0, np.cumsum(count)][:-1]  # of a distinct stretch's strings
    label = Suffixes(b"".join(texts), length).classes(spread(begin, count))
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, of, ids)
    first = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(first, label, np.repeat(least, count))
    mine = label[spread(where[of], size)]  # of each string of each stretch
    later = np.repeat(ids, size) > first[mine]
    # again in the same row
    chunk, doc, at = (np.array(block[c], np.int64) for c in ("chunk", "doc", "at"))
    order = np.lexsort((doc, chunk))
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(np.r_[False, (chunk[order][1:] != chunk[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
    twice = np.flatnonzero(np.repeat(np.bincount(row)[row] > 1, size))
    if len(twice):
        r, place = np.repeat(row, size)[twice], spread(at, size)[twice]
        order = np.lexsort((place, r, mine[twice]))
        m, r = mine[twice][order], r[order]
        later[twice[order][1:][(m[1:] == m[:-1]) & (r[1:] == r[:-1])]] = True
    bits = np.zeros((len(size), 8 * -(-(length - gram_of(length) + 1) // 8)), bool)
    bits[np.repeat(np.arange(len(size)), size), spread(np.zeros(len(size), np.int64), size)] = later
    hit = np.flatnonzero(bits.any(axis=1))
    packed = np.packbits(bits[hit], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(chunk[hit]), pa.array(at[hit]), pa.array(size[hit].astype(np.int32)), pa.array([x.tobytes() for x in packed], pa.binary())], ["chunk", "at", "n", "bits"])


def sorted_blocks(dealt: DataFrame, length: int, block: int, buckets: int) -> DataFrame:
    """MARK rows of dealt stretches: a bucket a task, by ranges of the leading bytes, a block at a time."""
    gram = gram_of(length)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ctx", "n", "id", "chunk", "doc", "at"]
        held, weight, last = {c: [] for c in names}, 0, None
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in names}
            leads = b.column("lead").to_pylist()
            start = 0
            for i, (t, k) in enumerate(zip(columns["ctx"], leads)):
                lead = t[k : k + gram]
                if weight >= block and lead != last:
                    for c in names:
                        held[c] += columns[c][start:i]
                    yield later_strings(held, length)
                    held, weight, start = {c: [] for c in names}, 0, i
                weight, last = weight + len(t), lead
            for c in names:
                held[c] += columns[c][start:]
        if held["ctx"]:
            yield later_strings(held, length)

    lead = F.substring("ctx", F.col("lead") + 1, F.lit(gram))
    return dealt.withColumn("gram", lead).repartitionByRange(buckets, "gram").sortWithinPartitions("gram").drop("gram").mapInArrow(blocks, MARK)


def hot_strings(dealt: DataFrame, length: int) -> DataFrame:
    """MARK rows of stretches of leads that are too common for a block: equal strings by groups, which are added up before they are shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                n = part.column("n").to_numpy()
                at = spread(part.column("at").to_numpy(), n)
                strings = [t[k : k + length] for t, m in zip(part.column("ctx").to_pylist(), n.tolist()) for k in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), *(pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in ("id", "chunk", "doc")), pa.array(at)], ["s", "id", "chunk", "doc", "at"])

    every = dealt.mapInArrow(each, "s binary, id long, chunk long, doc int, at long")
    first = every.groupBy("s").agg(F.min("id").alias("least"))
    here = every.groupBy("s", "chunk", "doc").agg(F.min("id").alias("id"), F.min("at").alias("first"), F.collect_set("at").alias("at"))  # at most a document's strings
    out = here.join(first, "s").select("chunk", "first", F.explode("at").alias("at"), (F.col("id") > F.col("least")).alias("later"))
    return out.where("later or at > first").select("chunk", "at", F.lit(1).alias("n"), F.lit(None).cast("binary").alias("bits"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>"


def cut_out(chunks: DataFrame, length: int, bytes_too: bool) -> DataFrame:
    """The result for each document of chunks, whose flags are the marks of its stretches."""

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_chunk(batches):
            c = Chunk(row)
            flags = row["flags"] or []
            place, n = (np.array([f[x] for f in flags], np.int64) for x in ("at", "n"))
            some = np.array([f["bits"] is not None for f in flags], bool)
            bits = [f["bits"] for f in flags if f["bits"] is not None]
            packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1) if bits else np.zeros((0, 1), np.uint8)
            i, k = np.nonzero(np.unpackbits(packed, axis=1))
            begin = np.r_[spread(place[~some], n[~some]), place[some][i] + k]
            edge = np.zeros(len(c.bytes) + 1, np.int32)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + length, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            data, rows = np.frombuffer(c.bytes, np.uint8), []
            for i, s, n in zip(c.ids.tolist(), c.starts.tolist(), c.sizes.tolist()):
                g = gone[s : s + n]
                step = np.diff(np.r_[0, g.view(np.int8), 0])
                kept = data[s : s + n][~g].tobytes()
                starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                rows.append((None if i == NO_ID else i, n, int(g.sum()), len(starts), hashlib.sha256(kept).hexdigest(), kept if bytes_too else None, starts.tolist(), ends.tolist()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "ends"])

    return chunks.mapInArrow(applied, RESULT)


def remove_repeats(docs: DataFrame, length: int = 100, chunk: int = 1 << 20, block: int = 1 << 19, bucket: int = 8 << 20, hot: int = 1 << 16, bytes_too: bool = True) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, starts, ends), a row for each of docs.

    starts and ends are the removed runs in bytes; kept, the remaining bytes, is null unless bytes_too.
    """
    if length < PERIOD + 8:
        raise ValueError(f"length must be {PERIOD + 8} at least")
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    light = docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n"))
    order = F.coalesce("doc_id", F.lit(int(NO_ID)))
    again = cut(light.where(F.col("n") >= length).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first"))
    again = F.broadcast(again) if fits(again, 128) else again
    marked = docs.withColumn("digest", F.sha2("text", 256)).join(again, "digest", "left")
    copy = F.col("first").isNotNull() & (order > F.col("first"))
    with tidy(spark):
        pack(marked.where(~copy), chunk).write.parquet(f"{path}/chunks", compression="zstd")
    chunks = spark.read.parquet(f"{path}/chunks")
    flags = cut(shared_leads(chunks, length))
    with tidy(spark):
        dealt_stretches(with_flags(chunks, flags), length).write.parquet(f"{path}/stretches", compression="zstd")
    every = spark.read.parquet(f"{path}/stretches")
    whole = every.where("ctx is null").select("chunk", "at", "n", F.lit(None).cast("binary").alias("bits"))
    dealt = every.where("ctx is not null")
    gram = F.substring("ctx", F.col("lead") + 1, F.lit(gram_of(length)))
    common = cut(dealt.groupBy(gram.alias("gram")).agg(F.count("*").alias("c")).where(F.col("c") > hot).select("gram"))
    total = dealt.agg(F.sum(F.length("ctx"))).first()[0] or 0
    buckets = max(12, total // bucket)
    if common.isEmpty():
        marks = sorted_blocks(dealt, length, block, buckets)
    else:
        common = F.broadcast(common) if fits(common, 64) else common
        joined = gram == F.col("gram")
        marks = sorted_blocks(dealt.join(common, joined, "left_anti"), length, block, buckets).unionByName(hot_strings(dealt.join(common, joined, "left_semi"), length))
    marks = cut(marks.unionByName(whole).groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "bits")).alias("flags")))
    out = cut_out(with_flags(chunks, marks), length, bytes_too)
    n = F.octet_length("text").cast("long")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    copies = marked.where(copy).select("doc_id", n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), none.alias("kept_sha256"), (F.lit(b"") if bytes_too else F.lit(None).cast("binary")).alias("kept"), F.array(F.lit(0).cast("long")).alias("starts"), F.array(n).alias("ends"))
    return out.unionByName(copies)


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), bytes_too=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op8_suffix": op8_suffix}
ORACLES: dict[str, str] = {}
