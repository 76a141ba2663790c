"""Chunks: whole documents packed into rows of about a megabyte, their prefix hashes, and bits sent to and from blocks of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import BROADCAST_BYTES, cut, mix64

NO_ID = np.iinfo(np.int64).min
CHUNK = "chunk long, ids binary, sizes binary, bytes binary"
BITS = "chunk long, phase int, block int, bits binary"
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and the base's powers and inverse powers up to n."""
    if len(_tables.get("up", ())) < n:
        rng, size = np.random.default_rng(20240229), 1 << max(20, int(n).bit_length())
        _tables["byte"] = rng.integers(0, 1 << 64, 256, np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 8 + 5
        for name, r in (("up", base), ("down", pow(base, -1, 1 << 64))):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(r, len(out), 1 << 64))])
            _tables[name] = out
    return _tables["byte"], _tables["up"], _tables["down"]


class Chunk:
    """The documents of a chunk, in the order of doc_id, as one run of bytes with prefix hashes."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.data = np.frombuffer(data, np.uint8)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        byte, up, _ = powers(len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(byte[self.data] * up[: len(self.data)], out=self.sums[1:])

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """64-bit fingerprints of the n bytes from each of at."""
        return mix64((self.sums[at + n] - self.sums[at]) * powers(len(self.data) + 1)[2][at])


def pack(docs: DataFrame, chunk: int) -> DataFrame:
    """docs(doc_id, text) -> chunks of whole documents."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, total = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal made, held, total
            held.sort(key=lambda x: x[0])
            ids, texts = [x[0] for x in held], [x[1] for x in held]
            row = [[part << 32 | made], [np.array(ids, np.int64).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [b"".join(texts)]]
            made, held, total = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["chunk", "ids", "sizes", "bytes"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or b""
                if held and total + len(t) > chunk:
                    yield out()
                held.append((NO_ID if i is None else i, t))
                total += len(t)
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(packed, CHUNK)


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}


def shared_bits(flags: list[dict] | None, phase: int, blocks: np.ndarray) -> np.ndarray:
    """One bit for each entry, in the order of blocks, from what the blocks sent back."""
    out = np.zeros(len(blocks), bool)
    for f in flags or ():
        if f["phase"] == phase:
            lo, hi = np.searchsorted(blocks, [f["block"], f["block"] + 1])
            out[lo:hi] = np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=hi - lo).astype(bool)
    return out


def by_block(blocks: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True]) if len(blocks) else [0]
    for s, e in zip(cuts[:-1], cuts[1:]):
        yield int(blocks[s]), slice(s, e)


def bits_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["chunk", "phase", "block", "bits"])


def with_flags(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """chunks with the flags of each; what is broadcast is weighed first."""
    flags = cut(flags.groupBy("chunk").agg(F.collect_list(F.struct("phase", "block", "bits")).alias("flags"), F.sum(F.length("bits") + 16).alias("w")))
    weight = flags.agg(F.sum("w")).first()[0] or 0
    flags = flags.drop("w")
    return chunks.join(F.broadcast(flags) if weight < BROADCAST_BYTES else flags, "chunk", "left")
