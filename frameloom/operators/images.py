"""Pictures as PNG files: single frames, and a clip's contact sheet, as rows (path, content) for the staged writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.operators.resample import kept_shape, pixels_of, resample

SIGNATURE = b"\x89PNG\r\n\x1a\n"
FILES = "path string, content binary"
PICTURE = "height int, width int, gray binary, notes string"
PAPER, TITLE, LABEL = 255, 40, 58


class BrokenImage(ValueError):
    """Bytes aren't a gray PNG of eight bits."""


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(picture: np.ndarray, notes: str = "") -> bytes:
    """A gray picture of bytes as PNG, notes as its description."""
    return png_of_bands(*picture.shape, iter([picture]), notes)


def png_of_bands(h: int, w: int, bands: Iterator[np.ndarray], notes: str = "") -> bytes:
    """The PNG of a picture that comes in bands from the top, of which one is held at a time."""
    pack, packed = zlib.compressobj(), []
    for band in bands:
        lines = np.zeros((len(band), w + 1), np.uint8)
        lines[:, 1:] = band
        packed.append(pack.compress(lines.tobytes()))
    packed.append(pack.flush())
    text = _chunk(b"iTXt", b"Description\0\0\0\0\0" + notes.encode("utf-8", "replace")) if notes else b""
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + text + _chunk(b"IDAT", b"".join(packed)) + _chunk(b"IEND", b"")


def png_picture(data: bytes) -> tuple[np.ndarray, str]:
    """(picture, notes) of a gray PNG whose lines aren't filtered, or by the line's left or upper neighbours."""
    if data[:8] != SIGNATURE:
        raise BrokenImage("no PNG")
    at, head, packed, notes = 8, None, b"", ""
    while at + 12 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise BrokenImage(f"chunk {name!r}")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        elif name == b"iTXt" and body.startswith(b"Description\0\0"):
            notes = body.split(b"\0", 5)[-1].decode()
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise BrokenImage(f"header {head}")
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(head[1], head[0] + 1)
    out = lines[:, 1:].copy()
    for i, kind in enumerate(lines[:, 0].tolist()):
        if kind == 1:
            out[i] = np.cumsum(out[i], dtype=np.uint64).astype(np.uint8)
        elif kind == 2 and i:
            out[i] += out[i - 1]
        elif kind > 2:
            raise BrokenImage(f"filter {kind}")
    return out, notes


def encoded(gray: Column | str, height: Column | str, width: Column | str, notes: Column | str | None = None) -> Column:
    """The picture as PNG."""

    @F.pandas_udf("binary")
    def run(g: pd.Series, h: pd.Series, w: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else png(pixels_of(x, a, b).astype(np.uint8), s or "") for x, a, b, s in zip(g, h, w, t)], dtype=object)

    return run(gray, height, width, F.lit("") if notes is None else notes)


def decoded(content: Column | str) -> Column:
    """PICTURE of a PNG; null for bytes that are none."""

    @F.pandas_udf(PICTURE)
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            try:
                p, notes = png_picture(x)
                rows.append((*p.shape, p.tobytes(), notes))
            except (BrokenImage, zlib.error, struct.error, TypeError):
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["height", "width", "gray", "notes"]).astype({"height": "Int32", "width": "Int32"})

    return run(content)


def contact_sheet(pictures: list[np.ndarray], width: int = 320, most_columns: int = 4) -> np.ndarray:
    """Pictures in a grid under a band for the title, a band for a label under each."""
    return np.concatenate(list(sheet_bands(pictures, width, most_columns)[2]))


def sheet_bands(pictures: list[np.ndarray], width: int = 320, most_columns: int = 4) -> tuple[int, int, Iterator[np.ndarray]]:
    """(height, width, bands) of a contact sheet: the title's band, then a row of the grid each, made as it is taken."""
    shapes = [kept_shape(*p.shape, width) for p in pictures]
    columns = min(most_columns, len(pictures))
    tall = max(h for h, _ in shapes) + LABEL

    def made() -> Iterator[np.ndarray]:
        yield np.full((TITLE, columns * width), PAPER, np.uint8)
        for i in range(0, len(pictures), columns):
            band = np.full((tall, columns * width), PAPER, np.uint8)
            for k, (p, shape) in enumerate(zip(pictures[i : i + columns], shapes[i : i + columns])):
                t = p if shape == p.shape else resample(p, *shape, "cubic")
                band[: t.shape[0], k * width : k * width + t.shape[1]] = t
            yield band

    return TITLE + -(-len(pictures) // columns) * tall, columns * width, made()


def keyframe_files(chosen: DataFrame, width: int = 320) -> DataFrame:
    """chosen(clip_id string, frame_order, frame_index, timestamp_sec, selected_reason, combined_score, gray, height, width) -> FILES.

    A picture a frame, and for each clip its contact sheet, with the labels as notes, and selected_frames.json. A clip's
    sheet is made in one call, which holds the frames as they came and one row of the sheet's grid in its size.
    """
    name = C.frame_file_name(F.col("frame_order"), F.col("timestamp_sec"), F.col("frame_index"), suffix=".png")
    named = chosen.withColumn("image_file", name)
    label = F.format_string("%02d | %s | %s | score=%.3f", "frame_order", C.format_time(F.col("timestamp_sec")), "selected_reason", "combined_score")
    pictures = named.select(F.concat_ws("/", "clip_id", "image_file").alias("path"), encoded("gray", "height", "width").alias("content"))
    one = F.struct("frame_order", "frame_index", "timestamp_sec", "selected_reason", "combined_score", "image_file")
    listed = named.groupBy("clip_id").agg(F.array_sort(F.collect_list(one)).alias("selected_frames"))
    record = F.to_json(F.struct(F.concat(F.col("clip_id"), F.lit(".mp4")).alias("clip_file"), F.size("selected_frames").alias("selected_count"), "selected_frames", F.concat_ws("/", "clip_id", F.concat(F.element_at(F.split("clip_id", "/"), -1), F.lit("_contact_sheet.png"))).alias("contact_sheet_path"), F.lit(None).cast("string").alias("error")), {"ignoreNullFields": "false"})
    records = listed.select(F.concat_ws("/", "clip_id", F.lit("selected_frames.json")).alias("path"), record.cast("binary").alias("content"))

    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for clip, frames in zip(b["clip_id"], b["frames"]):
                pages = [pixels_of(bytes(f["gray"]), f["height"], f["width"]) for f in frames]
                sheet = png_of_bands(*sheet_bands(pages, width), "\n".join(f["label"] for f in frames))
                yield pd.DataFrame([(f"{clip}/{clip.rsplit('/', 1)[-1]}_contact_sheet.png", sheet)], columns=["path", "content"])

    frames = F.array_sort(F.collect_list(F.struct("frame_order", label.alias("label"), "height", "width", "gray")))
    return pictures.unionByName(records).unionByName(named.groupBy("clip_id").agg(frames.alias("frames")).mapInPandas(sheets, FILES))
