"""Uncompressed video (Y4M: a line of header, then frames of one size) as a source of frames and a sink.

A file is cut into ranges of bytes, whatever its length, and small ranges are dealt to a task together; of each a task reads
the header, and of the frames that begin in it only those that are asked for: by a range of frame_index, which Spark pushes down, by a rate of candidates, which is an
option, or none where no pixels are among the columns. A video may be several files in one folder, each with the number of
its first frame in its header; so a long video is also written by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from frameloom.sources.staged import StagedWriter, files_in, located, registered

MAGIC, FRAME, SUFFIX = b"YUV4MPEG2", b"FRAME\n", ".y4m"
#: Bytes of a frame for each pixel, by colour space; the first plane is the gray picture.
COLOURS = {"mono": Fraction(1), "420": Fraction(3, 2), "422": Fraction(2), "444": Fraction(3)}
LONGEST_HEADER = 4096
#: What a task reads where ranges are small, and what opening a file counts for.
TOGETHER_BYTES, OPEN_BYTES = 32 << 20, 1 << 18
FRAMES = "video string, path string, frame_index long, timestamp_sec double, fps double, height int, width int, gray binary"
METADATA = "video string, path string, first long, frames long, fps double, height int, width int, error string"


class BrokenVideo(ValueError):
    """A file isn't a video of frames of one size."""


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    rate: Fraction
    colour: str
    first: int
    length: int

    @property
    def gray_bytes(self) -> int:
        return self.width * self.height

    @property
    def step(self) -> int:
        """Bytes from a frame to the next."""
        half = (self.width + 1) // 2
        planes = {"mono": 0, "420": 2 * half * ((self.height + 1) // 2), "422": 2 * half * self.height, "444": 2 * self.gray_bytes}
        return len(FRAME) + self.gray_bytes + planes[self.colour]

    @property
    def fps(self) -> float:
        return float(self.rate)

    def count(self, size: int) -> int:
        return max(0, size - self.length) // self.step


def parsed_header(start: bytes, path: str = "") -> Header:
    """The header in the first bytes of a file."""
    end = start.find(b"\n")
    if not start.startswith(MAGIC + b" ") or end < 0:
        raise BrokenVideo(f"{path}: no header")
    fields: dict[str, str] = {}
    for word in start[:end].decode("ascii", "replace").split(" ")[1:]:
        if word[:1] == "X":
            name, _, value = word[1:].partition("=")
            fields["X" + name] = value
        elif word:
            fields.setdefault(word[0], word[1:])
    colour = re.match(r"mono|420|422|444", fields.get("C", "420"))
    try:
        n, d = (int(x) for x in fields.get("F", "0:1").split(":"))
        width, height, first = int(fields["W"]), int(fields["H"]), int(fields.get("XFIRST", "0"))
    except (KeyError, ValueError) as e:
        raise BrokenVideo(f"{path}: {start[:end]!r}") from e
    if width <= 0 or height <= 0 or not colour or re.search(r"p\d\d|alpha|mono\d", fields.get("C", "")):
        raise BrokenVideo(f"{path}: {start[:end]!r}")
    return Header(width, height, Fraction(n, d) if d else Fraction(0), colour[0], first, end + 1)


def header_line(width: int, height: int, fps: float, first: int = 0) -> bytes:
    rate = Fraction(fps).limit_denominator(1001)
    return MAGIC + f" W{width} H{height} F{rate.numerator}:{rate.denominator} Ip A1:1 Cmono XFIRST={first}\n".encode()


def half_even_step(rate: Fraction, per_second: float) -> int:
    return max(1, round(rate / Fraction(per_second)))


def video_of(path: str, root: str, header: Header, segmented: bool) -> str:
    """A video's name: its file's path below the root, without suffix; that of the folder for one of several files."""
    name = path[len(root.rstrip("/")) :].lstrip("/") if path.startswith(root.rstrip("/")) else path
    name = name or path.rsplit("/", 1)[-1]
    return name.rsplit("/", 1)[0] if segmented and "/" in name else name.removesuffix(SUFFIX)


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What a task reads."""

    found: list[Range]


def together(ranges: Iterable[Range], most: int) -> list[Ranges]:
    """Ranges in their order, as many a task as make about most bytes, each counted as a file opened."""
    out, total = [], 0
    for r in ranges:
        cost = r.end - r.start + OPEN_BYTES
        if not out or total + cost > most:
            out.append(Ranges([]))
            total = 0
        out[-1].found.append(r)
        total += cost
    return out


class Y4mReader(DataSourceReader):
    """Frames in ranges of bytes; low and high are what was pushed down of frame_index."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.names
        self.task_bytes = int(options.get("task_bytes", 32 << 20))
        self.per_second, self.missing = (float(options[x]) if options.get(x) else None for x in ("candidate_fps", "missing_fps"))
        self.low, self.high = 0, (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            bounds = None
            if getattr(f, "attribute", None) == ("frame_index",):
                if isinstance(f, (EqualTo, EqualNullSafe)):
                    bounds = f.value, f.value
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    bounds = f.value + isinstance(f, GreaterThan), None
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    bounds = None, f.value - isinstance(f, LessThan)
                elif isinstance(f, In) and f.value:
                    self.narrow(min(f.value), max(f.value))  # the filter itself is left to Spark
                elif isinstance(f, IsNotNull):
                    bounds = None, None
            if bounds is None:
                yield f
            else:
                self.narrow(*bounds)

    def narrow(self, low: int | None, high: int | None) -> None:
        self.low, self.high = max(self.low, self.low if low is None else low), min(self.high, self.high if high is None else high)

    def partitions(self) -> list[Ranges]:
        ranges = (Range(x.path, x.size, s, min(x.size, s + self.task_bytes)) for x in files_in(self.path, SUFFIX) for s in range(0, max(x.size, 1), self.task_bytes))
        return together(ranges, max(self.task_bytes, TOGETHER_BYTES))

    def wanted(self, header: Header, part: Range) -> range:
        """Numbers within the file of the frames to read."""
        at = lambda b: max(0, -(-(b - header.length) // header.step))  # noqa: E731  the first frame that begins at b or later
        low, high = max(at(part.start), self.low - header.first), min(at(part.end), header.count(part.size), self.high - header.first + 1)
        step = 1
        if self.per_second:
            rate = header.rate if header.rate > 0 else Fraction(self.missing or 0)
            if rate <= 0:
                raise BrokenVideo(f"{part.path}: no frame rate")
            step = half_even_step(rate, self.per_second)
        low += -(header.first + low) % step
        return range(low, max(low, high), step)

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for r in part.found:
            yield from self.read_range(r)

    def read_range(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, root = located(self.path)
        pixels = "gray" in self.columns
        with store.open_input_file(part.path) as file:
            header = parsed_header(file.read(LONGEST_HEADER), part.path)
            name = video_of(part.path, root, header, b"XFIRST=" in self.first_line(file))
            fps = header.fps if header.rate > 0 else float(self.missing or 0)
            most, found = max(1, min(1024, (8 << 20) // header.gray_bytes)), self.wanted(header, part)
            for i in range(0, len(found), most):
                some = found[i : i + most]
                index = [header.first + k for k in some]
                values = {
                    "video": [name] * len(some), "path": [part.path] * len(some), "frame_index": index, "timestamp_sec": [k / fps if fps else None for k in index],
                    "fps": [fps] * len(some), "height": [header.height] * len(some), "width": [header.width] * len(some), "gray": [self.frame(file, header, k, part.path) for k in some] if pixels else None,
                }
                types = {"video": pa.string(), "path": pa.string(), "frame_index": pa.int64(), "timestamp_sec": pa.float64(), "fps": pa.float64(), "height": pa.int32(), "width": pa.int32(), "gray": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(values[c], types[c]) for c in self.columns], self.columns)

    @staticmethod
    def first_line(file: pa.NativeFile) -> bytes:
        file.seek(0)
        return file.read(LONGEST_HEADER).split(b"\n", 1)[0]

    @staticmethod
    def frame(file: pa.NativeFile, header: Header, k: int, path: str) -> bytes:
        file.seek(header.length + k * header.step)
        data = file.read(len(FRAME) + header.gray_bytes)
        if not data.startswith(FRAME) or len(data) < len(FRAME) + header.gray_bytes:
            raise BrokenVideo(f"{path}: no frame {k}")
        return data[len(FRAME) :]


@dataclass
class Files(InputPartition):
    found: list[tuple[str, int]]


class MetadataReader(DataSourceReader):
    """A row a file, from its header and its length; what isn't a video is a row with its error."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns, self.together = options["path"], schema.names, int(options.get("task_files", 256))

    def partitions(self) -> list[Files]:
        found = [(x.path, x.size) for x in files_in(self.path, SUFFIX)]
        return [Files(found[i : i + self.together]) for i in range(0, len(found), self.together)]

    def read(self, part: Files) -> Iterator[tuple]:
        store, root = located(self.path)
        for path, size in part.found:
            with store.open_input_file(path) as file:
                start = file.read(LONGEST_HEADER)
            try:
                h = parsed_header(start, path)
                row = {"video": video_of(path, root, h, b"XFIRST=" in start.split(b"\n", 1)[0]), "path": path, "first": h.first, "frames": h.count(size), "fps": h.fps, "height": h.height, "width": h.width, "error": None}
            except BrokenVideo as e:
                row = {"video": path, "path": path, "first": 0, "frames": 0, "fps": 0.0, "height": 0, "width": 0, "error": str(e)}
            yield tuple(row[c] for c in self.columns)


class Y4mWriter(StagedWriter):
    """Sorted rows (video, frame_index, gray, height, width, fps) as files of consecutive frames, one for each of their segments."""

    def put(self, rows: Iterator[Row]) -> Iterator[tuple[str, Iterator[bytes]]]:
        for (video, segment), frames in groupby(rows, key=lambda r: (r["video"], r["segment"])):
            first = next(frames)
            name = f"{video}/{first['frame_index']:012d}{SUFFIX}" if segment is not None else f"{video}{SUFFIX}"
            yield name, self.pieces(first, frames, segment is not None)

    @staticmethod
    def pieces(first: Row, rest: Iterator[Row], numbered: bool) -> Iterator[bytes]:
        at, shape = first["frame_index"], (first["height"], first["width"])
        line = header_line(shape[1], shape[0], first["fps"], at)
        yield line if numbered else line.replace(b" XFIRST=0", b"")
        yield FRAME + bytes(first["gray"])
        for k, r in enumerate(rest, 1):
            if r["frame_index"] != at + k or (r["height"], r["width"]) != shape or len(r["gray"]) != shape[0] * shape[1]:
                raise BrokenVideo(f"{r['video']}: frame {r['frame_index']} doesn't follow frame {at + k - 1}")
            yield FRAME + bytes(r["gray"])


class Y4m(DataSource):
    """The format ``y4m``; with the option metadata its rows are files, else frames."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return METADATA if self.options.get("metadata") else FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return (MetadataReader if self.options.get("metadata") else Y4mReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Y4mWriter:
        return Y4mWriter(self.options["path"], overwrite)


def read_frames(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, candidate_fps: float | None = None, missing_fps: float | None = None, task_bytes: int = 32 << 20) -> DataFrame:
    """FRAMES, or some of its columns, of the videos in path; with candidate_fps only every step-th frame, step by the video's rate.

    Pixels are read only if gray is among the columns. missing_fps stands in for a rate that isn't positive; else that is an error.
    """
    registered(spark, Y4m)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kept = StructType([f for f in StructType.fromDDL(FRAMES) if columns is None or f.name in columns])
    source = spark.read.format("y4m").schema(kept).option("task_bytes", task_bytes)
    for name, value in (("candidate_fps", candidate_fps), ("missing_fps", missing_fps)):
        source = source if value is None else source.option(name, str(value))
    df = source.load(path)
    return df if columns is None else df.select(*columns)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(video, fps, frame_count, height, width, duration_sec, error), a row a video, from headers and lengths alone."""
    registered(spark, Y4m)
    files = spark.read.format("y4m").option("metadata", "true").load(path)
    one = files.groupBy("video").agg(F.max("fps").alias("fps"), F.sum("frames").alias("frame_count"), F.max("height").alias("height"), F.max("width").alias("width"), F.first("error", ignorenulls=True).alias("error"))
    return one.withColumn("duration_sec", F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(0.0))


def write_frames(frames: DataFrame, path: str, fps: float | Column, segment_frames: int | None = 1024, overwrite: bool = False) -> None:
    """frames(video, frame_index, gray binary, height, width) as Y4M files: segments of so many frames a file, or one file a video.

    The frames of a file follow each other from its first; all files are there at the end, or none.
    """
    registered(frames.sparkSession, Y4m)
    segment = F.floor(F.col("frame_index") / segment_frames).cast("long") if segment_frames else F.lit(None).cast("long")
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    rows = frames.select("video", "frame_index", "gray", "height", "width", rate.cast("double").alias("fps"), segment.alias("segment"))
    dealt = rows.repartition("video", "segment").sortWithinPartitions("video", "segment", "frame_index")
    dealt.write.format("y4m").mode("overwrite" if overwrite else "append").save(path)
