"""Files written in two phases by a Python data source: tasks write into a staging folder, the driver publishes or drops it.

What a task wrote counts only once its message has reached the driver, so an attempt that failed, or ran twice, leaves
nothing: its files are in a folder of its own, and the staging folder goes with the job. Stores are those of pyarrow
(local, s3, gs, hdfs), by URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

DONE = "_SUCCESS"


class DoubleFile(ValueError):
    """Two rows name the same file."""


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def files_in(path: str, suffix: str) -> list[fs.FileInfo]:
    """The files of a folder, or the file itself, whose names end so; what lies under a name that begins with _ or . is none."""
    store, root = located(path)
    found = store.get_file_info(root)
    if found.type == fs.FileType.File:
        return [found]
    within = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = lambda x: not any(p.startswith(("_", ".")) for p in x.path[len(root.rstrip("/")) :].split("/"))
    return sorted((x for x in within if x.type == fs.FileType.File and x.path.endswith(suffix) and shown(x)), key=lambda x: x.path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class StagedWriter(DataSourceWriter):
    """A writer whose put() yields (name, pieces of bytes) for the rows of a task; rows come in the order they are written in."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.stage = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def put(self, rows: Iterator[Row]) -> Iterator[tuple[str, Iterator[bytes]]]:
        raise NotImplementedError

    def write(self, rows: Iterator[Row]) -> Written:
        folder, names = f"{self.stage}/{uuid.uuid4().hex}", []
        store, root = located(folder)
        for name, pieces in self.put(rows):
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name} doesn't lie in the folder that is written")
            target = f"{root}/{name}"
            if name in names[-1:] or store.get_file_info(target).type != fs.FileType.NotFound:
                raise DoubleFile(name)
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(target) as out:
                for piece in pieces:
                    out.write(piece)
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        made = [(m.folder, n) for m in messages if m for n in m.names]
        store, root = located(self.path)
        names = [n for _, n in made]
        if len(set(names)) < len(names):
            raise DoubleFile(next(n for n in sorted(names) if names.count(n) > 1))
        if not self.overwrite and (old := [n for n in names if store.get_file_info(f"{root}/{n}").type != fs.FileType.NotFound]):
            raise DoubleFile(old[0])
        store.create_dir(root, recursive=True)
        stage = self.stage.rsplit("/", 1)[1]
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(root)):
                if x.base_name != stage:
                    (store.delete_dir if x.type == fs.FileType.Directory else store.delete_file)(x.path)
        for folder in sorted({n.rsplit("/", 1)[0] for n in names if "/" in n}):
            store.create_dir(f"{root}/{folder}", recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: store.move(f"{located(x[0])[1]}/{x[1]}", f"{root}/{x[1]}"), made))
        self.drop()
        with store.open_output_stream(f"{root}/{DONE}"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.drop()

    def drop(self) -> None:
        store, stage = located(self.stage)
        if store.get_file_info(stage).type == fs.FileType.Directory:
            store.delete_dir(stage)


class FileWriter(StagedWriter):
    """Rows (path, content) as files."""

    def put(self, rows: Iterator[Row]) -> Iterator[tuple[str, Iterator[bytes]]]:
        for r in rows:
            yield r["path"], iter([bytes(r["content"])])


class StagedFiles(DataSource):
    """The format ``staged_files``: a file a row."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """files(path, content) into a folder: all of them are there at the end, or none."""
    registered(files.sparkSession, StagedFiles)
    files.select("path", "content").write.format("staged_files").mode("overwrite" if overwrite else "append").save(path)


def registered(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)
