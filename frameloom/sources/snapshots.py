"""Tables that several writers change: whole snapshots, and a file a version that only one writer can make.

A writer reads a version, writes its snapshot beside it, and then makes the file of the next version, which names the
snapshot. Making that file fails where another writer was first: nothing of the late writer is seen, and it may try again on
what is there by then. Readers take the newest version; a snapshot lies in a folder a run and status, so that a scan for some
reads no others.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

VERSIONS, PARTS = "_versions", ("run_id", "status")


class Conflict(RuntimeError):
    """Another writer has made that version."""


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions there are, oldest first."""
    files, where = _hadoop(spark, f"{path}/{VERSIONS}")
    names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n) for n in names if re.fullmatch(r"\d{12}", n))


def _snapshot(spark: SparkSession, path: str, version: int) -> tuple[str, StructType]:
    """The folder of a version's snapshot, and its columns as they were written: values in names of folders have no type."""
    folder, schema = spark.read.text(f"{path}/{VERSIONS}/{version:012d}", wholetext=True).first()[0].split("\n", 1)
    return f"{path}/{folder}", StructType.fromJson(json.loads(schema))


def _made_alone(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file, unless it is there: of several that try, one succeeds."""
    files, where = _hadoop(spark, path)
    files.mkdirs(where.getParent())
    if files.getUri().getScheme() == "file":  # Hadoop's local files look first and make later
        try:
            with open(urlparse(path).path, "x", encoding="utf-8") as f:
                f.write(text)
            return True
        except FileExistsError:
            return False
    try:
        out = files.create(where, False)
    except Exception as e:  # noqa: BLE001  what is there already is told by several kinds of errors
        if files.exists(where):
            return False
        raise e
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, int]:
    """(the table, its version): the newest, or one that is named."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path} has no version {'' if version is None else version}")
    version = known[-1] if version is None else version
    folder, schema = _snapshot(spark, path, version)
    return spark.read.schema(schema).parquet(folder).select(*schema.names), version


def commit(df: DataFrame, path: str, after: int | None) -> int:
    """Makes df the version after the one it was made from (None: the first); Conflict if that version is there already."""
    spark, new, folder = df.sparkSession, 0 if after is None else after + 1, f"snapshot-{uuid.uuid4().hex}"
    df.write.partitionBy(*[c for c in PARTS if c in df.columns]).parquet(f"{path}/{folder}")
    if not _made_alone(spark, f"{path}/{VERSIONS}/{new:012d}", f"{folder}\n{df.schema.json()}"):
        files, where = _hadoop(spark, f"{path}/{folder}")
        files.delete(where, True)
        raise Conflict(f"{path} has version {new} by another writer")
    return new


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Commits change of the newest version; where another writer was first, on what that one made."""
    for left in range(tries - 1, -1, -1):
        df, version = read(spark, path)
        try:
            return commit(change(df), path, version)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be 1 at least")


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Drops all but the newest versions and the snapshots that none names; how many were dropped. Not while readers of old ones run."""
    known = versions(spark, path)
    for v in known[:-keep]:
        files, where = _hadoop(spark, _snapshot(spark, path, v)[0])
        files.delete(where, True)
        files.delete(_hadoop(spark, f"{path}/{VERSIONS}/{v:012d}")[1], False)
    return len(known[:-keep])

