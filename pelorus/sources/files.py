"""Small files beside tables: through Spark's file systems where there is a session, so that a cluster's shared storage works as well."""

from __future__ import annotations

import pathlib
import shutil

from pyspark.sql import SparkSession


def _at(path: str):
    """(Hadoop path, its file system), or None without a session, as in an executor's Python."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write(path: str, content: bytes) -> None:
    """Write a file as a whole, in place of one that is there; its folders are made."""
    at = _at(path)
    if at is None:
        pathlib.Path(path).parent.mkdir(parents=True, exist_ok=True)
        pathlib.Path(path).write_bytes(content)
        return
    stream = at[1].create(at[0], True)
    try:
        stream.write(content)
    finally:
        stream.close()


def read(path: str) -> bytes:
    at = _at(path)
    if at is None:
        return pathlib.Path(path).read_bytes()
    if not at[1].exists(at[0]):
        raise FileNotFoundError(path)
    stream = at[1].open(at[0])
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def names(folder: str, suffix: str = "") -> list[str]:
    """Names of the files in a folder, sorted; none if there is no such folder."""
    at = _at(folder)
    if at is None:
        base = pathlib.Path(folder)
        found = [p.name for p in base.iterdir() if p.is_file()] if base.is_dir() else []
    else:
        found = [s.getPath().getName() for s in at[1].listStatus(at[0]) if s.isFile()] if at[1].exists(at[0]) else []
    return sorted(n for n in found if n.endswith(suffix) and not n.startswith("."))


def folders(folder: str) -> list[str]:
    """Names of the folders in a folder, sorted."""
    at = _at(folder)
    if at is None:
        base = pathlib.Path(folder)
        return sorted(p.name for p in base.iterdir() if p.is_dir()) if base.is_dir() else []
    return sorted(s.getPath().getName() for s in at[1].listStatus(at[0]) if s.isDirectory()) if at[1].exists(at[0]) else []


def make(folder: str) -> None:
    at = _at(folder)
    if at is None:
        pathlib.Path(folder).mkdir(parents=True, exist_ok=True)
    else:
        at[1].mkdirs(at[0])


def move(folder: str, to: str) -> None:
    """Move a folder within its file system; folders above its new place are made."""
    at, there = _at(folder), _at(to)
    if at is None:
        pathlib.Path(to).parent.mkdir(parents=True, exist_ok=True)
        pathlib.Path(folder).rename(to)
        return
    at[1].mkdirs(there[0].getParent())
    if not at[1].rename(at[0], there[0]):
        raise OSError(f"{folder} can't be moved to {to}")


def delete(path: str) -> None:
    """Delete a file, or a folder and all in it; nothing if there is none."""
    at = _at(path)
    if at is None:
        own = pathlib.Path(path)
        shutil.rmtree(own) if own.is_dir() else own.unlink(missing_ok=True)
    else:
        at[1].delete(at[0], True)
