"""Parquet tables of a layer, and tables written only to cut the lineage of a long job."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system Spark can reach holds ``path``; reads nothing."""
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """One file of UTF-8 text on any file system that Spark reaches; fails if it is there and may not be overwritten."""
    files, target = _files(spark, path)
    if files.exists(target) and not overwrite:
        raise FileExistsError(f"already written: {path}")
    stream = files.create(target, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


# Hidden from Spark's listings by their first character.
STAGED = "_staged-"
READY = "_READY"


def _publish(spark: SparkSession, root: str, staged: str) -> None:
    """Move everything from a complete staging folder into the layer, in place of what is there; may be repeated."""
    files, source = _files(spark, staged)
    _, target = _files(spark, root)
    for status in files.listStatus(source):
        name = status.getPath().getName()
        if name == READY:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(target, name)
        files.delete(path, True)
        if not files.rename(status.getPath(), path):
            raise OSError(f"could not move {status.getPath()} to {path}")
    files.delete(source, True)


def recover_layer(spark: SparkSession, root: str) -> None:
    """Finish a commit that was interrupted between its marker and its last move.

    A staging folder with a marker holds every table that has not been moved yet, so moving on gives the whole layer.
    One without a marker is a write under way or a broken one, and no part of the layer.
    """
    files, target = _files(spark, root)
    if not files.exists(target):
        return
    for status in files.listStatus(target):
        path = status.getPath()
        if path.getName().startswith(STAGED) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, READY)):
            _publish(spark, root, path.toString())


@contextmanager
def layer(spark: SparkSession, root: str, names: Iterable[str], overwrite: bool = False) -> Iterator[str]:
    """A folder in which the tables of a layer are written, and moved to ``root`` together when the block ends.

    If the block fails, nothing of it is left and the layer is as it was. The tables are moved once a marker says that
    all of them are complete; whoever reads the layer by :func:`load_layer` after a failure between two moves finishes
    them first. Frames over the folder are of no use after the block.
    """
    recover_layer(spark, root)
    check_targets(spark, root, names, overwrite)
    staged = f"{root.rstrip('/')}/{STAGED}{uuid4().hex}"
    try:
        yield staged
    except BaseException:
        remove(spark, staged)
        raise
    write_text(spark, f"{staged}/{READY}", "")
    _publish(spark, root, staged)


def load_layer(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Open the named tables. All missing ones are named in one error, before anything is read."""
    recover_layer(spark, root)
    paths = {name: table_path(root, name) for name in names}
    missing = [path for path in paths.values() if not exists(spark, path)]
    if missing:
        raise FileNotFoundError(f"missing table: {', '.join(missing)}")
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def check_targets(spark: SparkSession, root: str, names: Iterable[str], overwrite: bool = False) -> None:
    """Fail before a long job computes anything that it may not write."""
    if overwrite or not exists(spark, root):
        return
    taken = [path for path in (table_path(root, name) for name in names) if exists(spark, path)]
    if taken:
        raise FileExistsError(f"already written: {', '.join(taken)}")


def save_table(frame: DataFrame, root: str, name: str, overwrite: bool = False) -> DataFrame:
    """Write one table and return it as read back, so that what builds on it starts from the files."""
    path = table_path(root, name)
    frame.write.mode("overwrite" if overwrite else "errorifexists").parquet(path, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def save_tables(tables: Mapping[str, DataFrame], root: str, overwrite: bool = False) -> dict[str, DataFrame]:
    """:func:`save_table` for tables that do not build on each other, as concurrent Spark jobs."""
    with ThreadPoolExecutor(max_workers=max(1, len(tables))) as pool:
        jobs = {name: pool.submit(save_table, frame, root, name, overwrite) for name, frame in tables.items()}
        return {name: job.result() for name, job in jobs.items()}


def write_tables(tables: Mapping[str, DataFrame], root: str, overwrite: bool = False) -> dict[str, str]:
    """Write each frame as a Parquet table below ``root``: all of them, or none and the layer stays as it was."""
    for frame in list(tables.values())[:1]:
        with layer(frame.sparkSession, root, tables, overwrite) as staged:
            save_tables(tables, staged)
    return {name: table_path(root, name) for name in tables}


def scratch_root(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a plainly local session without that setting gets a temporary one.

    One process alone is plainly local. Any other master, or none to be read, needs a folder that all share. The folder
    is gone when the driver's process ends, with all frames over it; :func:`scratch` removes one earlier.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="basketry-")
    folder = f"{base.rstrip('/')}/basketry-{uuid4().hex}"
    if getattr(spark, "_jvm", None) is not None:
        files, path = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


@contextmanager
def scratch(spark: SparkSession, root: str | None = None) -> Iterator[str]:
    """A folder for the tables of one job, in ``root`` or by :func:`scratch_root`; it is gone after the job."""
    folder = f"{root.rstrip('/')}/basketry-{uuid4().hex}" if root else scratch_root(spark)
    try:
        yield folder
    finally:
        remove(spark, folder)


def held(frame: DataFrame) -> DataFrame:
    """A table of a few rows, computed now, which needs no file any more."""
    return frame.sparkSession.createDataFrame(frame.collect(), frame.schema)
