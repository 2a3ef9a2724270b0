"""The folder that all machines of a cluster share, and tables written there between steps."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset and the master is local (tests), a
    temporary one.  On a cluster a machine's own folder would not do: there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tabulon-"))
            folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_run.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names of what lies directly in a folder; none if there is no such folder."""
    fs, at = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if n.startswith(prefix))


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def removed(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


@contextmanager
def run_folder(spark: SparkSession, name: str):
    """Inside, fresh_path() and stored() use a folder of this run's own, which goes with all it holds at the end."""
    path = fresh_path(spark, name)
    before = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(before)
        removed(spark, path)


def tidy(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose steps lie in a folder of their own: its result is written beside that folder, which then goes.
    The session is that of the first argument, a DataFrame or the session itself."""

    @functools.wraps(build)
    def finished(first, *args, **kwargs) -> DataFrame:
        spark = first if isinstance(first, SparkSession) else first.sparkSession
        name = build.__name__.replace("_", "-")
        out = fresh_path(spark, name)
        with run_folder(spark, f"{name}-steps"):
            df = build(first, *args, **kwargs)
            df.write.parquet(out)
        return spark.read.schema(df.schema).parquet(out)

    return finished


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one: of several writers just one succeeds, and readers see all of it or none."""
    fs, at = _file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.getUri().getScheme() == "file":  # a local folder: a hard link is made or refused in one step
        try:
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    try:
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
        only_new = spark.sparkContext._gateway.new_array(options, 1)
        only_new[0] = options.NONE
        context.rename(draft, at, only_new)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(draft, False)
        return False


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def swapped_in(spark: SparkSession, new: str, path: str) -> None:
    """Put a finished folder in another one's place; the old one goes only after it was moved aside."""
    fs, at = _file_system(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    held = fs.exists(at)
    if held and not fs.rename(at, aside):
        raise OSError(f"{path} cannot be moved aside")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(new), at):
        if held:
            fs.rename(aside, at)
        raise OSError(f"{new} cannot be moved to {path}")
    if held:
        fs.delete(aside, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
