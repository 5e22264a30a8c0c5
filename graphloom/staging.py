"""Cutting lineage: tables written once in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset (tests, a laptop), a temporary
folder of this process is used instead, which is right for ``local[*]`` masters only.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []
_leaving: list[SparkSession] = []
_noting: ContextVar[tuple[list[str], ...]] = ContextVar("noting", default=())


def _clean() -> None:
    """What is left of written tables goes when the driver ends, if its session still lives."""
    try:
        drop_written(_leaving[0])
    except Exception:  # noqa: BLE001  (the process is ending, and the gateway may have gone first)
        _written.clear()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    if not _written and not _leaving:
        _leaving.append(spark)
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    for paths in _noting.get():
        paths.append(path)
    return path


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that are written inside, for :func:`drop_written` once nothing reads them any more."""
    paths: list[str] = []
    before = _noting.set((*_noting.get(), paths))
    try:
        yield paths
    finally:
        _noting.reset(before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage is then one scan."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """:func:`written`, and aggregates of the rows that come with the write, without a job of their own."""
    seen = Observation()
    out = written(df.observe(seen, *measures), name)
    return out, seen.get


def drop_written(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete the tables that :func:`written` has left so far, or those of ``paths``; frames that read them are then invalid."""
    jvm, n = spark.sparkContext._jvm, 0
    going = set(_written if paths is None else paths)
    gone = [x for x in _written if x in going]
    _written[:] = [x for x in _written if x not in going]
    for x in gone:
        path = jvm.org.apache.hadoop.fs.Path(x)
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
