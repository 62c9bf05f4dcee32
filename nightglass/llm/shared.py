"""Tables that cut lineage, in the folder that all executors share, and their removal."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes a write's shuffle files when the write has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class SharedFolderError(RuntimeError):
    """A cluster's session doesn't name the folder that its executors share."""


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset in a single local process (tests) a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SharedFolderError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='nightglass-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """The tables written inside a ``scratch`` block."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        """These outlive the block, as its result reads them."""
        self.kept |= {df._shared_path for df in tables}


class _Open(threading.local):
    """The blocks that a thread is in, the innermost last."""

    def __init__(self) -> None:
        self.blocks: list[Scratch] = []


_OPEN = _Open()


@contextmanager
def scratch() -> Iterator[Scratch]:
    """When the block ends, delete the tables that were written in it, but for kept ones, which go to the block around it."""
    own = Scratch()
    _OPEN.blocks.append(own)
    try:
        yield own
    except BaseException:
        own.kept.clear()
        raise
    finally:
        _OPEN.blocks.remove(own)
        discard(*(df for df in own.tables if df._shared_path not in own.kept))
        if _OPEN.blocks:
            _OPEN.blocks[-1].tables += [df for df in own.tables if df._shared_path in own.kept]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: a lost executor costs no recomputation.

    The shuffle files of the write go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/nightglass/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    if _OPEN.blocks:
        _OPEN.blocks[-1].tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    gone = {df._shared_path for df in tables}
    for own in _OPEN.blocks:
        own.tables = [df for df in own.tables if df._shared_path not in gone]
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
