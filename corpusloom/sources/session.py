"""Session plumbing: shared folders, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
GROUP_KEY = "parquet.block.row.count.limit"
READ_KEY = "spark.sql.parquet.columnarReaderBatchSize"
#: Rows that Spark's reader decodes at once where rows are long.
READ_ROWS = 256
#: Bytes of rows that go to a Python worker at a time; a longer row goes alone.
BATCH_BYTES = "4m"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and
    Spark runs in this process (tests, local mode) a folder of this process is
    made and recorded there; on a cluster no such folder is shared.
    """
    where = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not where:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where


def materialise(df: DataFrame, tag: str, group_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: losing an executor later costs no recomputation of what
    lies before.  The files live in the shared folder, never on one machine.
    A writer holds a row group, and a reader decodes up to 4096 of its rows at
    once: whole files, where rows are large.  ``group_rows`` bounds a group.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{tag}-{uuid.uuid4().hex}"
    for written in getattr(spark.sparkContext, "_corpusloom_scratch", []):
        written.append(path)
    df.write.options(**({GROUP_KEY: group_rows} if group_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def long_rows(spark: SparkSession) -> Iterator[None]:
    """What runs inside reads at most ``READ_ROWS`` rows at once: an executor holds a batch of each task, whatever its bytes."""
    before = spark.conf.get(READ_KEY)
    spark.conf.set(READ_KEY, str(min(int(before), READ_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(READ_KEY, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the tables that were written inside; for runs of which no table outlives them."""
    open_ = spark.sparkContext.__dict__.setdefault("_corpusloom_scratch", [])
    written: list[str] = []
    open_.append(written)
    try:
        yield
    finally:
        open_[:] = [x for x in open_ if x is not written]
        for name in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each context.

    Functions that run in Python workers are pickled by reference, so the
    workers must be able to import the package wherever the driver was started.
    Also bounds what goes to a worker at a time, unless the session says how much.
    """
    if spark.conf.get(BATCH_KEY, None) in (None, "67108864b"):  # Spark's default
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="corpusloom-src-"), "corpusloom_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    context._corpusloom_shipped = True


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__cl_{base}", 0
    while name.lower() in taken:
        n += 1
        name = f"__cl_{base}_{n}"
    return name
