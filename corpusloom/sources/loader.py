"""Reading, row ids, sampling and writing of tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.session import fresh_name, materialise

#: Formats by file ending; anything else, and folders, are Parquet.
FORMATS = {
    ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".csv": "csv", ".tsv": "tcsv", ".txt": "text", ".orc": "orc",
}
SAMPLE_SEED = 42
#: Files whose sizes are broadcast at most, about 150 bytes each; beyond, they are joined as a table.
BROADCAST_FILES = 100_000


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches, on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [] if found is None else [f.getPath().toString() for f in found]


def _read(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    reader = spark.read.format("csv" if kind == "tcsv" else kind)
    if kind in ("csv", "tcsv"):
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        reader = reader.option("sep", "\t" if kind == "tcsv" else ",")
    df = reader.load(paths)
    return df.withColumnRenamed("value", "text") if kind == "text" else df


def read_table(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """A table of one split: files ``<split>-*`` or ``<split>.*`` or a folder of its name, else all of the path.

    Files of several formats are read each by its own and joined by column
    names.  A column called ``split`` is a column like any other.
    """
    base = path.rstrip("/")
    own = _files(spark, f"{base}/{split}-*") or _files(spark, f"{base}/{split}.*") or _files(spark, f"{base}/{split}")
    names = own or _files(spark, f"{base}/*") or [base]
    by_kind: dict[str, list[str]] = {}
    for n in names:
        kind = FORMATS.get(os.path.splitext(n)[1].lower())
        if kind:
            by_kind.setdefault(kind, []).append(n)
    if len(by_kind) <= 1:
        return _read(spark, next(iter(by_kind), "parquet"), own or [base])
    tables = [_read(spark, kind, paths) for kind, paths in sorted(by_kind.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def load_dataset(
    spark: SparkSession, path: str, split: str = "train", text_field: str = "text", sample_size: int | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """Read a table, make sure of its text column, and sample it if asked."""
    df = read_table(spark, path, split)
    if df.isStreaming:
        raise TypeError("a batch table is needed")
    if text_field not in df.columns:
        raise ValueError(f"Text field '{text_field}' not found. There are: {df.columns}")
    return sample(df, sample_size, id_col)


def _is_scan(df: DataFrame) -> bool:
    """Whether a table is Parquet files just as they lie, so that its rows have a place in them."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet"


def with_row_id(df: DataFrame, id_col: str | None = None, name: str = "row_id") -> DataFrame:
    """``df`` with a column ``name``: the given id column, or a dense position from 0.

    A position is the number of rows in the files before, by name, and the place
    in the file.  Anything but a plain scan of Parquet files is first written, so
    every later use reads the same rows with the same positions, however often or
    in whatever partitions its plan would run.  The sizes of files are a small
    table, one row a file.
    """
    if id_col:
        return df.withColumn(name, F.col(id_col).cast("long"))
    scanned = df if _is_scan(df) else materialise(df, "rows")
    file, at, of, before = (fresh_name(df, x) for x in ("file", "at", "of", "before"))
    columns = [f"`{c}`" for c in df.columns if c.lower() != name.lower()]
    meta = scanned.metadataColumn("_metadata")
    placed = scanned.select(*columns, meta["file_path"].alias(file), meta["row_index"].alias(at))
    sizes = placed.groupBy(file).agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.orderBy(file)) - F.col("n")
    sizes = sizes.select(F.col(file).alias(of), first.alias(before))
    if len(scanned.inputFiles()) <= BROADCAST_FILES:
        sizes = F.broadcast(sizes)
    joined = placed.join(sizes, F.col(file) == F.col(of))
    return joined.select(*columns, (F.col(before) + F.col(at)).alias(name))


def sample(df: DataFrame, size: int | None, id_col: str | None = None, seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly ``size`` rows, the same each time; all where size is 0, null or not below the number of rows.

    Rows are taken by a hash of their id, so Spark keeps only each task's best.
    """
    if not size or size >= df.count():
        return df
    own = fresh_name(df, "place")
    rows = with_row_id(df, id_col, own)
    key = F.md5(F.concat(F.col(own).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return rows.orderBy(key, own).limit(size).select(*[f"`{c}`" for c in df.columns])


def check_output_path(path: str) -> None:
    """Raise unless a local path lies inside the current folder; done before any work."""
    inside = os.path.realpath(os.getcwd())
    where = os.path.realpath(path)
    if where != inside and not where.startswith(inside + os.sep):
        raise ValueError(f"Output path must be within current directory: {path}")


def save_dataset(df: DataFrame, path: str) -> None:
    """Write a table as Parquet; an existing one is never overwritten."""
    df.write.mode("errorifexists").parquet(path)
