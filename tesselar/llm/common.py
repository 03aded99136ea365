"""Helpers that several operators share: shared storage, salted joins, chunked text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A key counts as hot when it holds more than one row in HOT_SHARE, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tesselar-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tesselar/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that outlives executors.

    The shuffle files of the write go with its end: kept until the driver's next garbage collection, they add up.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _tables.remove(path)


def dropped(df: DataFrame) -> None:
    """Delete the table that stored() returned as df, once nothing reads it any more."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for path in [t for t in _tables if any(f.endswith(t.split("://")[-1].lstrip("/")) for f in folders)]:
        _delete(df.sparkSession, path)


def drop_stored(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the tables that stored() has written in this session after the first `since`, but for one."""
    kept = {f.rpartition("/")[0] for f in but.inputFiles()} if but is not None else set()
    for path in [t for t in _tables[since:] if not any(f.endswith(t.split("://")[-1].lstrip("/")) for f in kept)]:
        _delete(spark, path)


def n_stored() -> int:
    """How many tables stored() has written and not deleted."""
    return len(_tables)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in [c.lower() for c in df.columns]:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time, which bounds what a task holds beside the batch, as texts are large."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() does the same, faster, where every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_stats(rows: DataFrame, stats: DataFrame, keys: list[str], size_col: str, total: int) -> DataFrame:
    """Inner join of rows with one stats row per key, where one key may hold a third of the rows.

    stats[size_col] is the number of rows of the key.  Keys with more than total / HOT_SHARE rows, of which
    there are at most HOT_SHARE, are broadcast, so their rows stay where they are; the others are shuffled.
    stats is read twice and should be a stored table.
    """
    hot = F.broadcast(stats.where(F.col(size_col) * HOT_SHARE > F.lit(total)))
    cold = stats.where(~(F.col(size_col) * HOT_SHARE > F.lit(total)))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
