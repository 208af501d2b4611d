"""Session helpers shared by the operators: reading tables, cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset in local mode (tests, a laptop) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reachlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: How what is written in between is packed: nodes are digits and separators, of which zstd takes about two thirds of what the default does.
PACKED = {"compression": "zstd"}


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reachlens-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._reachlens_path = path
    return out


def packed(df: DataFrame) -> DataFrame:
    """``materialize`` for graphs, packed as ``PACKED`` says."""
    return materialize(df, **PACKED)


#: Rows up to which a table is broadcast.
SMALL_ROWS = 1_000_000


def if_small(df: DataFrame) -> DataFrame:
    """``df`` with the hint to broadcast it if it has at most ``SMALL_ROWS`` rows; for what is written, where the count comes from the files' footers."""
    return df.hint("broadcast") if df.count() <= SMALL_ROWS else df


def if_large(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with the hint to shuffle it if it has more than ``SMALL_ROWS`` rows: Spark sizes what is written by its packed bytes, so it would broadcast many more."""
    return df.hint("merge") if rows > SMALL_ROWS else df


def file_at(spark: SparkSession, path: str) -> tuple:
    """The file system of ``path`` and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


_publishing = threading.Lock()  # a local file system's rename looks and moves in two steps


def published(spark: SparkSession, path: str) -> str | None:
    """The text that stands at ``path``, None if there is none; any other failure to read is an error."""
    store, at = file_at(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> str:
    """Put ``text`` at ``path`` unless something stands there, by writing aside and renaming without overwriting; gives what stands there then."""
    store, at = file_at(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = store.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    none = spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    none[0] = getattr(fs, "Options$Rename").NONE
    with _publishing:
        if not store.exists(at):
            try:
                fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, at, none)
            except Exception:  # another session was first: what it put there counts
                if not store.exists(at):
                    raise
    store.delete(aside, False)
    return published(spark, path)


def ensure(spark: SparkSession, path: str) -> None:
    """Make a folder unless it is there."""
    store, at = file_at(spark, path)
    store.mkdirs(at)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read it afterwards."""
    path = getattr(df, "_reachlens_path", None)
    if path:
        store, at = file_at(df.sparkSession, path)
        store.delete(at, True)


def stands(df: DataFrame) -> bool:
    """Is what ``materialize`` wrote for ``df`` still there?"""
    store, at = file_at(df.sparkSession, df._reachlens_path)
    return bool(store.exists(at))
