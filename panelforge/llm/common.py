"""Helpers that the operators of this subpackage share: shared folders, input checks, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python: bounds a worker's memory where texts are long.
ARROW_ROWS = 2000


def session_setup(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts; a smaller setting of the session stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries give memory back by themselves
    _trim = None


def release() -> None:
    """Give freed memory back to the system: workers are reused by later stages, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: What this worker holds from one task to the next, by name.
_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """This worker's object of that name, made once; a task of an operator that doesn't ask for it drops it, see keep_only()."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def keep_only(name: str | None) -> None:
    """Drop what other operators' tasks have left in this worker: it is reused by later stages, whatever they do."""
    others = [k for k in _held if k != name]
    for k in others:
        del _held[k]
    if others:
        gc.collect()
        release()


def each(run: Callable, name: str | None = None) -> Callable:
    """A function of batches that releases memory when it is done; of what workers hold it uses name alone."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(name)
        try:
            yield from run(batches)
        finally:
            release()

    return released


def one(run: Callable, name: str | None = None) -> Callable:
    """A function of a group that releases memory when it is done; of what workers hold it uses name alone."""

    def released(table):
        keep_only(name)
        try:
            return run(table)
        finally:
            release()

    return released


def two(run: Callable) -> Callable:
    """A function of two groups that releases memory when it is done."""

    def released(left, right):
        keep_only(None)
        try:
            return run(left, right)
        finally:
            release()

    return released


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). One is made only where driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: A key with more than one in so many rows is hot; so there are at most that many hot keys.
HOT_SHARE = 1000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys that hold more than one in HOT_SHARE of the rows: HOT_SHARE rows at most, however large df is."""
    total = df.count()
    return stored(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") * HOT_SHARE > total).select(key), "hot-keys")


#: Rows of the small side of split_join() (some 100 bytes each) that are broadcast whole, at most.
WHOLE_ROWS = 100_000


def split_join(big: DataFrame, small: DataFrame, key: str, written: bool = False) -> DataFrame:
    """Inner join of big with small (one row for a key), so that no task gets all rows of a hot key.

    A small side of WHOLE_ROWS rows at most is broadcast. Beyond that only the rows of hot keys are, HOT_SHARE at most, and
    the rest is joined by a shuffle. big is read twice then, so it should be a stored table. written: small is stored already.
    """
    small = small if written else stored(small, "small-side")
    if small.count() <= WHOLE_ROWS:
        return big.join(F.broadcast(small), key)
    hot = hot_keys(big, key)
    few = small.join(F.broadcast(hot), key, "left_semi")
    usual = big.join(F.broadcast(hot), key, "left_anti").join(small, key)
    return usual.unionByName(big.join(F.broadcast(few), key))


#: Rows of ids (some 40 bytes each in a hash table) that are broadcast, at most.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, name: str) -> DataFrame:
    """df, stored and counted: marked for broadcast if it has BROADCAST_ROWS rows at most, else joined by a shuffle."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (nulls empty) as one array, and the offsets of the values in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def arrow_table(rows: list[tuple], ddl: str) -> pa.Table:
    """Rows as an Arrow table of the columns that ddl names."""
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
