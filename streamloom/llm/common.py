"""Helpers shared by the training-data operators: table access, scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy kernel works on at a time; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one only in one process without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "streamloom-scratch")
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _leave(spark: SparkSession, root: str) -> None:
    """At the end of the process, if its session still runs; a session stopped before leaves its tables to the folder's owner."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, root)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: lineage ends there, so a lost executor costs one stage.

    Results read some of these tables, so they stay until the process ends; ``drop`` and ``keep`` remove what nothing reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.paths = 0, set()
        atexit.register(_leave, spark, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Removes saved tables that nothing reads any more."""
        for df in dfs:
            self.paths.discard(df._scratch_path)
            _delete(self.spark, df._scratch_path)

    def keep(self, *dfs: DataFrame) -> None:
        """Removes all saved tables but these."""
        for path in self.paths - {df._scratch_path for df in dfs}:
            self.paths.discard(path)
            _delete(self.spark, path)


def apart(key) -> F.Column:
    """The same number as an expression that the planner does not see through.

    A join on it shuffles both sides itself, instead of building on the shuffle of an aggregate below, so that adaptive
    execution may split a key with very many rows over tasks.
    """
    return F.col(key).bitwiseXOR(F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of ``column`` (one row may hold more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


#: Rows and bytes of an Arrow batch between the JVM and Python, at most: texts may be long, so the usual row count alone
#: bounds no memory.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def release_memory() -> None:
    """Gives freed memory back to the system, so that waiting Python workers stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in rows and bytes and workers that hand back memory after each task.

    Spark reads these bounds from the session when the plan runs, so they are lowered there, for other plans too; lower
    bounds that are set already stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch("[0-9]+", str(conf.get(key, None)).strip())
        if not now or not 0 < int(now[0]) <= most:
            conf.set(key, str(most))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(tidy, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def byte_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and each row's offsets in them (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def held_out(doc_id) -> F.Column:
    """True for the fold that no training touches: crc32 of the id's decimal text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def plus(schema: StructType, **columns) -> StructType:
    """A copy of ``schema`` with more columns (``add`` would change the frame's own)."""
    out = StructType(list(schema.fields))
    for name, kind in columns.items():
        out.add(name, kind)
    return out


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem
