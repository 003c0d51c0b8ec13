"""What the operators share: the cluster's shared folder, Arrow text access, global sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; documents can be long, so batches are short.
BATCH_ROWS = 1024
#: Bytes of text that the vectorised kernels take at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that the cluster shares, ``spark.checkpoint.dir``.

    Where the setting is absent, a local master (tests, a single machine) gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            base = jdir.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="vocarium-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/vocarium-{uuid.uuid4().hex}"


def short_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of one Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: lineage is cut, a lost executor costs nothing."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of UTF-8 strings without nulls (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_large_string(arr.type) is False and pa.types.is_string(arr.type) is False:
        arr = arr.cast(pa.string())
    return pc.fill_null(arr, "") if arr.null_count else arr


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes below a string array and its n + 1 offsets into them, without copying text."""
    wide = pa.types.is_large_string(arr.type)
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of whole texts up to ``limit`` bytes."""
    if not len(arr):
        return
    buf, offs = raw(arr)
    lo, n = 0, len(arr)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, length), one run after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def bucket_totals(parts: DataFrame, bits: int, levels: int = 16) -> np.ndarray:
    """Add up per-task histograms of ``2 ** bits`` counters.

    ``parts`` has rows (chunk int, counts binary) of 2 ** 14 little-endian int64 counters, as
    ``histogram_rows`` makes them. Two rounds of streaming sums: memory in a task is a few
    chunks whatever the number of rows. The driver receives the fixed-size total.
    """
    schema = "chunk int, counts binary"

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
                v = np.frombuffer(x.as_buffer(), np.int64)
                if c in held:
                    held[c] += v
                else:
                    held[c] = v.copy()
        for c, v in held.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": [v.tobytes()]})

    n = max(1, 1 << bits >> 14)
    once = parts.withColumn("salt", F.spark_partition_id() % levels).repartition(n, "chunk", "salt").select("chunk", "counts").mapInArrow(add, schema)
    rows = once.repartition(n, "chunk").mapInArrow(add, schema).collect()
    total = np.zeros(1 << bits, np.int64)
    for r in rows:
        size = min(1 << 14, 1 << bits)
        total[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    return total


def histogram_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's histogram as rows for ``bucket_totals``; chunks of zeros are left out."""
    size = min(1 << 14, len(counts))
    for c in range(len(counts) // size):
        part = counts[c * size : (c + 1) * size]
        if part.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": [part.astype(np.int64).tobytes()]})
