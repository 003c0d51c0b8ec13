"""Concatenate-and-cut packing: all documents' ids as one stream, cut into fixed windows.

Pass one encodes each document once, in the order its task reads it, and writes the ids with the
document's offset inside its partition. Partition totals, one number a partition, are summed on the
driver to give each partition's global offset. Pass two cuts at multiples of the window; each piece
is a boundary record. Nothing is shuffled, and only the very last window can be short.

Null texts are empty; a document without ids still has its end id. Repeated rows are packed each.
An empty table gives no pieces. Clashing extra columns are left aside.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fastbpe, shared


def encoded(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, start, id, n, ids): a document's ids with the end id, and the ids of its partition before it."""
    shared.short_batches(df.sparkSession)
    slim = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = fastbpe.encoder(tokenizer)
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = shared.plain(b.column(1)).to_pylist()
            for lo, hi in fastbpe.chunked(texts):
                ids, per = coder.encode(texts[lo:hi])
                ids = np.insert(ids, np.cumsum(per), end_id)
                n = per + 1
                ends = np.cumsum(n)
                wide = ids.astype("<u4") if ids.max() >= 1 << 16 else ids.astype("<u2")
                offsets = np.concatenate(([0], ends)) * wide.itemsize
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(wide.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part), pa.int32()), pa.array(start + ends - n, pa.int64()), b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), blob.cast(pa.binary())],
                    ["part", "start", "id", "n", "ids"],
                )
                start += int(ends[-1])

    return slim.mapInArrow(run, f"part int, start long, id {kind}, n long, ids binary")


def pack(df: DataFrame, tokenizer: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Boundary records: (id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset), a row a piece.

    ``ids`` are the piece's ids as little-endian 32-bit integers; ``sequences`` joins them up.
    """
    table = shared.saved(encoded(df, tokenizer, end_id, id_col, text_col))
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, upto = {}, 0
    for p, n in totals:
        base[p] = upto
        upto += n
    kind = table.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, starts, n = (b.column(k).to_numpy() for k in (0, 1, 3))
            for lo in range(0, len(n), 256):
                out: list[tuple] = []
                rows = []
                for k in range(lo, min(lo + 256, len(n))):
                    raw = b.column(4)[k].as_buffer()
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[k] else "<u4").astype("<u4")
                    at = base[int(parts[k])] + int(starts[k])
                    done, size = 0, int(n[k])
                    while done < size:
                        seq, off = divmod(at + done, window)
                        take = min(size - done, window - off)
                        piece = ids[done : done + take].tobytes()
                        out.append((done, take, piece, zlib.crc32(piece), size, seq, off))
                        rows.append(k)
                        done += take
                cols = list(zip(*out, strict=True)) or [()] * 7
                arrays = [pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(rows, pa.int64())), *arrays], ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = table.mapInArrow(run, f"id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, pad_id: int = 0, window: int = 2048) -> DataFrame:
    """(sequence_id, ids array, n_ids) padded to the window; a last one whose length is a power of two stays as it is."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_ids"))
    hexed = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    ids = F.transform(F.sequence(F.lit(0), F.col("n_ids") - 1), lambda k: F.conv(F.concat(*[F.substring(hexed, (k * 8 + s).cast("int"), F.lit(2)) for s in (7, 5, 3, 1)]), 16, 10).cast("long"))
    power = F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0
    fill = F.when(power, F.lit(0)).otherwise(F.lit(window) - F.col("n_ids")).cast("int")
    return parts.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id).cast("long"), fill)).alias("ids"), "n_ids")
