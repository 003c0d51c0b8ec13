"""Documents as arrays: one row a document from text to counts, so that no token is a row to shuffle or sort."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import counts, vocab

#: Up to so many words a task adds pairs up in a table of half their square; beyond, in sorted runs.
TABLE_WORDS = 4096
#: Tokens whose pairs are made at once.
RUN = 1 << 18


def rows(lists: DataFrame) -> DataFrame:
    """(doc_ord, pos, token) of lists(doc_ord, t)."""
    return lists.select("doc_ord", F.posexplode("t").alias("pos", "token"))


def build_vocab(lists: DataFrame, max_size: int = 4000, min_count: int = 5) -> DataFrame:
    """As ``vocab.build_vocab``; each task counts a batch's tokens before they become rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = pc.value_counts(b.column(0).flatten())
            if len(c):
                yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], ["word", "n"])

    counted = lists.select("t").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return vocab.commonest(counted, max_size, min_count)


def encode(lists: DataFrame, voc: DataFrame) -> DataFrame:
    """(doc_ord, ids): tokens outside the vocabulary go, gaps close, documents without any go."""
    pairs = voc.select("word", "id").toArrow()  # bounded by the vocabulary's limit
    words, ids = pairs["word"].combine_chunks(), pairs["id"].to_numpy().astype(np.int32)
    field = next(f for f in lists.schema if f.name == "doc_ord").dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1)
            at = pc.fill_null(pc.index_in(t.flatten().cast(words.type), value_set=words), -1).to_numpy()
            ends = np.cumsum(np.concatenate(([0], pc.fill_null(pc.list_value_length(t), 0).to_numpy())))
            known = at >= 0
            kept = np.concatenate(([0], np.cumsum(known)))[ends]
            flat = ids[at[known]] if len(ids) else np.zeros(0, np.int32)
            got = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(flat))
            full = pa.array(np.diff(kept) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(full), got.filter(full)], ["doc_ord", "ids"])

    return lists.select("doc_ord", "t").mapInArrow(run, f"doc_ord {field}, ids array<int>")


def placed(ids: DataFrame, *columns) -> DataFrame:
    """(doc_ord, before, ...) of ids(doc_ord, ids): tokens in all documents before this one.

    A row a document, in blocks of documents. Documents of one number follow each other in no set order.
    """
    return offsets(ids.select("doc_ord", F.size("ids").cast("long").alias("n"), *columns))


def offsets(per: DataFrame) -> DataFrame:
    """per(doc_ord, n, ...) with ``before``, the sum of n in all rows before; rows without a number come last."""
    per = per.withColumn("block", F.floor(F.col("doc_ord") / vocab.DOC_BLOCK))
    base = per.groupBy("block").agg(F.sum("n").alias("t"))
    base = base.select(F.col("block").alias("b"), F.coalesce(F.sum("t").over(Window.orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)
    out = per.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(base, F.col("block").eqNullSafe(F.col("b")))
    return out.withColumn("before", F.col("base") + F.col("inner")).drop("block", "b", "base", "inner")


def positions(ids: DataFrame) -> DataFrame:
    """(gpos, doc_ord, id) of all tokens. Only rows without the ids are put in order."""
    return placed(ids, "ids").select("before", "doc_ord", F.posexplode("ids").alias("dpos", "id")).select((F.col("before") + F.col("dpos")).alias("gpos"), "doc_ord", "id")


def _edges(ids: DataFrame, window: int) -> DataFrame:
    """(gpos, doc_ord, id) of each document's first and last tokens; doc_ord is the place of its first."""
    ends = F.when(F.size("ids") <= 2 * window, F.col("ids")).otherwise(F.concat(F.slice("ids", 1, window), F.slice("ids", -window, window)))
    e = placed(ids, ends.alias("e")).select("before", "n", F.posexplode("e").alias("k", "id"))
    skipped = F.when(F.col("k") >= window, F.greatest(F.col("n") - 2 * window, F.lit(0))).otherwise(F.lit(0))
    return e.select((F.col("before") + F.col("k") + skipped).alias("gpos"), F.col("before").alias("doc_ord"), "id")


def cooccurrence(ids: DataFrame, size: int, window: int = 4, harmonic: bool = True, min_weight: float = 0.0, per_document: bool = False) -> DataFrame:
    """As ``counts.cooccurrence``, from ids(doc_ord, ids) below ``size``.

    A task adds up the pairs inside its documents by itself, and sends each cell once; only the first and last tokens
    of documents are rows, for the pairs that cross from one document to another.
    """
    unit = counts.unit_weight(window)
    table = size <= TABLE_WORDS

    def pairs(flat: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        for d in range(1, window + 1):
            same = doc[d:] == doc[:-d]
            x, y = flat[d:][same].astype(np.int64), flat[:-d][same].astype(np.int64)
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            yield (hi * (hi + 1) // 2 + lo), unit // d if harmonic else unit

    def sent(keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 1 << 16):
            key, wl = keys[k : k + (1 << 16)], sums[k : k + (1 << 16)]
            hi = ((np.sqrt(8.0 * key + 1) - 1) / 2).astype(np.int64)
            hi -= hi * (hi + 1) // 2 > key
            hi += (hi + 1) * (hi + 2) // 2 <= key
            yield pa.RecordBatch.from_arrays([pa.array((key - hi * (hi + 1) // 2).astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(wl)], ["a", "b", "wl"])

    def summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, wl = np.concatenate(keys), np.concatenate(sums)
        order = np.argsort(key, kind="stable")
        key, wl = key[order], wl[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[starts], np.add.reduceat(wl, starts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (size + 1) // 2, np.int64) if table else None
        keys, sums, held = [], [], 0
        for b in batches:
            every = b.column(0).flatten().to_numpy()
            which = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(0)).to_numpy())
            for lo in range(0, len(every), RUN):
                # the run before gives its last tokens again, as left sides only
                back = min(lo, window)
                flat, doc = every[lo - back : lo + RUN], which[lo - back : lo + RUN]
                for d, (key, weight) in enumerate(pairs(flat, doc), 1):
                    if back > d:  # pairs whose right side the run before had
                        key = key[np.count_nonzero(doc[d:back] == doc[: back - d]) :]
                    if table:
                        np.add.at(total, key, weight)
                    elif len(key):
                        keys.append(key)
                        sums.append(np.full(len(key), weight, np.int64))
                        held += len(key)
                if held > 1 << 23:
                    key, wl = summed(keys, sums)
                    keys, sums, held = [key], [wl], len(key)
                    if held > 1 << 22:
                        yield from sent(key, wl)
                        keys, sums, held = [], [], 0
        if table:
            full = np.flatnonzero(total)
            yield from sent(full, total[full])
        elif held:
            yield from sent(*summed(keys, sums))

    sums = ids.select("ids").mapInArrow(run, "a int, b int, wl long")
    if not per_document:
        sums = sums.unionByName(counts.unordered(_edges(ids, window), window, harmonic, across=True).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "wl"))
    return counts.mirrored(sums.groupBy("a", "b").agg(F.sum("wl").alias("wl")), unit, min_weight)
