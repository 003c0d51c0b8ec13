"""Benchmark decontamination by Wu-Manber search over words.

Every window of ``width`` consecutive words of a benchmark item is a pattern; a shorter item is one
pattern. For the patterns of one length, a shift table over blocks of two words says how far the
search may move on; where it says zero, the suffix block's bucket names the patterns, narrowed by
their first block, and a direct comparison of the words confirms each.

The benchmark comes in blocks of a bounded number of words, one at a time to the driver; each block's tables go to
every worker. With several blocks the documents are written once with a row number, and each block's hits are written.
Null and empty texts have no words. An empty benchmark hits nothing. Repeated items with one id count
once, a null item id as ''. Rows that repeat are judged each. Extra columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .wordhash import ALNUM_WORDS, mix, span_hashes, words

#: Benchmark words in one block; a larger benchmark is searched for in several passes. A block's tables take about 50
#: bytes a word and 2 ** TABLE_BITS bytes for each length of a pattern, in arrays: that bounds what is broadcast.
BLOCK_WORDS = 400_000
TABLE_BITS = 21


def item_words(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low, s, e, _ = words(raw, np.array([0, len(raw)]), ALNUM_WORDS)
    data = low.tobytes()
    return [data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def _hash_words(ws: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(ws), np.uint8)
    ends = np.cumsum([len(w) for w in ws])
    return span_hashes(buf, ends - np.array([len(w) for w in ws]), ends)


def block_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the two-word block that ends at each word; of the word alone at the first."""
    out = mix(h)
    out[1:] = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
    return out


class Pool:
    """Words of one block of the benchmark as arrays: bytes, places, hashes, and the item of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.names = sorted({item for item, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        every = [w for _, ws in items for w in ws]
        self.data = b"".join(every)
        self.end = np.cumsum([len(w) for w in every], dtype=np.int64)
        self.start = self.end - np.array([len(w) for w in every], np.int64)
        self.hash = _hash_words(every) if every else np.zeros(0, np.uint64)
        per = np.array([len(ws) for _, ws in items], np.int64)
        self.item = np.repeat(np.array([number[item] for item, _ in items], np.int32), per)
        self.first, self.per = np.cumsum(per) - per, per

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]]


class WuManber:
    """Tables for the patterns of one length, which begin at words ``at`` of the pool."""

    def __init__(self, length: int, pool: Pool, at: np.ndarray):
        self.m, self.pool = length, pool
        self.block = min(2, length)
        most = min(255, length - self.block + 1)
        self.shift = np.full(1 << TABLE_BITS, most, np.uint8)
        blocks = block_hashes(pool.hash) if self.block == 2 else mix(pool.hash)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, (blocks[at + j] >> np.uint64(64 - TABLE_BITS)).astype(np.int64), min(255, length - 1 - j))
        # buckets: patterns with one suffix block stand together
        order = np.argsort(blocks[at + length - 1], kind="stable")
        self.at = at[order]
        self.suffix, self.prefix = blocks[self.at + length - 1], blocks[self.at + self.block - 1]

    def search(self, shift: bytes, blocks: np.ndarray, word, n: int) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of each occurrence; word(k) gives the bytes of word k."""
        m, at, pool = self.m, self.m - 1, self.pool
        while at < n:
            step = shift[at]
            if step:
                at += step
                continue
            lo, hi = (int(np.searchsorted(self.suffix, blocks[at], side=side)) for side in ("left", "right"))
            if lo < hi:
                first = at - m + 1
                near = self.at[lo:hi][self.prefix[lo:hi] == blocks[first + self.block - 1]]
                items = {pool.names[pool.item[p]] for p in near.tolist() if all(word(first + k) == pool.word(p + k) for k in range(m))}
                if items:
                    yield first, items
            at += 1


def tables(items: list[tuple[str, list[bytes]]], width: int) -> list[WuManber]:
    pool = Pool(items)
    by_length: dict[int, list[np.ndarray]] = {}
    for first, n in zip(pool.first.tolist(), pool.per.tolist(), strict=True):
        if m := min(width, n):
            by_length.setdefault(m, []).append(np.arange(first, first + n - m + 1))
    return [WuManber(m, pool, np.concatenate(at)) for m, at in sorted(by_length.items())]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most BLOCK_WORDS words; a longer item comes in parts that overlap by a window less a word."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    for r in rows.toLocalIterator():
        ws = item_words(r["text"])
        step = max(1, BLOCK_WORDS - width + 1)
        for lo in range(0, max(1, len(ws) - width + 1), step):
            part = ws[lo : lo + step + width - 1]
            if held and size + len(part) > BLOCK_WORDS:
                yield held
                held, size = [], 0
            held.append((r["item"], part))
            size += len(part)
    yield held


def occurrences(docs: DataFrame, items: list[tuple[str, list[bytes]]], width: int, kind: str) -> DataFrame:
    """docs(rid, id, text) to (rid, id, n_words, spans, items); spans are word ranges, flat: start, end, start, ..."""
    found = docs.sparkSession.sparkContext.broadcast(tables(items, width))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = found.value
        for b in batches:
            arr = shared.plain(b.column(2))
            sizes, spans, hits = [], [], []
            for lo, hi, buf, offs in shared.chunks(arr):
                low, s, e, first = words(buf, offs, ALNUM_WORDS)
                h = span_hashes(low, s, e)
                pair, one = block_hashes(h), mix(h)
                data = low.tobytes()
                shifts = [(w, (pair if w.block == 2 else one), w.shift[((pair if w.block == 2 else one) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].tobytes()) for w in machines]
                for k in range(hi - lo):
                    a, z = int(first[k]), int(first[k + 1])
                    got, names = [], set()
                    for w, block, shift in shifts:
                        if z - a < w.m:
                            continue
                        for at, which in w.search(shift[a:z], block[a:z], lambda i, a=a: data[s[a + i] : e[a + i]], z - a):
                            got += (at, at + w.m)
                            names |= which
                    sizes.append(z - a)
                    spans.append(got)
                    hits.append(sorted(names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.string()))], ["rid", "id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, f"rid long, id {kind}, n_words long, spans array<long>, items array<string>")


def decontaminate(df: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) of every document."""
    shared.short_batches(df.sparkSession)
    docs = df.select(F.lit(0).cast("long").alias("rid"), df[id_col].alias("id"), df[text_col].alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    blocks = blocks_of(benchmark, item_col, item_text, width)
    block, ahead = next(blocks), next(blocks, None)
    if ahead is None:
        found = occurrences(docs, block, width, kind)
    else:  # rows get a number that stays, and what each block finds meets by it
        docs = shared.saved(docs.withColumn("rid", F.monotonically_increasing_id()))
        parts = []
        while block is not None:
            parts.append(shared.saved(occurrences(docs, block, width, kind).where("size(items) > 0" if parts else "true")))
            block, ahead = ahead, next(blocks, None)
        found = parts[0]
        for p in parts[1:]:
            found = found.unionAll(p)
        found = found.groupBy("rid").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit, n_items, sha = [], [], []
            for n, spans, items in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if spans:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, spans[::2], 1)
                    np.add.at(edge, spans[1::2], -1)
                    n_hit.append(int((np.cumsum(edge) > 0).sum()))
                else:
                    n_hit.append(0)
                n_items.append(len(items))
                sha.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), b.column(2), b.column(3)], ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])

    out = found.select("id", "n_words", "spans", "items").mapInArrow(digest, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<long>, items array<string>")
    return out.withColumnRenamed("id", id_col)


def clean(df: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text holds no window of any item. A filter for each block of the benchmark; no shuffle."""
    shared.short_batches(df.sparkSession)
    for items in blocks_of(benchmark, item_col, item_text, width):
        row = F.struct(*[df[f"`{c}`"] for c in df.columns])
        packed = df.select(F.lit(0).cast("long").alias("rid"), row.alias("id"), df[text_col].alias("text"))
        found = occurrences(packed, items, width, packed.schema["id"].dataType.simpleString())
        df = found.where(F.size("items") == 0).select("id.*")
    return df
