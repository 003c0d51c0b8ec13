"""Token ids on disk: each document a zstandard frame of its own, one shared dictionary, an offset index.

A shard is ``header | frames | index``. Header: magic ``VTOK``, version, id width, document count, the
SHA-256 of the dictionary, the index's place. Index: document id, whether it is null, frame end, ids in it. One short
document is read by one index entry and one frame; a wrong dictionary is told by its hash.

Documents are dealt into ranges of ascending id. Shards are rows of a Parquet table in the shared
folder, so any store that Spark writes holds them and a lost task leaves none behind. Document order
is (id, number of ids, frame); null ids come first and stay null. Null texts are empty and get the end id alone. Repeated rows
are all kept. An empty table makes a dictionary of no bytes and no shard.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fastbpe, shared

MAGIC = b"VTOK"
HEADER = struct.Struct("<4sHHI32sQ")
#: The dictionary is trained on whole documents, at most so many, those with the lowest hashes of their id; documents with
#: more bytes of ids are not among them. It decides how well frames compress and nothing else.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 600, 1 << 17, 65_536
SHARD_DOCS, SHARD_BYTES = 2048, 4 << 20
#: Ranges of document ids; each is one sorted run. Their bounds and token totals are all the driver holds.
MOST_RANGES, RANGE_DOCS = 20_000, 8192


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; of too few samples, their bytes themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


#: An index entry.
ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("end", "<u8"), ("n", "<u8")])


def write_shard(docs: list[tuple[int | None, int, bytes]], width: int, dict_hash: bytes) -> bytes:
    """docs: (id, number of ids, frame), in order."""
    frames = b"".join(f for _, _, f in docs)
    index = np.zeros(len(docs), ENTRY)
    index["id"] = [d or 0 for d, _, _ in docs]
    index["null"] = [d is None for d, _, _ in docs]
    index["end"] = np.cumsum([len(f) for _, _, f in docs])
    index["n"] = [n for _, n, _ in docs]
    return HEADER.pack(MAGIC, 2, width, len(docs), dict_hash, HEADER.size + len(frames)) + frames + index.tobytes()


class Shard:
    """Reads a shard; ``ids(k)`` decompresses document k alone."""

    def __init__(self, blob: bytes, dictionary: bytes):
        import zstandard

        magic, version, self.width, n, digest, at = HEADER.unpack_from(blob)
        if magic != MAGIC or version != 2:
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.blob = blob
        self.index = np.frombuffer(blob, ENTRY, n, at)
        self.reader = zstandard.ZstdDecompressor(dict_data=_dict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        lo = HEADER.size + (int(self.index["end"][k - 1]) if k else 0)
        n = int(self.index["n"][k])
        out = np.frombuffer(self.reader.decompress(self.blob[lo : HEADER.size + int(self.index["end"][k])], max_output_size=n * self.width), f"<u{self.width}")
        if len(out) != n:
            raise ValueError("a document's length differs from its index entry")
        return out


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode and write all documents in ascending id order; returns what a reader needs.

    {"path", "dictionary", "base": {range: ids in all ranges before it}}
    """
    spark = df.sparkSession
    shared.short_batches(spark)
    width = 2 if max(fastbpe.encoder(tokenizer).lib.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    slim = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    picked = slim.select("id").where("id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).distinct()
    # ids of the sampled documents: at most SAMPLE_DOCS rows to broadcast

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = fastbpe.encoder(tokenizer)
        for b in batches:
            texts = shared.plain(b.column(1)).to_pylist()
            out = [serialize(np.append(coder.encode([t])[0], end_id), width) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x if len(x) <= SAMPLE_BYTES else b"" for x in out], pa.binary())], ["id", "ids"])

    got = slim.join(F.broadcast(picked), "id", "left_semi").mapInArrow(sample, "id long, ids binary").where("length(ids) > 0").orderBy("id", "ids").limit(SAMPLE_DOCS).collect()
    dictionary = train_dictionary([bytes(r["ids"]) for r in got])
    digest = hashlib.sha256(dictionary).digest()

    rows = slim.count()
    ranges = int(min(MOST_RANGES, max(1, rows // RANGE_DOCS)))
    cuts = [k / ranges for k in range(1, ranges)]
    bounds = np.array((slim.agg(F.percentile_approx("id", cuts, max(10_000, 10 * ranges)).alias("q")).first()["q"] if cuts else None) or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = fastbpe.encoder(tokenizer)
        press = zstandard.ZstdCompressor(level=3, dict_data=_dict(dictionary), write_checksum=True)
        for b in batches:
            texts = shared.plain(b.column(1)).to_pylist()
            for lo, hi in fastbpe.chunked(texts):
                ids, per = coder.encode(texts[lo:hi])
                flat = np.insert(ids, np.cumsum(per), end_id)
                data = memoryview(serialize(flat, width))
                ends = np.cumsum(per + 1) * width
                frames = [press.compress(data[a:z]) for a, z in zip(ends - (per + 1) * width, ends, strict=True)]
                keys = b.column(0).slice(lo, hi - lo)
                where = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), keys, pa.array(per + 1, pa.int64()), pa.array(frames, pa.binary())], ["range", "id", "n", "frame"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, seq, docs, size = None, 0, 0, [], 0

        def shard():
            n = sum(d[1] for d in docs)
            cols = {"range": pa.array([now], pa.int32()), "seq": pa.array([seq], pa.int64()), "before": pa.array([before], pa.int64()), "n": pa.array([n], pa.int64()), "shard": pa.array([write_shard(docs, width, digest)], pa.binary())}
            return n, pa.RecordBatch.from_pydict(cols)

        for b in batches:
            for r, d, n, f in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if docs and (r != now or len(docs) >= SHARD_DOCS or size >= SHARD_BYTES):
                    n_ids, row = shard()
                    yield row
                    before, seq, docs, size = before + n_ids, seq + 1, [], 0
                if r != now:
                    now, before, seq = r, 0, 0
                docs.append((d, n, f))
                size += len(f)
        if docs:
            yield shard()[1]

    frames = slim.mapInArrow(encode, "range int, id long, n long, frame binary")
    dealt = frames.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "id", "n", "frame")
    dealt.mapInArrow(assemble, "range int, seq long, before long, n long, shard binary").write.mode("overwrite").option("compression", "none").parquet(path)
    base, upto = {}, 0
    for r in spark.read.parquet(path).groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():
        base[r["range"]] = upto
        upto += r["n"]
    return {"path": path, "dictionary": dictionary, "base": base}


def read_tokens(spark, written: dict) -> DataFrame:
    """(id, start, n_tokens, ids, ids_crc32) of every document, from the files."""
    dictionary, base = written["dictionary"], written["base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, before, blob in zip(*(b.column(k) for k in range(3)), strict=True):
                s = Shard(blob.as_py(), dictionary)
                n = s.index["n"].astype(np.int64)
                start = base[r.as_py()] + before.as_py() + np.cumsum(n) - n
                ids = [s.ids(k).astype("<u4").tobytes() for k in range(len(n))]
                crc = [zlib.crc32(x) for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(s.index["id"].astype(np.int64), mask=s.index["null"] > 0), pa.array(start, pa.int64()), pa.array(n), pa.array(ids, pa.binary()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids", "ids_crc32"])

    return spark.read.parquet(written["path"]).select("range", "before", "shard").mapInArrow(run, "id long, start long, n_tokens long, ids binary, ids_crc32 long")
