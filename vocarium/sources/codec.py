"""The one-file binary form of a space: magic, header length, JSON header, row-major 32-bit floats."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import SparkSession

from ..operators.space import Space

#: Ours; a file may begin with any four capital letters and the version.
MAGIC, VERSION = b"VOCA0001", b"0001"


def dumps(words: list[str], vectors: np.ndarray, meta: dict, magic: bytes = MAGIC) -> bytes:
    head = json.dumps({"words": words, "dim": int(vectors.shape[1]) if len(words) else 0, "meta": meta}, ensure_ascii=False).encode()
    return magic + struct.pack("<I", len(head)) + head + np.asarray(vectors, "<f4").tobytes()


def loads(data: bytes) -> tuple[list[str], np.ndarray, dict]:
    if not data[:4].isalpha() or not data[:4].isupper() or data[4:8] != VERSION:
        raise ValueError("not a saved space")
    (n,) = struct.unpack_from("<I", data, len(MAGIC))
    at = len(MAGIC) + 4
    head = json.loads(data[at : at + n])
    words = head["words"]
    return words, np.frombuffer(data, "<f4", len(words) * head["dim"], at + n).reshape(len(words), -1).astype(float), head.get("meta", {})


def save(space: Space, path: str, magic: bytes = MAGIC) -> None:
    """Driver-side: a space is as large as its vocabulary. For any store use ``Space.write``."""
    words, vectors = space.matrix()
    with open(path, "wb") as f:
        f.write(dumps(words, vectors, space.meta, magic))


def load(spark: SparkSession, path: str) -> Space:
    """Read through Spark, so that the file can be in any store."""
    row = spark.read.format("binaryFile").load(path).first()
    words, vectors, meta = loads(bytes(row["content"]))
    return Space.of(spark, words, vectors, meta)
