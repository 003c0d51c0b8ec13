"""Token counts by heap-and-linked-list byte-pair merging; no ids are made.

A piece starts as one symbol a byte. A heap holds the adjacent pairs by merge rank and place; the
lowest is popped, its two list nodes become one, and the new neighbours' pairs are pushed. The count
is the initial symbols minus the merges. Every distinct piece is counted once a worker.

Null and empty texts count 0 bytes and 0 tokens. Repeated rows are counted each; extra columns are
not touched; an empty table gives no rows. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import fastbpe, shared

_counters: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts tokens of whole texts with the merges of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.reset()

    def reset(self) -> None:
        self.cache = fastbpe.PieceCache(self.fill)
        self.count = np.zeros(1 << 14, np.int64)

    def fill(self, new: list[str]) -> None:
        upto = self.cache.n
        while upto > len(self.count):
            self.count = np.concatenate((self.count, np.zeros_like(self.count)))
        self.count[upto - len(new) : upto] = [self.merged(p.encode().decode("latin-1").translate(fastbpe.BYTE_CHARS)) for p in new]

    def merged(self, chars: str) -> int:
        """Symbols left after all merges of one piece."""
        rank, n = self.rank, len(chars)
        sym: list[str | None] = list(chars)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((chars[i], chars[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j >= n or rank.get((sym[i], sym[j])) != r:
                continue  # one of its symbols has gone into another merge
            sym[i] += sym[j]
            sym[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (q, i))
            k = before[i]
            if k >= 0 and (q := rank.get((sym[k], sym[i]))) is not None:
                heapq.heappush(heap, (q, k))
        return left

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special token's string counts as one token."""
        if self.cache.n > fastbpe.CACHE_PIECES:
            self.reset()
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            held = [t]
            for s in self.special:
                if s in t:
                    held = [x for p in held for x in p.split(s)]
            extra[k] = len(held) - 1
            parts += held
            owner += [k] * len(held)
        small, starts, ends, first, unsure = fastbpe.pieces(parts)
        numbers = self.cache.numbers(small, starts, ends)
        sums = np.concatenate(([0], np.cumsum(self.count[numbers])))
        per = sums[first[1:]] - sums[first[:-1]]
        for k in np.flatnonzero(unsure):
            per[k] = sum(self.merged(p.encode().decode("latin-1").translate(fastbpe.BYTE_CHARS)) for p in unicode_pieces(parts[k]))
        return np.bincount(owner, weights=per, minlength=len(texts)).astype(np.int64) + extra


def unicode_pieces(text: str) -> list[str]:
    """The pieces of a text with rare characters, by the pattern itself."""
    import regex

    return regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text)


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text. Narrow: no shuffle."""
    shared.short_batches(df.sparkSession)
    slim = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = PieceCounter(tokenizer)
        counter = _counters[tokenizer]
        for b in batches:
            arr = shared.plain(b.column(1))
            sizes = np.diff(shared.raw(arr)[1])
            texts = arr.to_pylist()
            got = [counter.counts(texts[lo:hi]) for lo, hi in fastbpe.chunked(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(np.concatenate(got) if got else [], pa.int64())], ["id", "n_bytes", "n_tokens"])

    return slim.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
