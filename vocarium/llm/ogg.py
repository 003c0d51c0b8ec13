"""Media columns in Ogg: a payload as 8-bit samples in pages with checksums, and back.

Written are two logical streams, their pages in turn: ``PCM8`` (a header packet, then packets of samples;
granule position = samples so far) and ``META`` (a header packet, then one of key=value lines). Reading verifies
every page's checksum and sequence number, sorts pages by serial number, joins packets from the lacing
values across pages, and takes times from granule positions.

The payload of a text is its UTF-8 bytes with zeros up to a positive multiple of 64; null and empty
texts give 64 zeros. Equal texts give equal media. Repeated rows are kept; other columns stay out. A media
value that is null or can't be read has nulls for all that would be read from it, and says why in ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

PAGE = struct.Struct("<4sBBqIIIB")
SOUND, META = 0x50434D38, 0x4D455441
RATE, PACKET = 8000, 4000
CONTINUED, FIRST, LAST = 1, 2, 4
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04C11DB7, most significant bit first, from 0): zlib's over bit-reversed bytes."""
    x = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_TURNED), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """packets: (bytes, granule position at its end). The first packet has a page of its own."""
    out: list[bytes] = []
    lacing, body, granule, going = bytearray(), bytearray(), -1, False

    def flush(last: bool, cut: bool) -> None:
        nonlocal lacing, body, granule, going
        kind = (CONTINUED if going else 0) | (0 if out else FIRST) | (LAST if last else 0)
        out.append(_page(kind, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, going = bytearray(), bytearray(), -1, cut

    for k, (data, at) in enumerate(packets):
        segments = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        done = 0
        while segments:
            take = segments[: 255 - len(lacing)]
            segments = segments[len(take) :]
            size = min(len(data) - done, 255 * len(take)) if not segments else 255 * len(take)
            lacing += take
            body += data[done : done + size]
            done += size
            if not segments:
                granule = at
            if len(lacing) == 255 and (segments or k < len(packets) - 1):
                flush(False, bool(segments))
        if k == 0 and len(packets) > 1 and lacing:
            flush(False, False)
    if lacing or not out:
        flush(True, False)
    return out


def encode(payload: bytes, meta: dict[str, str]) -> bytes:
    sound = [(b"PCM8" + struct.pack("<IBQ", RATE, 1, len(payload)), 0)]
    sound += [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    notes = [(b"META", 0), ("\n".join(f"{k}={v}" for k, v in sorted(meta.items())).encode(), 0)]
    turns = zip_longest(pages(sound, SOUND), pages(notes, META), fillvalue=b"")
    return b"".join(page for turn in turns for page in turn)


class Damaged(ValueError):
    """A page or packet that is not as it was written."""


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(kind, granule, serial, number, lacing, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if len(data) - at < PAGE.size:
            raise Damaged("a page is cut off")
        mark, version, kind, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        if mark != b"OggS" or version:
            raise Damaged(f"no page at byte {at}")
        lacing = data[at + PAGE.size : at + PAGE.size + n]
        end = at + PAGE.size + n + sum(lacing)
        if end > len(data) or len(lacing) < n:
            raise Damaged("a page is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise Damaged(f"wrong checksum of page {number} of stream {serial:08x}")
        yield kind, granule, serial, number, lacing, data[at + PAGE.size + n : end]
        at = end


def demultiplex(data: bytes) -> dict[int, dict]:
    """serial: {"packets": [bytes], "granules": [end of packet where a page tells it, else None], "pages": n}"""
    streams: dict[int, dict] = {}
    for kind, granule, serial, number, lacing, body in read_pages(data):
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "rest": b"", "ended": False})
        if number != s["pages"] or s["ended"] or bool(kind & CONTINUED) != bool(s["rest"]) or bool(kind & FIRST) != (number == 0):
            raise Damaged(f"page {number} of stream {serial:08x} is out of order")
        s["pages"] += 1
        done, size, held = 0, 0, s["rest"]
        for x in lacing:
            size += x
            if x < 255:
                s["packets"].append(held + body[done : done + size])
                s["granules"].append(None)
                done, size, held = done + size, 0, b""
        s["rest"] = held + body[done:]
        if granule >= 0 and s["granules"]:
            s["granules"][-1] = granule
        s["ended"] = bool(kind & LAST)
    for serial, s in streams.items():
        if s["rest"] or not s["ended"]:
            raise Damaged(f"stream {serial:08x} does not end")
    return streams


def decode(data: bytes) -> tuple[bytes, dict]:
    """The payload, and what the container says: pages, packets, seconds, meta."""
    streams = demultiplex(data)
    sound, notes = streams[SOUND], streams[META]
    rate, channels, samples = struct.unpack("<IBQ", sound["packets"][0][4:])
    payload = b"".join(sound["packets"][1:])
    ends = [g for g in sound["granules"] if g is not None]
    if len(payload) != samples or ends[-1] != samples or ends != sorted(ends):
        raise Damaged("granule positions differ from the samples")
    meta = dict(x.split("=", 1) for x in notes["packets"][1].decode().split("\n") if x)
    return payload, {"pages": sound["pages"] + notes["pages"], "packets": len(sound["packets"]) + len(notes["packets"]), "times": [g / (rate * channels) for g in ends], "meta": meta}


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def feature(payload: bytes, info: dict) -> str:
    """What the read-back media shows: streams' sizes, duration, and level statistics of the samples."""
    x = np.frombuffer(payload, np.uint8)
    d = x.astype(np.int64) - 128
    return f"pages={info['pages']};packets={info['packets']};us={round(info['times'][-1] * 1e6)};peak={int(np.abs(d).max())};power={int((d * d).sum())};cross={int(((d[1:] < 0) != (d[:-1] < 0)).sum())}"


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the stored form of every whole text."""
    shared.short_batches(df.sparkSession)
    slim = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr = shared.plain(b.column(1))
            n = np.diff(shared.raw(arr)[1])
            media = [encode(payload_of(t), {"bytes": str(int(k))}) for t, k in zip(arr.to_pylist(), n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return slim.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the media column back: payload and media digests, the feature string, and what is wrong with a row."""
    slim = df.select(df[id_col].alias("id"), "media")
    kind = slim.schema["id"].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                try:
                    if data is None:
                        raise Damaged("no media")
                    payload, info = decode(data)
                    rows.append((int(info["meta"]["bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, feature(payload, info), None))
                except (Damaged, KeyError, IndexError, ValueError, struct.error) as e:
                    rows.append((None, None, None, None, *stored, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    out = slim.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
    return out.withColumnRenamed("id", id_col)
