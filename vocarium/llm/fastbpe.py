"""Byte-level BPE at corpus speed, with the ids of the tokenizers library.

The library splits a text into pieces by a fixed pattern and merges inside each piece only. So a
text's ids are its pieces' ids in order. Here pieces are found by array operations over many texts
at once; the library encodes each *distinct* piece a worker meets, once; ids are then gathered.
Texts that hold a special token's string, or characters outside the tables, go to the library whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np

from .shared import ragged
from .wordhash import span_hashes

LETTER, NUMBER, SPACE, OTHER, EDGE, UNSURE = 0, 1, 2, 3, 4, 5
#: Pieces that one worker remembers before it starts anew; bounds its memory.
CACHE_PIECES = 700_000
_classes: np.ndarray | None = None
_encoders: dict[str | tuple[str, str], "BatchEncoder"] = {}


def byte_characters() -> dict[int, int]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: b for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = free
            free += 1
    return out


BYTE_CHARS = byte_characters()


def classes() -> np.ndarray:
    """Class of each character of the basic plane; UNSURE where Unicode versions may differ, and beyond."""
    global _classes
    if _classes is None:
        out = np.full(0x10002, UNSURE, np.uint8)
        old = unicodedata.ucd_3_2_0
        for cp in range(0x10000):
            c = chr(cp)
            now = unicodedata.category(c)
            if now != old.category(c) or now in ("Cn", "Cs", "Co"):
                continue
            out[cp] = LETTER if now[0] == "L" else NUMBER if now[0] == "N" else SPACE if now[0] == "Z" else OTHER
        out[[9, 10, 11, 12, 13, 0x85]] = SPACE
        out[[0x200B, 0x180E, 0xFEFF]] = UNSURE
        out[0x10000] = EDGE
        _classes = out
    return _classes


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters, piece starts, piece ends, each text's first piece (and the end), and which texts are unsure.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d, then letters, numbers or other characters with one
    space before them, then white space. Texts are laid out with an edge mark after each.
    """
    joined = "\U0010ffff".join(texts) + "\U0010ffff"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    small = np.minimum(cp, 0x10001)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.cumsum(lens + 1) - 1  # of the edge marks
    small[at] = 0x10000
    kind = classes()[small]
    n = len(kind)
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    solid = (kind == LETTER) | (kind == NUMBER) | (kind == OTHER)
    blank = kind == SPACE
    gap = small == 32
    # a run's last white space before a solid run: a plain space joins it, another one stands alone
    last = np.flatnonzero(blank[:-1] & solid[1:])
    begin[last] = True
    joins = last[gap[last]]
    begin[joins + 1] = False
    # contractions: an apostrophe that starts a piece, then letters
    for p in np.flatnonzero((small == 39) & begin):
        c = chr(small[p + 1]) if small[p + 1] < 128 else ""
        k = 1 if c and c in "stmd" else 2 if c and c in "rvl" and chr(min(small[p + 2], 0xFFFF)) == {"r": "e", "v": "e", "l": "l"}[c] else 0
        if k:
            begin[p + 1] = False
            if kind[p + 1 + k] == LETTER:
                begin[p + 1 + k] = True
    edge = kind == EDGE
    starts = np.flatnonzero(begin & ~edge)
    stop = begin.copy()
    stop |= edge
    bounds = np.flatnonzero(stop)
    ends = bounds[np.searchsorted(bounds, starts, side="right")]
    first = np.searchsorted(starts, np.concatenate((at - lens, [n])))
    unsure = np.zeros(len(texts), bool)
    odd = np.flatnonzero(kind == UNSURE)
    if len(odd):
        unsure[np.searchsorted(at, odd)] = True
    return small, starts, ends, first, unsure


def chunked(texts: list[str], limit: int = 400_000):
    """(first, after the last) of runs of texts with about ``limit`` characters."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, k
            lo, size = k, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


class PieceCache:
    """Numbers for distinct pieces; ``fill`` is called with the new ones, in the order of their numbers.

    A fixed table with three places for each 64-bit hash. A piece that finds none free takes
    another's, which then gets a new number when it comes again.
    """

    def __init__(self, fill: Callable[[list[str]], None], bits: int = 21):
        self.fill = fill
        self.mask = np.uint64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, np.uint64)
        self.value = np.zeros(1 << bits, np.int32)
        self.n = 0

    def places(self, h: np.ndarray):
        for shift in (0, 21, 42):
            yield ((h >> np.uint64(shift)) & self.mask).astype(np.int64)

    def taken(self, small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        """New pieces, as ``fill`` gets them."""
        return [small[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def numbers(self, small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = span_hashes(small, starts, ends)
        np.maximum(h, np.uint64(1), out=h)
        out = np.empty(len(h), np.int64)
        open_ = np.arange(len(h))
        for shift in (0, 21, 42):
            x = h[open_]
            at = ((x >> np.uint64(shift)) & self.mask).astype(np.int64)
            hit = self.key[at] == x
            out[open_[hit]] = self.value[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
        uniq, where, back = np.unique(h[open_], return_index=True, return_inverse=True)
        fresh = np.arange(self.n, self.n + len(uniq))
        self.n += len(uniq)
        out[open_] = fresh[back]
        where = open_[where]
        self.fill(self.taken(small, starts[where], ends[where]))
        left = np.arange(len(uniq))
        for k, at in enumerate(self.places(uniq)):
            free = left[self.key[at[left]] == 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.key[at[put]] = uniq[put]
            self.value[at[put]] = fresh[put]
            left = np.setdiff1d(left, put, assume_unique=True)
        at = (uniq[left] & self.mask).astype(np.int64)
        _, one = np.unique(at, return_index=True)
        self.key[at[one]] = uniq[left[one]]
        self.value[at[one]] = fresh[left[one]]
        return out


class BatchEncoder:
    """ids of many whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids of each.

    Distinct pieces are told apart by 64-bit hashes of their characters.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.cache_pieces = cache_pieces
        self.reset()

    def reset(self) -> None:
        self.cache = PieceCache(self.fill)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.len = np.zeros(1 << 14, np.int64)
        self.n = 0

    def fill(self, new: list[str]) -> None:
        """Merge new pieces with the library's model; it takes bytes as printable characters."""
        merge = self.lib.model.tokenize
        found = [[x.id for x in merge(p.encode().decode("latin-1").translate(BYTE_CHARS))] for p in new]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        total = int(lens.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(new) > len(self.len):
            self.len = np.concatenate((self.len, np.zeros_like(self.len)))
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        self.flat[self.used : self.used + total] = np.fromiter((x for f in found for x in f), np.uint32, total)
        self.len[self.n : self.n + len(new)] = lens
        self.start[self.n : self.n + len(new)] = self.used + np.cumsum(lens) - lens
        self.used += total
        self.n += len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text (uint32), and how many each text has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > self.cache_pieces:
            self.reset()
        small, starts, ends, first, unsure = pieces(texts)
        for k, t in enumerate(texts):
            if not unsure[k] and any(s in t for s in self.special):
                unsure[k] = True
        if unsure.any():
            whole = np.ones(len(starts), bool)
            for k in np.flatnonzero(unsure):
                whole[first[k] : first[k + 1]] = False
            kept = np.concatenate(([0], np.cumsum(whole)))
            starts, ends, first = starts[whole], ends[whole], kept[first]
        numbers = self.cache.numbers(small, starts, ends)
        lens = self.len[numbers]
        ids = self.flat[ragged(self.start[numbers], lens)]
        sums = np.concatenate(([0], np.cumsum(lens)))
        per = sums[first[1:]] - sums[first[:-1]]
        if unsure.any():
            parts = np.split(ids, np.cumsum(per)[:-1])
            for k in np.flatnonzero(unsure):
                parts[k] = np.asarray(self.lib.encode(texts[k], add_special_tokens=False).ids, np.uint32)
                per[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, per


class PieceBytes(PieceCache):
    """Gives new pieces as the UTF-8 bytes of all of them and the length of each."""

    def taken(self, small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = small[ragged(starts, ends - starts)].astype(np.uint32)
        size = 1 + (chars >= 0x80) + (chars >= 0x800)
        upto = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(ends - starts)))]
        return np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8), np.diff(upto)


class MergingEncoder(BatchEncoder):
    """The same ids, with new pieces of at most LONGEST bytes merged by array operations, many pieces at once.

    As in the library, a piece's pair of lowest rank goes first, the leftmost of equal ones. Longer pieces go to the library.
    """

    LONGEST, NEVER = (10, 16, 30), np.int32(1 << 30)

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.byte_id = np.array([vocab[chr(BYTE_CHARS[b])] for b in range(256)], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], np.int64)
        self.size = max(vocab.values()) + 2  # the id that ends a piece is in no pair
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        # a table of pairs; one whose place is taken goes to the next
        self.mask = (1 << 18) - 1
        self.pair, self.rank = np.full(self.mask + 1, -1), np.full(self.mask + 1, len(pairs))
        todo, at = np.arange(len(key)), self.place(key)
        while len(todo):
            free = np.flatnonzero(self.pair[at[todo]] < 0)
            free = free[np.unique(at[todo[free]], return_index=True)[1]]
            put = todo[free]
            self.pair[at[put]], self.rank[at[put]] = key[put], put
            todo = np.delete(todo, free)
            at[todo] = (at[todo] + 1) & self.mask
        super().__init__(path, cache_pieces)

    def reset(self) -> None:
        super().reset()
        self.cache = PieceBytes(self.fill)

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B1 >> 15) & self.mask

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; one more than the last rank where there is none."""
        key = a * self.size + b
        at = self.place(key)
        found = self.pair.take(at)
        out = self.rank.take(at)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        out[found < 0] = len(self.made) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.pair[at[open_]]
            out[open_] = np.where(found == key[open_], self.rank[at[open_]], len(self.made) - 1)
            open_ = open_[(found != key[open_]) & (found >= 0)]
        return out

    def merged(self, data: np.ndarray, start: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces data[start : start + len], one after the other, and their numbers."""
        n, none, w = len(lens), len(self.made) - 1, width + 1
        inside = np.arange(w) < lens[:, None]
        sym = np.full((n, w), self.size - 1)
        sym[inside] = self.byte_id[data[ragged(start, lens)]]
        key = np.full((n, w), self.NEVER, np.int32)
        rank = self.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width)
        key[:, :-1] = np.where(rank < none, rank * w + np.arange(width), self.NEVER)
        sym, flat, gone = sym.ravel(), key.ravel(), ~inside.ravel()
        after, before = np.arange(1, n * w + 1), np.arange(-1, n * w - 1)
        rows = np.arange(n)
        while len(rows):
            low = key[rows].min(1)
            rows, low = rows[low < self.NEVER], low[low < self.NEVER]
            base = rows * w
            i = base + low % w
            j = after[i]
            k = after[j]
            sym[i] = self.made[low // w]
            gone[j] = True
            flat[j] = self.NEVER
            after[i] = k
            before[k] = i
            r = self.ranks(sym[i], sym[k])
            flat[i] = np.where(r < none, r * w + (i - base), self.NEVER)
            ok = i > base
            i, base = i[ok], base[ok]
            h = before[i]
            r = self.ranks(sym[h], sym[i])
            flat[h] = np.where(r < none, r * w + (h - base), self.NEVER)
        return sym[~gone], np.count_nonzero(~gone.reshape(n, w), axis=1)

    def fill(self, new: tuple[np.ndarray, np.ndarray]) -> None:
        data, lens = new
        start = np.cumsum(lens) - lens
        order, ids, per, least = [], [], [], 0
        for width in self.LONGEST:
            mine = np.flatnonzero((lens > least) & (lens <= width))
            least = width
            if len(mine):
                got, n = self.merged(data, start[mine], lens[mine], width)
                order.append(mine)
                ids.append(got)
                per.append(n)
        for k in np.flatnonzero(lens > least):
            got = [x.id for x in self.lib.model.tokenize(data[start[k] : start[k] + lens[k]].tobytes().decode("latin-1").translate(BYTE_CHARS))]
            order.append(np.array([k]))
            ids.append(np.array(got))
            per.append(np.array([len(got)]))
        order, ids, per = np.concatenate(order), np.concatenate(ids), np.concatenate(per)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(lens) > len(self.len):
            self.len = np.concatenate((self.len, np.zeros_like(self.len)))
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.len[self.n + order] = per
        self.start[self.n + order] = self.used + np.cumsum(per) - per
        self.used += len(ids)
        self.n += len(lens)


def merging_encoder(path: str) -> MergingEncoder:
    """As ``encoder``, for new pieces in great number."""
    if ("merging", path) not in _encoders:
        _encoders["merging", path] = MergingEncoder(path)
    return _encoders["merging", path]


def encoder(path: str) -> BatchEncoder:
    """The worker's encoder of a vocabulary file; it stays for the worker's next tasks."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]
