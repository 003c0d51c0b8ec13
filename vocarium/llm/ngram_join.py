"""N-gram Jaccard join: sets of word n-grams in one global order, compared through a prefix tree.

1. Every document becomes a set of 64-bit n-gram hashes. Documents with equal sets are one class; its
   key is a 64-bit sum over the set, and a second sum tells whether two sets ever share a key, which
   is an error. Each class has a signature: the parities of its n-grams over some hundred buckets.
2. The global order is rare first: a fixed-size histogram over all documents gives every n-gram a
   frequency class, and ties follow the hash. Any order gives the same links; this one keeps shared
   passages out of the prefixes.
3. Two sets within the threshold share an n-gram among their first ``size - ceil(t * size) + 1``. Only
   these prefixes are shuffled, by n-gram, and n-grams of one class alone go no further.
4. Where classes meet, two of them are candidates if their signatures don't rule the threshold out:
   buckets that differ in parity are at most as many as n-grams that only one set has. Candidates are
   joined in place, so a group yields at most one row a member, and no pairs.
5. Joined candidates are a group. Its sets go out in tiles of a bounded size; a tile is one
   ``PrefixTree`` that its sets traverse together. That gives every link, counted and joined in place:
   a row a member and tile. All links lie in a group, so none is lost.

Very common n-grams are dealt by a salt that follows the histogram, and in blocks of BLOCK classes.
Blocks of one n-gram that are not joined through others meet in a second round, tile by tile,
without pairs of which both are joined already. The number of links in a group, and so the work in
5, can grow with its square; rows don't.

Null and empty texts have empty sets and link with nothing. A null id gets its set size and no
component, and isn't counted. Rows that repeat an id with equal sets count once for their component
and once each as links; with other sets they count as documents of their own. Extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import shared
from .components import components
from .prefix_tree import PrefixTree
from .wordhash import mix, shingles, word_hashes

#: Counters of the frequency histogram, in chunks, and bits of the filter of wanted ids: fixed sizes, sent to every worker.
SKETCH_BITS, CHUNK_BITS, FILTER_BITS = 22, 16, 24
#: Signatures have from 256 to 8192 bits.
SIGN_BITS = 8, 13
#: Classes of one n-gram that meet at once, and rows of it (as the histogram has them) that get one salt.
BLOCK, SALT_ROWS = 4096, 1 << 16
#: N-grams, and sets, that one side of a tile holds.
TILE_NGRAMS, TILE_SETS = 1 << 20, 2048
#: Classes that a task joins in place before it writes them out.
JOINED = 1 << 19


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def sets_of(arr: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct n-gram hashes) of every whole text."""
    for lo, hi, buf, offs in shared.chunks(arr):
        h, first = word_hashes(buf, offs)
        long_ = shingles(h, n) if len(h) >= n else h[:0]
        for k in range(hi - lo):
            a, z = int(first[k]), int(first[k + 1])
            yield lo + k, np.unique(long_[a : z - n + 1]) if z - a >= n else shingles(h[a:z], n)


def _key(s: np.ndarray) -> int:
    return int(mix(s).sum().view(np.int64))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


# -- signatures


def signature(s: np.ndarray) -> np.ndarray:
    """Bytes of parity bits: how many of the set's n-grams fall into each bucket, odd or even."""
    bits = min(max((len(s) // 2).bit_length(), SIGN_BITS[0]), SIGN_BITS[1])
    at = mix(s ^ np.uint64(0x5C5C36365C5C3636)) & np.uint64((1 << bits) - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1)


def differing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Buckets that differ, of rows of signatures with bytes of a power of two; the longer ones are folded."""
    n = min(one.shape[-1], two.shape[-1])
    fold = lambda x: np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, n), axis=-2)
    return np.bitwise_count(np.ascontiguousarray(fold(one) ^ fold(two)).view(np.uint64)).sum(-1, dtype=np.int64)


def possible(differ, a, b, percent: int):
    """Whether sets of sizes a and b of which at least ``differ`` n-grams are in one alone can link."""
    return np.maximum(differ, np.abs(a - b)) * (100 + percent) <= (100 - percent) * (a + b)


class Joined:
    """Classes joined in place; ``rows`` gives each class of two or more with its smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            x, up[x] = up.get(x, x), root
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def rows(self) -> Iterator[pa.RecordBatch]:
        pairs = [(x, self.find(x)) for x in list(self.up)]
        self.up = {}
        for lo in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs[lo : lo + 50_000], strict=True)], ["a", "b"])


# -- documents, classes, order


def digests(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, d1, d2, sign) a document, and each task's histogram in rows (chunk, counts)."""
    names = ["id", "n_shingles", "d1", "d2", "sign", "chunk", "counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for b in batches:
            arr = shared.plain(b.column(1))
            size, signs = np.zeros(len(arr), np.int64), [None] * len(arr)
            d1, d2 = np.zeros(len(arr), np.int64), np.zeros(len(arr), np.int64)
            held, held_n = [], 0
            for k, s in sets_of(arr, n):
                size[k] = len(s)
                if len(s):
                    d1[k], d2[k], signs[k] = _key(s), _key(s ^ np.uint64(0xA5A5A5A5DEADBEEF)), signature(s).tobytes()
                    held.append(_bucket(s))
                    held_n += len(s)
                if held and (held_n > 1 << 20 or k == len(arr) - 1):
                    np.add.at(counts, np.concatenate(held), 1)
                    held, held_n = [], 0
            none = pa.nulls(len(arr))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(d1), pa.array(d2), pa.array(signs, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        none = pa.nulls(1, pa.int64())
        for c, part in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(1, pa.binary()), pa.array([c], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], names)

    return docs.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, sign binary, chunk int, counts binary")


def frequency_classes(parts: DataFrame, levels: int = 16) -> np.ndarray:
    """A byte for every counter of the histogram, about 4 * log2 of its total; the totals are added up on executors."""

    def total(batches: Iterable[pa.RecordBatch], width) -> dict[int, np.ndarray]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
                v = np.frombuffer(pa.decompress(x.as_buffer(), (1 << CHUNK_BITS) * width().itemsize, "zstd"), width)
                held[c] = held[c] + v if c in held else v.astype(np.int64)
        return held

    def row(c: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": pa.array([data], pa.binary())})

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, v in total(batches, np.int32).items():
            yield row(c, pa.compress(v.tobytes(), "zstd", asbytes=True))

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, v in total(batches, np.int64).items():
            yield row(c, np.minimum(255, 4 * np.log2(v + 1.0)).astype(np.uint8).tobytes())

    chunks = 1 << SKETCH_BITS - CHUNK_BITS
    once = parts.withColumn("salt", F.spark_partition_id() % levels).repartition(chunks, "chunk", "salt").select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros((chunks, 1 << CHUNK_BITS), np.uint8)
    for r in once.repartition(chunks, "chunk").mapInArrow(tell, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def salts(classes: np.ndarray) -> np.ndarray:
    """How many salts n-grams of each frequency class get; 0: none. What a counter holds on average counts as noise."""
    load = (2.0 ** (classes / 4.0) - 1).mean() if len(classes) else 0.0
    rows = np.maximum(0, 2.0 ** (np.arange(256) / 4.0) - 1 - 2 * load)
    return np.where(rows > SALT_ROWS, -(-rows // SALT_ROWS), 0).astype(np.int64)


def prefixes(docs: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(token, salt, node) of the prefixes of classes; copies that one task reads count once. salt -1: none."""
    sent, times = docs.sparkSession.sparkContext.broadcast(classes), salts(classes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, done = sent.value, set()
        for b in batches:
            tokens, nodes, lens, held = [], [], [], 0
            for k, s in sets_of(shared.plain(b.column(1)), n):
                node = _key(s) if len(s) else 0
                if len(s) and node not in done:
                    done.add(node)
                    tokens.append(s[np.argsort(order[_bucket(s)], kind="stable")[: prefix_length(len(s), percent)]])
                    nodes.append(node)
                    lens.append(len(tokens[-1]))
                    held += lens[-1]
                if tokens and (held > 1 << 18 or k == b.num_rows - 1):
                    flat = np.concatenate(tokens)
                    yield rows(flat, np.repeat(np.array(nodes, np.int64), lens), times[order[_bucket(flat)]])
                    tokens, nodes, lens, held = [], [], [], 0

    def rows(tokens: np.ndarray, nodes: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
        dealt = (mix(tokens ^ nodes.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % np.maximum(wide, 1)
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.where(wide > 0, dealt, -1), pa.int32()), pa.array(nodes)], ["token", "salt", "node"])

    return docs.where("id is not null").mapInArrow(run, "token long, salt int, node long")


def meetings(table: DataFrame) -> DataFrame:
    """(token, block, node, hot) where two classes or more share a token; hot: it has several blocks."""
    names = ["token", "block", "node", "hot"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed = np.zeros((3, 0), np.int64), 0  # the last group's rows, and blocks of it that are written

        def out(rows: np.ndarray, begun: int, last: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of whole groups; of the first one, begun blocks are out already."""
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, rows.shape[1]))
            in_group = shared.ragged(np.zeros(len(at), np.int64), size)
            size = np.repeat(size, size)
            first = np.cumsum(new) == 1
            hot = (size > BLOCK) | (rows[1] >= 0) | (first & (begun > 0)) | (not last)
            block = (np.maximum(rows[1], 0) << 32) + in_group // BLOCK + np.where(first, begun, 0)
            take = (size > 1) | hot
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[0][take]), pa.array(block[take]), pa.array(rows[2][take]), pa.array(hot[take])], names)

        for b in batches:
            more = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)])
            held = np.concatenate((held, more), axis=1)
            if not held.shape[1]:
                continue
            keep = np.ones(held.shape[1], bool)
            keep[1:] = (held[:, 1:] != held[:, :-1]).any(0)
            held = held[:, keep]
            same = (held[:2] == held[:2, -1:]).all(0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from out(held[:, :cut], passed, True)
                held, passed = held[:, cut:], 0
            full = (held.shape[1] - 1) // BLOCK * BLOCK
            if full > 0:
                yield from out(held[:, :full], passed, False)
                held, passed = held[:, full:], passed + full // BLOCK
        if held.shape[1]:
            yield from out(held, passed, True)

    dealt = table.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    return dealt.mapInArrow(run, "token long, block long, node long, hot boolean")


# -- candidates


class Members:
    """Rows of one batch of meetings: class, size, signature bytes."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, signs: list):
        self.nodes, self.sizes = nodes, sizes
        self.width = np.array([len(x) for x in signs], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.bytes = np.concatenate([np.frombuffer(x, np.uint8) for x in signs]) if signs else np.zeros(0, np.uint8)

    def pairs(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs of rows are candidates."""
        out = np.zeros(len(x), bool)
        fit = np.flatnonzero(possible(0, self.sizes[x], self.sizes[y], percent))
        kinds = self.width[x[fit]] << 16 | self.width[y[fit]]
        for kind in np.unique(kinds):
            mine = fit[kinds == kind]
            step = max(1, (1 << 24) // max(int(kind) >> 16, int(kind) & 0xFFFF))
            for lo in range(0, len(mine), step):
                m = mine[lo : lo + step]
                a, b = x[m], y[m]
                one = self.bytes[self.start[a][:, None] + np.arange(int(kind) >> 16)]
                two = self.bytes[self.start[b][:, None] + np.arange(int(kind) & 0xFFFF)]
                out[m] = possible(differing(one, two), self.sizes[a], self.sizes[b], percent)
        return out

    def settle(self, lo: int, hi: int, joined: Joined, percent: int) -> None:
        """Join all candidates among rows lo..hi; pairs that are joined already are left out."""
        roots = np.array([joined.find(k) for k in self.nodes[lo:hi].tolist()], np.int64)
        for k in range(1, hi - lo):
            other = np.flatnonzero(roots[:k] != roots[k])
            if len(other):
                ok = self.pairs(lo + other, np.full(len(other), lo + k), percent)
                for r in np.unique(roots[other[ok]]).tolist():
                    joined.join(r, int(roots[k]))
                    now = joined.find(r)
                    roots[(roots == r) | (roots == roots[k])] = now


def candidates(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Forest (a, b) of candidates among meetings(token, block, node): every class with the smallest it is joined to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for group, m in _runs(batches, ("token", "block")):
            edge = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(0)))
            inner = np.setdiff1d(np.arange(1, group.shape[1]), edge)
            near = inner[m.pairs(inner - 1, inner, percent)]
            for k in near.tolist():
                joined.join(int(m.nodes[k - 1]), int(m.nodes[k]))
            ends = np.append(edge, group.shape[1])
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if hi - lo > 2:
                    m.settle(lo, hi, joined, percent)
            if len(joined.up) > JOINED:
                yield from joined.rows()
        yield from joined.rows()

    dealt = met.select("token", "block", "node").join(classes.select("node", "size", "sign").hint("merge"), "node")
    return dealt.repartition("token", "block").sortWithinPartitions("token", "block", "node").select("token", "block", "node", "size", "sign").mapInArrow(run, "a long, b long")


def _runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[np.ndarray, Members]]:
    """Whole groups of rows with equal keys, several groups at a time; a group is bounded by its block."""
    held: pa.Table | None = None

    def part(t: pa.Table) -> tuple[np.ndarray, Members]:
        group = np.stack([t[k].to_numpy() for k in keys])
        return group, Members(t["node"].to_numpy(), t["size"].to_numpy(), [x.as_buffer() for x in t["sign"]])

    for b in batches:
        if not b.num_rows:
            continue
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        last = np.stack([held[k].to_numpy() for k in keys])
        same = (last == last[:, -1:]).all(0)
        if not same.all():
            cut = len(same) - int(np.argmin(same[::-1]))
            yield part(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield part(held)


def across(met: DataFrame, group: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """More candidates (a, b) among the blocks of hot tokens whose classes lie in several groups(node, root).

    The commonest group of a token is dealt in blocks, and the others, the few, meet each block of it and
    each other: pairs within one group are known, so no block of the commonest meets another of its own.
    """
    now = met.where("hot").select("token", "node").join(group, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"))
    by_root = now.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_root.groupBy("token").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).where("top.n < all")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("token", F.col("top.root").alias("most"), blocks(F.col("top.n")).alias("many"), blocks(F.col("all") - F.col("top.n")).alias("few"))
    now = now.join(mixed, "token").withColumn("minor", F.col("root") != F.col("most"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many")).cast("long")).cast("int")
    now = now.withColumn("own", own)
    every: Column = F.sequence(F.lit(0), F.col("few") - 1)
    tile = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    with_most = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda k: tile(0, k, F.col("own")))
    with_few = F.transform(every, lambda k: tile(1, F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    tiles = F.when(F.col("minor"), F.concat(with_most, with_few)).otherwise(F.transform(every, lambda k: tile(0, F.col("own"), k)))
    dealt = now.select("token", "node", "root", F.explode(tiles).alias("t")).select("token", "node", "root", "t.kind", "t.x", "t.y")
    dealt = dealt.join(classes.select("node", "size", "sign").hint("merge"), "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()

        def rooted():
            for b in batches:
                for x, r in zip(b.column("node").to_pylist(), b.column("root").to_pylist(), strict=True):
                    joined.join(x, r)
                yield b

        for key, m in _runs(rooted(), ("token", "kind", "x", "y")):
            ends = [*np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))).tolist(), key.shape[1]]
            for lo, hi in zip(ends, ends[1:]):
                m.settle(lo, hi, joined, percent)
        yield from joined.rows()

    dealt = dealt.repartition("token", "kind", "x", "y").sortWithinPartitions("token", "kind", "x", "y", "node")
    return dealt.select("token", "kind", "x", "y", "node", "root", "size", "sign").mapInArrow(run, "a long, b long")


# -- links


def _bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A fixed number of bits, those of ids(id) set; the driver gets no more than that."""

    def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bits(b.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.uint64(1) << (at & 63).astype(np.uint64)).view(pa.int64())], ["word", "bits"])

    got = ids.mapInArrow(marks, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def wanted_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(node, ngrams) of documents in ids(id), and of few others; copies that one task reads come once."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = sent.value, set()
        for b in batches:
            at = _bits(b.column(0).to_numpy())
            take = np.flatnonzero(words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            if len(take):
                nodes, sets = [], []
                for _, s in sets_of(shared.plain(b.column(1).take(pa.array(take))), n):
                    if len(s) and (node := _key(s)) not in done:
                        done.add(node)
                        nodes.append(node)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "ngrams"])

    return docs.where("id is not null").mapInArrow(run, "node long, ngrams binary")


def tiles(docs: DataFrame, group: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Groups(node, root) with their sets, dealt in tiles: rows (root, x, y, side, node, copies, ngrams) in order."""
    own = group.join(classes.select("node", "rep", "size", "copies").hint("merge"), "node")
    sums = own.groupBy("root").agg(F.sum("size").alias("ngrams"), F.count(F.lit(1)).alias("sets"))
    sums = sums.select("root", F.greatest(F.ceil(F.col("ngrams") / TILE_NGRAMS), F.ceil(F.col("sets") / TILE_SETS)).cast("int").alias("blocks"))
    own = own.join(sums, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    own = shared.saved(own.select("root", "node", "rep", "copies", "block", "blocks"))
    sets = wanted_sets(docs, own.select(F.col("rep").alias("id")), n)
    met = own.drop("rep").join(sets.hint("merge"), "node")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).alias("side"), "node", "copies", "ngrams")
    return met.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "side", "node")


def settled(dealt: DataFrame, percent: int, classes: np.ndarray, pairs: bool = False) -> DataFrame:
    """Links of the tiles. (a, b, n): that class a links with n documents of other classes, and is joined to b;
    with ``pairs`` (a, b): each two classes that link."""
    sent = dealt.sparkSession.sparkContext.broadcast(classes)

    def links(rows: list[tuple]) -> tuple[list[int], np.ndarray, Iterator[tuple[int, np.ndarray]]]:
        """Classes of a tile, their copies, and (class, classes it links with), by number."""
        nodes, copies, sets, sides = zip(*rows, strict=True)
        every = np.unique(np.concatenate(sets))
        every = every[np.argsort(sent.value[_bucket(every)], kind="stable")]
        two = any(sides)
        left = [k for k, s in enumerate(sides) if not s]
        right = [k for k, s in enumerate(sides) if s] if two else left
        where = np.array(right, np.int64)
        found = ((left[k], where[p]) for k, p in PrefixTree([sets[k] for k in left], every).search([sets[k] for k in right], percent)) if left else iter(())
        return list(nodes), np.array(copies, np.int64), ((k, p[p != k]) for k, p in found)

    def counted(rows: list[tuple], cross: bool) -> pa.RecordBatch:
        nodes, copies, found = links(rows)
        times, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for k, p in found:
            times[k] += copies[p].sum()
            if cross:
                times[p] += copies[k]
            joined = np.unique(np.append(root[p], root[k]))
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
        at = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(at[root]), pa.array(times)], ["a", "b", "n"])

    def listed(rows: list[tuple], cross: bool) -> pa.RecordBatch:
        nodes, _, found = links(rows)
        at = np.array(nodes, np.int64)
        both = [(at[np.full(len(p), k)], at[p]) for k, p in found]
        a, b = (np.concatenate([x[k] for x in both]) if both else at[:0] for k in (0, 1))
        keep = np.ones(len(a), bool) if cross else a < b
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = listed if pairs else counted
        now, rows, seen = None, [], set()
        for b in batches:
            for *key, side, node, copies, ngrams in zip(*(b.column(k).to_pylist() for k in range(6)), b.column(6), strict=True):
                if key != now:
                    if len(rows) > 1:
                        yield give(rows, now[1] != now[2])
                    now, rows, seen = key, [], set()
                if node not in seen:
                    seen.add(node)
                    rows.append((node, copies, np.frombuffer(ngrams.as_buffer(), np.uint64).copy(), side))
        if len(rows) > 1:
            yield give(rows, now[1] != now[2])

    return dealt.mapInArrow(run, "a long, b long" if pairs else "a long, b long, n long")


# -- the operator


class Join:
    """The tables of one run: own(id, n_shingles, d1), classes(node, rep, copies, size, sign), group(node, root), dealt tiles."""

    def __init__(self, df: DataFrame, n: int, percent: int, id_col: str, text_col: str):
        shared.short_batches(df.sparkSession)
        self.percent = percent
        docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
        first = shared.saved(digests(docs, n))
        self.own = first.where("n_shingles is not null").select("id", "n_shingles", "d1")
        self.order = frequency_classes(first.where("chunk is not null").select("chunk", "counts"))
        doubt = Observation()
        classes = first.where("n_shingles > 0 and id is not null").groupBy(F.col("d1").alias("node")).agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("size"), F.first("sign").alias("sign"),
            ((F.min("d2") != F.max("d2")) | (F.min("n_shingles") != F.max("n_shingles"))).alias("doubt"),
        )
        self.classes = shared.saved(classes.observe(doubt, F.max("doubt").alias("doubt")).drop("doubt"))
        if doubt.get["doubt"]:
            raise RuntimeError("two different sets share a 64-bit key")
        hot = Observation()
        met = shared.saved(meetings(prefixes(docs, n, percent, self.order)).observe(hot, F.max("hot").alias("hot")))
        forest = shared.saved(candidates(met, self.classes, percent))
        group = components(forest)
        if hot.get["hot"]:
            found = group.select(F.col("id").alias("node"), F.col("component").alias("root"))
            group = components(forest.unionAll(shared.saved(across(met, found, self.classes, percent))))
        self.group = shared.saved(group.select(F.col("id").alias("node"), F.col("component").alias("root")))
        self.dealt = tiles(docs, self.group, self.classes, n)

    def links(self) -> DataFrame:
        """links(a, b): every two classes that link, by their smallest ids, a < b."""
        out = settled(self.dealt, self.percent, self.order, pairs=True)
        for c in ("a", "b"):
            out = out.join(self.classes.select(F.col("node").alias(c), F.col("rep").alias(f"rep_{c}")), c)
        return out.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))

    def members(self) -> DataFrame:
        """(id, n_shingles, component, class, n_links) of every document."""
        told = shared.saved(settled(self.dealt, self.percent, self.order))
        times = told.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")).where("n > 0")
        node = components(told.where("a <> b").select("a", "b")).select(F.col("id").alias("node"), F.col("component").alias("root"))
        node = shared.saved(node.join(self.classes.select("node", "rep").hint("merge"), "node").join(times, "node", "left"))
        least = node.groupBy("root").agg(F.min("rep").alias("component"))
        node = node.join(least, "root").select("node", "component", "n")
        every = self.classes.select("node", "rep", "copies").join(node.hint("merge"), "node", "left")
        every = every.select(F.col("node").alias("d1"), "rep", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
        real = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
        own = self.own.withColumn("d1", F.when(real, F.col("d1"))).join(every.hint("merge"), "d1", "left")
        return own.select("id", "n_shingles", F.coalesce("component", "id").alias("component"), F.col("rep").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def ngram_jaccard_links(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, membership). links(a, b): every two classes of equal sets that link, by their smallest ids, a < b.

    membership: (id, n_shingles, component_id, class_id, n_links) of every document; n_links counts the other documents
    that it links with, those of its own class and of all linked classes. Null ids and empty sets have none.
    """
    join = Join(df, n, percent, id_col, text_col)
    return join.links(), _named(join.members(), id_col)


def ngram_jaccard_join(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, class_id, n_links) of every document; links have 100 * intersection >= percent * union."""
    return _named(Join(df, n, percent, id_col, text_col).members(), id_col)


def _named(out: DataFrame, id_col: str) -> DataFrame:
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("class").alias("class_id"), "n_links")
