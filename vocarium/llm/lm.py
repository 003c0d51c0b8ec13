"""Language-model scores of whole texts: a causal self-attention model over subword ids, in numpy.

The model reads the byte-level BPE ids of the lower-cased text and an end id. One masked attention head,
one rectified layer and a table by last id give a distribution over ``CLASSES`` classes of ids; inside
a class an id has its share of the counts after the last id, over all training documents, smoothed by its
share of the class. So log10 P(text) = sum of log10 P(class | context) + log10 P(id | class, last id) over
its ids and the end.

Contexts are windows of ``WINDOW`` ids that overlap by ``WINDOW - STRIDE``; each id is scored once, in the window
where it has most context. Windows of many documents go through in batches under one causal mask.

The weights are fitted on every id of every training document, once: in each of ``ROUNDS`` rounds all tasks start
from the same weights, go through their share of the documents, and the mean by number of ids starts the next
round. Classes and counts of words, ids and pairs are over every training document too. Texts are encoded once;
their ids are written, two bytes each, for training and for scoring. The base score is the add-one word model: the commonest words' counts go to all workers (a fixed number), the
others meet by a join of (document, word) rows.

Null and empty texts are an end token alone. A null id counts as the text ''. Repeated rows are scored
each; extra columns stay out. Without training documents all counts are zero and the classes are uniform.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fastbpe, shared
from .quality import fold
from .wordhash import BLANK_WORDS, LOWER, word_hashes

WINDOW, STRIDE, WIDTH, CLASSES = 48, 40, 16, 64
#: Ids with a symbol of their own as context, and as what follows; the others go by class.
SYMBOLS, NEXT = 512, 4096
#: Rounds: each takes its share of every task's documents, so that all are learned from once.
ROUNDS = 2
#: Windows in a step of training.
LEAST_WINDOWS, MOST_WINDOWS = 8, 64
#: Ranks of the id before that classes are told by; all rarer ids count as one.
BEFORE = 256
#: Groups in which tasks' weights are added before they reach the driver.
SUMS = 16
#: Words whose counts every worker gets; the rest are joined.
HOT_WORDS = 1 << 16
#: The end token among word hashes.
END_WORD = np.uint64(0)
VOCABULARY_SIZE, END_ID = 50_257, 50_256


def lower_texts(arr: pa.Array) -> list[str]:
    """A-Z lower-cased; bytes of other characters never lie in that range."""
    buf, offs = shared.raw(arr)
    if not len(arr):
        return []
    low = LOWER[buf[offs[0] : offs[-1]]].tobytes().decode()
    if len(low) == offs[-1] - offs[0]:
        return [low[a:z] for a, z in zip((offs[:-1] - offs[0]).tolist(), (offs[1:] - offs[0]).tolist(), strict=True)]
    data = low.encode()
    return [data[a:z].decode() for a, z in zip((offs[:-1] - offs[0]).tolist(), (offs[1:] - offs[0]).tolist(), strict=True)]


def with_ends(ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(per), END_ID).astype(np.int64), per + 1


#: exp(x) is about the number whose bits are UNIT * x + BASE; within the same bounds as clipped exponents.
UNIT, BASE = 2**23 / np.log(2), 1064986823.0
LOW, HIGH = BASE - 80 * UNIT, BASE + 80 * UNIT


def bits_exp(z: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """exp((z - BASE) / UNIT) within some per cent, for softmax: sums of it normalise as well. Changes z.

    Where values go beyond the range, the mask is added (negative where a value doesn't count; the caller drops those) and
    rows are shifted below their maximum. 64-bit z (tests) are taken as they are, exactly.
    """
    exact = z.dtype == np.float64
    if exact or (z.size and z.max() > HIGH):
        if mask is not None:
            z += mask * z.dtype.type(1 if exact else UNIT)
        top = z.max(-1, keepdims=True)
        z -= top if exact else np.maximum(top - np.float32(BASE), 0)
    if exact:
        return np.exp(z)
    if z.size and z.min() < LOW:
        np.maximum(z, np.float32(LOW), out=z)
    return z.astype(np.int32).view(np.float32)


def ranks(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(VOCABULARY_SIZE, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(VOCABULARY_SIZE)
    return rank


def ids_before(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The id before each id; first: where documents begin."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first] = END_ID
    return before


def contexts(ids: np.ndarray, first: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """rank of the id before (at most BEFORE - 1) * VOCABULARY_SIZE + id, of each id."""
    return np.minimum(rank[ids_before(ids, first)], BEFORE - 1) * VOCABULARY_SIZE + ids


class Symbols:
    """How ids are told apart: class, symbol as context, cell as what follows. Taken from counts of ids and contexts."""

    def __init__(self, sample: list[np.ndarray]):
        counts = np.bincount(np.concatenate(sample), minlength=VOCABULARY_SIZE) if sample else np.zeros(VOCABULARY_SIZE)
        seen = [contexts(s, np.array([0]), ranks(counts)) for s in sample]
        self._tell(counts, *np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True))

    @classmethod
    def counted(cls, counts: np.ndarray, key: np.ndarray, times: np.ndarray) -> Symbols:
        """From counts of all ids, and those of the distinct contexts."""
        out = cls.__new__(cls)
        out._tell(counts, key, times)
        return out

    def _tell(self, counts: np.ndarray, key: np.ndarray, times: np.ndarray) -> None:
        self.assign(counts, key, times)
        self.cell = np.where(self.rank < NEXT, self.rank, NEXT + self.cls)
        self.cells = NEXT + CLASSES
        self.cell_class = np.concatenate((self.cls[np.argsort(self.rank)[:NEXT]], np.arange(CLASSES)))

    def pairs(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """symbol of the id before * cells + cell, of each id; first: where documents begin."""
        return self.symbol[ids_before(ids, first)] * self.cells + self.cell[ids]

    def assign(self, counts: np.ndarray, key: np.ndarray, times: np.ndarray) -> None:
        """Classes of ids: the commonest alone, the others by what stands before them."""
        order, rank = np.argsort(-counts, kind="stable"), ranks(counts)
        alone = CLASSES // 2
        cls = np.full(VOCABULARY_SIZE, CLASSES - 1)
        cls[order[:alone]] = np.arange(alone)
        ids = key % VOCABULARY_SIZE
        rest = np.setdiff1d(np.unique(ids), order[:alone])
        k = CLASSES - alone - 1
        if len(rest) > k:
            at = np.minimum(np.searchsorted(rest, ids), len(rest) - 1)
            ok = rest[at] == ids
            m = np.zeros((len(rest), BEFORE), np.float32)
            m[at[ok], key[ok] // VOCABULARY_SIZE] = times[ok]
            weight = m.sum(1)
            m /= np.maximum(weight, 1)[:, None]
            np.sqrt(m, out=m)
            centre = m[np.argsort(-weight, kind="stable")[:k]]
            for _ in range(12):
                near = np.argmax(m @ centre.T - 0.5 * (centre**2).sum(1), axis=1)
                for c in range(k):
                    mine = np.flatnonzero(near == c)
                    if len(mine):
                        centre[c] = weight[mine] @ m[mine] / weight[mine].sum()
            cls[rest] = alone + near
        self.cls, self.rank = cls.astype(np.int64), rank
        self.symbol = np.where(rank < SYMBOLS, rank, SYMBOLS + cls)


def row_sums(size: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(size, width): rows (of an even width) added up by their place; two columns at once, as parts of a complex number."""
    pair = np.complex64 if rows.dtype == np.float32 else np.complex128
    half = rows.shape[1] // 2
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    np.add.at(out.view(pair).ravel(), np.arange(size * half).reshape(size, half).take(at, axis=0).ravel(), np.ascontiguousarray(rows).view(pair).ravel())
    return out


class Adam:
    """Running sums of gradients (ten times their mean) and of their squares (a hundred times); the table B moves slower."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.names = sorted(p, key="B".__eq__)  # B last
        self.m = np.zeros(sum(v.size for v in p.values()), p["B"].dtype)
        self.s2 = np.zeros_like(self.m)
        self.step = 0

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        now, one, two = rate * min(1, self.step / 50), 1 - 0.9**self.step, 1 - 0.99**self.step
        v = np.concatenate([g[n].ravel() for n in self.names])
        self.m *= 0.9
        self.m += v
        v *= v
        self.s2 *= 0.99
        self.s2 += v
        np.sqrt(self.s2, out=v)
        v += 1e-7
        np.divide(self.m, v, out=v)
        v *= now * two**0.5 / one
        v[-p["B"].size :] *= 0.3
        lo = 0
        for n in self.names:
            p[n] -= v[lo : lo + p[n].size].reshape(p[n].shape)
            lo += p[n].size


class Attention:
    """Weights, training and scoring. counts: of ids; pairs: of (symbol before, cell), over the corpus."""

    def __init__(self, symbols: Symbols, counts: np.ndarray, pairs: np.ndarray, seed: int = 5):
        self.symbols = symbols
        cls, cell, of = symbols.cls, symbols.cell, symbols.cell_class
        share = (counts + 1.0) / np.bincount(cls, weights=counts + 1.0, minlength=CLASSES)[cls]
        held = np.bincount(cell, weights=share, minlength=symbols.cells)
        self.rest = np.log10(share / held[cell])
        n = pairs.reshape(-1, symbols.cells)
        by_class = np.zeros((len(n), CLASSES))
        np.add.at(by_class.T, of, n.T)
        self.follow = np.log10((n + 10 * np.maximum(held, 1e-12)) / (by_class[:, of] + 10)).astype(np.float32)
        every = (by_class.sum(0) + 1) / (by_class.sum() + CLASSES)
        bigram = np.log((by_class + 8 * every) / (by_class.sum(1, keepdims=True) + 8)).astype(np.float32)
        rng = np.random.default_rng(seed)
        d = WIDTH
        init = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        n = SYMBOLS + CLASSES
        self.p = {
            "E": (rng.normal(0, 0.3, (n, d))).astype(np.float32), "P": (rng.normal(0, 0.1, (WINDOW, d))).astype(np.float32),
            "QKV": init(d, 3 * d), "O": init(d, d) * 0.3, "W1": init(d, 2 * d), "W2": init(2 * d, d) * 0.3, "out": init(d, CLASSES) * 0.3, "B": bigram,
        }
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.past = np.tri(WINDOW, dtype=np.float32)

    def products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries times keys and values times the output matrix: attention needs no more of those four. (d, d) each, then both."""
        d = WIDTH
        q, k, v = (self.p["QKV"][:, i * d : (i + 1) * d] for i in range(3))
        meet, give = q @ k.T * q.dtype.type(d**-0.5), v @ self.p["O"]
        return meet, give, np.concatenate((meet, give), axis=1)

    def forward(self, x: np.ndarray, skip: int = 0) -> tuple:
        """Logits of the classes at each place from ``skip`` on, in bits_exp's units, and what gradients need.

        Attention is kept as exponentials and their sums: dividing the weighted values is cheaper than the weights.
        """
        p, (n, t), d = self.p, x.shape, WIDTH
        kind = p["E"].dtype.type
        unit, base = (kind(UNIT), kind(BASE)) if kind is np.float32 else (kind(1), kind(0))
        meet, give, _ = self.products()
        h0 = p["E"].take(x, axis=0)
        h0 += p["P"][:t]
        qv = (h0.reshape(-1, d) @ np.concatenate((meet * unit, give), axis=1)).reshape(n, t, 2 * d)
        a = qv[:, skip:, :d] @ h0.transpose(0, 2, 1)
        a += base
        a = bits_exp(a, self.mask[skip:t, :t])
        a *= self.past[skip:t, :t]
        s = a.reshape(-1, t) @ np.ones(t, kind)
        o = (a @ qv[..., d:]).reshape(-1, d)
        o /= s[:, None]
        h1 = h0[:, skip:].reshape(-1, d) + o
        r = h1 @ p["W1"]
        live = (r > 0).astype(kind)
        r *= live
        h2 = r @ p["W2"]
        h2 += h1
        z = h2 @ (p["out"] * unit)
        z += (p["B"] * unit + base).take(x[:, skip:].ravel(), axis=0)
        return z.reshape(n, t - skip, -1), (h0, qv, a, s, o, h1, live, r, h2)

    def classes(self, x: np.ndarray, y: np.ndarray, skip: int = 0) -> np.ndarray:
        """log P(class y | context) for a batch of windows, at each place from ``skip`` on."""
        e = bits_exp(self.forward(x, skip)[0].reshape(-1, CLASSES))
        y = y[:, skip:]
        return np.log(e.ravel().take(np.arange(0, e.size, CLASSES) + y.ravel()) / (e @ np.ones(CLASSES, e.dtype))).reshape(y.shape)

    def train(self, sample: list[np.ndarray], epochs: int = 1, seed: int = 9) -> None:
        """Rounds over documents that one process holds."""
        for part in range(ROUNDS * epochs):
            if mine := sample[part % ROUNDS :: ROUNDS]:
                self.learn(np.concatenate(mine), np.array([len(s) for s in mine]), Adam(self.p), pace(part, ROUNDS * epochs), np.random.default_rng((seed, part)))

    def learn(self, ids: np.ndarray, per: np.ndarray, adam: Adam, rate: float, rng: np.random.Generator) -> None:
        """One pass over all windows of whole documents, in random order; ids (ends included) lie one document after the other.

        A step takes LEAST_WINDOWS windows at first and one more every fourth step, up to MOST_WINDOWS.
        """
        first = np.cumsum(per) - per
        more = np.zeros(WINDOW, np.int16)  # so that a document's last window can be read whole
        x_of = np.concatenate((self.symbols.symbol[ids_before(ids, first)].astype(np.int16), more))
        y_of = np.concatenate((self.symbols.cls[ids].astype(np.int16), more))
        n_win = -(-per // WINDOW)
        start = shared.ragged(np.zeros(len(per), np.int64), n_win) * WINDOW
        size = np.minimum(WINDOW, np.repeat(per, n_win) - start)
        start += np.repeat(first, n_win)
        order = rng.permutation(len(start))
        lo = 0
        while lo < len(order):
            w = order[lo : lo + min(MOST_WINDOWS, LEAST_WINDOWS + adam.step // 4)]
            lo += len(w)
            at = start[w][:, None] + np.arange(WINDOW)
            x, y = x_of.take(at), y_of.take(at)
            beyond = np.arange(WINDOW) >= size[w][:, None]
            x[beyond], y[beyond] = 0, -1
            adam.update(self.p, self.gradients(x, y), rate)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, d, (n, t) = self.p, WIDTH, x.shape
        z, (h0, qv, a, s, o, h1, live, r, h2) = self.forward(x)
        meet, _, both = self.products()
        z = bits_exp(z.reshape(-1, CLASSES))
        flat_y = y.ravel().astype(np.int64)
        real = flat_y >= 0
        share = z.dtype.type(1 / max(1, np.count_nonzero(real)))
        z *= (real * share / (z @ np.ones(CLASSES, z.dtype)))[:, None]
        np.subtract.at(z.ravel(), (np.arange(len(flat_y)) * CLASSES + flat_y)[real], share)
        where = x.ravel().astype(np.int64)
        g = {"out": h2.T @ z, "B": row_sums(len(p["B"]), where, z)}
        dh = z @ p["out"].T
        g["W2"] = r.T @ dh
        dr = dh @ p["W2"].T
        dr *= live
        g["W1"] = h1.T @ dr
        dh += dr @ p["W1"].T
        do = dh / s[:, None]
        back = np.einsum("ij,ij->i", do, o).reshape(n, t, 1)
        do = do.reshape(n, t, d)
        da = do @ qv[..., d:].transpose(0, 2, 1)
        da -= back
        da *= a
        dqv = np.empty((n, t, 2 * d), z.dtype)
        np.matmul(da, h0, out=dqv[..., :d])
        np.matmul(a.transpose(0, 2, 1), do, out=dqv[..., d:])
        dk = da.transpose(0, 2, 1) @ h0
        dqv, h0 = dqv.reshape(-1, 2 * d), h0.reshape(-1, d)
        dh += dqv @ both.T
        dh += dk.reshape(-1, d) @ meet
        both = h0.T @ dqv
        by_meet, by_give = both[:, :d] * z.dtype.type(d**-0.5), both[:, d:]
        q, k, v = (p["QKV"][:, i * d : (i + 1) * d] for i in range(3))
        g["O"] = v.T @ by_give
        g["QKV"] = np.concatenate((by_meet @ k, by_meet.T @ q, by_give @ p["O"].T), axis=1)
        g["P"] = np.zeros_like(p["P"])
        g["P"][:t] = dh.reshape(n, t, d).sum(0)
        g["E"] = row_sums(len(p["E"]), where, dh)
        return g

    def score(self, ids: np.ndarray, per: np.ndarray, batch: int = 48) -> np.ndarray:
        """log10 probability of each document; ids (ends included) lie one document after the other."""
        first = np.cumsum(per) - per
        pair = self.symbols.pairs(ids, first)
        sym, cls = pair // self.symbols.cells, self.symbols.cls[ids]
        # windows start at 0, STRIDE, ...; past the first, a window's leading ids are context only
        n_win = 1 + np.maximum(0, -(-(per - WINDOW) // STRIDE))
        doc = np.repeat(np.arange(len(per)), n_win)
        start = shared.ragged(np.zeros(len(per), np.int64), n_win) * STRIDE
        size = np.minimum(WINDOW, per[doc] - start)
        skip = np.where(start > 0, WINDOW - STRIDE, 0)
        got = np.zeros(len(ids), np.float64)
        order = np.lexsort((size, skip))
        later = int(np.count_nonzero(skip == 0))
        for lo in (*range(0, later, batch), *range(later, len(order), batch)):
            w = order[lo : min(lo + batch, later) if lo < later else lo + batch]
            t, k = int(size[w].max()), int(skip[w[0]])
            at = (first[doc[w]] + start[w])[:, None] + np.arange(t)
            inside = np.arange(k, t) < size[w][:, None]
            at = np.minimum(at, len(ids) - 1)
            logp = self.classes(sym.take(at), cls.take(at), k)
            got[at[:, k:][inside]] = logp[inside]
        got /= np.log(10)
        got += self.follow.ravel()[pair]
        got += self.rest[ids]
        return np.add.reduceat(got, first) if len(per) else np.zeros(0)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def pace(part: int, parts: int, rate: float = 1e-2) -> float:
    """The learning rate of a round, falling from one to the next."""
    return rate * (1 - 0.9 * (part + 0.5) / parts)


def _count_rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(key), 50_000):
        k = key[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.uint64).view(np.int64)), pa.array(n[lo : lo + 50_000].astype(np.int64))], ["key", "n"])


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n): counts of words by hash, the end among them, over docs(text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for _, _, buf, offs in shared.chunks(shared.plain(b.column(0))):
                h, _ = word_hashes(buf, offs)
                key, n = np.unique(np.concatenate((h, np.full(len(offs) - 1, END_WORD))), return_counts=True)
                held.append((key, n))
                size += len(key)
                if size > 1_500_000:
                    held = [_merge(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield from _count_rows(*held[0])
                        held, size = [], 0
        if held:
            yield from _count_rows(*_merge(held))

    return _added(docs.mapInArrow(run, "key long, n long"))


def id_bytes(coder: fastbpe.BatchEncoder, texts: list[str]) -> list[bytes]:
    """The subword ids of each lower-cased text, whole and with the end, two bytes each."""
    out = []
    for lo, hi in fastbpe.chunked(texts):
        ids, per = with_ends(*coder.encode(texts[lo:hi]))
        data, upto = ids.astype("<u2").tobytes(), np.cumsum(per) * 2
        out += [data[z - 2 * n : z] for z, n in zip(upto.tolist(), per.tolist(), strict=True)]
    return out


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(ids) of every one of docs(text), to fit a model on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = fastbpe.merging_encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(id_bytes(coder, lower_texts(shared.plain(b.column(0)))), pa.binary())], ["ids"])

    return docs.mapInArrow(run, "ids binary")


def _ids(batches: Iterable[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, length of each document) of rows whose first column is ids, in runs of whole documents."""
    for b in batches:
        rows, size = [], 0
        for x in b.column(0):
            rows.append(np.frombuffer(x.as_buffer(), "<u2"))
            size += len(rows[-1])
            if size > limit:
                yield np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows])
                rows, size = [], 0
        if rows:
            yield np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows])


def id_counts(table: DataFrame, size: int, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """(key, n) of all keys_of(ids, where documents begin) below size; the driver gets at most ``size`` rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for ids, per in _ids(batches):
            np.add.at(total, keys_of(ids, np.cumsum(per) - per), np.int32(1))  # of total's own type, or it takes 20 times as long
        used = np.flatnonzero(total)
        yield from _count_rows(used, total[used])

    return _added(table.mapInArrow(run, "key long, n long")).toArrow()


def _filled(got: pa.Table, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out


def train_everywhere(model: Attention, table: DataFrame) -> int:
    """Fit the weights on all documents of table(ids), each in one of the rounds; the number of ids learned from.

    Every task's weights, times its number of ids, are added up in SUMS groups; the driver gets those sums only.
    """
    names = list(model.p)
    learned = 0

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids = None, 0
        for b in batches:
            for n, x in zip(b.column("n").to_pylist(), b.column("p"), strict=True):
                v = np.frombuffer(x.as_buffer(), np.float64)
                total, ids = (v.copy() if total is None else total + v), ids + n
        if total is not None:
            yield pa.RecordBatch.from_pydict({"task": pa.array([0], pa.int32()), "n": pa.array([ids], pa.int64()), "p": pa.array([total.tobytes()], pa.binary())})

    schema = "task int, n long, p binary"
    for part in range(ROUNDS):
        sent = table.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], sent=sent, part=part) -> Iterator[pa.RecordBatch]:
            task, net = TaskContext.get().partitionId(), copy.copy(sent.value)
            net.p = {k: v.copy() for k, v in net.p.items()}
            adam, rng, n, seen = Adam(net.p), np.random.default_rng((9, part, task)), 0, part
            for b in batches:
                mine = np.arange((-seen) % ROUNDS, b.num_rows, ROUNDS)
                seen += b.num_rows
                for ids, per in _ids([b.take(pa.array(mine))]):
                    net.learn(ids, per, adam, pace(part, ROUNDS), rng)
                    n += len(ids)
            if n:
                p = np.concatenate([net.p[k].ravel() for k in names]).astype(np.float64) * n
                yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "n": pa.array([n], pa.int64()), "p": pa.array([p.tobytes()], pa.binary())})

        parts = table.mapInArrow(run, schema).repartition(SUMS, F.col("task") % SUMS).sortWithinPartitions("task").mapInArrow(add, schema)
        rows = parts.collect()
        if not rows:
            continue
        ids = sum(r["n"] for r in rows)
        learned += ids
        mean = np.sum([np.frombuffer(r["p"], np.float64) for r in rows], axis=0) / ids
        lo = 0
        for k in names:
            v = model.p[k]
            model.p[k] = mean[lo : lo + v.size].reshape(v.shape).astype(v.dtype)
            lo += v.size
    return learned


def lm_scores(df: DataFrame, tokenizer: str, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = df.sparkSession
    shared.short_batches(spark)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    docs = docs.withColumn("held_out", fold(F.coalesce(docs["id"].cast("string"), F.lit("")), folds) == held)
    words = shared.saved(word_counts(docs.where(~F.col("held_out")).select("text")))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rows = shared.saved(_based(docs, words, distinct, tokenizer))
    main = rows.where("key is null").drop("key", "times")
    table = main.where(~F.col("held_out")).select("ids")

    sub = _filled(id_counts(table, VOCABULARY_SIZE, lambda ids, first: ids), VOCABULARY_SIZE)
    rank = ranks(sub)
    seen = id_counts(table, BEFORE * VOCABULARY_SIZE, lambda ids, first: contexts(ids, first, rank))
    symbols = Symbols.counted(sub, seen["key"].to_numpy(), seen["n"].to_numpy())
    known, cells = spark.sparkContext.broadcast(symbols), (SYMBOLS + CLASSES) * symbols.cells
    model = Attention(symbols, sub, _filled(id_counts(table, cells, lambda ids, first: known.value.pairs(ids, first)), cells))
    train_everywhere(model, table)

    sent = spark.sparkContext.broadcast(model)
    names = [c for c in main.columns if c != "ids"]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.score(ids, per) for ids, per in _ids([b], 200_000)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.concatenate(got) if got else np.zeros(0))], [*names, "score"])

    kind = docs.schema["id"].dataType.simpleString()
    main = main.select("ids", *names).mapInArrow(score, f"rid long, id {kind}, held_out boolean, n_tokens long, n_known long, known_log double, score double")
    if distinct > HOT_WORDS:
        rare = rows.where("key is not null").select("rid", "key", "times").join(words.select("key", "n"), "key")
        rare = rare.groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_log"))
        main = main.join(rare, "rid", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "known_log": F.col("known_log") + F.coalesce("more_log", F.lit(0.0))})
    unit = float(np.log10(total + distinct + 1.0))
    return main.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("known_log") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score")


def _based(docs: DataFrame, words: DataFrame, distinct: int, tokenizer: str) -> DataFrame:
    """What a text is read for: a row (rid, id, held_out, n_tokens, n_known, known_log, ids) of every document, its
    sums over hot words, and rows (rid, key, times) of its other words."""
    hot = words.select("key", "n").orderBy(F.desc("n"), "key").limit(HOT_WORDS).toArrow()
    hot_key = hot["key"].to_numpy().view(np.uint64)
    by_key = np.argsort(hot_key)
    sent = docs.sparkSession.sparkContext.broadcast((hot_key[by_key], np.log10(hot["n"].to_numpy()[by_key] + 1.0)))
    complete = distinct <= HOT_WORDS
    kind = docs.schema["id"].dataType.simpleString()
    names = ["rid", "id", "held_out", "n_tokens", "n_known", "known_log", "ids", "key", "times"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = sent.value
        coder = fastbpe.merging_encoder(tokenizer)
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            arr = shared.plain(b.column(1))
            n_tokens, n_known, known = [], [], []
            for lo, hi, buf, offs in shared.chunks(arr):
                h, first = word_hashes(buf, offs)
                n = hi - lo
                whose = np.concatenate((np.repeat(np.arange(n), np.diff(first)), np.arange(n)))
                h = np.concatenate((h, np.full(n, END_WORD)))
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                n_tokens.append(np.bincount(whose, minlength=n))
                n_known.append(np.bincount(whose[hit], minlength=n))
                known.append(np.bincount(whose[hit], weights=logs[at[hit]], minlength=n))
                if not complete and not hit.all():
                    doc, word = whose[~hit], h[~hit]
                    order = np.lexsort((word, doc))
                    doc, word = doc[order], word[order]
                    start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])))
                    none = pa.nulls(len(start))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid + lo + doc[start], pa.int64()), none.cast(b.column(0).type), none.cast(pa.bool_()), *(none.cast(k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.binary())), pa.array(word[start].view(np.int64)), pa.array(np.diff(np.append(start, len(doc))), pa.int64())],
                        names,
                    )
            none = pa.nulls(len(arr), pa.int64())
            cat = lambda x: np.concatenate(x) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(rid + np.arange(len(arr)), pa.int64()), b.column(0), b.column(2), pa.array(cat(n_tokens), pa.int64()), pa.array(cat(n_known), pa.int64()), pa.array(cat(known), pa.float64()), pa.array(id_bytes(coder, lower_texts(arr)), pa.binary()), none, none], names)
            rid += len(arr)

    return docs.select("id", "text", "held_out").mapInArrow(run, f"rid long, id {kind}, held_out boolean, n_tokens long, n_known long, known_log double, ids binary, key long, times long")
