"""Similar pairs of n-gram sets by a trie that all probes go through together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import shared


def least_overlap(a, b, percent: int):
    """Smallest intersection for which 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """A path-compressed trie of sets, each a path of its n-grams in one order.

    ``order`` has every n-gram of the sets once. Its last comes first in the paths, so the global
    order (rare first) makes paths begin with what many sets share. Sets are sorted by path; a node
    is a run of them, its edge the path that they share beyond the parent's, told by the least
    common prefix of neighbours. Equal sets are one leaf.
    """

    def __init__(self, sets: list[np.ndarray], order: np.ndarray):
        place = np.argsort(order, kind="stable")
        self.known, self.rank = order[place], len(order) - 1 - place
        paths = [np.sort(self.ranks(s)) for s in sets]
        self.sets = sorted(range(len(paths)), key=lambda k: paths[k].astype(">i8").tobytes())
        self.paths = [paths[k] for k in self.sets]
        self.sizes = np.array([len(p) for p in self.paths], np.int64)
        self.shared = np.array([self._common(a, b) for a, b in zip(self.paths, self.paths[1:])], np.int64)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def ranks(self, s: np.ndarray) -> np.ndarray:
        """Places in the order of those members of a set that it has."""
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return self.rank[at[self.known[at] == s]]

    def search(self, probes: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(set, all probes similar to it), by number; 100 * intersection >= percent * union.

        An edge's overlap with every probe is one sum over posting lists, and what a path has is
        shared by all sets below. A probe leaves a subtree when its overlap so far plus the lesser
        remaining length, of the probe or of the subtree's longest set, can't reach the threshold.
        """
        if not self.paths or not probes:
            return
        wide = len(self.known)
        own = [np.sort(self.ranks(p)) for p in probes]
        size = np.array([len(p) for p in probes], np.int64)  # with n-grams that no set has
        inside = np.array([len(p) for p in own], np.int64)
        first = np.cumsum(inside) - inside
        flat = np.concatenate(own)
        who = np.repeat(np.arange(len(own)), inside)
        in_order = who * wide + flat
        by_rank = np.argsort(flat, kind="stable")
        posted = who[by_rank]
        begin = np.searchsorted(flat[by_rank], np.arange(wide + 1))

        stack = [(0, len(self.paths), 0, np.arange(len(own)), np.zeros(len(own), np.int64))]
        while stack:
            lo, hi, depth, alive, overlap = stack.pop()
            upto = int(self.shared[lo : hi - 1].min()) if hi - lo > 1 else len(self.paths[lo])
            edge = self.paths[lo][depth:upto]
            if len(edge):
                at = shared.ragged(begin[edge], begin[edge + 1] - begin[edge])
                overlap = overlap + np.bincount(posted[at], minlength=len(own))[alive]
                least, most = int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())
                seen = np.searchsorted(in_order, alive * wide + int(edge[-1]), side="right") - first[alive]
                n = size[alive]
                need = least_overlap(n, np.maximum(least, -(-percent * n // 100)), percent)
                keep = (overlap + np.minimum(most - upto, inside[alive] - seen) >= need) & (100 * most >= percent * n) & (100 * n >= percent * least)
                alive, overlap = alive[keep], overlap[keep]
            if not len(alive):
                continue
            end = lo
            while end < hi and len(self.paths[end]) == upto:  # a path sorts before its continuations
                end += 1
            if end > lo:
                similar = alive[100 * overlap >= percent * (size[alive] + upto - overlap)]
                if len(similar):
                    for k in range(lo, end):
                        yield self.sets[k], similar
            if end < hi:
                cut = end + 1 + np.flatnonzero(self.shared[end : hi - 1] <= upto)
                edges = [end, *cut.tolist(), hi]
                stack += [(a, z, upto, alive, overlap) for a, z in zip(edges, edges[1:])]
