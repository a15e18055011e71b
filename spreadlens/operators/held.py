"""The held side of a search: the queries of a task as an index, which the rows of the base stream past.

Both sides are cut into tiles of at most ``TILE_ROWS`` rows that lie near each other (a few centres, found among the queries of the
task) and are of like length; what lies in a tile is a matter of speed alone. For two tiles, the terms that are frequent in both are
multiplied as matrices, in single precision; of all other terms a base row meets the lists of the queries that have them. So tiles
of rows that have little in common cost little; a tile meets the nearest ones first. What that sum, less its error, rules out against a query's k-th best similarity so
far (or the threshold) is left; the few pairs that stay are multiplied again in double precision, over all terms. As weights are
not negative, all errors are relative to the sum, so no pair is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .products import HOT_FACTOR, POSITIVE, ROUND, SLACK, best_so_far

#: Rows of a tile, frequent terms of two tiles and postings that meet at once, at most (but for a single base row).
TILE_ROWS, MOST_HOT, MOST_MET = 1024, 2048, 1 << 17
#: Pairs of a tile of queries that wait for double precision, at most (but for those of two tiles).
MOST_WAITING = 1 << 19
#: Rows and postings of the base that are searched together, at most (but for a single block).
BASE_ROWS, BASE_POSTINGS = 4096, 1_200_000
#: Centres of the rows, steps, terms and rows that they are made of, and rows that make tiles of their own at least.
CENTRES, CENTRE_STEPS, CENTRE_TERMS, CENTRE_ROWS, LEAST_ROWS = 8, 6, 512, 2048, 192
#: Similarities below it are 0 when rounded.
LOWEST = 4e-10


def ragged(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of lists of ``many`` items each, one list after the other."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + many, many)


class Side:
    """Rows of blocks as postings whose terms are places in a vocabulary; terms that it lacks are left out. The blocks are taken out
    of their list one by one, so that few of them are in memory beside their postings here."""

    def __init__(self, rows: list, vocabulary: np.ndarray):
        most, n = sum(len(r.places) for r in rows), 0
        self.places, self.weights = np.empty(most, np.int32), np.empty(most)
        ids, labels, sizes = [], [], []
        while rows:
            r = rows.pop(0)
            at = np.minimum(np.searchsorted(vocabulary, r.vocabulary), len(vocabulary) - 1).astype(np.int32)
            known = (vocabulary[at] == r.vocabulary)[r.places]
            e = n + int(np.count_nonzero(known))
            self.places[n:e], self.weights[n:e], n = at[r.places[known]], r.weights[known], e
            ids.append(r.ids)
            labels.append(r.labels)
            sizes.append(np.bincount(np.repeat(np.arange(len(r.ids), dtype=np.int32), r.sizes)[known], minlength=len(r.ids)))
        self.places, self.weights = self.places[:n], self.weights[:n]
        self.ids, self.labels, self.sizes = np.concatenate(ids), np.concatenate(labels), np.concatenate(sizes)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])

    def columns(self, rows: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
        """The rows' weights of some terms as a matrix; ``column`` is -1 for all other terms."""
        many = self.sizes[rows]
        at = ragged(self.start[rows], many)
        where = column[self.places[at]]
        mine = where >= 0
        out = np.zeros((len(rows), width), np.float32)
        out[np.repeat(np.arange(len(rows)), many)[mine], where[mine]] = self.weights[at[mine]]
        return out

    def tiles(self, rows: np.ndarray, near: np.ndarray) -> list:
        """The rows in tiles: by centre, then by length."""
        order = rows[np.lexsort((self.sizes[rows], near[rows]))]
        cuts, of = [0], near[order]
        for at in np.flatnonzero(of[1:] != of[:-1]) + 1:
            if at - cuts[-1] >= LEAST_ROWS and len(order) - at >= LEAST_ROWS:
                cuts.append(int(at))
        cuts.append(len(order))
        parts = [order[a:e] for a, e in zip(cuts[:-1], cuts[1:]) if e > a]
        return [x for p in parts for x in np.array_split(p, -(-len(p) // TILE_ROWS))]


class Tile:
    """Some rows of a side, as the lists of their terms: ``terms``, and ``size`` postings each from ``first`` on."""

    def __init__(self, side: Side, rows: np.ndarray, middle: np.ndarray):
        self.rows, self.ids, self.labels, self.middle = rows, side.ids[rows], side.labels[rows], middle
        many = side.sizes[rows]
        at = ragged(side.start[rows], many)
        key = np.sort(side.places[at].astype(np.int64) << 32 | np.arange(len(at)))
        order = key & 0xFFFFFFFF
        self.row, self.weight = np.repeat(np.arange(len(rows), dtype=np.int32), many)[order], side.weights[at[order]].astype(np.float32)
        places = key >> 32
        first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]][:len(places)])
        self.first, self.size, self.terms = (x.astype(np.int32) for x in (first, np.diff(np.r_[first, len(places)]), places[first]))
        self.longest = int(many.max())
        self.label = self.labels[0] if len(set(self.labels)) == 1 else None

    def matrix(self, lists: np.ndarray) -> np.ndarray:
        """The weights of some lists, (list, row)."""
        many = self.size[lists]
        at = ragged(self.first[lists], many)
        out = np.zeros((len(lists), len(self.rows)), np.float32)
        out[np.repeat(np.arange(len(lists)), many), self.row[at]] = self.weight[at]
        return out

    def sums(self, b: Tile, list_of: np.ndarray) -> tuple[np.ndarray, float]:
        """Similarities of a tile of the base to these rows, in single precision, and the greatest relative error that rounding
        may have made. ``list_of`` gives the list here that a term has, or -1."""
        n, width = len(b.rows), len(self.rows)
        mine = list_of[b.terms]
        lists = np.flatnonzero(mine >= 0)
        of = mine[lists]
        pairs = b.size[lists].astype(np.int64) * self.size[of]
        hot = pairs * HOT_FACTOR >= n * width
        if hot.sum() > MOST_HOT:
            hot = np.zeros(len(lists), bool)
            hot[np.argpartition(-pairs, MOST_HOT)[:MOST_HOT]] = True
        s = b.matrix(lists[hot]).T @ self.matrix(of[hot]) if hot.any() else np.zeros((n, width), np.float32)
        lists, of, pairs = lists[~hot], of[~hot], pairs[~hot]
        flat, ends, a = s.reshape(-1), np.cumsum(pairs), 0
        while a < len(lists):
            e = max(a + 1, int(np.searchsorted(ends, ends[a] - pairs[a] + MOST_MET, side="right")))
            own = b.size[lists[a:e]]
            at, to = ragged(b.first[lists[a:e]], own), np.repeat(of[a:e], own)      # a posting of the base meets a list
            many = self.size[to]
            met = ragged(self.first[to], many)
            cell = np.repeat(b.row[at].astype(np.int64) * width, many)
            cell += self.row[met]
            value = np.repeat(b.weight[at], many)
            value *= self.weight[met]
            np.add.at(flat, cell, value)
            a = e
        return s, 1.3e-7 * (min(b.longest, self.longest) + 16)


class Queries(Tile):
    """A tile of queries and their best so far."""

    def __init__(self, side: Side, rows: np.ndarray, middle: np.ndarray):
        super().__init__(side, rows, middle)
        self.number = pd.Series(np.arange(len(self.ids))).groupby(pd.Series(self.ids)).indices
        self.floor = np.full(len(self.ids), -np.inf)
        self.row_of, self.bid, self.sim, self.key = np.zeros(0, np.int64), self.ids[:0], np.zeros(0), np.zeros(0)

    def add(self, q: np.ndarray, bid: np.ndarray, sim: np.ndarray, key: np.ndarray, k: int) -> None:
        """Take pairs into the k best of their queries."""
        row, sim, key = (np.concatenate(x) for x in ((self.row_of, q), (self.sim, sim), (self.key, key)))
        bid = np.concatenate([self.bid, bid]) if len(self.bid) else bid
        self.row_of, at, self.sim, self.key = best_so_far([row, np.arange(len(row)), sim, key], pd.factorize(bid, sort=True)[0], k, POSITIVE)
        self.bid = bid[at]
        n = np.bincount(self.row_of, minlength=len(self.floor))
        self.floor[n == k] = self.key[(np.cumsum(n) - 1)[n == k]]


def kth(q: np.ndarray, s: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th greatest of the positive values of each of ``n`` queries, in single precision; minus infinity for those with fewer."""
    have = np.bincount(q, minlength=n)
    first, out = np.cumsum(have) - have, np.full(n, -np.inf)
    # positive numbers in single precision are in order as integers
    order = np.sort(q << 32 | (0x7FFFFFFF - s.astype(np.float32).view(np.int32).astype(np.int64)))
    out[have >= k] = (0x7FFFFFFF - (order[(first + k - 1)[have >= k]] & 0xFFFFFFFF)).astype(np.int32).view(np.float32)
    return out


class Held:
    """The queries of a task, which are taken out of ``rows``; ``search`` takes blocks of the base, ``best`` gives what is found by then."""

    def __init__(self, rows: list, k: int | None, min_sim: float | None, exclude_self: bool, other_label: bool):
        self.k, self.min_sim, self.exclude_self, self.other_label = k, min_sim, exclude_self, other_label
        self.vocabulary = np.unique(np.concatenate([r.vocabulary for r in rows]))
        self.dense, self.list_of = np.zeros(len(self.vocabulary)), np.full(len(self.vocabulary), -1, np.int32)
        self.side = Side(rows, self.vocabulary)
        self._centres()
        self.groups = [Queries(self.side, x, m) for x, m in self._tiles(self.side)]

    def _tiles(self, side: Side) -> list:
        """(rows, mean of their centres) of the tiles of a side; rows of a label have tiles of their own where labels matter and it has many."""
        near, of = self._near(side), np.zeros(len(side.ids), np.int64)
        if self.other_label:
            of = pd.factorize(side.labels)[0]
            of = np.where((np.bincount(of) < LEAST_ROWS)[of], -1, of)
        return [(x, self.centres[near[x]].mean(axis=0)) for label in np.unique(of) for x in side.tiles(np.flatnonzero(of == label), near)]

    def _centres(self) -> None:
        """Centres of the queries: some rows, moved to the mean of the rows that are nearest."""
        df = np.bincount(self.side.places, minlength=len(self.vocabulary))
        often = np.argsort(-df, kind="stable")[:CENTRE_TERMS]
        self.column = np.full(len(self.vocabulary), -1, np.int32)
        self.column[often] = np.arange(len(often))
        x = self._view(self.side, np.unique(np.linspace(0, len(self.side.ids) - 1, CENTRE_ROWS).astype(np.int64)))
        x = x[(x != 0).any(axis=1)]
        c = x[np.unique(np.linspace(0, max(len(x) - 1, 0), CENTRES).astype(np.int64))[:len(x)]]
        for _ in range(CENTRE_STEPS if len(x) else 0):
            near = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-30)[:, None]
        self.centres = c if len(c) else np.zeros((1, CENTRE_TERMS), np.float32)

    def _view(self, side: Side, rows: np.ndarray) -> np.ndarray:
        x = side.columns(rows, self.column, CENTRE_TERMS)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-30)[:, None]

    def _near(self, side: Side) -> np.ndarray:
        """The nearest centre of every row."""
        parts = np.array_split(np.arange(len(side.ids)), -(-len(side.ids) // TILE_ROWS))
        return np.concatenate([np.argmax(self._view(side, p) @ self.centres.T, axis=1) for p in parts])

    def search(self, rows: list):
        """Search blocks of the base, which are taken out of the list: (query ids, base ids, similarity, rounded) of the pairs that reach the threshold, if there is one."""
        base = Side(rows, self.vocabulary)
        tiles = [Tile(base, x, m) for x, m in self._tiles(base)]
        for g in self.groups:
            self.list_of[g.terms] = np.arange(len(g.terms))
            # what may be among the best: of earlier blocks (base row -1) and of these
            q, b, s, most = g.row_of, np.full(len(g.row_of), -1), g.key, 0.0
            for t in sorted(tiles, key=lambda t: -float(t.middle @ g.middle)):
                if self.other_label and t.label is not None and t.label == g.label:
                    continue
                sums, eps = g.sums(t, self.list_of)
                if self.other_label and (g.label is None or t.label is None):
                    sums[t.labels[:, None] == g.labels[None, :]] = 0.0
                if self.exclude_self:
                    for i, x in enumerate(t.ids):
                        sums[i, g.number.get(x, [])] = 0.0
                flat = np.flatnonzero(sums >= self._cut(g.floor, sums, eps)[None, :])
                if self.k is not None and len(flat) > 8 * self.k * len(g.ids):      # the best so far say little about this tile
                    flat = np.flatnonzero(sums >= self._cut(np.full(len(g.ids), -np.inf), sums, eps)[None, :])
                if not len(flat):
                    continue
                i, j = np.divmod(flat, len(g.ids))
                if self.k is None:
                    yield from self._reached(g, j, t.rows[i], base)
                    continue
                q, b, s, most = np.concatenate([q, j]), np.concatenate([b, t.rows[i]]), np.concatenate([s, sums.reshape(-1)[flat]]), max(most, eps)
                g.floor = np.maximum(g.floor, kth(q, s, self.k, len(g.ids)) * (1 - most) - SLACK)
                keep = s * (1 + 2 * most) >= g.floor[q] - SLACK
                q, b, s = q[keep], b[keep], s[keep]
                if len(q) > MOST_WAITING:
                    self._settle(g, q, b, base)
                    q, b, s, most = g.row_of, np.full(len(g.row_of), -1), g.key, 0.0
            self.list_of[g.terms] = -1
            if self.k is not None:
                self._settle(g, q, b, base)

    def _settle(self, g: Queries, q: np.ndarray, b: np.ndarray, base: Side) -> None:
        """Take the pairs that may be among the best (base row -1: already there) into them."""
        q, b = q[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        q, b = q[order], b[order]
        if len(q):
            sim = self._exact(q, b, g, base)
            g.add(q, base.ids[b], sim, np.round(sim, ROUND), self.k)

    def _cut(self, floor: np.ndarray, sums: np.ndarray, eps: float) -> np.ndarray:
        """The least value, in single precision, that a pair of each query may have."""
        least = floor.copy() if self.k is not None else np.full(len(floor), self.min_sim)
        none = np.isneginf(least)
        if none.any() and len(sums) > self.k:
            least[none] = np.partition(sums[:, none], len(sums) - self.k, axis=0)[len(sums) - self.k] * (1 - eps) - SLACK
        return np.maximum((least - 2 * SLACK) * (1 - 2 * eps), LOWEST).astype(np.float32)

    def _reached(self, g: Queries, q: np.ndarray, b: np.ndarray, base: Side):
        for a in range(0, len(q), MOST_MET):
            sim = self._exact(q[a:a + MOST_MET], b[a:a + MOST_MET], g, base)
            key = np.round(sim, ROUND)
            keep = key >= self.min_sim
            yield g.ids[q[a:a + MOST_MET][keep]], base.ids[b[a:a + MOST_MET][keep]], sim[keep], key[keep]

    def _exact(self, q: np.ndarray, b: np.ndarray, g: Queries, base: Side) -> np.ndarray:
        """Similarities in double precision of pairs, those of one base row in a row."""
        out, rows, mine, dense = np.zeros(len(q)), g.rows[q], self.side, self.dense
        edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else []
        for a, e in zip(edges[:-1], edges[1:]):
            held = slice(base.start[b[a]], base.start[b[a] + 1])
            dense[base.places[held]] = base.weights[held]
            many = mine.sizes[rows[a:e]]
            at = ragged(mine.start[rows[a:e]], many)
            out[a:e] = np.bincount(np.repeat(np.arange(e - a), many), dense[mine.places[at]] * mine.weights[at], e - a)
            dense[base.places[held]] = 0.0
        return out

    def best(self):
        """(query ids, base ids, similarity, rounded) of the k best rows of all queries."""
        for g in self.groups:
            if len(g.row_of):
                yield g.ids[g.row_of], g.bid, g.sim, g.key
