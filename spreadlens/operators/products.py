"""The dense similarity cells, how a task takes them one by one, and what both searches share: rounding and the selection of rows."""

from __future__ import annotations

import numpy as np

ROUND = 9
SLACK = 2e-9            # room for rounding when similarities are compared before it
HOT_FACTOR = 1000        # a term goes to the matrix product when its pair count * HOT_FACTOR >= pairs of rows
#: Similarities that count: positive ones.
POSITIVE = float(np.finfo(float).tiny)


def near_best(s: np.ndarray, floor: np.ndarray, k: int, slack: float, lowest: float):
    """(rows, columns) of the values of ``lowest`` or more that reach their row's floor, or, where that is minus infinity,
    the k-th value of the row, less ``slack``."""
    least = floor - slack
    none = np.isneginf(floor)
    if none.any() and s.shape[1] > k:
        least[none] = np.partition(s[none], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack
    return np.nonzero(s >= np.maximum(least, lowest).astype(s.dtype)[:, None])


def best_so_far(found: list, place: np.ndarray, k: int, lowest: float) -> list:
    """The k greatest of every row of ``found`` (row, column, value, rounded) by rounded value, of equals those of the
    least ``place``; sorted so."""
    row, col, sim, key = found
    order = np.lexsort((place[col], -key, row))
    order = order[key[order] >= lowest]
    rows = row[order]
    order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
    return [x[order] for x in (row, col, sim, key)]


def matching(key: np.ndarray, least: float):
    """(rows, columns) of the values of ``least`` or more."""
    return np.nonzero(key >= least)


def streamed(kinds: tuple, rows: int, prepare, search):
    """A map over Arrow batches (cell, side, qid, bid, ...) that come sorted by cell, a cell's base rows (side 0) before its
    queries (side 1). ``prepare`` gets the base rows of a cell, ``search`` that and ``rows`` queries at a time, and yields
    (query ids, base ids, similarities, rounded similarities). A cell without base rows finds nothing."""
    def run(batches):
        import pyarrow as pa

        types = [pa.string() if x == "string" else pa.int64() for x in kinds]
        cell, parts, base, queries, n = None, [], None, [], 0

        def out():
            for q, b, sim, key in search(base, queries):
                yield pa.RecordBatch.from_arrays([pa.array(q.tolist(), types[0]), pa.array(b.tolist(), types[1]), pa.array(sim), pa.array(key)], names=["qid", "bid", "sim", "skey"])

        for batch in batches:
            key = batch.column("cell").to_numpy() * 2 + batch.column("side").to_numpy()
            edges = np.flatnonzero(np.diff(key)) + 1
            for a, e in zip([0, *edges], [*edges, len(key)]):
                if a == e:
                    continue
                if key[a] // 2 != cell:
                    if queries:
                        yield from out()
                    cell, parts, base, queries, n = key[a] // 2, [], None, [], 0
                if key[a] % 2 == 0:
                    parts.append(batch.slice(a, e - a))
                    continue
                if base is None and not parts:
                    continue
                if base is None:
                    base, parts = prepare(parts), []
                while a < e:
                    take = min(rows - n, e - a)
                    queries.append(batch.slice(a, take))
                    a, n = a + take, n + take
                    if n == rows:
                        yield from out()
                        queries, n = [], 0
        if queries:
            yield from out()

    return run
