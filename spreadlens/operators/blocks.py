"""Stored blocks of packed rows: how a task makes them, and how a task reads them back.

A block is one row of a table: (number, label, n, postings, ids, labels, sizes, vocabulary, places, weights). The codes of its
postings are kept once (``vocabulary``, sorted), each posting as its 32-bit place among them and a weight, row after row
(``sizes`` postings each). ``label`` is that of all rows, or null where they have several, which ``labels`` then names.
"""

from __future__ import annotations

import numpy as np

FIELDS = "n bigint, postings bigint, ids array<{}>, labels array<string>, sizes binary, vocabulary binary, places binary, weights binary"
COLUMNS = ["number", "label", "n", "postings", "ids", "labels", "sizes", "vocabulary", "places", "weights"]


def schema(kind: str) -> str:
    return "number bigint, label string, " + FIELDS.format(kind)


def lists(col):
    """(lengths, values) of a list column."""
    return np.diff(col.offsets.to_numpy()), col.flatten().to_numpy()


class Pile:
    """Rows that wait for their block, as slices of Arrow batches."""

    def __init__(self, rows: int, postings: int):
        self.most = rows, postings
        self.pieces, self.n, self.postings = [], 0, 0

    def take(self, batch, ends, a: int, e: int) -> int:
        """Add rows from ``a`` on, up to ``e`` and to what a block may hold; the first row that was not taken."""
        fits = int(np.searchsorted(ends, ends[a] + self.most[1] - self.postings, side="right")) - 1
        z = max(min(e, a + self.most[0] - self.n, fits), a if self.n else a + 1)
        if z > a:
            self.pieces.append(batch.slice(a, z - a))
            self.n, self.postings = self.n + z - a, self.postings + int(ends[z] - ends[a])
        return z

    def add(self, other: Pile) -> None:
        self.pieces, self.n, self.postings = self.pieces + other.pieces, self.n + other.n, self.postings + other.postings
        other.pieces, other.n, other.postings = [], 0, 0

    def full(self) -> bool:
        return self.n >= self.most[0] or self.postings >= self.most[1]

    def block(self, number: int):
        """The block as an Arrow batch of one row; the pile is empty afterwards."""
        import pyarrow as pa

        ids = pa.concat_arrays([p.column("id") for p in self.pieces])
        labels = [x for p in self.pieces for x in p.column("label").to_pylist()]
        one = len(set(labels)) == 1
        parts = [lists(p.column("codes")) for p in self.pieces]
        vocabulary, places = np.unique(np.concatenate([x[1] for x in parts]), return_inverse=True)
        weights = np.concatenate([p.column("weights").flatten().to_numpy() for p in self.pieces])
        held = np.concatenate([x[0] for x in parts]).astype("<i4"), vocabulary.astype("<i8"), places.astype("<i4"), weights.astype("<f8")
        named = pa.array([] if one else labels, pa.string())
        cells = [pa.array([x], kind) for x, kind in ((number, pa.int64()), (labels[0] if one else None, pa.string()), (self.n, pa.int64()), (self.postings, pa.int64()))]
        cells += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, named)]
        cells += [pa.array([x.tobytes()], pa.binary()) for x in held]
        self.pieces, self.n, self.postings = [], 0, 0
        return pa.RecordBatch.from_arrays(cells, names=COLUMNS)


def maker(rows: int, postings: int, own_rows: int):
    """A map of Arrow batches (id, label, codes, weights), sorted by label, to blocks of at most ``rows`` rows and ``postings``
    postings (but for a row that has more by itself). ``own_rows`` rows of a label, or a full block, make blocks of their
    own; the rest share blocks."""
    def run(batches):
        from pyspark import TaskContext

        own, mixed, label, seen, number = Pile(rows, postings), Pile(rows, postings), None, 0, TaskContext.get().partitionId() << 32

        def close():
            """The label's last rows: a block of their own, or a part of a shared one."""
            nonlocal number
            if own.n and seen >= own_rows:
                number += 1
                yield own.block(number)
            elif own.n:
                if mixed.n and (mixed.n + own.n > rows or mixed.postings + own.postings > postings):
                    number += 1
                    yield mixed.block(number)
                mixed.add(own)

        for batch in batches:
            labels, ends = batch.column("label").to_pylist(), batch.column("codes").offsets.to_numpy()
            cuts = [0, *[i for i in range(1, len(labels)) if labels[i] != labels[i - 1]], len(labels)]
            for a, e in zip(cuts[:-1], cuts[1:]):
                if a == e:
                    continue
                if labels[a] != label:
                    yield from close()
                    label, seen = labels[a], 0
                while a < e:
                    z = own.take(batch, ends, a, e)
                    seen += z - a
                    if own.full() or z < e:
                        number += 1
                        yield own.block(number)
                        seen = max(seen, own_rows)
                    a = z
        yield from close()
        if mixed.n:
            number += 1
            yield mixed.block(number)

    return run


class Rows:
    """The rows of a stored block, read from row ``i`` of an Arrow batch whose columns have a prefix."""

    def __init__(self, batch, i: int, prefix: str):
        of = lambda name: batch.column(prefix + name)[i]
        binary = lambda name, kind: np.frombuffer(of(name).as_buffer(), kind)
        ids, label = of("ids").values, of("label").as_py()
        self.ids = np.array(ids.to_pylist(), dtype=np.int64 if str(ids.type) == "int64" else object)
        self.labels = np.array(of("labels").as_py() if label is None else [label] * len(self.ids), dtype=object)
        self.sizes = binary("sizes", "<i4")
        self.vocabulary, self.places, self.weights = binary("vocabulary", "<i8"), binary("places", "<i4"), binary("weights", "<f8")
