"""The held side of a search against brute force, and what reaches a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.operators import blocks, held, routed


def rows(rng, ids, labels=None, most=30, width=400):
    """Rows as a stored block has them: unit weights of terms, some frequent, some of one row only."""
    r = blocks.Rows.__new__(blocks.Rows)
    r.ids = np.array(ids)
    r.labels = np.array(labels if labels is not None else ["a"] * len(ids), dtype=object)
    terms = [np.unique(np.r_[rng.choice(12, 3), rng.choice(width, rng.integers(1, most)), 10_000 + rng.integers(0, 10**6)]) for _ in ids]
    weights = [rng.random(len(t)) + 0.01 for t in terms]
    r.sizes = np.array([len(t) for t in terms], np.int32)
    r.vocabulary, places = np.unique(np.concatenate(terms), return_inverse=True)
    r.places, r.weights = places.astype(np.int32), np.concatenate([w / np.linalg.norm(w) for w in weights])
    return r


def matrix(blocks_of, width=10_000 + 10**6):
    at = {}
    for r in blocks_of:
        start = np.r_[0, np.cumsum(r.sizes)]
        for n, i in enumerate(r.ids):
            at[int(i)] = (dict(zip(r.vocabulary[r.places[start[n]:start[n + 1]]].tolist(), r.weights[start[n]:start[n + 1]])), r.labels[n])
    return at


def brute(q, b, k, ok):
    out = {}
    for i, (mine, label) in matrix(q).items():
        sims = [(-round(sum(w * of[t] for t, w in mine.items() if t in of), 9), j) for j, (of, other) in matrix(b).items() if ok(i, label, j, other)]
        out[i] = [(j, -s) for s, j in sorted(sims)[:k] if s < 0]
    return out


def searched(h, parts):
    for p in parts:
        assert list(h.search(p)) == []
    out = {}
    for x in h.best():
        for i, j, _, key in zip(*x):
            out.setdefault(int(i), []).append((int(j), float(key)))
    return {i: sorted(x, key=lambda p: (-p[1], p[0])) for i, x in out.items()}


@pytest.mark.parametrize("limits", [(1024, 1 << 17, 1 << 19, 192), (16, 50, 40, 4), (7, 1, 1, 1)])
@pytest.mark.parametrize("hot", [1, 10**9])
def test_best_equal_brute_force(monkeypatch, limits, hot):
    for name, x in zip(("TILE_ROWS", "MOST_MET", "MOST_WAITING", "LEAST_ROWS"), limits):
        monkeypatch.setattr(held, name, x)
    monkeypatch.setattr(held, "HOT_FACTOR", hot)        # all terms by lists, or as matrices
    rng = np.random.default_rng(limits[0])
    q = [rows(rng, range(a, a + 40), rng.choice(["x", "y", "z"], 40)) for a in (0, 40)]
    b = [rows(rng, range(a, a + 50), rng.choice(["x", "y", "z"], 50)) for a in (60, 110, 160)]
    b[2].ids, b[2].labels, b[2].sizes, b[2].vocabulary, b[2].places, b[2].weights = b[1].ids + 50, b[1].labels, b[1].sizes, b[1].vocabulary, b[1].places, b[1].weights     # ties
    for self_too, label in ((False, False), (True, False), (False, True)):
        got = searched(held.Held(q[:], 4, None, self_too, label), [b[:2], b[2:]])
        want = brute(q, b, 4, lambda i, own, j, other: not (self_too and i == j) and not (label and own == other))
        assert got == {i: [(j, pytest.approx(s, abs=1.5e-9)) for j, s in x] for i, x in want.items() if x}


def test_threshold_equals_brute_force():
    rng = np.random.default_rng(9)
    q, b = [rows(rng, range(50))], [rows(rng, range(100, 160)), rows(rng, range(200, 260))]
    h = held.Held(q[:], None, 0.3, False, False)
    got = {(int(i), int(j)) for qid, bid, _, _ in h.search(b[:]) for i, j in zip(qid, bid)}
    assert got == {(i, j) for i, x in brute(q, b, 120, lambda *_: True).items() for j, s in x if s >= 0.3} and got


def test_queries_without_a_common_term_have_a_centre():
    r = blocks.Rows.__new__(blocks.Rows)
    r.ids, r.labels, r.sizes = np.arange(9000), np.array(["a"] * 9000, dtype=object), np.ones(9000, np.int32)
    r.vocabulary, r.places, r.weights = np.arange(9000)[::1], np.arange(8999, -1, -1, dtype=np.int32), np.ones(9000)
    assert searched(held.Held([r], 2, None, False, False), [[r]]) == {i: [(i, 1.0)] for i in range(9000)}


def test_each_block_reaches_a_task_once(spark):
    kind = blocks.schema("bigint")
    of = lambda n: spark.range(n).select(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("number", "n") else F.col("id").alias(f.name)
                                                    for f in spark.createDataFrame([], kind).schema]).alias("x")).select("x.*")
    got = routed._pairs(of(12).coalesce(1), of(30).coalesce(1)).select("b_number", "q_number", "b_n", "q_n").collect()
    assert len(got) == 12 + 30 - 1               # not 12 x 30
    assert [r.b_n for r in got if r.b_n is not None] == list(range(12)) and sorted(r.q_n for r in got if r.q_n is not None) == list(range(30))
    assert all(r.b_number == 0 for r in got[:30])        # all queries come before the second block of the base
    many = routed._pairs(of(12).repartition(3), of(30).repartition(2)).collect()
    assert len(many) == 2 * 12 + 3 * 30 - 6


def test_tasks_hold_bounded_queries_and_few_copies():
    assert routed._dealt(30, 250_000, 1_000_000, 75_000_000, 100, 8) == (25, 2)
    assert routed._dealt(4, 20_000, 80_000, 6_000_000, 10, 8) == (3, 11)
    assert routed._dealt(1, 10, 10, 100, 1, 8) == (1, 32)
