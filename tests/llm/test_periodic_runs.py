"""Periodic runs against brute force: every period, every start."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from spreadlens.llm import periodic_runs
from spreadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def smallest_period(w):
    """By the failure function."""
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def plain_runs(w, min_words=6, exponent=4):
    """Every maximal stretch of equal words q apart, for every q; kept if q is its smallest period."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_words, exponent * q) and smallest_period(w[i:j + q]) == q:
                out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def batches():
    r = np.random.default_rng(0)
    for letters in (1, 2, 2, 2, 3, 4):
        yield [list(r.integers(0, letters, n)) for n in (*range(0, 14), 200, 333)]
    made = []
    for _ in range(60):
        w = list(r.integers(0, 50, r.integers(0, 20)))
        for _ in range(r.integers(1, 4)):
            unit = list(r.integers(0, r.integers(1, 5), r.integers(1, 25)))
            w += (unit * 7)[: int(len(unit) * r.uniform(2.5, 7))] + list(r.integers(0, 50, r.integers(0, 5)))
        made.append(w)
    yield made
    # nested runs, and periods whose short grams all occur twice in a period
    a, b = [0] * 6 + [1], [1] * 5 + [0, 1, 2] * 5
    yield [(a * 5 + [2]) * 5, (b * 4 + a * 4) * 4, [0, 0, 1, 0, 1, 1] * 9 + [0, 0, 1] * 9, ([0] * 5 + [1]) * 3 + [0] * 5]
    order = [0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 1, 0, 0, 1, 0, 1, 0, 0, 1, 1, 1, 0, 1, 0, 1, 1, 0, 1, 1, 1, 1, 1]
    yield [(order + order[5:] + order[:5]) * 4, (order + order[::-1]) * 6]


@pytest.mark.parametrize("rule", [(6, 4), (2, 4), (9, 3), (40, 5), (1, 10)])
def test_runs_equal_brute_force(rule):
    for docs in batches():
        codes, counts = np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs])
        first = np.cumsum(counts) - counts
        want = [(int(f) + s, n, q) for d, f in zip(docs, first) for s, n, q in plain_runs(d, *rule)]
        assert periodic_runs.find_runs(codes, counts, *rule) == sorted(want, key=lambda r: (r[0], r[2]))


def test_runs_survive_colliding_hashes(monkeypatch):
    class Zero:
        def integers(self, low, high, n, kind):
            return np.full(n, 1 << 63, kind)      # odd multiples of one number: grams collide by the sum of their words

    docs = next(batches())[:] + [[0, 1, 2] * 9, [2, 1, 0] * 9 + [1, 0, 2] * 3]
    codes, counts = np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs])
    want = periodic_runs.find_runs(codes, counts)
    monkeypatch.setattr(np.random, "default_rng", lambda seed: Zero())
    assert periodic_runs.find_runs(codes, counts) == want and want


def test_one_long_run_takes_few_extensions(monkeypatch):
    calls, real = [], periodic_runs.reach
    monkeypatch.setattr(periodic_runs, "reach", lambda *a: calls.append(a) or real(*a))
    codes = np.tile(np.arange(3), 40_000)
    assert periodic_runs.find_runs(codes, np.array([len(codes)])) == [(0, 120_000, 3)] and len(calls) == 2


def test_columns_and_odd_rows(spark):
    texts = [None, "", " \t\n ", "a", "a a a a a a", "x " * 9, "ä b\x0bä b ä b ä b", "no\x1crun\x85here", "1 2 3 4 5 6", "q" * 5000, ("long " * 4000 + "tail ") * 3]
    rows = [(i, t, "mine", 1, "keep") for i, t in enumerate(texts)] + [(4, "a a a a a a", "mine", 1, "keep"), (None, "b b b b b b b", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, Words int, _runs string")
    out = periodic_runs.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "_runs", "words", "runs", "collapsed"]
    got = Counter((r.doc_id, r._runs, r.words, tuple(map(tuple, r.runs)), r.collapsed) for r in out.collect())
    want = Counter()
    for i, t, _, _, keep in rows:
        w = (t or "").encode().split()
        runs = plain_runs(w)
        want[i, keep, len(w), tuple(runs), plain_collapsed(w, runs)] += 1
    assert got == want
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        # brute force takes time with the square of the words; the few longer texts go through the tested search
        runs = plain_runs(w) if n <= 4000 else periodic_runs.find_runs(np.unique(w, return_inverse=True)[1], np.array([n]))
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[r.doc_id] = (
            len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_collapsed(w, runs)),
        )
    assert got == want and any(x[0] for x in want.values())
