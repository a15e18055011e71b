"""Periodic runs of words, by seed and extend along diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least ``min_words``
words and ``exponent`` periods, that no neighbouring word extends. Two copies of it, q words apart, overlap in its
length less q words, so a run shows up as a k-gram that occurs again q words later, k being the least such overlap.

* Seeds. Periods are taken in ranges from ``low`` to ``high``, each with its own k: the overlap that every period of
  the range guarantees, at least 2 * high. An occurrence of a run's k-gram less than q words after another would then
  give the run a smaller period, so the copy q words later is the next occurrence in the document: of the pairs of
  occurrences of a gram only neighbouring ones are made, as many as there are words, however often a gram occurs.
* Grams. The first k-grams are sorted by a hash and compared word by word; those of each next k are pairs of
  overlapping grams of the k before, by their exact numbers. Only grams that occur again in their document go on, so
  texts without repeats are done after the first range.
* Extension. The seeds of a lag (a diagonal) are taken in order of place; a table keeps for each lag how far it is
  covered, and a seed inside that is skipped. Others are extended to both sides by comparing words.

A batch of documents is one array of word numbers and no gram crosses a document, so the work on a text is nearly
linear in its words whatever it repeats, and memory is some hundred bytes a word of the batch or longest text.

Nulls: a null text is an empty one, without words and runs. Repeated rows have runs each. An empty table gives no rows.
The columns of the input are kept; those named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, free_name, small_batches, utf8, whole_text

MIN_WORDS = 6
EXPONENT = 4
#: Words compared at once by an extension, doubled as it goes on.
REACH = 64
RESULT = "struct<words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def ranges(longest: int, min_words: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, k): ranges of periods, and the least overlap of the copies of runs of such periods."""
    low = 1
    while max(min_words, exponent * low) <= longest:
        high, k = low, max(min_words - low, (exponent - 1) * low)
        while (more := min(k, max(min_words - high - 1, (exponent - 1) * (high + 1)))) >= 2 * (high + 1):
            high, k = high + 1, more
        yield low, high, k
        low = high + 1


def numbered(order, new):
    """Places in order of their gram and place, and the number of their gram, of grams that occur again."""
    import numpy as np

    again = ~(new & np.append(new[1:], True))
    return order[again], (np.cumsum(new) - 1)[again]


def first_grams(codes, ends, row, k: int):
    """(places, gram numbers) of the k-grams that occur again in their row."""
    import numpy as np

    place = np.flatnonzero(np.arange(len(codes)) + k <= ends)
    random = np.random.default_rng(11).integers(0, 1 << 62, k + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    keys = row[place].astype(np.uint64) * random[k]
    for j in range(k):
        keys += (codes[place + j].astype(np.uint64) + np.uint64(1)) * random[j]
    by = np.argsort(keys, kind="stable")
    order, keys = place[by], keys[by]

    def differ(a, b):
        out = row[a] != row[b]
        for j in range(k):
            out |= codes[a + j] != codes[b + j]
        return out

    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    same = np.flatnonzero(~new)
    if differ(order[same], order[same - 1]).any():      # two grams of one hash: sort by the words themselves
        order = place[np.lexsort([codes[place + j] for j in range(k - 1, -1, -1)] + [row[place]])]
        new[1:] = differ(order[1:], order[:-1])
    return numbered(order, new)


def longer_grams(place, gram, ends, at, k: int, more: int):
    """The same for grams of ``more`` words, at most 2 * k, from those of ``k`` words. ``at`` is room for gram numbers."""
    import numpy as np

    at[place] = gram
    go = place + more <= ends[place]
    go[go] = at[place[go] + more - k] >= 0
    here = np.sort(place[go])
    keys = at[here] * (gram[-1] + 1 if len(gram) else 1) + at[here + more - k]
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    at[place] = -1
    return numbered(here[order], new)


def reach(codes, at: int, lag: int, stop: int, step: int) -> int:
    """From ``at`` on (``step`` 1) or before it (-1), the first place whose word differs from that ``lag`` later, or ``stop``."""
    import numpy as np

    n = REACH
    while at != stop:
        a, b = (at, min(at + n, stop)) if step > 0 else (max(at - n, stop), at)
        bad = np.flatnonzero(codes[a:b] != codes[a + lag:b + lag])
        if len(bad):
            return a + int(bad[0]) if step > 0 else a + int(bad[-1]) + 1
        at, n = (b if step > 0 else a), 2 * n
    return at


def extended(codes, begins, ends, place, lag) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the stretches around seeds, given in order of lag and place."""
    import numpy as np

    covered: dict[int, int] = {}
    i = 0
    while i < len(place):
        at, q = int(place[i]), int(lag[i])
        if at >= covered.get(q, 0):
            right = reach(codes, at, q, int(ends[at]) - q, 1)
            left = reach(codes, at, q, int(begins[at]), -1)
            covered[q] = right
            yield left, right - left + q, q
        to = int(np.searchsorted(lag, q, "right"))
        i += int(np.searchsorted(place[i:to], covered[q]))


def find_runs(codes, counts, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. ``codes`` are the word numbers of all rows, ``counts``
    the words of each row, starts are places in ``codes``."""
    import numpy as np

    if exponent < 3:
        raise ValueError("runs of at least three periods are asked for")
    stops = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    ends, begins = np.repeat(stops, counts), np.repeat(stops - counts, counts)
    at, found, have = np.full(len(codes), -1, np.int64), [], 0
    for low, high, k in ranges(int(counts.max(initial=0)), min_words, exponent):
        if not have:
            place, gram = first_grams(codes, ends, row, k)
            have = k
        while have < k:
            more = min(2 * have, k)
            place, gram = longer_grams(place, gram, ends, at, have, more)
            have = more
        if not len(place):
            break
        lag = np.diff(place)
        seed = np.flatnonzero((gram[1:] == gram[:-1]) & (lag >= low) & (lag <= high))
        order = np.lexsort((place[seed], lag[seed]))
        found += [r for r in extended(codes, begins, ends, place[seed][order], lag[seed][order]) if r[1] >= max(min_words, exponent * r[2])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def analysed(text, min_words: int, exponent: int):
    """The struct array of RESULT for a batch of texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    word, counts = byte_words(*utf8(text))
    codes = word.dictionary_encode().indices.to_numpy() if len(word) else np.zeros(0, np.int32)
    found = np.array(find_runs(codes, counts, min_words, exponent), np.int64).reshape(-1, 3)
    first = np.r_[0, np.cumsum(counts)]
    row = np.searchsorted(first, found[:, 0], "right") - 1
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    lists = lambda values, per_row: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_row)], pa.int32()), values)
    run = pa.StructArray.from_arrays([pa.array(found[:, 0] - first[row]), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["start", "length", "period"])
    left = np.diff(np.r_[0, np.cumsum(keep)][first])
    return pa.StructArray.from_arrays(
        [
            pa.array(counts.astype(np.int64)), lists(run, np.bincount(row, minlength=len(counts))),
            pc.binary_join(lists(word.filter(pa.array(keep)), left), b" ").cast(pa.string()),
        ],
        names=["words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``words`` (their number), ``runs`` by start and period, and ``collapsed``: the words, joined by blanks,
    without those that a run holds after its first period."""
    small_batches(docs.sparkSession)
    names = ["words", "runs", "collapsed"]
    made = free_name(docs, "_runs")

    @F.arrow_udf(RESULT)
    def run(texts):
        return analysed(texts, min_words, exponent)

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.withColumn(made, run(whole_text(text))).select(*kept, *[F.col(f"{made}.{c}").alias(c) for c in names])
