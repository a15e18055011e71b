"""Exact removal of byte windows that occur more than once: a depth-limited radix sort of suffixes, most significant
digit first.

Suffixes count as ordered once their first ``threshold`` bytes are; equal groups at that depth are exactly the
repeated windows. A distributed digit pass is a grouping: suffixes that are alone in their group are finished and
drop out, the others go on with their next digit. Digits are hashes of byte runs.

* Sampling. Sorting every suffix would move several times the corpus, so the first passes sort one representative
  for a run of neighbouring window starts. Every window of ``threshold`` bytes has an anchor: the place of the least
  hash among its ``DIGIT``-byte substrings (the leftmost of equals). Equal windows have their anchor at the same
  offset, so only windows with equal anchor digits can be equal; the starts that share an anchor form a run.
* First digit: the anchor's substring. Runs alone with their digit hold no repeated window.
* Second digit: the whole span of the run (bytes from its first start to the end of its last window, and where the
  anchor lies in it). If all runs of a group agree, all of their windows are repeated, at any group size.
* Last digit, for groups that split (context differs around a shared passage): one run of each distinct span goes
  on with its bytes, which give the 128-bit digit of each of its windows. Equal windows have equal first digits, so a
  group is resolved where it stands; groups of more than ``MAX_GROUP`` distinct spans are spread over the cluster
  by the last digit instead. A span that occurs twice has only repeated windows; its runs are found by a join on the
  span, where spans of more than ``HOT_SHARE`` of all runs (by that share fewer than 1,024) meet them without a shuffle.

Nulls: a null text is empty. Rows are told apart by doc_id and text; a repeated row repeats all windows. Texts below the
threshold have no window. An empty table gives no rows; extra columns are kept by ``without_repeats`` and else ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, free_shuffles, release, small_batches, stage, utf8, whole_text

THRESHOLD = 200
DIGIT = 64
#: Window starts handled at once.
PIECE = 1 << 16
#: Span texts compared at once, and the group size beyond which windows are spread over the cluster one by one.
GATHER = 4096
MAX_GROUP = 4096
#: Spans that hold more than this share of all runs are joined by broadcast: there are fewer than its inverse of them.
HOT_SHARE = 1 / 1024

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MIX = 0xBF58476D1CE4E5B9
PLACE_BITS = 20


def byte_values(seed: int):
    """A pseudo-random odd 64-bit value for each byte."""
    import numpy as np

    raw = b"".join(hashlib.blake2b(bytes([seed, b]), digest_size=8).digest() for b in range(256))
    return np.frombuffer(raw, np.uint64) | np.uint64(1)


class Rolling:
    """Hashes of any byte runs of a buffer from sums of weighted prefixes, modulo 2**64."""

    _powers: dict = {}

    def __init__(self, data, which: int):
        import numpy as np

        n = len(data)
        if which not in self._powers or len(self._powers[which][0]) < n:
            size = max(n, PIECE + 4 * THRESHOLD)
            with np.errstate(over="ignore"):
                up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASES[which], np.uint64)], dtype=np.uint64)
                down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(BASES[which], -1, 1 << 64), np.uint64)], dtype=np.uint64)
            self._powers[which] = up, down, byte_values(which)
        up, self.down, values = self._powers[which]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * up[:n], dtype=np.uint64, out=self.sums[1:])

    def runs(self, start, end):
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, length: int):
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def mixed(x):
    """Spread the bits of a hash."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def window_minimum(keys, width: int):
    """The least of every ``width`` neighbouring keys, by doubling."""
    import numpy as np

    have, m = 1, keys
    while have * 2 <= width:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have:]) if have < width else m


def pieces(offsets, threshold: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Cut the rows of a buffer in pieces of about PIECE bytes: (from, to, [(row, from, to)]). Long rows are cut with an
    overlap of a window, so each window lies in one piece."""
    rows, base = [], None
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        if b - a < threshold:
            continue
        if rows and b - base > PIECE:
            yield base, rows[-1][2], rows
            rows = []
        while b - a >= threshold:
            to = min(b, a + PIECE + threshold - 1)
            if not rows:
                base = a
            rows.append((row, a, to))
            if to == b:
                break
            yield base, to, rows
            rows, a = [], to - threshold + 1
    if rows:
        yield base, rows[-1][2], rows


def anchor_runs(data, offsets, threshold: int = THRESHOLD):
    """Arrays (row, start, count, first digit, second digit) of the runs of window starts that share an anchor."""
    import numpy as np

    width, out = threshold - DIGIT + 1, []
    for base, to, rows in pieces(offsets, threshold):
        buf = data[base:to]
        n_starts = len(buf) - threshold + 1
        first, second = Rolling(buf, 0), Rolling(buf, 1)
        digits = first.all(DIGIT)
        place = np.uint64((1 << PLACE_BITS) - 1)
        keys = (mixed(digits) & ~place) | np.arange(len(digits), dtype=np.uint64)
        anchor = (window_minimum(keys, width) & place).astype(np.int64)
        edge = np.zeros(n_starts + 1, np.int64)
        begin = np.array([a - base for _, a, _ in rows])
        np.add.at(edge, begin, 1)
        np.add.at(edge, np.array([b - base - threshold + 1 for _, _, b in rows]), -1)
        valid = np.cumsum(edge[:-1]) > 0
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
        s, e = np.flatnonzero(new), np.flatnonzero(last)
        who = np.searchsorted(begin, s, "right") - 1
        span = mixed(second.runs(s, e + threshold) ^ mixed(((anchor[s] - s) * 4096 + (e - s)).astype(np.uint64)))
        row = np.array([r for r, _, _ in rows])[who]
        out.append((row, s + base - offsets[row], e - s + 1, digits[anchor[s]].view(np.int64), span.view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def runs(docs: DataFrame, threshold: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            row, start, count, gram, span = anchor_runs(*utf8(b.column("text")), threshold)
            keys = b.column("_k").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row], pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(gram, pa.int64()), pa.array(span, pa.int64())],
                names=["_k", "start", "count", "gram", "span"],
            )

    return docs.mapInArrow(run, "_k long, start int, count int, gram long, span long")


def span_texts(asked: DataFrame, threshold: int) -> DataFrame:
    """(gram, _k, start, count, n, bytes) of the asked runs, their bytes cut from the texts."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            data, offsets = utf8(b.column("text"))
            ask = b.column("ask")
            rows = pc.list_parent_indices(ask).to_numpy()
            items = pa.RecordBatch.from_struct_array(ask.flatten())
            first = offsets[rows] + items.column("start").to_numpy()
            length = items.column("count").to_numpy().astype(np.int64) + threshold - 1
            ends = np.cumsum(length)
            take = np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
            cuts = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data[take])])
            yield pa.RecordBatch.from_arrays(
                [items.column("gram"), b.column("_k").take(pa.array(rows)), *(items.column(c) for c in ("start", "count", "n")), cuts.cast(pa.binary())],
                names=["gram", "_k", "start", "count", "n", "bytes"],
            )

    return asked.mapInArrow(run, "gram long, _k long, start int, count int, n int, bytes binary")


def window_digits(rows, threshold: int):
    """For a batch of span texts: (span of each window, its start, its two digits)."""
    import numpy as np

    data, _ = utf8(rows.column("bytes"))
    count = rows.column("count").to_numpy().astype(np.int64)
    ends, wins = np.cumsum(count + threshold - 1), np.cumsum(count)
    span = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(span)) - np.repeat(wins - count, count)
    at = (ends - count - threshold + 1)[span] + inside
    start = rows.column("start").to_numpy()[span] + inside.astype(np.int32)
    return span, start, Rolling(data, 0).all(threshold)[at], Rolling(data, 1).all(threshold)[at]


def repeated_in_groups(rows, threshold: int):
    """Runs (_k, start, count) of the windows that occur again among the span texts of a batch holding whole groups;
    only for spans that occur once, since all windows of the others are repeated."""
    import numpy as np
    import pyarrow as pa

    span, start, d1, d2 = window_digits(rows, threshold)
    many = rows.column("n").to_numpy() > 1
    order = np.lexsort((d2, d1))
    same = (d1[order][1:] == d1[order][:-1]) & (d2[order][1:] == d2[order][:-1])
    twice = np.zeros(len(span), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= ~many[span]
    new, last = twice.copy(), twice.copy()
    new[1:] &= ~twice[:-1] | (span[1:] != span[:-1])
    last[:-1] &= ~twice[1:] | (span[1:] != span[:-1])
    s, e = np.flatnonzero(new), np.flatnonzero(last)
    return pa.RecordBatch.from_arrays(
        [rows.column("_k").take(pa.array(span[s])), pa.array(start[s]), pa.array((e - s + 1).astype(np.int32))], names=["_k", "start", "count"]
    )


def resolve(spans: DataFrame, threshold: int) -> DataFrame:
    """(_k, start, count) of the repeated windows of the groups; the groups come whole, one after another."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def flush(last: bool):
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gram = rows.column("gram").to_numpy()
            stop = len(gram) if last else int(np.searchsorted(gram, gram[-1], "left"))
            held[:] = [] if last else [rows.slice(stop)]
            return rows.slice(0, stop)

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= GATHER and (done := flush(False)).num_rows:
                yield repeated_in_groups(done, threshold)
                n = held[0].num_rows
        if n:
            yield repeated_in_groups(flush(True), threshold)

    return spans.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "_k long, start int, count int")


def windows(spans: DataFrame, threshold: int) -> DataFrame:
    """(_k, start, d1, d2, weight, open): each window of the span texts with its 128-bit digit."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            span, start, d1, d2 = window_digits(b, threshold)
            n = b.column("n").to_numpy()[span]
            yield pa.RecordBatch.from_arrays(
                [b.column("_k").take(pa.array(span)), pa.array(start), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32)), pa.array(n == 1)],
                names=["_k", "start", "d1", "d2", "weight", "open"],
            )

    return spans.mapInArrow(run, "_k long, start int, d1 long, d2 long, weight int, open boolean")


def keyed(docs: DataFrame, name: str = "_k") -> DataFrame:
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), whole_text()))


def runs_of_spans(split: DataFrame, spans: DataFrame) -> DataFrame:
    """The runs of ``split`` whose span occurs more than once. No task gets more than ``HOT_SHARE`` of all runs for one span:
    the spans beyond it are few by that very share and are broadcast, the others are joined by a shuffle."""
    key = ["gram", "span"]
    limit = (spans.agg(F.sum("runs")).first()[0] or 0) * HOT_SHARE
    many = spans.where("n > 1")
    hot = F.broadcast(many.where(F.col("runs") > limit).select(*key))
    cold = many.where(F.col("runs") <= limit).select(*key)
    return split.join(hot, key, "left_semi").union(split.join(hot, key, "left_anti").join(cold, key, "left_semi"))


def repeated_ranges(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(_k, ranges): for each row key the byte ranges (start, end) that repeated windows cover."""
    if threshold <= DIGIT:
        raise ValueError(f"windows of more than {DIGIT} bytes are asked for")
    spark = docs.sparkSession
    free_shuffles(spark)
    small_batches(spark)
    texts = keyed(docs).select("_k", whole_text().alias("text"))
    found = stage(runs(texts, threshold), "op7-runs")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    # written first: the join then deals out both sides anew, and a digit that many runs share can be split
    grams = stage(grams.where("n > 1").select("gram", (F.col("lo") == F.col("hi")).alias("alike")), "op7-grams")
    again = stage(found.join(grams, "gram"), "op7-again")
    release(found)
    release(grams)
    split = again.where("not alike")
    spans = split.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(F.struct("_k", "start", "count")).alias("r"))
    spans = stage(spans.select("gram", "span", F.least("n", F.lit(2)).cast("int").alias("n"), F.col("n").alias("runs"), "r.*"), "op7-spans")
    ask = spans.groupBy("_k").agg(F.collect_list(F.struct("gram", "start", "count", "n")).alias("ask"))
    cuts = stage(span_texts(texts.join(ask, "_k"), threshold), "op7-cuts")
    large = cuts.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > MAX_GROUP).select("gram")
    large = stage(large, "op7-large")
    single = resolve(cuts.join(large, "gram", "left_anti"), threshold)
    # a group of very many spans is spread by its last digits over the cluster
    win = stage(windows(cuts.join(large, "gram", "left_semi"), threshold), "op7-windows")
    digits = win.groupBy("d1", "d2").agg(F.sum("weight").alias("w")).where("w > 1").select("d1", "d2")
    spread = win.where("open").join(digits, ["d1", "d2"], "left_semi").select("_k", "start", F.lit(1).alias("count"))
    twice = runs_of_spans(split, spans).select("_k", "start", "count")
    alike = again.where("alike").select("_k", "start", "count")
    covered = alike.union(twice).union(single).union(spread)
    end = (F.col("start") + F.col("count") - 1 + threshold).alias("end")
    ranges = stage(covered.groupBy("_k").agg(F.sort_array(F.collect_set(F.struct("start", end))).alias("ranges")), "op7-ranges")
    for done in (again, spans, cuts, large, win):
        release(done)
    return ranges


def merged(ranges: list) -> list[tuple[int, int]]:
    """Union of sorted ranges, touching ones as one."""
    out: list[list[int]] = []
    for r in ranges:
        a, b = r["start"], r["end"]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def removals(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Every row with ``spans`` (the maximal removed byte runs) and ``kept`` (the remaining bytes)."""
    ranges = repeated_ranges(docs, threshold)
    joined = keyed(docs.select("doc_id", "text")).join(ranges, "_k", "left").select("doc_id", F.encode(whole_text(), "utf-8").alias("text"), "ranges")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            spans = [merged(r or []) for r in b.column("ranges").to_pylist()]
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([cut(t, s) for t, s in zip(texts, spans)], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the repeated windows cut from ``text`` (a character that loses a byte goes whole)."""
    key, found = free_name(docs, "_k"), free_name(docs, "_ranges")
    ranges = repeated_ranges(docs.select("doc_id", "text"), threshold).select(F.col("_k").alias(key), F.col("ranges").alias(found))

    @F.pandas_udf("string")
    def shorten(texts, found):
        import pandas as pd

        return pd.Series([t if r is None or not len(r) else cut(t.encode(), merged(r)).decode("utf-8", "ignore") for t, r in zip(texts, found)])

    joined = keyed(docs, key).join(ranges, key, "left")
    new = F.when(F.col(found).isNull(), F.col("text")).otherwise(shorten(whole_text(), F.col(found)))
    cols = [F.col(f"`{c}`") if c != "text" else new.alias("text") for c in docs.columns]
    return joined.select(*cols)
