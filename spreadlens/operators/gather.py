"""Requests with the rows that they picked, where many requests pick the same rows.

Requests are dealt into shares by a hash of their id, some ``SHARE_PICKS`` picks each. A picked row travels once to each
share that asks for it, however many requests of the share picked it, and however many cells a request is for: what is
shuffled are the distinct (share, row) pairs and the requests, not one copy of a row for each pick. The rows that are picked
at all are stored first, so that the shuffle of all rows that finds them is gone before the shares are dealt. A task holds the rows of
one share, lets its requests stream past and hands them on in small batches, so neither the requests with their rows nor
anything made of these is ever shuffled or stored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from . import routed

#: Picks of a share on average, and the least that a share is cut off for to keep all cores busy.
SHARE_PICKS = 4096
LEAST_PICKS = 256
#: Bytes of an output batch, but for a single longer request.
BATCH_BYTES = 4 << 20


def _bytes(rows) -> np.ndarray:
    """Bytes of the strings of every row of a struct array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.full(len(rows), 64, np.int64)
    for i in range(rows.type.num_fields):
        if pa.types.is_string(rows.type.field(i).type):
            size += pc.fill_null(pc.binary_length(rows.field(i)), 0).to_numpy(zero_copy_only=False)
    return size


def _joined(names: list[str], fields: list[str], row_fields: list[str]):
    """A map of Arrow batches (share, side, id, held, own, picks) that lie by share, its rows before its requests."""
    def run(batches):
        import pyarrow as pa

        now, pieces, rows, at, size = None, [], None, {}, None
        for b in batches:
            shares, sides = b.column("share").to_numpy(), b.column("side").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (np.diff(shares) != 0) | (np.diff(sides) != 0), True]) if len(shares) else [0]
            for a, e in zip(cuts[:-1], cuts[1:]):
                if shares[a] != now:
                    now, pieces, rows = shares[a], [], None
                if sides[a] == 0:
                    pieces.append((b.column("id").slice(a, e - a), b.column("held").slice(a, e - a)))
                    continue
                if rows is None:
                    at = {}
                    for n, i in enumerate(x for ids, _ in pieces for x in ids.to_pylist()):
                        at.setdefault(i, []).append(n)
                    rows = pa.concat_arrays([h for _, h in pieces]) if pieces else b.column("held").slice(0, 0)
                    size, pieces = _bytes(rows), []
                own, picks = b.column("own").slice(a, e - a), b.column("picks").slice(a, e - a).to_pylist()
                low, found, total = 0, [], 0
                for i, mine in enumerate(picks):
                    found.append([(p, n) for p in mine or () for n in at.get(p["id"], ())])
                    total += int(sum(size[n] for _, n in found[-1]))
                    if total < BATCH_BYTES and i + 1 < len(picks):
                        continue
                    flat = [x for f in found for x in f]
                    taken = rows.take(pa.array([n for _, n in flat], pa.int64()))
                    kind = b.schema.field("picks").type.value_type
                    cells = [pa.array([p[c] for p, _ in flat], kind.field(kind.get_field_index(c)).type) for c in fields]
                    cells += [taken.field(taken.type.get_field_index(c)) for c in row_fields]
                    ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(cells, [*fields, *row_fields]))
                    part = own.slice(low, i + 1 - low)
                    yield pa.RecordBatch.from_arrays([*[part.field(part.type.get_field_index(c)) for c in names], lists], names=[*names, "picked"])
                    low, found, total = i + 1, [], 0

    return run


def with_rows(requests: DataFrame, picks: DataFrame, rows: DataFrame, share_picks: int = SHARE_PICKS) -> DataFrame:
    """The ``requests`` (doc_id, ...) with ``picked``, an array of struct (the other columns of the pick, those of the row),
    for every pick (doc_id, row_id, ...) of their id and every row (row_id, ...) of the pick; none if there are none. Each row
    of ``requests`` is one row of the result, whether its id is null or repeats."""
    spark = requests.sparkSession
    small_batches(spark)
    rows = routed.staged(rows.join(picks.select("row_id").distinct(), "row_id", "left_semi"), "picked-rows")
    n, cores = picks.count(), spark.sparkContext.defaultParallelism
    shares = max(1, math.ceil(n / share_picks), min(cores, math.ceil(n / LEAST_PICKS)))
    fields = [c for c in picks.columns if c not in ("doc_id", "row_id")]
    row_fields = [c for c in rows.columns if c != "row_id"]
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(shares)).cast("int").alias("share")
    of = picks.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("row_id").alias("id"), *fields)).alias("picks"))
    kind, held = (df.schema[c].dataType for df, c in ((picks, "row_id"), (rows.select(F.struct(*row_fields).alias("held")), "held")))
    asked = requests.select("doc_id", F.struct(*requests.columns).alias("own")).join(of, "doc_id", "left").select(
        share, F.lit(1).alias("side"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast(held).alias("held"), "own", "picks")
    needed = picks.select(share, "row_id").distinct().join(rows, "row_id").select(
        "share", F.lit(0).alias("side"), F.col("row_id").cast(kind).alias("id"), F.struct(*row_fields).alias("held"),
        F.lit(None).cast(asked.schema["own"].dataType).alias("own"), F.lit(None).cast(asked.schema["picks"].dataType).alias("picks"))
    dealt = needed.unionByName(asked).repartitionById(shares, "share").sortWithinPartitions("share", "side")
    typed = lambda df, c: f"{c}:{df.schema[c].dataType.simpleString()}"
    picked = ",".join([*[typed(picks, c) for c in fields], *[typed(rows, c) for c in row_fields]])
    out = ", ".join([*[f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in requests.columns], f"picked array<struct<{picked}>>"])
    return dealt.mapInArrow(_joined(list(requests.columns), fields, row_fields), out)
