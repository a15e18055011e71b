"""Exact cosine top-k and threshold joins between a query set and a base set.

Sparse vectors (postings) are searched in stored blocks that stream past the queries a task holds, see ``routed``. Dense
vectors have no terms to bound them by and are multiplied in blocks: both sides are split into hash blocks, one task takes
a (query block, base block) cell, holds the base block as a matrix and lets the queries stream past it, some rows at a
time. A query's k-th best similarity so far rules out nearly all values of later products by one comparison, and a cell
emits only its top-k per query row (pairs over a threshold as they are found). Rows are copied once for each block of
the other side; with blocks of ``b_block_rows`` that is few copies at any size that all pairs can be made of. A final
row_number over at most k x (base blocks) rows per query picks the global top-k.

Ranking = (similarity rounded to 9 decimals, descending; base id ascending). Every base row is a candidate, so a
query without any shared term still gets k rows with similarity 0, the lowest ids first, as the reference does.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import routed
from .products import ROUND, SLACK, best_so_far, matching, near_best, streamed


def _block_counts(spark, n_q: int, n_b: int, b_block_rows: int, min_cells: int | None):
    """Block grid (bq x bb): base blocks no larger than the row cap, at least ``min_cells`` cells for parallelism, and
    among such grids the one replicating the fewest rows (n_q * bb + n_b * bq, each side is copied once per block
    of the other side)."""
    lo_b = max(1, math.ceil(n_b / b_block_rows))
    target = min_cells or 2 * spark.sparkContext.defaultParallelism
    best = None
    for bq in range(1, min(max(n_q, 1), target) + 1):
        bb = max(lo_b, min(max(n_b, 1), math.ceil(target / bq)))
        cost = n_q * bb + n_b * bq
        if best is None or cost < best[0]:
            best = (cost, bq, bb)
    return best[1], best[2]


#: Base rows that are multiplied at once, and the least similarity of a pair.
TILE = 2048
LOWEST = float(np.finfo(np.float32).min)


def _unit(pieces: list) -> np.ndarray:
    """The vectors of the pieces as rows of unit length; a zero vector stays one."""
    sizes = np.concatenate([np.diff(p.column("vec").offsets.to_numpy()) for p in pieces])
    if any(p.column("vec").null_count for p in pieces) or len(set(sizes.tolist())) > 1:
        raise ValueError("vectors must not be null and must have one length")
    m = np.concatenate([p.column("vec").flatten().to_numpy(zero_copy_only=False) for p in pieces]).astype(np.float64).reshape(len(sizes), -1)
    n = np.sqrt((m * m).sum(axis=1))
    n[n == 0] = 1.0
    return m / n[:, None]


def _column(pieces: list, name: str) -> np.ndarray:
    return np.array([x for p in pieces for x in p.column(name).to_pylist()], dtype=object)


def _dense_search(kinds: tuple, rows: int, k: int | None, min_sim: float | None, exclude_same_label: bool, exclude_self: bool):
    """Searches of rows that come sorted by cell, a cell's base rows before its queries. A product in single precision rules
    out what is below the threshold by more than its error; the rest is multiplied again in double precision."""
    def found(base, queries):
        bids, blab, b, place, b32 = base
        qids, qlab, q = _column(queries, "qid"), _column(queries, "label"), _unit(queries)
        if q.shape[1] != b.shape[1]:
            raise ValueError("vectors must not be null and must have one length")
        q32, slack = q.astype(np.float32), SLACK + 1.3e-7 * (q.shape[1] + 8)
        odd = not (np.isfinite(q).all() and np.isfinite(b).all())
        same = pd.DataFrame({"id": qids, "q": np.arange(len(qids))}).merge(pd.DataFrame({"id": bids, "b": np.arange(len(bids))}), on="id") if exclude_self else None
        floor, held = np.full(len(qids), -np.inf), [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        for a in range(0, len(bids), TILE):
            s = q32 @ b32[a:a + TILE].T
            if exclude_same_label:
                s[qlab[:, None] == blab[None, a:a + TILE]] = -np.inf
            if same is not None:
                mine = same[(same["b"] >= a) & (same["b"] < a + TILE)]
                s[mine["q"].to_numpy(), mine["b"].to_numpy() - a] = -np.inf
            if odd:
                s[np.isnan(s)] = -np.inf
            i, j = near_best(s, floor, k, slack, LOWEST) if k is not None else matching(s, np.float32(max(min_sim - slack, LOWEST)))
            sim = np.einsum("ij,ij->i", q[i], b[a + j])
            new = [i, a + j, sim, np.round(sim, ROUND)]
            if k is None:
                keep = new[3] >= min_sim
                i, j, sim, key = (x[keep] for x in new)
                yield qids[i], bids[j], sim, key
                continue
            if not len(i):
                continue
            held = best_so_far([np.concatenate(x) for x in zip(held, new)], place, k, LOWEST)
            n = np.bincount(held[0], minlength=len(qids))
            floor[n == k] = held[3][(np.cumsum(n) - 1)[n == k]]
        if k is not None:
            yield qids[held[0]], bids[held[1]], held[2], held[3]

    def base(parts):
        ids = _column(parts, "bid")
        b = _unit(parts)
        return ids, _column(parts, "label"), b, pd.factorize(ids, sort=True)[0], b.astype(np.float32)

    return streamed(kinds, rows, base, found)


def _id_type(df: DataFrame, id_col: str) -> str:
    return "string" if df.schema[id_col].dataType.simpleString() == "string" else "long"


def _dense_cells(query_docs, base_docs, *, k=None, min_sim=None, id_col="doc_id", label_col=None, exclude_same_label=False,
                 exclude_self=False, vec_col=None, q_block_rows=512, b_block_rows=16384, min_cells=None):
    spark = query_docs.sparkSession
    both = query_docs.select(F.lit(0).alias("side")).unionByName(base_docs.select(F.lit(1).alias("side")))
    got = dict(both.groupBy("side").count().collect())          # both side sizes in one job
    bq, bb = _block_counts(spark, got.get(0, 0), got.get(1, 0), b_block_rows, min_cells)
    kinds = _id_type(query_docs, id_col), _id_type(base_docs, id_col)

    def side(docs, number, mine, others):
        own = F.col(id_col).cast(kinds[number])
        label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
        ids = [own if i == number else F.lit(None).cast(kinds[i]) for i in (0, 1)]
        return docs.select(F.lit(1 - number).alias("side"), ids[0].alias("qid"), ids[1].alias("bid"), label.alias("label"), F.col(vec_col).alias("vec"),
                           F.pmod(F.xxhash64(own), F.lit(mine)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"))

    q = side(query_docs, 0, bq, bb).withColumn("cell", F.col("mine") * bb + F.col("other"))
    b = side(base_docs, 1, bb, bq).withColumn("cell", F.col("other") * bb + F.col("mine"))
    dealt = b.unionByName(q).drop("mine", "other").repartitionById(bq * bb, "cell").sortWithinPartitions("cell", "side", "bid")
    run = _dense_search(kinds, q_block_rows, k, min_sim, exclude_same_label, exclude_self)
    return dealt.mapInArrow(run, f"qid {kinds[0]}, bid {kinds[1]}, sim double, skey double")


def exact_topk(query_docs: DataFrame, base_docs: DataFrame, k: int, *, query_vecs: DataFrame | None = None,
               base_vecs: DataFrame | None = None, id_col: str = "doc_id", label_col: str | None = None,
               exclude_same_label: bool = False, exclude_self: bool = False, vec_col: str | None = None,
               index: routed.Index | None = None, shard_rows: int | None = None, **blocks) -> DataFrame:
    """(qid, bid, sim, skey, rank) — the k best base rows of every query row (rank 1 = most similar).

    Sparse input: ``*_docs`` (id[, label]) + ``*_vecs`` (doc_id, term, weight) L2-normalised, and optionally the base's
    ``index``. Dense input: ``vec_col`` names an array column of ``*_docs`` (normalised here). ``exclude_same_label``
    keeps only base rows whose label differs from the query row's (the contrastive partner search); ``exclude_self``
    drops the pair of a row with itself (a set against itself)."""
    if vec_col is None:
        index = index or routed.build(base_docs, base_vecs, id_col, label_col, shard_rows)
        return routed.topk(query_docs, query_vecs, index, k, id_col, label_col, exclude_same_label, exclude_self)
    cells = _dense_cells(query_docs, base_docs, k=max(k, 1), id_col=id_col, label_col=label_col, exclude_same_label=exclude_same_label,
                         exclude_self=exclude_self, vec_col=vec_col, **blocks)
    w = Window.partitionBy("qid").orderBy(F.col("skey").desc(), F.col("bid").asc())
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similarity_join(query_docs: DataFrame, base_docs: DataFrame, min_sim: float, *, query_vecs=None,
                    base_vecs=None, id_col: str = "doc_id", label_col: str | None = None,
                    exclude_same_label: bool = False, vec_col: str | None = None, index: routed.Index | None = None,
                    shard_rows: int | None = None, **blocks) -> DataFrame:
    """(qid, bid, sim, skey) for every pair whose rounded cosine similarity is >= ``min_sim`` (positive for sparse input)."""
    if vec_col is None:
        index = index or routed.build(base_docs, base_vecs, id_col, label_col, shard_rows)
        return routed.similar(query_docs, query_vecs, index, min_sim, id_col, label_col, exclude_same_label)
    return _dense_cells(query_docs, base_docs, min_sim=min_sim, id_col=id_col, label_col=label_col,
                        exclude_same_label=exclude_same_label, vec_col=vec_col, **blocks)
