"""TF-IDF as DataFrame jobs: raw term counts, smoothed idf fitted on the train side only, L2-normalised weights.

Semantics (defaults of the vectoriser the reference uses): tokens are runs of >= 2 word characters of the
lower-cased text; tf = raw count; idf = ln((1 + n) / (1 + df)) + 1 where n counts every fitted document, empty
ones included; each row is L2-normalised, an all-zero row stays zero; at transform time terms outside the fitted
vocabulary are dropped.

Scale notes: the per-document token counting is a hash aggregate whose partial (map-side) step already produces
one row per (doc, term), so raw tokens never cross the network. The join with the fitted vocabulary is left to AQE: it
knows the vocabulary's bytes, broadcasts a small one, and else splits skewed (frequent-term) partitions. The fitted table
is a stored one.

For the search, rows are made packed (``packed``): texts meet their id in one shuffle, a task counts the codes of their terms, and
the idf of the ``FREQUENT`` most frequent terms is broadcast, a bounded table; the other terms, a small share of the
postings, meet theirs in a join. So no posting of a frequent term is ever a row. ``fit`` over ``doc_terms`` likewise
shuffles texts and the counts of distinct terms, not postings.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import routed
from .blocks import lists

#: Terms whose idf every task holds, at most.
FREQUENT = 1 << 18


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf) for every token-bearing document."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _words(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(id, words, ...): the tokens of all texts of an id, which meet in one shuffle of the texts."""
    both = docs.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(text_col).alias("texts"), *more)
    return both.withColumn("words", tokens(F.array_join("texts", "\n"))).drop("texts")


def doc_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term): the distinct terms of every document; ``counts`` enough for ``fit``."""
    return _words(docs, id_col, text_col).select(F.col("id").alias("doc_id"), F.explode(F.array_distinct("words")).alias("term"))


@dataclass
class TfidfModel:
    idf: DataFrame          # (term, df, idf), stored
    n_docs: int
    vocab_size: int
    salt: int | None = None

    def codes(self) -> tuple[DataFrame, int]:
        """(code, term, df, idf) of the vocabulary, and the salt that gives each term a code of its own."""
        coded = lambda salt: self.idf.withColumn("code", _code(F.col("term"), salt))
        if self.salt is None:
            self.salt = next(n for n in count() if coded(n).groupBy("code").count().where("count > 1").isEmpty())
        return coded(self.salt), self.salt

    def limit(self) -> float:
        """The least df of the terms whose idf is broadcast, ``FREQUENT`` at most: a histogram of the dfs (64 steps for each
        doubling, so a few thousand rows at any size) gives it."""
        if self.vocab_size <= FREQUENT:
            return 0.0
        step = F.floor(F.log2("df") * 64)
        total, least = 0, np.inf
        for s, n in sorted(((r["s"], r["n"]) for r in self.idf.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True):
            total += n
            if total > FREQUENT:
                break
            least = s
        return least


def _code(term, salt: int):
    return F.xxhash64(term, F.lit(salt))


def fit(train_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        counts: DataFrame | None = None, n_docs: int | None = None) -> TfidfModel:
    """Fit vocabulary + smoothed idf on the train documents (every document counts toward n).

    n is a scalar subquery of the same job (or given). The model is written to the scratch folder: kept in a cache, it would
    keep the shuffled texts that it was counted from. ``counts`` = precomputed ``term_counts``."""
    counts = counts if counts is not None else term_counts(train_docs, id_col, text_col)
    n = (F.lit(float(n_docs)) if n_docs is not None
         else train_docs.select(F.count_distinct(F.col(id_col)).cast("double")).scalar())
    idf = routed.staged(
        counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        .select("term", "df", (F.log((F.lit(1.0) + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"), n.alias("_n")), "idf")
    stats = idf.agg(F.count(F.lit(1)).alias("v"), F.max("_n").alias("n")).first()
    n_docs = int(stats.n) if stats.n is not None else train_docs.select(id_col).distinct().count()
    return TfidfModel(idf=idf.drop("_n"), n_docs=n_docs, vocab_size=stats.v)


def transform(model: TfidfModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, weight) L2-normalised; documents with no known term have no rows (zero vector)."""
    counts = counts if counts is not None else term_counts(docs, id_col, text_col)
    raw = counts.join(model.idf.select("term", "idf"), "term")
    raw = raw.select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / norm).alias("weight"))


def weighted(frequent, kind: str):
    """A map of Arrow batches (id, labels, codes of all tokens, rare (code, idf)) to packed rows; ``frequent`` gives the sorted
    codes of the frequent terms and their idf. Codes that neither names are left out."""
    def run(batches):
        import pyarrow as pa

        known, value = frequent()
        for b in batches:
            n, codes = lists(b.column("codes"))
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((codes, row))
            row, codes = row[order], codes[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])][:len(row)])
            tf = np.diff(np.r_[first, len(row)])
            row, codes = row[first], codes[first]
            idf = np.zeros(len(codes))
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                idf = np.where(known[at] == codes, value[at], 0.0)
            rare = b.column("rare")
            many, flat = np.diff(rare.offsets.to_numpy()), rare.flatten()
            mine = np.flatnonzero(idf == 0)
            if len(flat) and len(mine):
                # in order of row, code and side, an own term stands right behind the idf of its row and code
                rows = np.r_[np.repeat(np.arange(len(n)), many), row[mine]]
                keys = np.r_[flat.field("code").to_numpy(), codes[mine]]
                order = np.lexsort((np.arange(len(rows)) >= len(flat), keys, rows))
                a, z = order[:-1], order[1:]
                hit = (a < len(flat)) & (z >= len(flat)) & (rows[a] == rows[z]) & (keys[a] == keys[z])
                idf[mine[z[hit] - len(flat)]] = flat.field("idf").to_numpy()[a[hit]]
            keep = idf > 0
            row, codes, w = row[keep], codes[keep], tf[keep] * idf[keep]
            weights = w / np.sqrt(np.bincount(row, w * w, len(n)))[row]
            size = np.bincount(row, minlength=len(n))
            have = np.flatnonzero(size)
            ends = np.r_[0, np.cumsum(size[have])].astype(np.int32)
            head = codes[np.lexsort((codes, weights, row))][ends[1:] - 1]
            of = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
            take = pa.array(have)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("labels").take(take), pa.array(head, pa.int64()), of(codes), of(weights)],
                                             names=["id", "labels", "head", "codes", "weights"])

    return run


def packed(model: TfidfModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None,
           fitted: bool = False) -> routed.Packed:
    """The vectors of ``transform`` in stored blocks, one row for each id and label. ``fitted``: the model was fitted on these
    documents, so they have no term that it lacks."""
    spark, kind = docs.sparkSession, routed.id_kind(docs, id_col)
    label = routed.label_of(F.col(label_col) if label_col else F.lit(None))
    texts = docs.select(F.col(id_col).cast(kind).alias("id"), label.alias("label"), F.col(text_col).alias("text")).where("id is not null")
    coded, salt = model.codes()
    strange = [] if fitted else routed.strange_terms(
        texts.select(F.explode(tokens(F.col("text"))).alias("mine")).distinct().select(_code(F.col("mine"), salt).alias("code"), "mine"), coded.select("code", "term"))
    codes = lambda words: F.transform(F.filter(words, lambda t: ~t.isin(strange)) if strange else words, lambda t: _code(t, salt))
    rows = _words(texts, "id", "text", F.collect_set("label").alias("labels")).select("id", "labels", codes(F.col("words")).alias("codes"))
    least = F.floor(F.log2("df") * 64) >= F.lit(model.limit())
    top = coded.where(least).select("code", "idf").toArrow()
    order = np.argsort(top.column("code").to_numpy())
    held = spark.sparkContext.broadcast((top.column("code").to_numpy()[order], top.column("idf").to_numpy()[order]))
    pair = "struct<code:bigint,idf:double>"
    if model.vocab_size > top.num_rows:
        each = texts.select("id", F.explode(F.array_distinct(codes(tokens(F.col("text"))))).alias("code"))
        each = each.join(F.broadcast(coded.where(least).select("code")), "code", "left_anti").join(coded.where(~least).select("code", "idf"), "code")
        rows = rows.join(each.groupBy("id").agg(F.collect_set(F.struct("code", "idf")).alias("rare")), "id", "left")
        rows = rows.withColumn("rare", F.coalesce("rare", F.array().cast(f"array<{pair}>")))
    else:
        rows = rows.withColumn("rare", F.array().cast(f"array<{pair}>"))
    found = rows.select("id", "labels", "codes", "rare").mapInArrow(weighted(lambda: held.value, kind), f"id {kind}, labels array<string>, head bigint, codes array<bigint>, weights array<double>")
    found = found.select("id", F.explode("labels").alias("label"), "head", "codes", "weights")
    return routed.packed(found, transform(model, docs, id_col, text_col), coded.select("code", "term"), salt)
