"""Exemplar selection: top-k similar train rows, nearest opposite-label partner, balanced retrieval, seeded
stratified exemplars. All selections are joins / windows over bounded per-row candidate lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import free_shuffles, release
from . import knn, routed, tfidf


@dataclass
class Retrieval:
    """A fitted text index: train/test documents, the train-fitted TF-IDF model and both sides' vectors, as tables that are
    computed where they are read and packed in blocks for the searches, made once."""
    model: tfidf.TfidfModel
    train: DataFrame        # (doc_id, text, label, ...)
    test: DataFrame         # (doc_id, text, label, ...)
    train_vecs: DataFrame   # (doc_id, term, weight)
    test_vecs: DataFrame
    shards: routed.Index | None = None
    train_blocks: routed.Packed | None = None
    test_blocks: routed.Packed | None = None

    def train_packed(self) -> routed.Packed:
        if self.train_blocks is None:
            self.train_blocks = tfidf.packed(self.model, self.train, label_col="label", fitted=True)
        return self.train_blocks

    def test_packed(self) -> routed.Packed:
        if self.test_blocks is None:
            self.test_blocks = tfidf.packed(self.model, self.test)
        return self.test_blocks

    def index(self) -> routed.Index:
        """The train side in blocks, made once for all searches."""
        if self.shards is None:
            self.shards = routed.build(self.train, self.train_packed(), label_col="label", n_docs=self.model.n_docs)
        return self.shards

    def release(self) -> None:
        """Delete the stored blocks, once what was searched is stored too; a later search makes them again."""
        for side in (self.train_blocks, self.test_blocks):
            if side is not None:
                release(side.blocks)
        self.shards = self.train_blocks = self.test_blocks = None


def build(corpus: DataFrame, split_col: str = "split", keep_counts: bool = False) -> Retrieval:
    """Fit on the train split. The vectors of both splits are not computed before they are read. ``keep_counts`` is for a
    caller who reads the train vectors: the split is then tokenised once, its counts are kept on disk for both the fit and
    its vectors. The size of the train split comes from one pruned scan (ids only)."""
    free_shuffles(corpus.sparkSession)
    train = corpus.filter(F.col(split_col) == "train")
    test = corpus.filter(F.col(split_col) == "test")
    counts = tfidf.term_counts(train).persist(StorageLevel.DISK_ONLY) if keep_counts else None
    model = tfidf.fit(train, counts=counts if keep_counts else tfidf.doc_terms(train), n_docs=train.count())
    return Retrieval(model, train, test, tfidf.transform(model, train, counts=counts), tfidf.transform(model, test))


def topk_similar(r: Retrieval, k: int) -> DataFrame:
    """(test_id, train_id, rank, similarity) — the k most similar train rows of every test row."""
    index = r.index()       # the larger side first: its texts are shuffled while nothing else is stored
    top = knn.exact_topk(r.test, r.train, k, query_vecs=r.test_packed(), index=index)
    return top.select(F.col("qid").alias("test_id"), F.col("bid").alias("train_id"), "rank",
                      F.col("sim").alias("similarity"))


def nearest_opposite(r: Retrieval) -> DataFrame:
    """(train_id, partner_id, similarity) — for every train row the most similar train row with another label.

    Depends on the train side only, so it is computed once and joined to any selection (the reference recomputes
    it for every test row and selected row). Rows of a single-label train set have no partner."""
    top = knn.exact_topk(r.train, r.train, 1, query_vecs=r.train_packed(), index=r.index(), label_col="label", exclude_same_label=True)
    return top.select(F.col("qid").alias("train_id"), F.col("bid").alias("partner_id"), F.col("sim").alias("similarity"))


def balanced(top: DataFrame, partners: DataFrame, k: int) -> DataFrame:
    """Similar rows in rank order, then each one's partner in the same order (duplicates kept).

    (test_id, slot, kind, train_id, anchor_id, similarity): slot 1..k = 'Similar' (similarity to the test row);
    slot k+1..2k = 'Contrastive' (similarity to its anchor, the similar row it balances). A similar row without a
    partner leaves its contrastive slot out."""
    sim = top.filter(F.col("rank") <= k)
    similar = sim.select("test_id", F.col("rank").alias("slot"), F.lit("Similar").alias("kind"), "train_id",
                         F.col("train_id").alias("anchor_id"), "similarity")
    contrast = sim.join(partners.withColumnRenamed("similarity", "psim"), "train_id").select(
        "test_id", (F.col("rank") + k).alias("slot"), F.lit("Contrastive").alias("kind"),
        F.col("partner_id").alias("train_id"), F.col("train_id").alias("anchor_id"), F.col("psim").alias("similarity"))
    return similar.unionByName(contrast)


def stratified_exemplars(train: DataFrame, per_label: int, seed: str, id_col: str = "doc_id",
                         label_col: str = "label") -> DataFrame:
    """Seeded class-balanced sample: per label the ``per_label`` rows with the smallest md5(seed || id).

    (label, pick, doc_id). The window is partitioned by label but only keeps the top rows of each (Spark plans a
    WindowGroupLimit that pre-filters before the shuffle), so a dominant label costs no large sort."""
    key = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    w = Window.partitionBy(label_col).orderBy(key, F.col(id_col))
    return (
        train.select(label_col, id_col, F.row_number().over(w).alias("pick"))
        .filter(F.col("pick") <= per_label)
        .select(F.col(label_col).alias("label"), "pick", F.col(id_col).alias("doc_id"))
    )
