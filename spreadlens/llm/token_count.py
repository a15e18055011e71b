"""Token counts by a two-tier lookup on the map side: a broadcast table of frequent pieces, then worker caches.

A text is cut before each blank that a visible character follows; a byte-level pre-tokeniser always starts a pre-token
there, so the token count of a text is the sum over its pieces (a blank, a word, what is stuck to it). The first
tier is a compact table, broadcast, of the pieces most frequent in the corpus and their token counts; its size is
bounded by ``TABLE`` pieces of at most ``MAX_PIECE`` characters. The second tier is a bounded cache per worker, filled by
the tokenizer itself. No piece is shuffled for counting: to find the frequent ones each task counts all its pieces
and sends its ``PER_TASK`` most frequent, which are summed. The table affects the speed only, never a count.

Texts that hold an added token go to the tokenizer whole. Nulls: a null text is empty, with no bytes and no tokens.
Texts of any length are handled piece by piece. An empty table gives no rows; repeated rows are counted each; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, most_frequent, small_batches, stage, whole_text

TABLE = 1 << 16
PER_TASK = 8192
MAX_PIECE = 32
CACHE = 400_000
#: Distinct pieces a task holds while it counts; when full, the rare half goes.
HELD = 300_000

ODD_BLANK = re.compile(r" (?=\s)| $")
CUT = re.compile(r" (?=\S)")


def pieces(text: str) -> list[str]:
    """The pieces of a text, each but the first without the blank it starts with."""
    return CUT.split(text) if ODD_BLANK.search(text) else text.split(" ")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, tuple(a.content for a in t.get_added_tokens_decoder().values())


def frequent_pieces(docs: DataFrame, table: int = TABLE, per_task: int = PER_TASK) -> list[str]:
    """The most frequent pieces of the corpus, at most ``table``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(pieces(t)[1:])
            if len(seen) > HELD:
                seen = Counter(dict(seen.most_common(HELD // 2)))
        top = [(p, n) for p, n in seen.most_common(per_task) if n > 1 and len(p) <= MAX_PIECE]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    counts = stage(docs.select(whole_text().alias("text")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "op10-pieces")
    return most_frequent(counts, "n", table).select("piece").toArrow().column("piece").to_pylist()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens exceed ``limit``."""
    path = path or default_vocabulary()
    spark = docs.sparkSession
    free_shuffles(spark)
    frequent = frequent_pieces(docs)
    encoder, _ = tokenizer(path)
    table = spark.sparkContext.broadcast({p: len(e.ids) for p, e in zip(frequent, encoder.encode_batch([" " + p for p in frequent], add_special_tokens=False))})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, cache = table.value, worker_cache(path)
        encoder, special = tokenizer(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            parts = [None if any(s in t for s in special) else pieces(t) for t in texts]
            missing = {p for ps in parts if ps for p in ps[1:] if p not in known and p not in cache}
            if len(cache) + len(missing) > CACHE:
                cache.clear()
                missing = {p for ps in parts if ps for p in ps[1:] if p not in known}
            todo = list(missing)
            cache.update(zip(todo, (len(e.ids) for e in encoder.encode_batch_fast([" " + p for p in todo], add_special_tokens=False))))
            heads = [t if ps is None else ps[0] for t, ps in zip(texts, parts)]
            counts = [len(e.ids) for e in encoder.encode_batch_fast(heads, add_special_tokens=False)]
            for i, ps in enumerate(parts):
                if ps:
                    counts[i] += sum([known[p] if p in known else cache[p] for p in ps[1:]])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


@lru_cache(maxsize=2)
def worker_cache(path: str) -> dict[str, int]:
    return {}
