"""Benchmark decontamination: a BM25 inverted index of the test items, block-max WAND, and an overlap check.

Every training text is cut in overlapping passages of ``PASSAGE`` words; each passage is a query against the index of
test items. A score is BM25 over the distinct words of passage and item, divided by the item's score against
itself, so it is the share of the item that the passage covers and one threshold fits all items. All items at or
above it are retrieved:

* common words whose impacts sum to less than ``IDLE`` (below the threshold) in every item are non-essential: a passage with no
  essential word can't reach it, and most words of a text are passed over by one lookup;
* items stand in blocks; a block's postings hold the greatest impact of a word in it. The essential words of a
  passage and the block's greatest non-essential sum bound the score, and only blocks whose bound reaches the threshold
  are scored exactly.

A retrieved pair is verified: the share of the word 3-grams of the item's question and of its answer that the passage holds
must reach their limits. The answer is the last sentence, but at least the last third of the item, so that a changed or
missing closing word does not decide alone; the question is the rest.
Items of more than ``PASSAGE // 2`` words are indexed in parts of that length.

The index is broadcast in shards of at most ``SHARD_CHARS`` characters of items, so its size is bounded for any
benchmark; collection statistics are those of the whole benchmark.

Nulls: a null text has no words and no match; a null item has none either; items of a null id match and come last. Ties:
all items at the threshold count. Items equal in id and text are one item, others that share an id match by themselves;
repeated rows match each. Empty tables give no matches. Extra columns are kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, shared, small_batches, whole_text

WORDS = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
PASSAGE = 128
THRESHOLD = 0.5
#: Most that the non-essential words of an item may weigh; the less, the tighter the bounds and the longer the lists.
IDLE = 0.25
QUESTION = 0.6
ANSWER = 0.5
BLOCK = 8
K1, B = 1.2, 0.75
SHARD_CHARS = 8_000_000
MATCH = "item_id long, at int, score double, question double, answer double"


def tokens(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def parts(text: str) -> list[tuple[list[str], list[str], list[str]]]:
    """(words, question, answer) of an item, or of each part of a long one."""
    words = tokens(text)
    size = PASSAGE // 2
    if len(words) > size:
        # the last part reaches back, so that no part is too short to tell
        starts = [*range(0, len(words) - size, size), len(words) - size]
        return [(w, w[: 2 * size // 3], w[2 * size // 3:]) for w in (words[s:s + size] for s in starts)]
    last = tokens(SENTENCE.split(text.strip())[-1])
    least = max(1, len(words) // 3)
    if not least <= len(last) < len(words):
        last = words[-least:]
    return [(words, words[: len(words) - len(last)], last)] if words else []


class Index:
    """Postings, block maxima and bounds of a shard of items."""

    def __init__(self, items: list[tuple[int, str]], n: int, mean: float, df: dict[str, int], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items = []       # ((number, item_id), impacts by word, question grams, answer grams)
        for item in enumerate(items):
            item_id, text = (item[0], item[1][0]), item[1][1]
            for words, question, answer in parts(text):
                tf = Counter(words)
                impact = {
                    w: math.log(1 + (n - df.get(w, 1) + 0.5) / (df.get(w, 1) + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean))
                    for w, f in tf.items()
                }
                own = sum(impact.values())
                self.items.append((item_id, {w: x / own for w, x in impact.items()}, grams(question), grams(answer)))
        common = Counter(w for _, impact, _, _ in self.items for w in impact)
        owners = defaultdict(list)
        for i, (_, impact, _, _) in enumerate(self.items):
            for w in impact:
                owners[w].append(i)
        idle, rest = set(), [0.0] * len(self.items)
        for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])):
            if all(rest[i] + self.items[i][1][w] < min(IDLE, threshold * 0.99) for i in owners[w]):
                idle.add(w)
                for i in owners[w]:
                    rest[i] += self.items[i][1][w]
        self.rest = [max(rest[b:b + BLOCK]) for b in range(0, len(rest), BLOCK)]
        #: essential word -> [(block, greatest impact in it)]
        self.postings = {}
        for w, own in owners.items():
            if w not in idle:
                best: dict[int, float] = {}
                for i in own:
                    best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), self.items[i][1][w])
                self.postings[w] = list(best.items())

    def matches(self, text: str) -> list[dict]:
        """Verified matches of a text, the best passage for each item."""
        words = tokens(text)
        postings, step = self.postings, PASSAGE // 2
        essential = defaultdict(set)
        for p, w in enumerate(words):
            if w in postings:
                q = p // step
                essential[q].add(w)
                if q:
                    essential[q - 1].add(w)
        found: dict[tuple, dict] = {}
        for q, hit in essential.items():
            bound: dict[int, float] = defaultdict(float)
            for w in hit:
                for block, most in postings[w]:
                    bound[block] += most
            live = [b for b, x in bound.items() if x + self.rest[b] >= self.threshold - 1e-9]
            if live:
                passage = words[q * step:q * step + PASSAGE]
                self._score(passage, q * step, live, found)
        return [m for _, m in sorted(found.items(), key=lambda x: (x[0][1] is None, x[0][1] or 0, x[0][0]))]

    def _score(self, passage: list[str], at: int, blocks: list[int], found: dict[tuple, dict]) -> None:
        have, triples = set(passage), None
        for b in blocks:
            for item_id, impact, question, answer in self.items[b * BLOCK:(b + 1) * BLOCK]:
                score = sum([x for w, x in impact.items() if w in have])
                if score < self.threshold - 1e-9:
                    continue
                if triples is None:
                    triples = {n: grams(passage, n) for n in (1, 2, 3)}
                share = lambda gs: sum(g in triples[len(g)] for g in gs) / len(gs) if gs else 1.0
                q, a = share(question), share(answer)
                if q >= QUESTION and a >= ANSWER and (item_id not in found or score > found[item_id]["score"]):
                    found[item_id] = {"item_id": item_id[1], "at": at, "score": score, "question": q, "answer": a}


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Index]:
    """The index of the test items, in shards of bounded size."""
    @F.pandas_udf("array<string>")
    def words(texts):
        return texts.map(lambda t: sorted(set(tokens(t))))

    @F.pandas_udf("int")
    def length(texts):
        return texts.map(lambda t: len(tokens(t)))

    items = benchmark.select(F.col("item_id").cast("long"), whole_text().alias("text")).distinct()
    n, mean, chars = items.agg(F.count("*"), F.avg(length("text")), F.sum(F.length("text"))).first()
    if not n:
        return
    shards = max(1, math.ceil((chars or 0) / SHARD_CHARS))
    df = items.select(F.explode(words("text")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    for k in range(shards):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        got = [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()]
        terms = {r["w"]: r["df"] for r in df.join(mine.select(F.explode(words("text")).alias("w")).distinct(), "w", "left_semi").collect()}
        yield Index(got, n, max(1.0, mean or 1.0), terms, threshold)


def restored(values: dict) -> Index:
    i = Index.__new__(Index)
    vars(i).update(values)
    return i


def with_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, name: str = "matches") -> DataFrame:
    """``docs`` with the verified test items of each text, in a column ``name`` (one of that name is replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    out, names = docs, []
    for k, index in enumerate(indexes(benchmark, threshold)):
        held = shared(spark, restored, vars(index))

        @F.pandas_udf(f"array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>")
        def run(texts, held=held):
            import pandas as pd

            return pd.Series([held().matches(t) for t in texts], dtype=object)

        names.append(free_name(out, f"_m{k}"))
        out = out.withColumn(names[-1], run(whole_text()))
    empty = F.array().cast(f"array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>")
    return out.withColumn(name, F.concat(empty, *names)).drop(*names)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and test item that it holds."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, threshold).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.at", "m.score", "m.question", "m.answer")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    name = free_name(docs, "_matches")
    return with_matches(docs, benchmark, threshold, name).where(F.size(name) == 0).drop(name)
