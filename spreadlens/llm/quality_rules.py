"""Quality rules with adaptive limits: per language and source, from mergeable quantile sketches (native Spark).

Every document gets counts (words, word characters, symbols, duplicate lines, words in repeated 8-word windows) and
ratios of them. The ratios are summarised per (lang, source) in a log-bucket quantile sketch: a value ``x`` falls in
bucket ``ceil(log_gamma x)``, so a sketch is a table of bucket counts, two sketches merge by adding counts, and any
quantile is known to the relative accuracy of one bucket. Fences ``q75 + 3 max(iqr, floor)`` (and the mirrored lower
one for word length) replace fixed cut-offs. Groups below ``min_rows`` documents use the sketch of their language,
merged from the same counts, and failing that the sketch of all documents. The limits are joined back to the
documents and decide ``kept``.

Nulls: a null text has no words and fails the base rules; a null language or source is a group of its own. Empty
tables give no rows. Repeated rows are judged each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage, whole_text, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30

#: Relative accuracy of the sketches.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
TINY = 1e-6
ZERO_BUCKET = -10_000

#: Ratio -> (smallest spread that counts, has a lower fence too).
RATIOS = {"symbol_ratio": (0.02, False), "dup_line_ratio": (0.1, False), "repeat_ratio": (0.05, False), "word_length": (0.6, True)}
FENCE = 3.0


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every document. Repeated windows are found by the hash of their
    words; only documents that hold an equal pair sort their windows to see which words are covered."""
    lines = F.filter(F.split("_t", "\n", -1), lambda s: s.rlike(WORD))
    win = F.transform(
        F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.element_at("_hw", (i + j).cast("int")) for j in range(WINDOW)]),
    )
    order = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    same = lambda k, j: F.get("_ord", k.cast("int"))["h"] == F.get("_ord", j.cast("int"))["h"]
    hits = F.filter(
        F.transform("_ord", lambda s, k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), s["i"])),
        lambda p: p.isNotNull(),
    )
    covered = F.aggregate(
        F.transform("_pos", lambda p, k: F.least(F.coalesce(F.get("_pos", (k + 1).cast("int")) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return (
        docs.select("doc_id", "lang", "source", whole_text().alias("_t"))
        .withColumn("_w", words(F.col("_t")))
        .withColumns({
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate("_t", SPACES, "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "_lines": lines,
            "_hw": F.transform("_w", lambda w: F.xxhash64(w)),
        })
        .withColumns({
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_win": F.when(F.col("n_words") >= WINDOW, win).otherwise(F.array().cast("array<bigint>")),
        })
        .withColumn("_rep", F.size(F.array_distinct("_win")) < F.size("_win"))
        .withColumn("_ord", F.when(F.col("_rep"), order))
        .withColumn("_pos", F.when(F.col("_rep"), F.sort_array(hits)))
        .withColumn("n_repeat_words", F.when(F.col("_rep"), covered).otherwise(F.lit(0).cast("long")))
        .select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    )


def with_ratios(counts: DataFrame) -> DataFrame:
    """The ratios that the fences judge; null where a document has no words."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.withColumns({
        "symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words"),
    })


def bucket(x: Column) -> Column:
    return F.when(x < TINY, F.lit(ZERO_BUCKET)).otherwise(F.ceil(F.log(x) / F.lit(math.log(GAMMA)))).cast("int")


def sketches(ratios: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the sketch of every group. Counted with map-side combine, so a source
    that holds a third of all rows sends one row per bucket and task."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in RATIOS])
    return (
        ratios.select("lang", "source", F.explode(pairs).alias("p"))
        .where(F.col("p.x").isNotNull())
        .groupBy("lang", "source", F.col("p.metric").alias("metric"), bucket(F.col("p.x")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, keys: list[str], probs: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """Merge the sketches to one per ``keys`` and metric; n documents and the quantiles q<percent>."""
    by = Window.partitionBy(*keys, "metric")
    value = F.when(F.col("bucket") == ZERO_BUCKET, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    return (
        sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        .withColumns({"cum": F.sum("n").over(by.orderBy("bucket")), "total": F.sum("n").over(by), "v": value})
        .groupBy(*keys, "metric")
        .agg(F.max("total").alias("docs"), *[F.min(F.when(F.col("cum") >= p * F.col("total"), F.col("v"))).alias(f"q{int(p * 100)}") for p in probs])
    )


def limits(sketch: DataFrame, min_rows: int) -> DataFrame:
    """One row per (lang, source): <metric>_hi for all metrics, <metric>_lo for those with a lower fence."""
    groups = sketch.select("lang", "source", "metric").distinct()
    own = quantiles(sketch, ["lang", "source"]).where(F.col("docs") >= min_rows)
    lang = quantiles(sketch, ["lang"]).where(F.col("docs") >= min_rows)
    every = quantiles(sketch, [])
    on = lambda a, b, keys: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    g, o, s, e = groups.alias("g"), own.alias("o"), lang.alias("s"), every.alias("e")
    pick = lambda q: F.coalesce(F.col(f"o.{q}"), F.col(f"s.{q}"), F.col(f"e.{q}"))
    joined = (
        g.join(o, on(groups, own, ["lang", "source", "metric"]), "left")
        .join(s, F.col("g.lang").eqNullSafe(F.col("s.lang")) & (F.col("g.metric") == F.col("s.metric")), "left")
        .join(e, F.col("g.metric") == F.col("e.metric"), "left")
        .select("g.lang", "g.source", "g.metric", pick("q25").alias("lo"), pick("q75").alias("hi"))
    )
    spread = reduce(lambda acc, m: acc.when(F.col("metric") == m, F.greatest(F.col("hi") - F.col("lo"), F.lit(RATIOS[m][0]))), RATIOS, F.when(F.lit(False), F.lit(0.0)))
    fenced = joined.withColumn("s", FENCE * spread).withColumns({"up": F.col("hi") + F.col("s"), "down": F.col("lo") - F.col("s")})
    aggs = [F.max(F.when(F.col("metric") == m, F.col("up"))).alias(f"{m}_hi") for m in RATIOS]
    aggs += [F.max(F.when(F.col("metric") == m, F.col("down"))).alias(f"{m}_lo") for m, (_, low) in RATIOS.items() if low]
    return fenced.groupBy("lang", "source").agg(*aggs)


def quality_rules(docs: DataFrame, min_rows: int = 100) -> DataFrame:
    """Counts, ratios, base_failed and kept of every document."""
    counts = stage(document_counts(docs), "op1-counts")
    ratios = with_ratios(counts)
    fence = limits(sketches(ratios), min_rows)
    d, f = ratios.alias("d"), fence.alias("f")
    inside = [F.coalesce(F.col(f"d.{m}") <= F.col(f"f.{m}_hi"), F.lit(True)) for m in RATIOS]
    inside += [F.coalesce(F.col(f"d.{m}") >= F.col(f"f.{m}_lo"), F.lit(True)) for m, (_, low) in RATIOS.items() if low]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return (
        d.join(f, F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
        .withColumns({"base_failed": base, "kept": ~base & reduce(lambda a, b: a & b, inside)})
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )
