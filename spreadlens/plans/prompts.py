"""Prompt assembly as column expressions: one system prompt per request row built from its exemplar rows
(at most 2k rows that the request brings along, or a ``collect_list`` over them, ordered by slot), plus a user message.

The wording is a user parameter (``PromptTemplate``); the default wording below is ours. What is fixed is the slot
structure: numbered exemplar blocks with text and capitalised label (optionally the kind tag and the three graph
metrics with two decimals), then the closing line; the user message carries the text (optionally the metrics)
and the answer instruction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalize, fmt2

NL = "\n"
SEP = "\n\n"
MISSING = "n/a"


@dataclass(frozen=True)
class PromptTemplate:
    intro: str
    header: str = "Labelled examples:"
    closing: str = "Classify the next post the same way."
    answer: str = "Answer with one word: Fake or Real."


TEXT_ONLY = PromptTemplate(
    intro=("You label short social-media posts. Decide whether a post belongs to a coordinated political "
           "disinformation campaign (Fake) or spread organically (Real), judging by its wording, tone and claims."),
)

WITH_GRAPH = PromptTemplate(
    intro=("You label short social-media posts together with statistics of how they were reposted. Decide whether "
           "a post belongs to a coordinated political disinformation campaign (Fake) or spread organically (Real). "
           "Mean degree centrality tells how connected the reposting accounts are, eigenvector centrality how "
           "influential they are, and the median repost delay how quickly reposts followed the post; coordinated "
           "campaigns tend to repost in quick bursts."),
)


def _num(c: Column) -> Column:
    return F.coalesce(fmt2(c), F.lit(MISSING))


def metric_lines(prefix: str = "", of: Callable[[str], Column] = F.col) -> Column:
    return F.concat(
        F.lit("Mean degree centrality: "), _num(of(prefix + "avg_degree_centrality")), F.lit(NL),
        F.lit("Eigenvector centrality: "), _num(of(prefix + "eigenvector_centrality")), F.lit(NL),
        F.lit("Median repost delay: "), _num(of(prefix + "median_retweet_time")), F.lit(" seconds"),
    )


def exemplar_block(with_metrics: bool, with_kind: bool, of: Callable[[str], Column] = F.col) -> Column:
    """One exemplar block from columns slot, kind, ex_text, ex_label (+ ex_ metrics), or from what ``of`` gives by name."""
    head = F.concat(F.lit("Example "), of("slot").cast("string"),
                    F.concat(F.lit(" ("), of("kind"), F.lit(")")) if with_kind else F.lit(""), F.lit(":"))
    parts = [head, F.lit(NL), F.lit('Post: "'), F.coalesce(of("ex_text"), F.lit("")), F.lit('"'), F.lit(NL)]
    if with_metrics:
        parts += [metric_lines("ex_", of), F.lit(NL)]
    parts += [F.lit("Label: "), capitalize(of("ex_label"))]
    return F.concat(*parts)


def system_prompts(exemplars: DataFrame, group_cols: list[str], template: PromptTemplate, with_metrics: bool,
                   with_kind: bool) -> DataFrame:
    """exemplars (group..., slot, kind, ex_text, ex_label[, ex_ metrics]) -> (group..., system_prompt, exemplars).

    ``exemplars`` (array<struct<slot, label, similarity>>) travels with the request for offline test clients."""
    blocks = exemplars.select(*group_cols, "slot", exemplar_block(with_metrics, with_kind).alias("block"),
                              F.col("ex_label").alias("label"), F.col("ex_similarity").alias("similarity"))
    agg = blocks.groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(F.struct("slot", "block", "label", "similarity"))).alias("_b"))
    return agg.select(*group_cols, *_from_blocks(template))


def _from_blocks(template: PromptTemplate) -> list[Column]:
    """system_prompt and exemplars from the sorted blocks ``_b``."""
    body = F.array_join(F.transform("_b", lambda x: x["block"]), SEP)
    return [
        F.concat(F.lit(template.intro + SEP + template.header + SEP), body, F.lit(SEP + template.closing))
        .alias("system_prompt"),
        F.transform("_b", lambda x: F.struct(x["slot"].alias("slot"), x["label"].alias("label"),
                                             x["similarity"].alias("similarity"))).alias("exemplars"),
    ]


def from_picked(requests: DataFrame, picked: Column, template: PromptTemplate, with_metrics: bool, with_kind: bool) -> DataFrame:
    """The requests with ``system_prompt`` and ``exemplars`` of their ``picked`` rows, an array of struct (slot, kind, ex_text,
    ex_label, ex_similarity[, ex_ metrics]), as ``system_prompts`` makes them; a row without any (k = 0) gets the
    instruction without examples. The prompts are made row by row, where the picked rows are."""
    block = lambda x: F.struct(x["slot"].alias("slot"), exemplar_block(with_metrics, with_kind, lambda c: x[c]).alias("block"),
                               x["ex_label"].alias("label"), x["ex_similarity"].alias("similarity"))
    system, exemplars = _from_blocks(template)
    j = requests.withColumn("_b", F.array_sort(F.transform(picked, block)))
    return j.withColumn("exemplars", exemplars).withColumn(
        "system_prompt", F.when(F.size("_b") > 0, system).otherwise(F.lit(template.intro + SEP + template.closing))).drop("_b")


def user_prompt(template: PromptTemplate, with_metrics: bool, text_col: str = "text") -> Column:
    parts = [F.lit("Post: "), F.coalesce(F.col(text_col), F.lit(""))]
    if with_metrics:
        parts += [F.lit(NL), metric_lines()]
    parts += [F.lit(SEP + template.answer)]
    return F.concat(*parts)
