"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, beside a unigram base score.

Counts. Every training document's words (and one end token) are counted per task and summed by key; the counts of all
distinct tokens stay a distributed table. Its ``FREQUENT`` most frequent tokens (of at most ``MAX_TOKEN`` bytes) are
broadcast, a bounded table; the other tokens of the documents, a small share, meet their counts in a join on the token.

Model. The vocabulary is all of the frequent tier, so it grows with the counts up to ``FREQUENT`` tokens; all other
tokens are one more outcome, inside which a token has its smoothed count's share, so the probabilities of all tokens
sum to one. A token is predicted in three levels: its group of classes given the context, its class in the group, itself
in the class. Classes are runs of ranks, about sqrt(V), short ones for the most frequent; groups are runs of classes.
Inputs are the same tokens, one for all others and one for the places before a document. The context of a token is the
sum of the ``CONTEXT`` tokens before it in the document, each embedded and scaled by a vector for its position; logits
are products with the vectors of groups, classes and tokens plus biases. Scoring multiplies batches of contexts with all
group vectors, all class vectors of the group and all token vectors of the class, so log-probabilities are normalised
exactly.

Training. The documents are dealt by a hash into shards of ``SHARD`` counted tokens. Each shard trains all levels on all
its documents, in the order of the hash, by noise-contrastive estimation from one common start, and changes only rows
that its tokens meet; every row is averaged over the shards by how often they changed it, ``FAN_IN`` at a time. So the
model depends on the rows of a table and not on its files or partitions. What reaches the driver is one model, at most
2 * FREQUENT rows and some thousand of WIDTH + 1 floats (34 MB), which is broadcast.

Nulls: a null text is an empty one, that is one end token. Without training tokens every probability is that of the
empty counts. An empty table gives no rows; repeated rows are counted and scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, fold, free_shuffles, most_frequent, shared, small_batches, stage, utf8, whole_text

FREQUENT = 1 << 18
MAX_TOKEN = 64
#: Outcomes that a model can tell apart at most: the frequent tier and one for all other tokens.
OUTPUTS = FREQUENT + 1
CONTEXT = 3
WIDTH = 15
#: Noise groups of a step, noise classes in every group that it meets, and noise tokens in every class.
NOISE = (16, 8, 4)
BATCH = 1024
#: Logits that are worked on at once, so that they stay in a core's cache.
CELLS = 1 << 17
#: Tokens and rate of a training step, and the steps of a shard at least: a small corpus is gone through again.
STEP = 4096
RATE = 0.3
LEAST_STEPS = 500
#: Training tokens of a shard, and models that are averaged at once.
SHARD = 4_000_000
FAN_IN = 16
#: Distinct tokens a task holds before it passes their counts on, and counts of batches that it holds besides.
HELD = 400_000
#: Rows of parameters that are averaged at once.
ROWS = 8192
#: The end of a document, as a token; no word holds white space.
END = b"\n"
LOG10 = np.log(10.0)


def words(column):
    """The words of a column of texts, A-Z lowered, as one array, and the number of words of each text."""
    data, offsets = utf8(column)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return byte_words(lower[data], offsets)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c): occurrences of every token in the rows of ``docs`` (column ``text``)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def summed(parts):
            t = pa.Table.from_batches(parts).group_by("token", use_threads=False).aggregate([("c", "sum")])
            return pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("token", "c_sum")], names=["token", "c"])

        parts, new, ends = [], 0, 0
        for b in batches:
            parts.append(pa.RecordBatch.from_arrays(words(b.column("text"))[0].value_counts().flatten(), names=["token", "c"]))
            new, ends = new + parts[-1].num_rows, ends + b.num_rows
            if new > HELD:
                parts, new = [summed(parts)], 0
                if parts[0].num_rows > HELD:
                    yield parts.pop()
        if ends:
            yield summed([*parts, pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["token", "c"])])

    return docs.select("text").mapInArrow(run, "token binary, c long").where("c > 0").groupBy("token").agg(F.sum("c").alias("c"))


class Tables:
    """Frequent tokens, whose places are their ids, and their counts, the end first, and totals."""

    def __init__(self, tokens: list[bytes], known, total: int, distinct: int):
        self.tokens = tokens
        self.log_c = np.log10(known + 0.5)
        self.words = len(tokens)
        self.total, self.distinct = total, distinct
        rest = total - known.sum()
        self.base = float(np.log10(total + 0.5 * (distinct + 1)))
        self.rest = float(np.log10(rest + 0.5 * (max(distinct - self.words, 0) + 1)))
        share = np.append(known, rest + 0.5) + 1e-3
        self.share = share / share.sum()

    def coded(self, column):
        """For a column of texts: ids of their tokens (END is 0, others of no frequent token -1), the number of tokens of
        each text, and their words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        word, counts = words(column)
        known = word.dictionary_encode()
        if isinstance(self.tokens, list):
            self.tokens = pa.array(self.tokens, pa.binary())
        of = pc.fill_null(pc.index_in(known.dictionary, value_set=self.tokens), -1).to_numpy().astype(np.int64)
        ids = np.zeros(len(word) + len(counts), np.int64)
        ids[np.arange(len(word)) + np.repeat(np.arange(len(counts)), counts)] = of[known.indices.to_numpy()]
        return ids, counts + 1, word

    def outcomes(self, ids):
        """Frequent tokens are their own outcome; all others share the last one."""
        return np.where(ids < 0, self.words, ids)


def counted(row, word, n: int):
    """For words of ``n`` rows: a list for each row of its distinct words and how often they come."""
    import pyarrow as pa

    known = word.dictionary_encode()
    width = max(len(known.dictionary), 1)
    pairs, times = np.unique(row * width + known.indices.to_numpy(), return_counts=True)
    ends = np.searchsorted(pairs, np.arange(n + 1) * width).astype(np.int32)
    cells = [known.dictionary.take(pa.array(pairs % width)), pa.array(times, pa.int64())]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cells, ["token", "n"]))


def sequence(outcomes, length, words: int):
    """Outcomes of texts in turn, before each text ``CONTEXT`` places of ``words + 1``; so the inputs of a token are the
    places before it. (sequence, places of the tokens)."""
    at = np.arange(len(outcomes)) + CONTEXT * (1 + np.repeat(np.arange(len(length)), length))
    out = np.full(len(outcomes) + CONTEXT * len(length), words + 1, np.int64)
    out[at] = outcomes
    return out, at


def class_bounds(words: int):
    """First outcome of each class, and the number of outcomes: sqrt(words) runs of ranks that grow in length, and the
    outcome of all other tokens by itself."""
    k = int(np.ceil(np.sqrt(words)))
    return np.append(np.unique(np.rint(words * (np.arange(k + 1) / k) ** 2).astype(np.int64)), words + 1)


def group_bounds(classes: int):
    """First class of each group, and the number of classes: about sqrt(classes) runs of equal length."""
    k = int(np.ceil(np.sqrt(classes)))
    return np.unique(np.rint(classes * np.arange(k + 1) / k).astype(np.int64))


class Model:
    """Parameters as one matrix, a bias in its last column, viewed as the rows of inputs, outputs, classes, groups and
    positions."""

    def __init__(self, matrix, outcomes: int):
        self.matrix = matrix
        classes = class_bounds(outcomes - 1)
        groups = group_bounds(len(classes) - 1)
        #: by level, from groups down: first row of each node's children, and their number
        self.bounds = (groups, classes)
        self.sizes = tuple(np.diff(b) for b in self.bounds)
        self.class_of = np.repeat(np.arange(len(classes) - 1), self.sizes[1])
        self.group_of = np.repeat(np.arange(len(groups) - 1), self.sizes[0])
        self.first = np.cumsum([0, outcomes + 1, outcomes, len(classes) - 1, len(groups) - 1])
        self.inputs, self.outputs, self.classes, self.groups, self.scales = np.split(matrix, self.first[1:])

    @classmethod
    def start(cls, share, seed: int = 5) -> Model:
        n = len(share)
        classes = class_bounds(n - 1)
        rows = n + 1 + n + len(classes) - 1 + len(group_bounds(len(classes) - 1)) - 1 + CONTEXT
        m = cls(np.random.default_rng(seed).standard_normal((rows, WIDTH + 1), np.float32) * np.float32(0.1), n)
        of_class = np.add.reduceat(share, classes[:-1])
        of_group = np.add.reduceat(of_class, m.bounds[0][:-1])
        m.inputs[:, WIDTH] = 0
        m.scales[:] = 1.0 / np.arange(1, CONTEXT + 1)[:, None] ** 0.5
        m.outputs[:, WIDTH] = np.log(share / of_class[m.class_of])
        m.classes[:, WIDTH] = np.log(of_class / of_group[m.group_of])
        m.groups[:, WIDTH] = np.log(of_group)
        return m

    def contexts(self, inputs):
        """For the inputs of n + CONTEXT neighbouring places: the scaled sums of those before each of the last n places, and
        a one for the bias."""
        n = len(inputs) - CONTEXT
        out = np.zeros((n, WIDTH + 1), np.float32)
        for k in range(CONTEXT):
            out += inputs[CONTEXT - 1 - k:CONTEXT - 1 - k + n] * self.scales[k]
        out[:, WIDTH] = 1
        return out

    def log_probabilities(self, seq, at):
        """Normalised natural log-probability of the outcome at each place ``at`` of a sequence."""
        order = at[np.argsort(seq[at], kind="stable")]
        own = seq[order]
        kind = self.class_of[own]
        top = self.group_of[kind]
        c = np.empty((len(seq), WIDTH + 1), np.float32)
        for a in range(CONTEXT, len(seq), BATCH):
            c[a:a + BATCH] = self.contexts(self.inputs.take(seq[a - CONTEXT:a + BATCH], axis=0))
        c = c.take(order, axis=0)
        log_p = log_softmax(c, self.groups, top)
        for bounds, rows, node, child in ((self.bounds[0], self.classes, top, kind), (self.bounds[1], self.outputs, kind, own)):
            cuts = np.flatnonzero(np.diff(node, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                low, high = bounds[node[a]:node[a] + 2]
                if high - low > 1:
                    log_p[a:b] += log_softmax(c[a:b], rows[low:high], child[a:b] - low)
        out = np.empty(len(seq))
        out[order] = log_p
        return out[at]


def log_softmax(c, rows, own):
    """log(softmax(c rows')) of the column ``own`` of each line."""
    out, weights, ones = np.empty(len(own)), rows.T, np.ones(len(rows), np.float32)
    size = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x).max()) if len(x) else 0.0
    small = size(c) * size(rows) < 60      # only very large logits need a shift
    step = max(16, CELLS // len(rows))
    for a in range(0, len(own), step):
        logits = c[a:a + step] @ weights
        mine = logits[np.arange(len(logits)), own[a:a + step]].astype(np.float64)
        if not small:
            shift = logits.max(axis=1)
            logits -= shift[:, None]
            mine -= shift
        out[a:a + step] = mine - np.log(np.exp(logits, out=logits) @ ones)
    return out


def sigmoid(x):
    with np.errstate(over="ignore"):       # an infinite exponential gives 0
        return 1 / (1 + np.exp(-x))


class Trainer:
    """Noise-contrastive estimation with Adagrad (one rate a row) on the rows that a step meets. The noise groups of a step,
    the noise classes of each group and the noise tokens of each class are shared by the step's tokens in them."""

    def __init__(self, share, seed: int = 17):
        self.m = m = Model.start(share)
        self.sums = np.ones(len(m.matrix), np.float32)
        self.met = np.zeros(len(m.matrix), np.float32)
        self.random = np.random.default_rng(seed)
        groups = np.add.reduceat(np.add.reduceat(share, m.bounds[1][:-1]), m.bounds[0][:-1])
        self.log_noise = np.log(NOISE[0] * groups).astype(np.float32)
        self.draw = np.cumsum(groups)
        self.steps = 0

    def change(self, part: int, rows, grads):
        """An Adagrad step of the rows of a part of the matrix; the gradients of equal rows are added."""
        order = np.argsort(rows, kind="stable")
        r = rows[order]
        cuts = np.flatnonzero(np.diff(r, prepend=-1))
        v, at = np.add.reduceat(grads.take(order, axis=0), cuts, axis=0), r[cuts] + self.m.first[part]
        s = self.sums[at] + np.einsum("ij,ij->i", v, v) / np.float32(WIDTH)
        self.sums[at] = s
        v *= (np.float32(RATE) / np.sqrt(s))[:, None]
        self.m.matrix[at] = np.subtract(self.m.matrix.take(at, axis=0), v, out=v)
        self.met[at] += 1

    def inside(self, level: int, rows, node, child, c, dc):
        """Gradients of the children (rows of a matrix) of the nodes of a level (0 groups, 1 classes) that the tokens, in
        order of node, are in; adds to ``dc``. (children, gradients) for ``change``."""
        first, sizes, noise = self.m.bounds[level], self.m.sizes[level], NOISE[level + 1]
        deep = np.flatnonzero(sizes[node] > 1)
        if not len(deep):
            return np.zeros(0, np.int64), np.zeros((0, WIDTH + 1), np.float32)
        node, child, cc = node[deep], child[deep], c.take(deep, axis=0)
        cuts = np.flatnonzero(np.diff(node, prepend=-1))
        met, n = node[cuts], np.diff(np.append(cuts, len(node)))
        log_noise = np.log(noise / sizes[node]).astype(np.float32)
        drawn = (np.arange(noise) + self.random.random((len(cuts), noise))) / noise
        ids = first[met][:, None] + (drawn * sizes[met][:, None]).astype(np.int64)
        own, others = rows.take(child, axis=0), rows.take(ids, axis=0)
        g = -sigmoid(log_noise - np.einsum("ij,ij->i", cc, own))[:, None]
        if level:
            others = others.take(np.repeat(np.arange(len(cuts)), n), axis=0)
            h = sigmoid(np.einsum("jrd,jd->jr", others, cc) - log_noise[:, None])
            back = np.einsum("jr,jrd->jd", h, others)
            away = np.add.reduceat((h[:, :, None] * cc[:, None, :]).reshape(len(cc), -1), cuts, axis=0)
        else:       # few nodes of many tokens each
            h, back, away = np.empty((len(cc), noise), np.float32), np.empty_like(cc), np.empty_like(others)
            for i, (a, b) in enumerate(zip(cuts.tolist(), (cuts + n).tolist())):
                h[a:b] = sigmoid(cc[a:b] @ others[i].T - log_noise[a:b, None])
                back[a:b], away[i] = h[a:b] @ others[i], h[a:b].T @ cc[a:b]
        dc[deep] += g * own + back
        return np.concatenate([child, ids.ravel()]), np.concatenate([g * cc, away.reshape(-1, WIDTH + 1)])

    def step(self, seq) -> None:
        """A step on the tokens of a sequence but its first ``CONTEXT`` places."""
        m, last = self.m, len(self.m.outputs)
        at = np.flatnonzero(seq[CONTEXT:] < last)
        if not len(at):
            return
        at = at[np.argsort(seq[at + CONTEXT], kind="stable")]
        target = seq[at + CONTEXT]
        kind = m.class_of[target]
        top = m.group_of[kind]
        x = m.inputs.take(seq, axis=0)
        c = m.contexts(x).take(at, axis=0)
        noise = np.minimum(np.searchsorted(self.draw, self.random.random(NOISE[0])), len(self.draw) - 1)
        own, others = m.groups.take(top, axis=0), m.groups.take(noise, axis=0)
        g = -sigmoid(self.log_noise[top] - np.einsum("ij,ij->i", c, own))[:, None]
        h = sigmoid(c @ others.T - self.log_noise[noise])
        dc = g * own + h @ others
        classes = self.inside(0, m.classes, top, kind, c, dc)
        outputs = self.inside(1, m.outputs, kind, target, c, dc)
        dc[:, WIDTH] = 0
        back, n = np.zeros((len(seq) - CONTEXT, WIDTH + 1), np.float32), len(seq) - CONTEXT
        back[at] = dc
        dx, scales = np.zeros_like(x), np.empty_like(m.scales)
        for k in range(CONTEXT):
            of = slice(CONTEXT - 1 - k, CONTEXT - 1 - k + n)
            dx[of] += back * m.scales[k]
            scales[k] = np.einsum("nd,nd->d", back, x[of])
        self.change(0, seq, dx)
        for part, (rows, grads) in ((1, outputs), (2, classes)):
            if len(rows):
                self.change(part, rows, grads)
        self.change(3, np.concatenate([top, noise]), np.concatenate([g * c, h.T @ c]))
        self.change(4, np.arange(CONTEXT), scales)
        self.steps += 1


class Shard:
    """The training of one shard: steps of ``STEP`` places, whatever batches the documents come in. The tokens of a shard
    that gives fewer than ``LEAST_STEPS`` steps are gone through again."""

    def __init__(self, share):
        self.words, self.trainer = len(share) - 1, Trainer(share)
        self.held, self.size, self.all = [], 0, []

    def add(self, outcomes, length) -> None:
        self.held.append(sequence(outcomes, length, self.words)[0])
        self.size += len(self.held[-1])
        if self.size >= 4 * STEP:
            self.run(False)

    def run(self, last: bool) -> None:
        """Steps on what is held; the rest, and the places that the next token's context reaches back to, stay."""
        seq, a = np.concatenate(self.held), 0
        while len(seq) - a > (CONTEXT if last else STEP + CONTEXT):
            part = seq[a:a + STEP + CONTEXT]
            self.trainer.step(part)
            if self.all is not None:
                self.all.append(part)
            a += STEP
        if self.trainer.steps >= LEAST_STEPS:
            self.all = None
        self.held, self.size = [seq[a:]], len(seq) - a

    def done(self) -> Trainer:
        self.run(True)
        steps, again = 0, self.all
        while again and self.trainer.steps < LEAST_STEPS and steps != self.trainer.steps:
            steps = self.trainer.steps
            for part in again:
                self.trainer.step(part)
        return self.trainer


def outcomes_of(column):
    """The outcomes of a column of packed 32-bit numbers, and the offsets of its rows."""
    data, offsets = utf8(column)
    return np.frombuffer(data.tobytes(), "<i4").astype(np.int64), offsets // 4


def trained(coded: DataFrame, share, total: int):
    """The matrix of a model: each shard of the rows of ``coded`` trains one from a common start, and every row is averaged
    over the shards by how often they changed it. Shards hold ``SHARD`` tokens on average and take their rows by a hash,
    in the order of that hash, so the model depends on the rows alone and not on how a table is split."""
    shards = max(1, -(-total // SHARD))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(number: int, trainer: Trainer):
            for block in range(-(-len(trainer.met) // ROWS)):
                at = np.flatnonzero(trainer.met[block * ROWS:(block + 1) * ROWS]) + block * ROWS
                if len(at):
                    cells = [[block], [number], [at.tobytes()], [trainer.met[at].astype(np.float64).tobytes()], [trainer.m.matrix[at].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cells, (pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=["block", "shard", "at", "n", "means"])

        shard, now = None, None
        for b in batches:
            ids, offsets = outcomes_of(b.column("ids"))
            numbers = b.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1))
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if numbers[a] != now:
                    if shard:
                        yield from out(now, shard.done())
                    shard, now = Shard(share()), int(numbers[a])
                shard.add(ids[offsets[a]:offsets[e]], np.diff(offsets[a:e + 1]))
        if shard:
            yield from out(now, shard.done())

    def add(pdf):
        import pandas as pd

        block, shard = int(pdf["block"].iloc[0]), int(pdf["shard"].min())
        n, sums = np.zeros(ROWS), np.zeros((ROWS, WIDTH + 1))
        for _, at, w, means in pdf.sort_values("shard")[["shard", "at", "n", "means"]].itertuples(index=False):
            at, w = np.frombuffer(at, np.int64) - block * ROWS, np.frombuffer(w, np.float64)
            n[at] += w
            sums[at] += w[:, None] * np.frombuffer(means, np.float32).reshape(-1, WIDTH + 1)
        at = np.flatnonzero(n)
        means = (sums[at] / n[at, None]).astype(np.float32)
        return pd.DataFrame({"block": [block], "shard": [shard], "at": [(at + block * ROWS).tobytes()], "n": [n[at].tobytes()], "means": [means.tobytes()]})

    kind = "block int, shard long, at binary, n binary, means binary"
    place = F.xxhash64("ids", "doc_id")
    dealt = coded.select("ids", F.pmod(place, F.lit(shards)).alias("shard"), place.alias("place"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place")
    sums, left = dealt.select("ids", "shard").mapInArrow(run, kind), shards
    while left > 1:
        # fans of bounded width, in levels: numbers of shards are divided, never one group over all shards
        sums = sums.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).groupBy("block", "shard").applyInPandas(add, kind)
        left = -(-left // FAN_IN)
    model = Model.start(share())
    for r in sums.collect():
        model.matrix[np.frombuffer(r["at"], np.int64)] = np.frombuffer(r["means"], np.float32).reshape(-1, WIDTH + 1)
    return model.matrix


def score(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    free_shuffles(spark)
    small_batches(spark, rows=2048)
    rows = docs.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), whole_text().alias("text"))
    learn = rows.where(~F.col("held_out"))
    counts = stage(token_counts(learn), "op3-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = most_frequent(counts.where(F.length("token") <= MAX_TOKEN), "c", FREQUENT).orderBy(F.desc("c"), "token").toArrow()
    ends = counts.where(F.col("token") == F.lit(END)).select("c").first()
    tokens, known = short.column("token").to_pylist(), short.column("c").to_pylist()
    frequent = [(t, c) for t, c in zip(tokens, known) if t != END]
    plain = [END, *[t for t, _ in frequent]], np.array([ends["c"] if ends else 0, *[c for _, c in frequent]], float), total, distinct
    tables = shared(spark, Tables, *plain)

    def code(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = tables()
        for b in batches:
            ids, length, word = t.coded(b.column("text"))
            n, inner = len(length), ids < 0
            row = np.repeat(np.arange(n), length)
            at = np.flatnonzero(inner)
            rare = counted(row[at], word.take(pa.array(at - row[at])), n)
            known = np.bincount(row, ~inner & ((ids > 0) | (t.total > 0)), n).astype(np.int64)
            log_c = np.where(inner, 0.0, t.log_c[np.maximum(ids, 0)])
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[0, 4 * np.cumsum(length)].astype(np.int32)), pa.py_buffer(t.outcomes(ids).astype("<i4"))])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("held_out"), pa.array(length), pa.array(known), pa.array(np.bincount(row, log_c - t.base, n), pa.float64()), packed, rare,
                ],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "ids", "rare"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double"
    coded = rows.mapInArrow(code, f"{kind}, ids binary, rare array<struct<token:binary,n:bigint>>")
    coded = stage(coded.withColumn("_row", F.monotonically_increasing_id()), "op3-coded")
    share = shared(spark, np.asarray, Tables(*plain).share)
    matrix = shared(spark, np.asarray, trained(coded.where(~F.col("held_out")), share, total))
    rest = Tables(*plain).rest

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m, others = Model(matrix(), len(share())), len(share()) - 1
        for b in batches:
            ids, offsets = outcomes_of(b.column("ids"))
            length = np.diff(offsets)
            log_p = m.log_probabilities(*sequence(ids, length, others)) / LOG10 - np.where(ids == others, rest, 0.0)
            sums = np.bincount(np.repeat(np.arange(len(length)), length), log_p, len(length))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums, pa.float64())], names=[*b.schema.names[:-1], "model"])

    names = ["_row", "doc_id", "held_out", "n_tokens", "known", "base"]
    scored = coded.select(*names, "ids").mapInArrow(run, f"_row long, {kind}, model double")
    rare = coded.select("_row", F.explode("rare").alias("r")).select("_row", "r.token", "r.n")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    met = rare.join(counts, "token", "left").groupBy("_row").agg(F.sum(F.col("n") * log_c).alias("log_c"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("met"))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(met, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more("met")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more("log_c")).alias("base_score"), (F.col("model") + more("log_c")).alias("score"),
    )
