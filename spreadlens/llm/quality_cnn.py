"""Quality probability of a text from a byte-level convolutional network in numpy.

Bytes are embedded; one more input says whether a byte ends a run of ``RUN`` bytes that stood up to 40 bytes earlier
in the document, which no linear filter could tell. Learned filters of ``2 * BLOCK`` bytes are applied to chunks that overlap by half and cover the
whole document; each filter's greatest response over the document (max-pooling) goes through a small hidden layer
into one probability. A chunk is two neighbouring blocks, so its responses are the sum of what its first and its
second block give, and a batch of documents is one matrix product.

The network is trained on a bounded sample of labelled rows (``PER_CLASS`` texts of up to ``MAX_CHARS`` characters of each
label); every whole text is scored. The back-propagated part is only what the maxima came from.

Nulls: a null text is an empty one, which is a document of zero bytes. Labels of one class only give that share as
the score. An empty table gives no rows; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, shared, small_batches, utf8, whole_text

BLOCK = 8
WIDTH = 8
FILTERS = 32
HIDDEN = 16
PER_CLASS = 1500
MAX_CHARS = 12_000
EPOCHS = 6
#: Training steps at least, for small samples.
LEAST_STEPS = 300
ACCEPT = 0.3
#: Distances at which a byte run counts as a repetition, and its length.
LAGS = range(2, 41)
RUN = 4
CELL = WIDTH + 1
#: Bytes of a document that go through the filters at once; the maxima of its parts are combined.
PART = 1 << 18
#: Blocks before a part that hold all bytes of a repetition that ends in it.
BEFORE = -(-(max(LAGS) + RUN - 1) // BLOCK)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "emb": r.normal(0, 0.5, (256, WIDTH)).astype(f),
            "filt": r.normal(0, (2 * BLOCK * CELL) ** -0.5, (2, BLOCK * CELL, FILTERS)).astype(f),
            "fb": np.zeros(FILTERS, f),
            "hid": r.normal(0, FILTERS ** -0.5, (FILTERS, HIDDEN)).astype(f),
            "hb": np.zeros(HIDDEN, f),
            "out": r.normal(0, HIDDEN ** -0.5, HIDDEN).astype(f),
            "ob": np.zeros(1, f),
        }
        self.share, self.shift, self.trained = 0.5, 0.0, False

    def responses(self, blocks, firsts=(0,)):
        """Filter responses of the chunks that start at each block but the last; blocks: (n, BLOCK) bytes of the
        documents that start at the blocks ``firsts``."""
        flat = blocks.reshape(-1)
        x = np.empty((len(flat), CELL), np.float32)
        x[:, :WIDTH] = self.p["emb"][flat]
        x[:, WIDTH] = repeated(flat, np.asarray(firsts) * BLOCK)
        x = x.reshape(len(blocks), -1)
        y = x @ np.concatenate([self.p["filt"][0], self.p["filt"][1]], axis=1)
        return x, y[:-1, :FILTERS] + y[1:, FILTERS:]

    def pooled(self, data, offsets):
        """The greatest response of each filter in every document: (rows, FILTERS)."""
        out = np.empty((len(offsets) - 1, FILTERS), np.float32)
        small = []
        for i in range(len(out)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if b - a <= PART:
                small.append(i)
                continue
            blocks, step = padded(data[a:b]), max(1, PART // BLOCK)
            out[i] = -np.inf
            for s in range(0, len(blocks) - 1, step):
                low = max(0, s - BEFORE)
                out[i] = np.maximum(out[i], self.responses(blocks[low:s + step + 1])[1][s - low:].max(axis=0))
        at = 0
        while at < len(small):
            group, size = [], 0
            while at < len(small) and (not group or size < PART):
                group.append(small[at])
                size += int(offsets[small[at] + 1] - offsets[small[at]])
                at += 1
            docs = [padded(data[offsets[i]:offsets[i + 1]]) for i in group]
            ends = np.cumsum([len(d) for d in docs])
            _, y = self.responses(np.concatenate(docs), np.r_[0, ends[:-1]])
            y[ends[:-1] - 1] = -np.inf          # a chunk across two documents
            out[group] = np.maximum.reduceat(y, np.r_[0, ends[:-1]], axis=0)
        return out

    def head(self, pooled):
        z = np.maximum(pooled + self.p["fb"], 0)
        h = np.tanh(z @ self.p["hid"] + self.p["hb"])
        return z, h, h @ self.p["out"] + self.p["ob"][0]

    def scores(self, data, offsets):
        if not self.trained:
            return np.full(len(offsets) - 1, float(self.share))
        logit = self.head(self.pooled(data, offsets))[2].astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))

    def gradients(self, texts: list[bytes], y):
        p, grads = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        kept, pooled = [], np.empty((len(texts), FILTERS), np.float32)
        for i, t in enumerate(texts):
            blocks = padded(np.frombuffer(t, np.uint8))
            x, r = self.responses(blocks)
            best = r.argmax(axis=0)
            pooled[i] = r[best, np.arange(FILTERS)]
            kept.append((np.stack([blocks[best], blocks[best + 1]]), np.stack([x[best], x[best + 1]])))
        z, h, logit = self.head(pooled)
        err = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        grads["out"], grads["ob"] = h.T @ err, np.array([err.sum()], np.float32)
        dh = np.outer(err, p["out"]) * (1 - h * h)
        grads["hid"], grads["hb"] = z.T @ dh, dh.sum(axis=0)
        dz = (dh @ p["hid"].T) * (z > 0)
        grads["fb"] = dz.sum(axis=0)
        for (b, x), g in zip(kept, dz):
            grads["filt"] += (x * g[None, :, None]).transpose(0, 2, 1)
            de = (p["filt"].transpose(0, 2, 1) * g[None, :, None]).reshape(-1, CELL)[:, :WIDTH]
            np.add.at(grads["emb"], b.reshape(-1), de)
        return grads

    def fit(self, texts: list[bytes], y, share: float, epochs: int = EPOCHS, batch: int = 32, rate: float = 4e-3, seed: int = 11):
        """Adam on the logistic loss; the sample's class shares are corrected to ``share`` afterwards."""
        self.share = share
        n1 = int(y.sum())
        if not 0 < n1 < len(y):
            return self
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        per_epoch = -(-len(y) // batch)
        epochs = max(epochs, -(-LEAST_STEPS // per_epoch))
        steps, total = 0, epochs * per_epoch
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                steps += 1
                lr = rate * min(1.0, 2 * (1 - steps / (total + 1)))
                for k, g in self.gradients([texts[i] for i in pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9 ** steps)) / (np.sqrt(v[k] / (1 - 0.999 ** steps)) + 1e-8)).astype(np.float32)
        clip = lambda q: min(max(q, 1e-3), 1 - 1e-3)
        odds = lambda q: np.log(clip(q) / (1 - clip(q)))
        self.shift, self.trained = float(odds(share) - odds(n1 / len(y))), True
        return self


def repeated(flat, starts):
    """Whether each byte ends a run that stood a few bytes earlier in its document (not for zero bytes)."""
    n = len(flat)
    lag = np.full(n, 255, np.uint8)
    if n >= RUN:
        g = flat[: n - 3].astype(np.uint32)
        for k in range(1, RUN):
            g |= flat[k:n - 3 + k].astype(np.uint32) << np.uint32(8 * k)
        for d in reversed(LAGS):
            if d < len(g):
                np.copyto(lag[d + RUN - 1:], np.uint8(d), where=g[d:] == g[:-d])
    place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    return (lag < 255) & (place >= lag.astype(np.int64) + RUN - 1) & (flat != 0)


def padded(data):
    """Bytes as blocks: filled up with zeros to whole blocks, and one block of zeros after them."""
    n = max(1, -(-len(data) // BLOCK)) + 1
    out = np.zeros(n * BLOCK, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, BLOCK)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Network:
    texts, y, share = labelled_sample(docs, labels, "quality", lambda c: fold(c, 5) != 0, per_class, max_chars)
    return Network().fit([t.encode() for t in texts], y, share)


def restored(parameters: dict, share: float, shift: float, trained: bool) -> Network:
    n = Network()
    n.p, n.share, n.shift, n.trained = parameters, share, shift, trained
    return n


def score(docs: DataFrame, labels: DataFrame, threshold: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    n = train(docs, labels)
    network = shared(spark, restored, n.p, n.share, n.shift, n.trained)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            scores = network().scores(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
