"""BPE encoding and decoding by forced-boundary splitting.

The vocabulary file gives tokens, merges and added tokens. Two neighbouring symbols (bytes of a pre-token, the last
one marked as a word end) that stand side by side in no vocabulary token can never become part of one token: there
the pre-token is cut. The fragments are encoded independently by the merge ranks, and the ids of a text are their
concatenation. The fragments of all new white-space-free chunks of a batch are cut at once from a table of byte pairs.
Encoded fragments and chunks are kept in bounded caches per worker, so frequent ones are encoded once.

Text handling as the vocabulary file prescribes: added tokens are cut out of the raw text first; the rest is
normalised (NFC, white space to one blank, lower case by character) and pre-tokenised by the file's pattern, of which
only the matches count. Decoding: the file names no decoder, so the token strings are joined by blanks.

Nulls: a null text is empty and has no tokens. Texts are handled one by one, whatever their length. An empty table
gives no rows; repeated rows are encoded each. The columns of the input are kept, those of the same names replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, whole_text

#: Chunks, and fragments, held by the caches of a worker.
CACHE = 400_000
#: Room of an id in a pair of ids.
SHIFT = 20
MASK = (1 << SHIFT) - 1
#: Symbols of a fragment beyond which a heap finds the next merge.
LONG = 128
#: White space of the normaliser's pattern.
SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is a visible
    Latin-1 character, else the next one from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Codec:
    """Encoder and decoder of one vocabulary file. Symbols and tokens are ids; a pair of ids is one number."""

    def __init__(self, path: str):
        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids = model["vocab"]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.added.items()]}
        #: pair -> rank and id of what it merges to, as one number that sorts by rank
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.merges[self.ids[left] << SHIFT | self.ids[right]] = rank << SHIFT | self.ids[left + right]
        self.none = len(model["merges"]) << SHIFT
        alphabet = byte_alphabet()
        #: ids of a byte inside a pre-token (0) and at its end (1)
        self.symbol = [[self.ids[c + e] for c in alphabet] for e in ("", self.end)]
        byte_of = {c: i for i, c in enumerate(alphabet)}
        #: whether two bytes stand side by side in a token, the second one inside (0) or at the end of a pre-token (1)
        self.inside = np.zeros((2, 256, 256), bool)
        for t in self.ids:
            last = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            raw = [byte_of[c] for c in (t[: -len(self.end)] if last else t) if c in byte_of]
            for i in range(1, len(raw)):
                self.inside[int(last and i == len(raw) - 1), raw[i - 1], raw[i]] = True
        if not self.end:
            self.inside[1] = self.inside[0]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.space = re.compile(f"[{SPACE}]+")
        #: white-space-free chunk -> packed ids, and -> decoded text; fragment (inside, at the end) -> ids
        self.packed: dict[str, bytes] = {"": b""}
        self.decoded: dict[str, str] = {"": ""}
        self.known: tuple[dict[bytes, tuple], dict[bytes, tuple]] = ({}, {})

    def fragments(self, pre_tokens: list[bytes]):
        """(fragment, whether it ends its pre-token) of pre-tokens in turn: cut where two neighbours stand side by side in
        no token."""
        import numpy as np

        data = b"".join(pre_tokens)
        raw, ends = np.frombuffer(data, np.uint8), np.cumsum([len(t) for t in pre_tokens])
        last = np.zeros(len(raw), np.int8)
        last[ends - 1] = 1
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = ~self.inside[last[1:], raw[:-1], raw[1:]] | (last[:-1] > 0)
        places = np.flatnonzero(cut)
        final = last[places[1:] - 1].tolist()
        places = places.tolist()
        return [data[a:b] for a, b in zip(places, places[1:])], final

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the neighbours of the least rank, of equals the first, until none can be merged."""
        get, none = self.merges.get, self.none
        if len(ids) > LONG:
            return self.merge_long(ids)
        ranks = [get(a << SHIFT | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            new = best & MASK
            ids[i:i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | new, none)
            if i < len(ranks):
                ranks[i] = get(new << SHIFT | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for long fragments: a heap of (rank, place) over a linked list, in n log n."""
        import heapq

        get, n = self.merges.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << SHIFT | ids[j]) != m:
                continue
            ids[i], ids[j], after[i] = m & MASK, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := get(ids[a] << SHIFT | ids[b])) is not None:
                    heapq.heappush(heap, (m, a))
        return [i for i in ids if i >= 0]

    def encoded(self, pre_tokens: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of every pre-token: its fragments' ids, one after another."""
        out, parts = [], []
        for f, final in zip(*self.fragments(pre_tokens)) if pre_tokens else ():
            known = self.known[final]
            ids = known.get(f)
            if ids is None:
                symbol = self.symbol[0]
                ids = [symbol[b] for b in f]
                if final:
                    ids[-1] = self.symbol[1][f[-1]]
                ids = known[f] = tuple(self.merge(ids))
            if final:
                out.append((*parts, *ids) if parts else ids)
                parts = []
            else:
                parts += ids
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks into the caches."""
        found = [[t.encode() for t in self.pattern.findall(c)] for c in chunks]
        ids = iter(self.encoded([t for ts in found for t in ts]))
        for c, ts in zip(chunks, found):
            own = [i for _ in ts for i in next(ids)]
            self.packed[c], self.decoded[c] = self.pack(own), self.decode(own)

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        text = self.space.sub(" ", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def chunks(self, text: str) -> list[str | int]:
        """The chunks of a text in order; an added token is its id."""
        if not self.special or not any(s in text for s in self.added):
            return self.normalise(text).split(" ")
        out: list[str | int] = []
        for p in self.special.split(text):
            out += [self.added[p]] if p in self.added else self.normalise(p).split(" ")
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str, int]]:
        """(packed ids, decoded text, number of ids) of every text."""
        for d in self.known:
            if len(d) > CACHE:
                d.clear()
        chunks = [self.chunks(t) for t in texts]
        todo = set().union(*chunks) - self.packed.keys()
        if len(self.packed) + len(todo) > CACHE:
            self.packed, self.decoded = {"": b""}, {"": ""}
            todo = set().union(*chunks) - self.packed.keys()
        for i in [c for c in todo if isinstance(c, int)]:
            todo.remove(i)
            self.packed[i], self.decoded[i] = self.pack([i]), self.names[i]
        self.learn(list(todo))
        ids = [b"".join(map(self.packed.__getitem__, c)) for c in chunks]
        return [(i, " ".join(filter(None, map(self.decoded.__getitem__, c))), len(i) // 4) for i, c in zip(ids, chunks)]

    @staticmethod
    def pack(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids) -> str:
        names = self.names
        return " ".join([names[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (packed little-endian 32-bit ids), ``n_tokens`` and ``decoded``."""
    path = path or default_vocabulary()
    small_batches(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded string, n_tokens long")
    def run(texts):
        import pandas as pd

        c = codec(path)
        return pd.DataFrame(c.encode_batch(texts.tolist()), columns=["ids", "decoded", "n_tokens"])

    made, names = free_name(docs, "_bpe"), ["ids", "decoded", "n_tokens"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.withColumn(made, run(whole_text(text))).select(*kept, *[F.col(f"{made}.{c}").alias(c) for c in names])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text: hashed where they are made, so neither has to
    travel."""
    path = path or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(path)
        for b in batches:
            out = c.encode_batch(b.column("text").to_pylist())
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([o[2] for o in out], pa.int64()), pa.array([sha(o[0]) for o in out]), pa.array([sha(o[1].encode()) for o in out])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
