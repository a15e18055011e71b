"""SimHash near-duplicate groups: byte-position inverted index, count filtering, verification, components.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most four bits agree in at
least four of them (the guaranteed minimum of the count filter). Posting lists of single bytes would be hit by
every 256th fingerprint, so the index keeps, instead of single (position, byte) lists, their intersections over
twenty triples of positions, chosen so that any four shared positions contain one of the triples. A pair met in a
posting list has its shared positional bytes tallied, goes on with four or more, and is then verified by its bit
distance. Equal fingerprints are one node, so exact copies never meet in the index.

A posting of two entries is its least and greatest entry; one of up to ``JOIN_LIMIT`` is joined with itself; a larger
one is cut in blocks of about ``BLOCK`` entries, every pair of blocks is searched, and each search returns a spanning
forest of the links that it finds rather than all of them, which leaves the components as they are. No pair
of fingerprints goes uncompared.

Nulls: a null text has no words and the fingerprint zero, like an empty one; rows with a null doc_id take part and
can't name their component. Repeated rows and ids are copies. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, free_shuffles, small_batches, stage, whole_text
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
JOIN_LIMIT = 32
BLOCK = 2048


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of the eight positions such that any four positions contain one: split the positions in three
    groups and take the triples inside a group and those with two in a group and one in the next."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    out = [t for g in groups for t in combinations(g, 3)]
    out += [(*p, x) for i, g in enumerate(groups) for p in combinations(g, 2) for x in groups[(i + 1) % 3]]
    return out


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit integer."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    w = text.lower().split()     # of bytes: lowers A-Z and splits at \\x20 and \\x09-\\x0D only
    if not w:
        return 0
    whole = b" ".join(w)
    if len(w) <= shingle:
        h = np.array([digest(whole, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        first = [0, *(ends[: len(w) - shingle] + 1).tolist()]
        h = np.fromiter((digest(whole[s:e], SEED) for s, e in zip(first, ends[shingle - 1:].tolist())), np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, fp) of every row; the digest is that of the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint(t.encode(), shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(fps, pa.int64())], names=["doc_id", "digest", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.sha2(whole_text(), 256).alias("digest"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest string, fp long")


def byte_at(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(255)


def postings(nodes: DataFrame) -> DataFrame:
    """(key, fp): the intersected byte-position lists; a key is the number of its triple and three bytes."""
    fp = F.col("fp")
    keys = [
        (F.lit(n) * (1 << 24) + byte_at(fp, a) * (1 << 16) + byte_at(fp, b) * 256 + byte_at(fp, c)).cast("long")
        for n, (a, b, c) in enumerate(covering_triples())
    ]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def linked(a: Column, b: Column, max_bits: int) -> Column:
    """Count filter, then the bit distance."""
    shared = sum((byte_at(a, i) == byte_at(b, i)).cast("int") for i in range(8))
    return (shared >= 8 - max_bits) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)


def spanning_links(fps, max_bits: int):
    """Links (root, member) that span the components of the fingerprints under the bit distance, by breadth-first
    search: each fingerprint is compared with all not reached yet."""
    import numpy as np

    rest, roots, members = np.unique(fps).view(np.uint64), [], []
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                near |= (np.bitwise_count(front[at:at + 64, None] ^ rest[None, :]) <= max_bits).any(axis=0)
            front, rest = rest[near], rest[~near]
            roots.append(np.full(len(front), root, np.uint64))
            members.append(front)
    join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
    return join(roots), join(members)


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between different fingerprints whose components are those of all links."""
    if max_bits > 4:
        raise ValueError("the covering triples guarantee distances of up to 4 bits")
    posted = stage(postings(nodes), "op9-postings")
    sizes = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = stage(sizes, "op9-sizes")
    twos = sizes.where("n = 2").select("a", "b").where(linked(F.col("a"), F.col("b"), max_bits))
    some = posted.join(sizes.where(f"n > 2 and n <= {JOIN_LIMIT}").select("key"), "key")
    few = (
        some.select("key", F.col("fp").alias("a")).join(some.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & linked(F.col("a"), F.col("b"), max_bits)).select("a", "b")
    )
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    many = (
        posted.join(sizes.where(f"n > {JOIN_LIMIT}").select("key", blocks.alias("k")), "key")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        .select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def search(pdf):
        import pandas as pd

        a, b = spanning_links(pdf["fp"].to_numpy(), max_bits)
        return pd.DataFrame({"a": a, "b": b})

    hot = many.groupBy("key", "i", "j").applyInPandas(search, "a long, b long")
    return twos.union(few).union(hot).distinct()


def groups(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The marked rows (doc_id, digest, fp), and of every fingerprint its component and the component's first row:
    (fp, root, first), first being the least (doc_id, digest) of the rows with an id."""
    free_shuffles(docs.sparkSession)
    marked = stage(fingerprints(docs, shingle), "op9-fingerprints")
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))
    nodes = stage(marked.groupBy("fp").agg(F.min(row).alias("first")), "op9-nodes")
    roots = components(links(nodes, max_bits), "a", "b")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return marked, placed.drop("first").join(placed.groupBy("root").agg(F.min("first").alias("first")), "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    marked, found = groups(docs, shingle, max_bits)
    named = found.select("fp", F.col("first.doc_id").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without those that repeat another: of each group the row with the least doc_id stays, of
    equal ids that with the least text digest, and of rows equal in both one. A group always keeps a row. Rows with a
    null doc_id can't be matched with their group and stay."""
    _, found = groups(docs, shingle, max_bits)
    digest = free_name(docs, "_digest")
    first = found.groupBy("root").agg(F.first("first").alias("f")).select(F.col("f.doc_id").alias("_first"), F.col("f.digest").alias("_text"))
    rows = docs.withColumn(digest, F.sha2(whole_text(), 256))
    kept = rows.join(first, (rows["doc_id"] == first["_first"]) & (rows[digest] == first["_text"]), "left_semi").dropDuplicates(["doc_id", digest])
    return kept.drop(digest).union(docs.where(F.col("doc_id").isNull()))
