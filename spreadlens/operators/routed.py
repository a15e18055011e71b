"""Exact top-k and threshold joins of sparse vectors: stored blocks of rows, that stream past the queries a task holds.

A row travels packed, as one array of 64-bit term codes and one of weights. The rows of either side are stored in blocks
of at most ``CHUNK`` rows and ``BLOCK_POSTINGS`` postings: the codes of a block once, each posting as a 32-bit place among
them and a weight. A task takes a share of the base's blocks and a part of the queries' out of a Cartesian product that reads the
stored files, so neither side is shuffled, however many blocks the other has. It gets each block once: it holds its queries as an index
(``held``), and the rows of the base stream past. Stored are the two sides, once; shuffled are at most k rows a query for each
share of the base.

Both sides are multiplied tile by tile, in single precision; what that leaves to decide is multiplied again in double
precision. A task emits at most k rows a query (or what reaches the threshold, as it is found), so no operator holds all pairs, and
no key is a term, so no frequent term is a hot key.

A label predicate (``base label <> query label``) is one on tiles: a label of many rows has tiles of its own, and two tiles of one
label never meet; other rows share tiles, where equal labels are masked. A row of a label that nearly all rows have so
searches the few rows of other labels only, however many neighbours of its own label are nearer.

Codes are hashes of terms, proved to differ for all terms of the base (else another salt is taken); a query's term whose
code is that of another term of the base is left out, as the base lacks it. So the search is exact.

Ranking = (similarity rounded to 9 decimals, descending; base id ascending). Every base row is a candidate: a query with
fewer than k positive similarities is filled up with the least ids of the rest at similarity 0. Weights must not be
negative, and vectors are taken as they are (unit length for cosines).

Nulls: rows with a null id are left out on both sides; null labels are a label of their own, as are different strings.
An id that comes twice with one label is one row. An empty base gives no rows; a query without terms gets the k least ids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, small_batches
from . import blocks, held

#: Rows of a shard on average at most, and at least where the cores don't ask for more shards.
SHARD_ROWS = 4096
LEAST_ROWS = 256
#: Rows and postings of a stored block at most (a single row may have more postings).
CHUNK = 1024
BLOCK_POSTINGS = 400_000
#: Rows and postings of the base that a cell of work has on average at most.
BLOCK_ROWS = 32768
CELL_POSTINGS = 12_000_000
#: Rows that a label has in a task at least to get blocks of its own there, and how many labels are planned for.
OWN_ROWS, OWN_LABELS = 256, 256
#: Postings of the queries that a task holds on average at most.
HELD_POSTINGS = 3_000_000


def staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label_of(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def id_kind(df: DataFrame, id_col: str) -> str:
    return "string" if df.schema[id_col].dataType.simpleString() == "string" else "long"


@dataclass
class Packed:
    """Vectors of a set of rows in stored blocks, which either side of a search reads. ``vecs`` and ``rows`` are computed
    only where they are read."""
    vecs: DataFrame         # (doc_id, term, weight)
    rows: DataFrame         # (id, label, head, codes, weights); head is a row's heaviest term or its code
    blocks: DataFrame       # (number, label or null where several, n, postings, ids, labels, sizes, vocabulary, places, weights), staged
    terms: DataFrame        # (code, term) that the codes stand for; one term a code
    salt: int


@dataclass
class Index:
    """A base cut into blocks; build it once for any number of searches. ``postings`` and ``maxima`` show how rows of one
    label and one heaviest term lie together and what bounds them; nothing computes these two unless they are read."""
    postings: DataFrame     # (shard, label, id, term, weight), each row of the base in one shard
    maxima: DataFrame       # (shard, label, term, most)
    docs: DataFrame         # (id, label)
    rows: DataFrame         # (id, label, head, codes, weights), computed where it is read only
    blocks: DataFrame       # the rows in stored blocks, see Packed
    terms: DataFrame        # (code, term) of the base; one term a code
    salt: int
    shard_rows: int
    sizes: list[tuple]      # (label, rows, postings) of the labels with blocks of their own
    rest: tuple             # (rows, postings) of all others

    def least(self, n: int) -> list[tuple]:
        """(id, label) of the n least ids of every label; n rows for each distinct label reach the driver."""
        w = Window.partitionBy("label").orderBy("id")
        return [(r["id"], r["label"]) for r in self.docs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).collect()]


def sides(docs: DataFrame, vecs: DataFrame, id_col: str, label_col: str | None) -> tuple[DataFrame, DataFrame]:
    """((id, label), (id, term, weight)) of a set of rows; postings of rows that are not in the set are left out."""
    kind = id_kind(docs, id_col)
    d = docs.select(F.col(id_col).cast(kind).alias("id"), label_of(F.col(label_col) if label_col else F.lit(None)).alias("label"))
    v = vecs.select(F.col("doc_id").cast(kind).alias("id"), "term", "weight").where("weight > 0")
    return d.where("id is not null").dropDuplicates(["id", "label"]), v


def _queries(docs: DataFrame, vecs: DataFrame | Packed, id_col: str, label_col: str | None):
    """As ``sides``; packed vectors stay so."""
    d, v = sides(docs, vecs.vecs if isinstance(vecs, Packed) else vecs, id_col, label_col)
    return d, vecs if isinstance(vecs, Packed) else v


def _code(salt: int) -> Column:
    return F.xxhash64("term", F.lit(salt))


def _packed(d: DataFrame, v: DataFrame, salt: int) -> DataFrame:
    """(id, label, head, codes, weights): one row for each row of ``d`` that has terms; head is its heaviest term."""
    rows = v.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(_code(salt).alias("code"), "weight"))).alias("p"),
                               F.max_by("term", F.struct("weight", "term")).alias("head"))
    return rows.join(d, "id").select("id", "label", "head", F.col("p.code").alias("codes"), F.col("p.weight").alias("weights"))


def _coded_terms(v: DataFrame) -> tuple[DataFrame, int]:
    """(code, term) of all terms and the salt that gives each a code of its own."""
    salt = 0
    while True:
        terms = staged(v.select(_code(salt).alias("code"), "term").distinct(), "shard-terms")
        if terms.groupBy("code").count().where("count > 1").isEmpty():
            return terms, salt
        salt += 1


def build(docs: DataFrame, vecs: DataFrame, id_col: str = "doc_id", label_col: str | None = None, shard_rows: int | None = None,
          n_docs: int | None = None) -> Index:
    """Index of a base (of ``n_docs`` rows, counted unless given), whose vectors are (doc_id, term, weight) or ``Packed``. A
    shard of ``postings`` holds the rows of one label whose heaviest term is the same, cut by a hash where these are
    many; terms that head few rows share shards by a hash of the term."""
    given = vecs if isinstance(vecs, Packed) else None
    d, v = sides(docs, given.vecs if given else vecs, id_col, label_col)
    heads = v.groupBy("id").agg(F.max_by("term", F.struct("weight", "term")).alias("head"))
    headed = d.join(heads, "id")
    sizes = headed.groupBy("label", "head").agg(F.count("*").alias("n"))
    if shard_rows is None:
        cores = docs.sparkSession.sparkContext.defaultParallelism
        shard_rows = min(SHARD_ROWS, max(LEAST_ROWS, math.ceil((d.count() if n_docs is None else n_docs) / cores)))
    many = F.col("n") * 2 > shard_rows
    spare = sizes.where(~many).groupBy("label").agg(F.sum("n").alias("rest"))
    plan = sizes.join(spare, "label", "left").select(
        "label", "head", many.alias("own"), F.ceil(F.when(many, F.col("n")).otherwise(F.col("rest")) / shard_rows).alias("parts"))
    number = F.pmod(F.when(F.col("own"), F.xxhash64("id")).otherwise(F.xxhash64("head")), F.col("parts"))
    shard = F.concat_ws("/", "label", F.when(F.col("own"), F.col("head")).otherwise(F.lit("")), number.cast("string"))
    placed = headed.join(plan, ["label", "head"]).select("id", "label", shard.alias("shard"))
    postings = v.join(placed, "id").select("shard", "label", "id", "term", "weight")
    maxima = postings.groupBy("shard", "label", "term").agg(F.max("weight").alias("most"))
    if given is None:
        terms, salt = _coded_terms(v)
        given = packed(_packed(d, v, salt), v, terms, salt)
    of = given.blocks.groupBy("label").agg(F.sum("n").alias("n"), F.sum("postings").alias("p"))
    own = [tuple(r) for r in of.where("label is not null").orderBy(F.col("n").desc(), "label").limit(OWN_LABELS).collect()]
    rest = of.where(F.col("label").isNull() | ~F.col("label").isin([x[0] for x in own])).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0))).first()
    return Index(postings, maxima, d, given.rows, given.blocks, given.terms, given.salt, shard_rows, own, tuple(rest))


def packed(rows: DataFrame, vecs: DataFrame, terms: DataFrame, salt: int) -> Packed:
    """The rows in stored blocks; a task's rows lie in them by label and head."""
    small_batches(rows.sparkSession)
    run = blocks.maker(CHUNK, BLOCK_POSTINGS, OWN_ROWS)
    sorted_rows = rows.sortWithinPartitions("label", "head", "id").select("id", "label", "codes", "weights")
    return Packed(vecs, rows, staged(sorted_rows.mapInArrow(run, blocks.schema(id_kind(rows, "id"))), "shard-blocks"), terms, salt)


def strange_terms(terms: DataFrame, known: DataFrame) -> list[str]:
    """Those of ``terms`` (code, mine) that share a code with another term of ``known`` (code, term); nearly always none."""
    return [r["mine"] for r in terms.join(known, "code").where("mine <> term").select("mine").collect()]


def _cells(index: Index, q_docs: DataFrame, other_label: bool) -> tuple[list[dict], list[int]]:
    """The work in cells of about equal products of rows and queries, so many that all cores are busy: parts of the base as
    (label, or None where several share it; first part; parts), and the number of cells of each part."""
    sized = [x for x in [*index.sizes, (None, *index.rest)] if x[1]]
    counts = {r["label"]: r["n"] for r in q_docs.where(F.col("label").isin([x[0] for x in index.sizes])).groupBy("label").agg(F.count("*").alias("n")).collect()} if other_label else {}
    n_q = q_docs.count()
    work = [n * (n_q - counts.get(label, 0)) for label, n, _ in sized]
    share = max(1.0, sum(work) / (2 * q_docs.sparkSession.sparkContext.defaultParallelism))
    groups, cells = [], []
    for (label, n, p), w in zip(sized, work):
        want = max(1, math.ceil(w / share))
        parts = max(1, math.ceil(n / BLOCK_ROWS), math.ceil(p / CELL_POSTINGS), min(want, n, round(math.sqrt(want * n * n / max(w, 1)))))
        groups.append({"label": label, "at": len(cells), "parts": parts})
        cells += [math.ceil(want / parts)] * parts
    return groups, cells


def _searches(kinds: tuple, k: int | None, how: dict):
    """A map of the pairs of a task's blocks, (b_*) of the base and (q_*) of the queries, in which one of the two is the first of its side:
    each block comes once with its rows, all queries before the second block of the base."""
    def run(batches):
        import pyarrow as pa

        types = [pa.string() if x == "string" else pa.int64() for x in kinds]
        out = lambda qid, bid, sim, key: pa.RecordBatch.from_arrays([pa.array(qid.tolist(), types[0]), pa.array(bid.tolist(), types[1]), pa.array(sim), pa.array(key)], names=["qid", "bid", "sim", "skey"])
        queries, seen, base, side, now, rows, postings = [], set(), [], None, None, 0, 0

        def searched():
            nonlocal side, rows, postings
            if side is None:
                side = held.Held(queries, k, **how)
            for x in side.search(base):
                yield out(*x)
            rows = postings = 0

        for batch in batches:
            of_base, of_queries = batch.column("b_number").to_pylist(), batch.column("q_number").to_pylist()
            for i, (b, number) in enumerate(zip(of_base, of_queries)):
                if b != now:
                    if base and (rows >= held.BASE_ROWS or postings >= held.BASE_POSTINGS):
                        yield from searched()
                    now = b
                    base.append(blocks.Rows(batch, i, "b_"))
                    rows, postings = rows + len(base[-1].ids), postings + len(base[-1].places)
                if number not in seen:
                    if side is not None:
                        raise RuntimeError("a block of queries came after the search began")
                    seen.add(number)
                    queries.append(blocks.Rows(batch, i, "q_"))
        if base:
            yield from searched()
        if side is not None and k is not None:
            for x in side.best():
                yield out(*x)

    return run


def _dealt(n_cells: int, n_q: int, n_b: int, postings: int, most: int, cores: int) -> tuple[int, int]:
    """Parts of the queries and of the base that the tasks of a search take. A part of the queries is held, so its postings are
    bounded (as far as its ``most`` files can be told apart); each part reads the other side as often as that has parts."""
    tasks = max(n_cells, 4 * cores)
    held_in = math.ceil(postings / HELD_POSTINGS)
    parts = min(most, max(1, held_in, round(math.sqrt(tasks * n_q / max(1, n_b)))))
    return parts, math.ceil(tasks / parts)


def _pairs(base: DataFrame, queries: DataFrame) -> DataFrame:
    """The pairs of blocks, (b_*) and (q_*), of each share of the base and part of the queries in which one of the two is the first
    of its side. The rows of a block are in its pair with the first of the other side, so they reach a task once."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))         # number of a row in its partition
    b, q = (df.select(*[F.col(c).alias(side + c) for c in blocks.COLUMNS], at.alias(side + "at")) for side, df in (("b_", base), ("q_", queries)))
    pairs = b.hint("shuffle_replicate_nl").join(q, (F.col("b_at") == 0) | (F.col("q_at") == 0))
    once = lambda side, other: [F.when(F.col(other + "at") == 0, F.col(side + c)).alias(side + c) for c in blocks.COLUMNS if c != "number"]
    return pairs.select("b_number", "q_number", *once("b_", "q_"), *once("q_", "b_"))


def _found(q_docs: DataFrame, q_vecs: DataFrame | Packed, index: Index, other_label: bool, k: int | None, **how) -> DataFrame:
    """(qid, bid, sim, skey) of what the blocks find: for top-k at most k rows a query and share of the base."""
    spark = q_docs.sparkSession
    kinds = id_kind(q_docs, "id"), id_kind(index.docs, "id")
    ids = f"qid {kinds[0]}, bid {kinds[1]}, sim double, skey double"
    _, cells = _cells(index, q_docs, other_label)
    if not cells:
        return spark.createDataFrame([], ids)
    if not isinstance(q_vecs, Packed):
        terms = q_vecs.select(_code(index.salt).alias("code"), F.col("term").alias("mine")).distinct()
        strange = strange_terms(terms, index.terms)
        mine = q_vecs.where(~F.col("term").isin(strange)) if strange else q_vecs
        q_vecs = packed(_packed(q_docs, mine, index.salt), mine, index.terms, index.salt)
    elif q_vecs.salt != index.salt:
        raise ValueError("the queries are packed with other codes than the base")
    n_q, postings, n_b = *q_vecs.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("postings"), F.lit(0))).first(), sum(x[1] for x in index.sizes) + index.rest[0]
    parts, shares = _dealt(sum(cells), n_q, n_b, postings, max(1, q_vecs.blocks.rdd.getNumPartitions()), spark.sparkContext.defaultParallelism)
    pairs = _pairs(index.blocks.coalesce(shares), q_vecs.blocks.coalesce(parts))
    return pairs.mapInArrow(_searches(kinds, k, how | {"other_label": other_label}), ids)


def _bounds(q_docs: DataFrame, q_vecs: DataFrame, index: Index, other_label: bool) -> DataFrame:
    """(id, shard, bound): for each query and shard that share a term, no similarity between them is greater."""
    q = q_vecs.join(q_docs.select("id", F.col("label").alias("own")), "id")
    m = q.join(index.maxima, "term")
    if other_label:
        m = m.where("label <> own")
    return m.groupBy("id", "shard").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))


def topk(query_docs: DataFrame, query_vecs: DataFrame, index: Index, k: int, id_col: str = "doc_id", label_col: str | None = None,
         exclude_same_label: bool = False, exclude_self: bool = False) -> DataFrame:
    """(qid, bid, sim, skey, rank): the k best base rows of every query row."""
    q_docs, q_vecs = _queries(query_docs, query_vecs, id_col, label_col)
    if k <= 0:
        return q_docs.join(index.docs.select(F.col("id").alias("bid")), F.lit(False)).select(F.col("id").alias("qid"), "bid", F.lit(0.0).alias("sim"), F.lit(0.0).alias("skey"), F.lit(0).alias("rank"))
    found = _found(q_docs, q_vecs, index, exclude_same_label, k=k, min_sim=None, exclude_self=exclude_self)
    w = Window.partitionBy("qid").orderBy(F.col("skey").desc(), F.col("bid").asc())
    found = staged(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "shard-found")
    have = found.groupBy("qid").agg(F.count("*").alias("n"))
    short = q_docs.join(have, q_docs["id"] == have["qid"], "left").select(q_docs["id"].alias("qid"), "label", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    return found if short.isEmpty() else found.unionByName(_filled(short, found, index, k, exclude_same_label, exclude_self))


def _filled(short: DataFrame, found: DataFrame, index: Index, k: int, other_label: bool, exclude_self: bool) -> DataFrame:
    """Rows of similarity 0 that bring queries of fewer than k found rows, (qid, label, n), up to k, the least ids first."""
    least = sorted(index.least(2 * k + 1))
    if not least:
        return found.limit(0)
    bid = index.docs.schema["id"].dataType
    choice = F.array(*[F.struct(F.lit(i).cast(bid).alias("bid"), F.lit(lab).alias("of")) for i, lab in least])
    rows = short.select("qid", "label", "n", F.explode(choice).alias("c")).select("qid", "label", "n", "c.bid", "c.of")
    if other_label:
        rows = rows.where("of <> label")
    if exclude_self:
        rows = rows.where("bid <> qid")
    rows = rows.join(found.select("qid", "bid"), ["qid", "bid"], "left_anti")
    place = F.col("n") + F.row_number().over(Window.partitionBy("qid").orderBy("bid"))
    return rows.select("qid", "bid", F.lit(0.0).alias("sim"), F.lit(0.0).alias("skey"), place.cast("int").alias("rank")).where(F.col("rank") <= k)


def similar(query_docs: DataFrame, query_vecs: DataFrame, index: Index, min_sim: float, id_col: str = "doc_id", label_col: str | None = None,
            exclude_same_label: bool = False) -> DataFrame:
    """(qid, bid, sim, skey) of all pairs of rounded similarity ``min_sim`` or more, which must be positive."""
    if min_sim <= 0:
        raise ValueError("a threshold join needs a positive threshold; every pair reaches 0")
    q_docs, q_vecs = _queries(query_docs, query_vecs, id_col, label_col)
    return _found(q_docs, q_vecs, index, exclude_same_label, k=None, min_sim=min_sim, exclude_self=False)
