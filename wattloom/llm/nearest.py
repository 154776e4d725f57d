"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import read, ship
from .embedding_dedup import units, usable

REACH = 2  # buckets to either side that a probe may step
TRIED = 128  # queries on which the number of probes is fitted
BLOCK, ASKED = 4096, 512


class Hashing:
    """`tables` hash tables of `hashes` p-stable (Gaussian) functions floor((a.x + b) / width)."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.a = rng.standard_normal((tables, dim, hashes))
        self.b = rng.uniform(0, width, (tables, hashes))
        self.mix = rng.integers(0, 1 << 62, (tables, hashes)) * 2 + 1
        self.width, self.tables = width, tables
        self.steps = np.array(list(product(range(-REACH, REACH + 1), repeat=hashes)))

    def slots(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        f = (x @ self.a[t] + self.b[t]) / self.width
        s = np.floor(f)
        return s.astype(np.int64), f - s

    def code(self, slots: np.ndarray, t: int) -> np.ndarray:
        return (slots * self.mix[t]).sum(axis=-1)

    def probes(self, x: np.ndarray, t: int, n: int) -> np.ndarray:
        """(rows, n) bucket codes: the row's own first, then perturbed ones by falling estimated
        success, that is by the sum of squared distances to the bucket's sides."""
        s, rest = self.slots(x, t)
        off = np.arange(-REACH, REACH + 1)
        gap = np.where(off < 0, rest[:, :, None] - off - 1, np.where(off > 0, off - rest[:, :, None], 0.0)) ** 2
        cost = sum(gap[:, i, self.steps[:, i] + REACH] for i in range(s.shape[1]))
        order = np.argsort(cost, axis=1, kind="stable")[:, :n]
        return self.code(s[:, None, :] + self.steps[order], t)


def by_length(b: pa.RecordBatch, col: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = np.diff(b.column(col).offsets.to_numpy())
    for d in np.unique(size).tolist():
        yield d, b.filter(pa.array(size == d))


def nearest_in(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, cosine) of the k rows of y nearest to each row of x, ties to smaller ids."""
    sim = x @ y.T
    k = min(k, len(y))
    rows, found, values = [], [], []
    low = np.partition(sim, len(y) - k, axis=1)[:, len(y) - k] - 1e-12
    for i, (s, at_least) in enumerate(zip(sim, low, strict=True)):
        at = np.flatnonzero(s >= at_least)
        at = at[np.lexsort((ids[at], -s[at].round(12)))[:k]]
        rows.append(np.full(len(at), i))
        found.append(ids[at])
        values.append(s[at])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(values)


def fit_probes(classes: DataFrame, queries: DataFrame, make, k: int, goal: float, seed: int) -> int:
    """Fewest probes per table with which the k nearest of a bounded sample (TRIED queries, by
    hash) are met with recall `goal`. The sample is compared with all classes in one pass."""
    some = queries.orderBy(F.xxhash64(F.lit(seed), "qid"), "qid").limit(TRIED).collect()
    held = {}
    for r in some:
        held.setdefault(len(r.vec), []).append(r)
    asked = {d: (np.array([r.qid for r in g]), np.array([r.vec for r in g], np.float64)) for d, g in held.items()}
    asked = {d: (q, v / np.linalg.norm(v, axis=1, keepdims=True)) for d, (q, v) in asked.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in by_length(b, "vec"):
                if d not in asked:
                    continue
                q, x = asked[d]
                rep = part.column("rep").to_numpy()
                row, near, sim = nearest_in(x, units(part.column("vec")), rep, k + 1)
                order = np.argsort(rep)
                vec = part.column("vec").take(pa.array(order[np.searchsorted(rep, near, sorter=order)]))
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(near), pa.array(sim), vec], ["qid", "rep", "sim", "vec"])

    kind = classes.schema["vec"].dataType.simpleString()
    near = classes.select("rep", "vec").mapInArrow(compare, f"qid long, rep long, sim double, vec {kind}").where(F.col("sim") < 1 - 1e-12)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "rep"))).where(F.col("r") <= k)
    true: dict[int, list] = {}
    for r in near.select("qid", "vec").collect():  # at most TRIED x k rows
        true.setdefault(r.qid, []).append(r.vec)
    places, most = [], 1
    for d, (q, x) in asked.items():
        h = make(d)
        most = max(most, len(h.steps))
        rows = [(i, v) for i, one in enumerate(q.tolist()) for v in true.get(one, [])]
        if not rows:
            continue
        i = np.array([a for a, _ in rows])
        y = np.array([v for _, v in rows], np.float64)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        first = np.full(len(i), np.iinfo(np.int64).max)
        for t in range(h.tables):
            hit = h.probes(x, t, len(h.steps))[i] == h.code(h.slots(y, t)[0], t)[:, None]
            first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, np.iinfo(np.int64).max))
        places.append(first)
    if not places:
        return most
    places = np.sort(np.concatenate(places))
    return int(min(most, places[min(len(places) - 1, int(np.ceil(goal * len(places))) - 1)]))


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, tables: int = 2, hashes: int = 4, width: float = 1.5,
    probes: int | None = None, goal: float = 0.96, seed: int = 7, key: str = "vec_id", vec: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row with `is_query`.

    Nearness is the cosine in double precision, ties go to the smaller key; a query's own key is no
    candidate. Rows with a NULL key and vectors that are NULL, empty, zero or hold NULL or
    non-finite components take no part; vectors of different lengths are not compared. Where a key
    repeats, its smallest vector counts. Columns of other names are left out.

    Unit vectors (whose distances rank as cosines) are hashed into `tables`; a query visits
    `probes` buckets a table in estimated success order, or as many as fit a recall of `goal` on a
    bounded sample of TRIED queries. Equal vectors are one class with its k + 1 smallest keys. A
    bucket is dealt into blocks of about BLOCK vectors, a query is compared with whole blocks and
    takes its best along, so a crowded bucket is neither cut off nor listed pair by pair. Queries
    that found fewer than k rows visit all buckets of the first table.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[vec].dataType.simpleString()
    good = vectors.where(F.col(key).isNotNull() & usable(vec)).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = good.groupBy("id").agg(F.min(F.struct("vec", "asks")).alias("r")).select("id", "r.vec", "r.asks")
    where = scratch_path(spark, "vectors")
    good.write.parquet(where)
    good = spark.read.parquet(where)
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    some = good.select("vec", "id", rank.alias("r")).where(F.col("r") <= k + 1)
    where = scratch_path(spark, "classes")
    some.groupBy("vec").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")).write.parquet(where)
    classes = spark.read.parquet(where)
    queries = good.where("asks").select(F.col("id").alias("qid"), "vec")

    made: dict[int, Hashing] = {}

    def make(dim: int) -> Hashing:
        if dim not in made:
            made[dim] = Hashing(dim, tables, hashes, width, seed)
        return made[dim]

    visits = probes or fit_probes(classes, queries, make, k, goal, seed)
    made.clear()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in by_length(b, "vec"):
                h, x = make(d), units(part.column("vec"))
                for t in range(tables):
                    code = h.code(h.slots(x, t)[0], t)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int32()), pa.array([t] * n, pa.int32()), pa.array(code), part.column("rep"), part.column("vec")], ["dim", "t", "code", "rep", "vec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in by_length(b, "vec"):
                h = make(d)
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    x = units(some.column("vec"))
                    for t in range(tables):
                        codes = h.probes(x, t, visits)
                        take = pa.array(np.repeat(np.arange(len(x)), codes.shape[1]))
                        n = len(take)
                        yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int32()), pa.array([t] * n, pa.int32()), pa.array(codes.ravel()), some.column("qid").take(take), some.column("vec").take(take)], ["dim", "t", "code", "qid", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                g, h = b.column("g")[i].values, b.column("h")[i].values
                q = g.field("qid").to_numpy()
                row, rep, sim = nearest_in(units(g.field("vec")), units(h.field("vec")), h.field("rep").to_numpy(), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(rep), pa.array(sim)], ["qid", "rep", "sim"])

    place = ["dim", "t", "code"]
    where = scratch_path(spark, "buckets")
    classes.select("rep", "vec").mapInArrow(index, f"dim int, t int, code long, rep long, vec {kind}").write.parquet(where)
    index_rows = spark.read.parquet(where)
    sizes = index_rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = index_rows.join(sizes, place).withColumn("blk", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    blocks = dealt.groupBy(*place, "blk").agg(F.collect_list(F.struct("rep", "vec")).alias("h"))

    def visit(asked: DataFrame) -> DataFrame:
        """Each (dim, t, code, qid, vec) against all blocks of its bucket; the best k + 1 a block."""
        met = asked.join(sizes, place)
        crowd = met.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("groups"))
        met = met.join(crowd, place).withColumn("grp", F.pmod(F.xxhash64("qid"), "groups").cast("int"))
        met = met.groupBy(*place, "grp", "blocks").agg(F.collect_list(F.struct("qid", "vec")).alias("g"))
        met = met.select(*place, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), "g")
        best = met.join(blocks, [*place, "blk"]).select("g", "h").mapInArrow(compare, "qid long, rep long, sim double")
        return best.groupBy("qid", "rep").agg(F.max("sim").alias("sim"))

    def cut(best: DataFrame) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(F.desc(F.round("sim", 12)), "rep")
        return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("qid", "rep")

    def answers(best: DataFrame) -> DataFrame:
        """Exact scores of the classes found, spread over their keys, the k nearest of each query."""
        pairs = best.join(queries, "qid").join(classes.select("rep", "ids", F.col("vec").alias("other")), "rep")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, part in by_length(b, "vec"):
                    score = (units(part.column("vec")) * units(part.column("other"))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("qid"), part.column("ids"), pa.array(score)], ["qid", "ids", "score"])

        scored = pairs.select("qid", "ids", "vec", "other").mapInArrow(exact, "qid long, ids array<long>, score double")
        rows = scored.select("qid", "score", F.explode("ids").alias("vec_id")).where(F.col("qid") != F.col("vec_id"))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = cut_lineage(answers(cut(visit(queries.mapInArrow(probe, f"dim int, t int, code long, qid long, vec {kind}")))))
    done = first.where(F.col("rank") == k).select("qid")
    short = cut_lineage(queries.join(done, "qid", "left_anti"))
    everywhere = sizes.where(F.col("t") == 0).select(*place)
    again = short.withColumn("dim", F.size("vec")).join(everywhere, "dim").select(*place, "qid", "vec")
    second = answers(cut(visit(again)))
    out = first.join(short.select("qid"), "qid", "left_anti").select("qid", "rank", "vec_id", "score").unionByName(second.select("qid", "rank", "vec_id", "score"))
    return out.select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """The five nearest embeddings of every fiftieth one."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
