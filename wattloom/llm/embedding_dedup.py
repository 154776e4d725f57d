"""Embedding near-duplicates by NN-descent over a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import read, ship
from .components import components

BLOCK = 1024
IN_CHUNK = 64


def usable(vec: str) -> Column:
    """True where the vector is not NULL, empty or zero and all components are finite numbers."""
    v = F.col(vec).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of a list column whose vectors have one length."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per different vector of a label: its smallest id, number of copies and group."""
    cls = rows.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return cls.withColumn("grp", F.xxhash64("label", F.size("vec")))


def leaves(classes: DataFrame, trees: int, leaf: int, k: int, seed: int) -> DataFrame:
    """(u, v, sim): near neighbours within runs of `leaf` rows ordered by random-hyperplane bits.

    Rows are range-partitioned by group, bits and a hash, so that equal bits can be split."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = np.diff(b.column("vec").offsets.to_numpy())
            for d in np.unique(length):
                part = b.filter(pa.array(length == d))
                x = units(part.column("vec"))
                for t in range(trees):
                    plane = np.random.default_rng([seed, t, int(d)]).standard_normal((int(d), 31))
                    bits = (x @ plane > 0) @ (1 << np.arange(30, -1, -1))
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), pa.array(bits, pa.int64()), part.column("grp"), part.column("rep"), part.column("vec")], ["t", "bits", "grp", "rep", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(rep: np.ndarray, vec: pa.Array) -> pa.RecordBatch:
            x = units(vec)
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            m = min(k, len(x) - 1)
            top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            row = np.repeat(np.arange(len(x)), m)
            return pa.RecordBatch.from_arrays([pa.array(rep[row]), pa.array(rep[top.ravel()]), pa.array(sim[row, top.ravel()])], ["u", "v", "sim"])

        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            yield from run(t, near, last=False)
            rest = t.slice(max(0, t.num_rows - leaf))
        if rest is not None:
            yield from run(rest, near, last=True)

    def run(t: pa.Table, near, last: bool) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        part = np.stack([t.column("t").to_numpy().astype(np.int64), t.column("grp").to_numpy()])
        cut = np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1
        rep, vec = t.column("rep").to_numpy(), t.column("vec").combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows], strict=True):
            for at in range(a, max(a + 1, z - leaf // 2), leaf // 2):
                end = min(z, at + leaf)
                if end - at > 1:
                    yield near(rep[at:end], vec.slice(at, end - at))

    kind = classes.schema["vec"].dataType.simpleString()
    marked = classes.select("grp", "rep", "vec").mapInArrow(sign, f"t int, bits long, grp long, rep long, vec {kind}")
    marked = marked.withColumn("h", F.xxhash64("rep")).repartitionByRange("t", "grp", "bits", "h")
    return marked.sortWithinPartitions("t", "grp", "bits", "h").mapInArrow(compare, "u long, v long, sim double")


def best(edges: DataFrame, k: int, threshold: float, most: int) -> DataFrame:
    """The k nearest of each node; a list whose k entries all reach the threshold is enlarged, to
    `most` entries."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("r") <= most)
    return ranked.where((F.col("r") <= k) | (F.col("sim") >= threshold)).drop("r")


def descend(graph: DataFrame, classes: DataFrame, threshold: float, most: int) -> DataFrame:
    """(u, v, sim) better than what u has, or, while u has fewer than `most`, at the threshold: every
    node compares its neighbours, in both directions, with each other, and each takes along `most`
    of a group at best (which fills its list). Incoming neighbours of a hub are dealt into chunks of about IN_CHUNK, each
    compared with all outgoing ones."""
    worst = graph.groupBy(F.col("u").alias("m")).agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("size"))
    low = F.when(F.col("size") < most, F.least("low", F.lit(threshold - 1e-9))).otherwise(F.col("low"))
    worst = worst.select("m", low.alias("worst"))
    out = graph.select(F.col("u").alias("p"), F.col("v").alias("m"), "fresh")
    into = graph.select(F.col("v").alias("p"), F.col("u").alias("m"), "fresh")
    chunks = into.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / IN_CHUNK).cast("int").alias("chunks"))
    into = into.join(chunks, "p").select("p", F.pmod(F.xxhash64("m"), "chunks").cast("int").alias("c"), "m", "fresh")
    out = out.join(chunks, "p", "left").select("p", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("c"), "m", "fresh")
    members = out.unionByName(into).groupBy("p", "c", "m").agg(F.max("fresh").alias("fresh"))
    info = classes.select(F.col("rep").alias("m"), "vec").join(worst, "m")
    groups = members.join(info, "m").groupBy("p", "c").agg(F.collect_list(F.struct("m", "fresh", "worst", "vec")).alias("g"), F.max("fresh").alias("any"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column("g")
            ends, s = g.offsets.to_numpy(), g.values
            m, fresh, worst_, vec = (s.field(f) for f in ("m", "fresh", "worst", "vec"))
            m, fresh, worst_ = m.to_numpy(), fresh.to_numpy(zero_copy_only=False), worst_.to_numpy()
            us, vs, sims = [], [], []
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if z - a < 2:
                    continue
                x = units(vec.slice(a, z - a))
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                new = fresh[a:z]
                take = (sim > worst_[a:z, None]) & (new[:, None] | new[None, :])
                for row in np.flatnonzero(take.sum(axis=1) > most):
                    at = np.flatnonzero(take[row])
                    take[row] = False
                    take[row, at[np.argpartition(-sim[row, at], most - 1)[:most]]] = True
                i, j = np.nonzero(take)
                us.append(m[a + i])
                vs.append(m[a + j])
                sims.append(sim[i, j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, sims)], ["u", "v", "sim"])

    return groups.where("any").select("g").mapInArrow(compare, "u long, v long, sim double")


def crowd_links(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): rows at the threshold or nearer within a component, counted block against block
    and never listed. `members`: comp, rep, n, vec."""
    size = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(size, "comp").withColumn("blk", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    blocks = dealt.groupBy("comp", "blk").agg(F.collect_list(F.struct("rep", "n", "vec")).alias("g"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, c = (b.column(f)[i].values for f in ("g", "h"))
                x, y, n = units(a.field("vec")), units(c.field("vec")), c.field("n").to_numpy()
                got = (x @ y.T >= threshold) @ n
                yield pa.RecordBatch.from_arrays([a.field("rep"), pa.array(got)], ["rep", "links"])

    other = blocks.select("comp", F.col("g").alias("h"))
    pairs = blocks.select("comp", "g").join(other, "comp").select("g", "h")
    return pairs.mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def bridges(members: DataFrame, threshold: float) -> DataFrame:
    """(comp, other, rep, links): rows of other crowded components at the threshold or nearer.

    A full list may hold rows of its own component only, so links between two crowded components can
    be in no list. Their rows are dealt to blocks, blocks keep their centre and radius, and two
    blocks of a group are compared row by row where centres and radii allow the threshold. `members`:
    grp, comp, rep, n, vec.
    """
    size = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(size, "comp").withColumn("blk", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    blocks = dealt.groupBy("grp", "comp", "blk").agg(F.collect_list(F.struct("rep", "n", "vec")).alias("g"))
    reach = float(np.arccos(np.clip(threshold, -1, 1)))

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centres, radii = [], []
            for g in b.column("g"):
                x = units(g.values.field("vec"))
                c = x.sum(axis=0)
                c = c / (np.linalg.norm(c) or 1.0)
                centres.append(c.tolist())
                radii.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("comp"), b.column("blk"), pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], ["grp", "comp", "blk", "centre", "radius"])

    ball = cut_lineage(blocks.mapInArrow(balls, "grp long, comp long, blk int, centre array<double>, radius double"))
    twin = ball.select("grp", *[F.col(c).alias(f"{c}2") for c in ("comp", "blk", "centre", "radius")])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("centre", "centre2", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))))
    pairs = ball.join(twin, "grp").where(F.col("comp") < F.col("comp2")).where(angle <= F.col("radius") + F.col("radius2") + F.lit(reach + 1e-6))
    pairs = pairs.select("comp", "blk", "comp2", "blk2")
    plain = blocks.select("comp", "blk", "g")
    both = pairs.join(plain, ["comp", "blk"]).join(plain.toDF("comp2", "blk2", "h"), ["comp2", "blk2"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, c = (b.column(f)[i].values for f in ("g", "h"))
                near = units(a.field("vec")) @ units(c.field("vec")).T >= threshold
                one, two = b.column("comp")[i].as_py(), b.column("comp2")[i].as_py()
                for s, other, comp, to in ((a, near @ c.field("n").to_numpy(), one, two), (c, a.field("n").to_numpy() @ near, two, one)):
                    hit = np.flatnonzero(other)
                    data = [np.full(len(hit), comp), np.full(len(hit), to), s.field("rep").to_numpy()[hit], other[hit]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in data], ["comp", "other", "rep", "links"])

    return both.select("comp", "comp2", "g", "h").mapInArrow(count, "comp long, other long, rep long, links long")


def audit(classes: DataFrame, found: DataFrame, threshold: float, sample: int, seed: int) -> float:
    """Share of the links of at most `sample` vectors, compared with all, that were found."""
    some = classes.orderBy(F.xxhash64(F.lit(seed), "rep"), "rep").limit(sample).collect()
    held = [(r.rep, r.grp, np.array(r.vec, np.float64)) for r in some]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys((r for r, _, _ in held), 0)
        for b in batches:
            grp, n = b.column("grp").to_numpy(), b.column("n").to_numpy()
            for rep, g, v in held:
                at = np.flatnonzero(grp == g)
                if len(at):
                    x = units(b.column("vec").take(pa.array(at)))
                    total[rep] += int(n[at][x @ (v / np.linalg.norm(v)) >= threshold].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["rep", "true"])

    true = classes.select("grp", "n", "vec").mapInArrow(count, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    r = found.join(F.broadcast(true), "rep").agg(F.sum(F.least(F.col("n_links") + 1, "true") - 1).alias("got"), F.sum(F.col("true") - 1).alias("all")).first()
    return 1.0 if not r["all"] else r["got"] / r["all"]


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, k: int = 10, most: int = 64, trees: int = 5, leaf: int = 96, rounds: int = 3,
    extra: int = 3, recall: float = 0.995, seed: int = 5, key: str = "vec_id", vec: str = "embedding", label: str = "label",
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of `vectors`.

    Rows of one label (and vector length) link at cosine >= threshold in double precision; NULL
    labels, NULL keys and vectors that are NULL, empty, zero or hold NULL or non-finite components
    link with nothing. n_links counts the other rows linked directly, copies included; component_id
    is the smallest key reachable, itself included.

    Copies form one class. The neighbour graph starts from random-hyperplane leaves and is refined
    `rounds` times, then until an audit of at most 200 vectors against all finds `recall` of their
    links (at most `extra` rounds more; if it still does not, an error is raised). Lists grow from k to
    `most` when full of links; the links in and between components that hold a full list are counted
    block against block, so none is cut off.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"), F.col(label).alias("label"))
    good = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & usable("vec"))
    where = scratch_path(spark, "classes")
    classes_of(good).write.parquet(where)
    classes = spark.read.parquet(where)
    start = leaves(classes, trees, leaf, k, seed).withColumn("fresh", F.lit(True))
    graph = cut_lineage(best(start, k, threshold, most))
    for i in range(rounds + extra):
        new = descend(graph, classes, threshold, most).withColumn("fresh", F.lit(True))
        graph = cut_lineage(best(graph.withColumn("fresh", F.lit(False)).unionByName(new), k, threshold, most))
        if i + 1 < rounds:
            continue
        linked = graph.where(F.col("sim") >= threshold).select("u", "v")
        comps = components(linked.toDF("a", "b"))
        full = linked.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= most)
        crowded = full.join(comps, full.u == comps.node).select(F.col("root").alias("comp")).distinct()
        members = classes.join(comps, F.col("rep") == F.col("node")).select("grp", F.col("root").alias("comp"), "rep", "n", "vec")
        members = members.join(crowded, "comp", "left_semi")
        across = cut_lineage(bridges(members, threshold))
        crowd = crowd_links(members.drop("grp"), threshold).unionByName(across.select("rep", "links"))
        crowd = crowd.groupBy("rep").agg(F.sum("links").alias("links"))
        merged = components(across.select(F.col("comp").alias("a"), F.col("other").alias("b"))).toDF("root", "top")
        comps = comps.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        either = linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        sizes = classes.select(F.col("rep").alias("v"), "n")
        plain = either.join(sizes, "v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links_out"))
        found = classes.select("rep", "n").join(plain, "rep", "left").join(crowd, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
        links = F.coalesce(F.col("links") - 1, F.coalesce("links_out", F.lit(0)) + F.col("n") - 1)
        found = cut_lineage(found.select("rep", links.alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
        if audit(classes, found, threshold, 200, seed) >= recall:
            break
    else:
        raise RuntimeError(f"the audit found less than {recall} of the links; raise `most`, `trees` or `extra`")
    owner = classes.select("label", "vec", "rep").join(found, "rep").drop("rep")
    linked_rows = good.join(owner, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~(F.col("label").isNotNull() & F.col("id").isNotNull() & usable("vec")))
    alone = alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked_rows.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s
  FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND s > 0 AND isfinite(s)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.s * b.s) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS r FROM v
  UNION
  SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.a WHERE reach.r < l.a),
roots AS (SELECT a, min(r) AS r FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, roots.r AS component_id, v.vec_id = roots.r AS kept
FROM v JOIN roots ON roots.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
