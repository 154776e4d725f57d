"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read, ship, slices

SLOTS = 128  # a power of two: places of a fingerprint, 12 bits each
SLICE = 1 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
# phrases of a level hold about 2.5 times as many characters as those of the level below; the
# lowest level that counts, by the length of the text in characters
LOWEST = ((16, 0), (64, 1), (256, 2))
OTHERS = 3
_WEIGHT = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def tossed(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One deterministic coin toss: twice the lowest bit in which a symbol differs from its left
    neighbour, plus its own bit there. Neighbours that differ keep differing labels; a text's first
    symbol (`first`: their places) takes its lowest bit."""
    x = np.empty_like(a)
    x[1:] = a[1:] ^ a[:-1]
    x[first] = 1
    low = np.bitwise_count(~x & (x - a.dtype.type(1)))
    np.minimum(low, 8 * a.itemsize - 1, out=low)
    return 2 * low + ((a >> low) & a.dtype.type(1)).astype(np.uint8)


def blocks_of(a: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol become one symbol (named by symbol and length): (symbols, first places)."""
    new = np.empty(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    if len(at) == len(a):
        return a, first
    size = np.diff(at, append=len(a)).astype(np.uint64)
    out = a[at]
    many = size > 1
    out[many] = _mix(out[many] * _WEIGHT[0] + size[many])
    return out, np.searchsorted(at, first)


def phrase_starts(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where phrases begin: at local maxima of labels that four tosses bring below six, so
    that a phrase has 2 to 12 symbols and depends on the symbols around it alone."""
    label = a
    for _ in range(4):
        label = tossed(label, first)
    top = np.zeros(len(a), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    top[first + 1] = False
    top[np.append(first[1:], len(a)) - 1] = False
    top[first] = True
    return np.flatnonzero(top)


def levels(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, text number of each name), from the characters up to one phrase a text."""
    size = np.array([len(t) for t in texts], np.int64)
    which = np.flatnonzero(size)
    size = size[which]
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    level = 0
    while len(which):
        a, first = blocks_of(a, np.cumsum(size) - size)
        size = np.diff(first, append=len(a))
        yield level, a if level else _mix(a + _WEIGHT[1]), np.repeat(which, size)
        more = size > 1
        if not more.all():
            a, which, size = a[np.repeat(more, size)], which[more], size[more]
            first = np.cumsum(size) - size
        if not len(which):
            return
        start = phrase_starts(a, first)
        length = np.diff(start, append=len(a))
        place = np.arange(len(a)) - np.repeat(start, length)
        a = _mix(np.add.reduceat(a * _WEIGHT[place & 63], start))
        size = np.diff(np.searchsorted(start, first), append=len(start))
        level += 1


def sketches(texts: list[str]) -> np.ndarray:
    """One row of SLOTS numbers (0 to 4095) per text: the phrase names that count are dealt to the
    slots by their first bits, and a slot keeps 12 bits of its least name (0: no name)."""
    least = np.full(len(texts) * SLOTS, NONE, np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    low = np.full(len(texts), OTHERS)
    for below, level in reversed(LOWEST):
        low[size < below] = level
    shift = np.uint64(65 - SLOTS.bit_length())
    for level, name, text in levels(texts):
        if level < OTHERS:
            new = np.concatenate([[True], text[1:] != text[:-1], [True]])
            count = (low[text] <= level) | (new[1:] & new[:-1])  # a text's last phrase always counts
            name, text = name[count], text[count]
        np.minimum.at(least, text * SLOTS + (name >> shift).astype(np.int64), name)
    out = np.where(least == NONE, 0, 1 + least % np.uint64(4095))
    return out.astype(np.uint16).reshape(len(texts), SLOTS)


def spelled(v: np.ndarray) -> list[str]:
    """Three hexadecimal digits per slot."""
    a, b = v[:, 0::2], v[:, 1::2]
    three = np.stack([a >> 4, (a & 15) << 4 | b >> 8, b & 255], axis=2).astype(np.uint8)
    return [row.tobytes().hex() for row in three]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either fingerprint fills: an estimate of the share of
    phrases in common. Two empty fingerprints are alike (1)."""
    filled = (a | b) != 0
    n = filled.sum(axis=1)
    return np.where(n == 0, 1.0, (filled & (a == b)).sum(axis=1) / np.maximum(n, 1))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint) of every row of `docs`.

    A text is cut into phrases, phrases into phrases of phrases and so on by deterministic coin
    tossing, so that equal substrings get equal phrases inside, wherever they stand. The
    fingerprint (384 hexadecimal digits) samples the phrase names of all levels above the lowest;
    equal texts have equal ones. NULL and empty texts have zeros only; repeated rows come back as
    often; other columns are left out. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    names = ["key", "n_chars", "fingerprint"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            texts = [t or "" for t in b.column("text").to_pylist()]
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").cast(to_arrow_type(kind)), size, pa.array(spelled(sketches(texts)))], names)

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(emit, f"key {kind.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def block_of(key: Column, bounds: list[int]) -> Column:
    """Number of `bounds` (descending) above the key; len(bounds) + 1 for NULL. Two short searches."""
    if not bounds:
        return F.when(key.isNull(), 1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))

    def above(a: Column) -> Column:
        return F.size(F.filter(a, lambda b: b > key))

    whole = F.array(*[F.lit(b) for b in bounds])
    full = above(F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])) * step
    return F.when(key.isNull(), len(bounds) + 1).otherwise(full + above(F.slice(whole, full + 1, F.lit(step))))


def in_descending_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, copy, id, text): the rows by descending key, dealt into blocks of neighbours and
    sorted within partitions. A block's last row (`copy`) repeats the next block's first row, and
    the last block's repeats the first row of all, so every row is followed by its successor.

    Equal keys follow each other by the hash and then the content of their text; NULL keys come
    last. Texts are shuffled once. The driver holds two numbers a block (four blocks a shuffle
    partition), found on the keys alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / blocks for i in range(1, blocks)]
    cuts = rows.agg(F.percentile_approx("id", share, 20 * blocks)).first()[0] or []
    rows = rows.withColumn("block", block_of(F.col("id"), sorted(set(cuts), reverse=True)))
    found = sorted((r.block, r.top) for r in rows.groupBy("block").agg(F.max("id").alias("top")).collect())
    if not found:
        return rows.select("block", F.lit(False).alias("copy"), "id", "text")
    at = F.create_map(*[F.lit(x) for b, top in found if top is not None for x in (b, top)]) if found[0][1] is not None else None
    before = F.create_map(*[F.lit(x) for (b, _), (p, _) in zip(found, found[-1:] + found[:-1], strict=True) for x in (b, p)])
    leads = F.col("id").isNull() if at is None else F.col("id").isNull() | (F.col("id") == F.get(F.map_values(at), F.array_position(F.map_keys(at), F.col("block")).cast("int") - 1))
    order = F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))
    copies = rows.where(leads).groupBy("block").agg(F.first("id").alias("id"), F.min(order).alias("o"))
    copies = copies.select(before[F.col("block")].alias("block"), F.lit(True).alias("copy"), "id", F.col("o.t").alias("text"))
    both = rows.select("block", F.lit(False).alias("copy"), "id", "text").unionByName(copies)
    return both.repartition("block").sortWithinPartitions("block", "copy", F.desc_nulls_last("id"), F.xxhash64("text"), "text")


def compare_with_edited(docs: DataFrame, part: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    every row of `docs`; the key (an integer) gives the order, see in_descending_order.

    The edited text has its last floor(n_chars / part) characters replaced by the first as many
    (or all) of the next row's text; near_edited and near_next are the likeness to its fingerprint
    and to the next row's. A table of one row is followed by itself. NULL texts count as empty;
    repeated rows come back as often; other columns are left out.
    """
    ship(docs.sparkSession)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in slices(batches, "text", SLICE):
            rows = held + [(c, i, t or "") for c, i, t in zip(*(b.column(x).to_pylist() for x in ("copy", "id", "text")), strict=True)]
            held = [] if rows[-1][0] else rows[-1:]
            texts = [t for _, _, t in rows]
            mine = [k for k in range(len(rows) - 1) if not rows[k][0]]
            if not mine:
                continue
            after = [k + 1 for k in mine]
            edited = [texts[k][: len(texts[k]) - len(texts[k]) // part] + texts[k + 1][: len(texts[k]) // part] for k in mine]
            own, new = sketches(texts), sketches(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][1] for k in mine], pa.int64()),
                    pa.array([len(texts[k]) for k in mine], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array(spelled(own[mine])),
                    pa.array(spelled(new)),
                    pa.array(likeness(own[mine], new)),
                    pa.array(likeness(own[mine], own[after])),
                ],
                names,
            )
        if held:
            raise RuntimeError("a block of rows ended without its successor")

    shape = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_order(docs, key, text).mapInArrow(emit, shape).withColumnRenamed("id", key)


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return compare_with_edited(read(spark, sf_dir, "documents"))
