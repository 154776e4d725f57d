"""SimHash near-duplicates, with Golay-code fuzzy hashing for the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import read, ship
from .components import components

BITS = 64
WIDTH, DATA = 23, 12  # the perfect binary Golay code
GENERATOR = 0xAE3  # fixed value: its generator polynomial
_CACHE: dict = {}


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the whole text as a signed 64-bit integer.

    Words are runs between ASCII white space, A-Z lower-cased; shingles of `shingle` words joined
    by a space, repeats included; fewer words make one shingle, none give 0. A bit is set if it is
    set in over half of the XXH64 (seed 42) of the shingles.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], "<u8")
    votes = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        votes += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


def golay() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndrome of each value of the three bytes of a word; error pattern of each syndrome."""
    if "golay" not in _CACHE:

        def rest(x: int) -> int:
            for i in range(WIDTH, DATA - 2, -1):
                if x >> i & 1:
                    x ^= GENERATOR << (i - (WIDTH - DATA))
            return x

        one = [rest(1 << i) for i in range(24)]
        tables = []
        for byte in range(3):
            t = np.zeros(256, np.int64)
            for b in range(8):
                t[np.arange(256) >> b & 1 == 1] ^= one[8 * byte + b]
            tables.append(t)
        error = np.zeros(1 << (WIDTH - DATA), np.int64)
        for weight in (1, 2, 3):
            for bits in combinations(range(WIDTH), weight):
                s = 0
                for b in bits:
                    s ^= one[b]
                error[s] = sum(1 << b for b in bits)
        _CACHE["golay"] = tables, error
    return _CACHE["golay"]


def codeword(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within 3 bits of each 23-bit word."""
    tables, error = golay()
    s = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255]
    return (x ^ error[s]) >> (WIDTH - DATA)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments: one more than the bits that may differ, and at least
    three, so that none is wider than a code word."""
    n = max(3, max_bits + 1)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)]


def keys_of(fp: np.ndarray, max_bits: int, fuzzy: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): a key holds a segment's place, its exact bits and a codeword index of the next
    segment. With n segments and fewer than n differing bits some segment is equal while the next
    differs by one bit at most (else each equal segment would be followed by two differing bits).
    The next segment is decoded as it is, or (`fuzzy`) with each bit turned over too: then words
    one bit apart share an index, and a segment has one index or up to six."""
    u = fp.astype(np.int64).view(np.uint64)
    parts = segments(max_bits)
    rows, keys = [], []
    for j, (a, w) in enumerate(parts):
        exact = (u >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64)
        b, v = parts[(j + 1) % len(parts)]
        near = (u >> np.uint64(b) & np.uint64((1 << v) - 1)).astype(np.int64)
        flips = np.array([0, *(1 << np.arange(v))] if fuzzy else [0], np.int64)
        index = np.sort(codeword(near[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(((j << 23 | exact[r]) << DATA) | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def links(classes: DataFrame, max_bits: int = 2, crowded: int = 20_000) -> DataFrame:
    """(a, b): the ids of all pairs of different fingerprints at `max_bits` or fewer bits.

    `classes` has one row per fingerprint (fp, id). Keys shared by over `crowded` fingerprints are
    not joined: their fingerprints look up every word within `max_bits` bits instead, which finds
    the same pairs at a cost per fingerprint that does not grow.
    """

    def keyed(fuzzy: bool):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp = b.column("fp").to_numpy()
                for at in range(0, len(fp), 4096):
                    row, key = keys_of(fp[at : at + 4096], max_bits, fuzzy)
                    take = pa.array(row + at)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column("fp").take(take), b.column("id").take(take)], ["key", "fp", "id"])

        return classes.mapInArrow(emit, "key long, fp long, id long")

    left, right = keyed(False), keyed(True)
    busy = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key")
    r = right.select("key", F.col("fp").alias("fp2"), F.col("id").alias("id2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits
    pairs = left.join(busy, "key", "left_anti").join(r, "key").where((F.col("fp") < F.col("fp2")) & near)
    turned = [sum(1 << b for b in bits) for n in range(1, max_bits + 1) for bits in combinations(range(BITS), n)]

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array(turned, np.uint64).view(np.int64)
        for b in batches:
            for fp, i in zip(b.column("fp").to_pylist(), b.column("id").to_pylist(), strict=True):
                other = flips ^ np.int64(fp)
                yield pa.RecordBatch.from_pydict({"id": np.full(len(other), i), "fp2": other})

    looked = left.join(busy, "key", "left_semi").select("fp", "id").distinct().mapInArrow(around, "id long, fp2 long")
    rest = looked.join(classes.select(F.col("fp").alias("fp2"), F.col("id").alias("id2")), "fp2")
    return pairs.select("id", "id2").unionByName(rest.select("id", "id2")).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row of `docs`.

    Fingerprints that differ in `max_bits` (0 to 5) or fewer bits link; component_id is the smallest key
    reachable. NULL and empty texts have fingerprint 0 and link like others. Rows with a NULL key
    keep a fingerprint, link nothing and have a NULL component. Equal fingerprints form one class
    before any pair is looked for; repeated rows come back as often; other columns are left out.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("max_bits must lie between 0 and 5")
    spark = docs.sparkSession
    ship(spark)

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t if isinstance(t, str) else None, shingle) for t in texts], dtype="int64")

    where = scratch_path(spark, "fingerprints")
    docs.select(F.col(key).cast("long").alias("id"), hashed(F.col(text).cast("string")).alias("fp")).write.parquet(where)
    rows = spark.read.parquet(where)
    classes = rows.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("id"))
    found = components(links(classes, max_bits)).withColumnRenamed("node", "id")
    owner = classes.join(found, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    out = rows.join(owner, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by SimHash."""
    return simhash_groups(read(spark, sf_dir, "documents"))
