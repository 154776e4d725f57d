"""Periodic runs of words, found with minimizers at several scales."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read, ship, slices

SHORT = 8  # periods up to this are found by direct lag scans
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs that does not commute."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def window(best: Callable, a: np.ndarray, width: int) -> np.ndarray:
    """`best` (np.minimum or np.maximum) of each `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        a = best(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return best(a[: len(a) - rest], a[rest:]) if rest else a


def minimizers(g: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some window of `width` places, ties included."""
    least = window(np.minimum, g, width)
    edge = np.zeros(width - 1, g.dtype)
    return np.flatnonzero(window(np.maximum, np.concatenate([edge, least, edge]), width) == g)


def scales(longest: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """(smallest period, largest period, window) of each scale. Grams as long as the largest
    period tell all places of a period apart, and a run of `repeats` periods holds a whole window
    of them together with its copy one period later."""
    low = SHORT + 1
    while repeats * low <= longest:
        high = max(low, 3 * low // 2)
        yield low, high, (repeats - 1) * low - high + 1
        low = high + 1


def _reach(w: np.ndarray, at: int, d: int, step: int) -> int:
    """How many places from `at` on in the direction `step` equal the word `d` places further."""
    n, size = 0, 64
    while True:
        if step > 0:
            a, b = w[at + n : at + n + size], w[at + n + d : at + n + d + size]
            a = a[: len(b)]
        else:
            z = at - n + 1
            a, b = w[max(0, z - size) : z][::-1], w[max(0, z - size) + d : z + d][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return n + int(differ[0])
        n += len(a)
        if len(a) < size:
            return n
        size *= 2


def periodic_runs_of(w: np.ndarray, sizes: np.ndarray, min_words: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run in `w`, texts of `sizes` word numbers, longest first, each
    followed by a number found nowhere else (so that no stretch reaches over it).

    Periods up to SHORT come from direct lag scans. At a larger scale the minimizers of a window
    inside a run come back one period later; neighbouring equal minimizers at a distance of the
    scale are seeds, and a seed is extended word by word. A stretch that also has a smaller period
    is the run of that period, found at its own scale, and is left out.
    """
    found: list[tuple[int, int, int]] = []
    ends = np.cumsum(sizes + 1)

    def upto(least: int) -> int:
        n = int(np.count_nonzero(sizes >= least))
        return int(ends[n - 1]) if n else 0

    for q in range(1, SHORT + 1):
        least = max(min_words, repeats * q)
        part = w[: upto(least)]
        if len(part) <= q:
            continue
        equal = np.concatenate([[False], part[q:] == part[:-q], [False]])
        turn = np.flatnonzero(equal[1:] != equal[:-1])
        s, e = turn[::2], turn[1::2] + q
        long = e - s >= least
        found.extend(zip(s[long].tolist(), e[long].tolist(), [q] * int(long.sum()), strict=True))
    level, grams = 1, w.astype(np.uint64)
    for low, high, width in scales(int(sizes[0]) if len(sizes) else 0, repeats):
        end = upto(max(min_words, repeats * low))
        if not end:
            break
        grams = grams[: end - level + 1]
        while 2 * level <= high:
            grams = _mix(grams[:-level], grams[level:])
            level *= 2
        last = end - high + 1  # grams that begin later would reach past `end`
        g = _mix(grams[:last], grams[high - level : high - level + last])
        if len(g) < width:
            continue
        at = minimizers(g, width)
        at = at[np.argsort(g[at], kind="stable")]
        d = at[1:] - at[:-1]
        seed = (g[at[1:]] == g[at[:-1]]) & (d >= low) & (d <= high)
        p, d = at[:-1][seed], d[seed]
        order = np.lexsort((p, d))
        p, d = p[order], d[order]
        i = 0
        while i < len(p):
            x, q = int(p[i]), int(d[i])
            past = x + _reach(w, x, q, 1)  # the first place that differs from the one q further
            s = x - _reach(w, x - 1, q, -1) if x else 0
            if past + q - s >= max(min_words, repeats * q):
                found.append((s, past + q, q))
            # further seeds of this distance inside the stretch lead to the same run
            i += 1 + int(np.searchsorted(p[i + 1 : int(np.searchsorted(d, q, "right"))], past))
    run = np.array(sorted(set(found)), np.int64).reshape(-1, 3)
    new = np.ones(len(run), bool)
    new[1:] = (run[1:, :2] != run[:-1, :2]).any(axis=1)
    return run[new, 0], run[new, 1], run[new, 2]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def find_runs(texts: list[bytes | None], min_words: int = 24, repeats: int = 3) -> list[tuple[int, list[dict], bytes]]:
    """(words, runs, text without the repeats) of each text, in the given order."""
    words = [t.split() if t else [] for t in texts]
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    number = _Numbers()
    sizes = np.array([len(words[i]) for i in order], np.int64)
    w = np.full(int(sizes.sum()) + len(order), 0, np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    for k, i in enumerate(order):
        w[first[k] : first[k] + sizes[k]] = np.fromiter(map(number.__getitem__, words[i]), np.int64, len(words[i]))
    w[first + sizes] = len(number) + np.arange(len(order))
    runs: dict[int, list[dict]] = {}
    dropped: dict[int, np.ndarray] = {}
    for s, e, q in zip(*(x.tolist() for x in periodic_runs_of(w, sizes, min_words, repeats)), strict=True):
        k = int(np.searchsorted(first, s, "right")) - 1
        i, base = order[k], int(first[k])
        runs.setdefault(i, []).append({"start": s - base, "length": e - s, "period": q})
        keep = dropped.setdefault(i, np.ones(len(words[i]), bool))
        keep[s - base + q : e - base] = False
    out = []
    for i, ws in enumerate(words):
        kept = compress(ws, dropped[i].tolist()) if i in dropped else ws
        mine = sorted(runs.get(i, []), key=lambda r: (r["start"], r["period"]))
        out.append((len(ws), mine, b" ".join(kept)))
    return out


def periodic_runs(docs: DataFrame, min_words: int = 24, repeats: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of every row of `docs`.

    Words are runs of characters other than space and \\x09-\\x0D, numbered from 0. `runs` lists, by
    start and then period, every longest stretch of at least `min_words` words and `repeats` (3 or
    more) of its smallest period: {start, length, period}. `collapsed` is the text with single
    spaces and each run cut to its first period. NULL and empty texts have no words, no runs and
    an empty `collapsed`; repeated rows come back as often; other columns are left out. Texts are
    worked on by slices of about 4 MB, a longer text alone; nothing is shuffled.
    """
    if repeats < 3:
        raise ValueError("repeats must be 3 or more")
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    fields = [("key", to_arrow_type(kind)), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = find_runs(b.column("text").to_pylist(), min_words, repeats)
            n, runs, left = zip(*got, strict=True)
            data = [pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("key").cast(fields[0][1]), *data], schema=pa.schema(fields))

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    shape = f"key {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return source.mapInArrow(search, shape).withColumnRenamed("key", key)


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a repeated tail in about every tenth text: with h the crc32 of the key's
    decimal text and g = h // 10, h % 10 = 0, words from a = g % n on repeat with period
    p = 1 + (n - a) // (3 + g % 8). Other texts, and rows with a NULL key, are as given."""
    h = F.crc32(F.col(f"`{key}`").cast("string"))
    word = F.regexp_extract_all(F.col("__t"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    df = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__t"), h.alias("__h"))
    df = df.withColumn("__w", F.when(F.col("__h") % 10 == 0, word)).withColumn("__n", F.size("__w"))
    g = F.floor(F.col("__h") / 10)
    df = df.withColumn("__a", F.when(F.col("__n") > 0, g % F.col("__n")))
    df = df.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8)))

    def source(i: Column) -> Column:
        place = F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
        return F.get(F.col("__w"), place.cast("int"))

    made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), source), " ")
    return df.select(key, F.when(F.col("__n") > 0, made).otherwise(F.col("__t")).alias(text))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of `periodic_runs`: the number of runs, the one with the greatest exponent
    (exact length / period; ties to the smallest start, then period; NULL without runs) and sha256
    of the run list and of the collapsed text."""

    def ahead(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        by_place = F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
        return F.when(x != y, F.signum(y - x)).otherwise(by_place).cast("int")

    best = F.get(F.array_sort("runs", ahead), F.lit(0))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select(key, "runs", "collapsed", best.alias("__best"), F.array_join(line, "").alias("__lines"))
    return out.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("__best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * __best.length) div __best.period").alias("exponent_milli"),
        F.sha2(F.col("__lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, with the planted ones."""
    return run_digests(periodic_runs(with_planted_runs(read(spark, sf_dir, "documents"))))
