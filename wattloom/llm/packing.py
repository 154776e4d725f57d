"""Packing by length histogram, shortest pack first."""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import scratch_path
from .common import read, ship, slices
from .token_counts import tokenizer

# fixed value: the white space at which the word vocabulary always cuts
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
KEPT_WORDS = 300_000
RANKED = 100_000
_CACHE: dict = {}


def byte_letters(word: str) -> str:
    """The word as the byte-level step spells it: printable Latin-1 bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    if "bytes" not in _CACHE:
        same = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in same]
        _CACHE["bytes"] = [chr(b) if b in same else chr(256 + others.index(b)) for b in range(256)]
    return "".join([_CACHE["bytes"][b] for b in word.encode()])


def plain(word: str) -> bool:
    """Latin letters only, composed: one pre-token, which only lower-casing changes."""
    return word.isalpha() and (word.isascii() or (max(word) <= "\u024f" and word.lower().isalpha() and unicodedata.is_normalized("NFC", word)))


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit words.

    Pre-tokens never hold white space, so each distinct run between white space is encoded once.
    Runs that come twice in a call are kept for the next ones (a bounded number). A run of Latin
    letters with marks behind it is the word, encoded once for all its spellings, and the marks; any
    other run goes through the library's whole chain.
    """
    kept, words = _CACHE.setdefault(path, ({}, {}))
    parts = [(SPACE.split(t) if SEPARATORS.search(t) else t.split()) if t else [] for t in texts]
    out: list[bytes | None] = []
    late = []
    for i, p in enumerate(parts):
        try:
            out.append(b"".join(map(kept.__getitem__, p)))
        except KeyError:
            out.append(None)
            late.append(i)
    times: Counter[str] = Counter()
    for i in late:
        times.update(parts[i])
    fresh = times.keys() - kept.keys()
    if len(words) > KEPT_WORDS:
        words.clear()
    t = tokenizer(path)
    cut = {w: w.rstrip(".,;:!?") for w in fresh}
    whole = [w for w, core in cut.items() if not plain(core)]
    marks = {w[len(core) :] for w, core in cut.items()} - words.keys()
    for some, into in ((whole, kept), (list(marks), words)):
        for w, e in zip(some, t.encode_batch_fast(some, add_special_tokens=False), strict=True):
            into[w] = array("I", e.ids).tobytes()
    for w, core in cut.items():
        if w in kept:
            continue
        low = core.lower()
        ids = words.get(low)
        if ids is None:
            ids = words[low] = array("I", [x.id for x in t.model.tokenize(low if low.isascii() else byte_letters(low))]).tobytes()
        kept[w] = ids + words[w[len(core) :]]
    for i in late:
        out[i] = b"".join(map(kept.__getitem__, parts[i]))
    if len(kept) > KEPT_WORDS:
        kept.clear()
    else:
        for w in fresh:
            if times[w] == 1:
                del kept[w]
    return out


def pieces_table(docs: DataFrame, path: str, size: int, end_id: int, key: str, text: str, where: str) -> DataFrame:
    """Written table of pieces: each document's ids and its end id, cut after every `size` ids."""
    kind = to_arrow_type(docs.schema[key].dataType)
    fields = ["row", "id", "start", "length", "ids_crc32", "doc_tokens"]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text"):
            rows, at = [], []
            for i, ids in enumerate(encode(b.column("text").to_pylist(), path)):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, size):
                    m = min(size, n - a)
                    rows.append((row, a, m, zlib.crc32(ids[4 * a : 4 * (a + m)]), n))
                    at.append(i)
                    row += 1
            c = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([c[0], b.column("id").take(pa.array(at)).cast(kind), *c[1:]], fields)

    id_type = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    out = source.mapInArrow(cut, f"row long, id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")
    out.write.parquet(where)
    return docs.sparkSession.read.parquet(where)


def packing_patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of the patterns: lengths are placed longest first, each into the pack with
    most room left, whole groups of equal packs at a time. At most a few patterns per length, so
    the result grows with `size`, not with the number of documents."""
    by_room: list[list[tuple[int, list[int]]]] = [[] for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], size
        while left > 0:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                by_room[size - length].append((left, [length]))
                break
            count, pack = by_room[room].pop()
            taken = min(count, left)
            if count > taken:
                by_room[room].append((count - taken, pack))
            by_room[room - length].append((taken, [*pack, length]))
            left -= taken
            room = min(room, size)
    return [p for packs in by_room for p in packs]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes, as runs sorted by (length, first rank)."""
    runs, used, sequence = [], {}, 0
    for count, pack in patterns:
        offset = 0
        for length in pack:
            rank = used.get(length, 0)
            runs.append((length, rank, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A document is its ids (tokenizer file at `path`) and `end_id`; NULL and empty texts have the
    end id alone. It is cut after every `size` ids. The driver sees the histogram of piece lengths,
    at most `size` rows. Pieces are numbered within their length in groups of about 100,000 by a
    hash of their row number, so a frequent length is not one group. Repeated rows are packed as
    often; other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    table = pieces_table(docs, path, size, end_id, key, text, scratch_path(spark, "pieces"))
    histogram = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = slots(packing_patterns(histogram, size))
    most = max(histogram.values(), default=0)
    groups = -(-most // RANKED)
    group = F.pmod(F.xxhash64("row"), F.lit(max(1, groups)))
    grouped = table.withColumn("group", group)
    sizes = grouped.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "group", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "group").orderBy("row")) - 1
    ranked = grouped.withColumn("rank", rank).join(sizes, ["length", "group"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        run = np.searchsorted(place["key"], (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": place["sequence"][run] + rank.to_numpy() - place["rank"][run], "offset": place["offset"][run]})

    out = ranked.withColumn("at", where("length", "rank"))
    return out.select(F.col("id").alias(key), "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
