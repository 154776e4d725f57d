"""Token counts: pieces counted once per distinct pre-token, summed per document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read, ship, slices

BLOCK_BYTES = 48 << 20
BLOCK_ROWS = 1 << 16
OWN = "\x00block"
HELD_SUMS = 1 << 21
# fixed value: the split of the byte-level vocabulary
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RARE = re.compile("[\x1c-\x1f -\U0010ffff]")
_CACHE: dict = {}


def tokenizer(path: str):
    if path not in _CACHE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _CACHE[path] = Tokenizer.from_file(path)
    return _CACHE[path]


def pre_tokens(text: str, path: str) -> list[str]:
    """The text's pre-tokens, in order; strings of added tokens are pre-tokens of their own.

    Where code points occur on whose class the two regex libraries could disagree, the tokenizer
    itself gives the places to cut."""
    t = tokenizer(path)
    key = ("added", path)
    if key not in _CACHE:
        _CACHE[key] = re.compile("|".join(re.escape(x.content) for x in t.get_added_tokens_decoder().values()) or r"(?!)")
    out: list[str] = []
    at = 0
    for m in [*_CACHE[key].finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        if _RARE.search(part):
            out += [part[a:z] for _, (a, z) in t.pre_tokenizer.pre_tokenize_str(part)]
        else:
            out += SPLIT.findall(part)
        if m:
            out.append(m[0])
            at = m.end()
    return out


def pieces_of(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(token, pieces): each distinct pre-token of the corpus and its pieces, counted once."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK_BYTES):
            seen: set[str] = set()
            for t in b.column("text").to_pylist():
                seen.update(pre_tokens(t, path) if t else ())
            for part in _parts(list(seen)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["token"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            n = [len(e.ids) for e in t.encode_batch_fast(b.column("token").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("token").cast(pa.string()), pa.array(n, pa.int32())], ["token", "pieces"])

    every = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(words, "token string").distinct()
    return every.mapInArrow(count, "token string, pieces int")


def _parts(x: list, size: int = 20_000) -> Iterator[list]:
    return (x[a : a + size] for a in range(0, len(x), size))


def frequencies(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """Pre-token frequencies, by block of documents: a repeated pre-token has one row per block.

    uses: the places (2 bytes) of its documents in the block, then how often each has it (1 byte;
    more than 255 times are several entries). One more row per block, under a token of its own
    that no text can hold, has the block's keys and byte counts (as an Arrow stream: list columns
    make Spark's batches slow to build).
    """
    kind = to_arrow_type(docs.schema[key].dataType)
    schema = pa.schema([("token", pa.string()), ("block", pa.int64()), ("uses", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in slices(batches, "text", BLOCK_BYTES):
            for b in (whole.slice(a, BLOCK_ROWS) for a in range(0, whole.num_rows, BLOCK_ROWS)):
                number: dict[str, int] = {}
                codes, sizes = [], []
                for t in b.column("text").to_pylist():
                    sizes.append(len(t.encode("utf-8", "replace")) if t else 0)
                    codes.append(np.fromiter((number.setdefault(w, len(number)) for w in pre_tokens(t, path)), np.int64) if t else np.zeros(0, np.int64))
                rows = len(codes)
                cell = np.concatenate(codes) * rows + np.repeat(np.arange(rows), [len(c) for c in codes])
                del codes
                cell, times = np.unique(cell, return_counts=True)
                cell = np.repeat(cell, -(-times // 255))
                first = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, bool)
                many = np.full(len(cell), 255)
                many[first] = (times - 1) % 255 + 1
                ends = np.append(np.searchsorted(cell, np.arange(len(number)) * rows), len(cell))
                place, many = (cell % rows).astype("<u2"), many.astype("u1")
                words = list(number)
                for at in range(0, len(words), 20_000):
                    part = words[at : at + 20_000]
                    uses = [place[a:z].tobytes() + many[a:z].tobytes() for a, z in zip(ends[at:].tolist(), ends[at + 1 : at + 20_001].tolist(), strict=False)]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([block] * n, pa.int64()), pa.array(uses, pa.binary())], schema=schema)
                own = pa.RecordBatch.from_arrays([b.column("id").cast(kind), pa.array(sizes, pa.int64())], ["id", "n_bytes"])
                yield pa.RecordBatch.from_arrays([pa.array([f"{OWN}{block}"]), pa.array([block]), pa.array([packed(own)])], schema=schema)
                block += 1

    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(count, "token string, block long, uses binary")


def packed(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of `docs`.

    Pieces are counted once per distinct pre-token by the tokenizer file at `path` (a byte-level
    vocabulary of the tokenizers library), joined to the pre-token frequencies, and summed; ids are
    never held. NULL and empty texts count 0. Rows that repeat come back as often; other columns
    are left out. A frequent pre-token has one row per block of documents; the join splits those
    rows where Spark finds them skewed.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[key].dataType.simpleString()
    kind = to_arrow_type(docs.schema[key].dataType)
    # every distinct pre-token is one small row; hashing those spares sorting the frequencies
    joined = frequencies(docs, path, key, text).join(pieces_of(docs, path, text).hint("shuffle_hash"), "token", "left")
    joined = joined.select("block", "uses", F.when(~F.startswith("token", F.lit(OWN)), F.col("pieces")).alias("pieces"))
    fields = [("block", pa.int64()), ("place", pa.binary()), ("total", pa.binary())]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, v in held.items():
                at = np.flatnonzero(v)
                small = v[at].max(initial=0) < 1 << 32
                data = [[block], [at.astype("<u2").tobytes()], [v[at].astype("<u4" if small else "<u8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(data, fields, strict=True)], schema=pa.schema(fields))

        for b in batches:
            own = b.filter(pc.is_null(b.column("pieces")))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column("block"), pa.nulls(own.num_rows, pa.binary()), own.column("uses").cast(pa.binary())], schema=pa.schema(fields))
            b = b.filter(pc.is_valid(b.column("pieces")))
            uses = b.column("uses").to_pylist()
            size = np.array([len(u) // 3 for u in uses], np.int64)
            if not len(size):
                continue
            at = np.frombuffer(b"".join(u[: 2 * n] for u, n in zip(uses, size.tolist(), strict=True)), "<u2")
            n = np.frombuffer(b"".join(u[2 * n :] for u, n in zip(uses, size.tolist(), strict=True)), "u1")
            n = np.repeat(b.column("pieces").to_numpy(), size) * n.astype(np.int64)
            block = np.repeat(b.column("block").to_numpy(), size)
            order = np.argsort(block, kind="stable")
            names, first = np.unique(block[order], return_index=True)
            for name, some in zip(names.tolist(), np.split(order, first[1:]), strict=True):
                v = np.bincount(at[some], n[some]).astype(np.int64)
                held[name] = _sum(held[name], v) if name in held else v
            if sum(map(len, held.values())) > HELD_SUMS:
                yield from out()
                held.clear()
        yield from out()

    def total(t: pa.Table) -> pa.Table:
        v = np.zeros(0, np.int64)
        for at, x in zip(t.column("place").to_pylist(), t.column("total").to_pylist(), strict=True):
            if at is None:
                own = pa.ipc.open_stream(x).read_all()
            elif at:
                at = np.frombuffer(at, "<u2")
                v = _sum(v, np.bincount(at, np.frombuffer(x, "<u4" if len(x) == 4 * len(at) else "<u8")).astype(np.int64))
        v = np.concatenate([v, np.zeros(own.num_rows - len(v), np.int64)])
        return pa.table({"id": own.column("id").cast(kind), "n_bytes": own.column("n_bytes"), "n_tokens": pa.array(v, pa.int64())})

    sums = joined.mapInArrow(partial, "block long, place binary, total binary")
    rows = sums.groupBy("block").applyInArrow(total, f"id {id_type}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    out = a.copy()
    out[: len(b)] += b
    return out


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
