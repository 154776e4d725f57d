"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fold_of, ship, slices

SYMBOLS = 64  # 0: no letter; 1-26: a-z; 27-63: every other letter, by its code point
_CACHE: dict = {}


def letter_table() -> np.ndarray:
    """Code point -> symbol."""
    if "letters" not in _CACHE:
        table = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            if cp >= 128 and unicodedata.category(chr(cp))[0] == "L":
                table[cp] = 27 + (cp * 2654435761 >> 7) % (SYMBOLS - 27)
        table[97:123] = table[65:91] = np.arange(1, 27)
        _CACHE["letters"] = table
    return _CACHE["letters"]


def letter_vectors(dims: int, n: int, seed: int) -> list[np.ndarray]:
    """Random +-1 vectors of the symbols, rotated once per position of the n-gram."""
    key = ("vectors", dims, n, seed)
    if key not in _CACHE:
        base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))
        _CACHE[key] = [np.roll(base, n - 1 - p, axis=1) for p in range(n)]
    return _CACHE[key]


def symbols_of(text: str) -> np.ndarray:
    """The text's letters, lower-cased, with one 0 for each gap and at both ends."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    s = np.zeros(len(cps) + 2, np.int64)
    s[1:-1] = letter_table()[cps]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def profiles(texts: list[str | None], dims: int, n: int, seed: int) -> np.ndarray:
    """One bundle per text: the sum of its n-gram vectors, each the product (binding) of the
    rotated vectors of its letters. Texts without letters give a zero row."""
    out = np.zeros((len(texts), dims), np.float32)
    rows, codes = [], []
    for i, t in enumerate(texts):
        s = symbols_of(t) if t else np.zeros(0, np.int64)
        if len(s) < n or not s.any():
            continue
        c = s[: len(s) - n + 1]
        for p in range(1, n):
            c = c * SYMBOLS + s[p : len(s) - n + 1 + p]
        rows.append(i)
        codes.append(c)
    if not rows:
        return out
    present = np.bincount(np.concatenate(codes), minlength=SYMBOLS**n) if SYMBOLS**n <= 1 << 24 else None
    if present is None:
        grams, place = np.unique(np.concatenate(codes), return_inverse=True)
    else:
        grams = np.flatnonzero(present)
        index = np.zeros(len(present), np.int32)
        index[grams] = np.arange(len(grams))
        place = index[np.concatenate(codes)]
    bound = None
    for p, table in enumerate(letter_vectors(dims, n, seed)):
        part = table[grams // SYMBOLS ** (n - 1 - p) % SYMBOLS]
        bound = part if bound is None else bound * part
    bound = bound.astype(np.float32)
    # counts times vectors, for as many texts at once as keep the table of counts small
    step = max(1, (1 << 21) // len(grams))
    ends = np.cumsum([len(c) for c in codes])
    for k in range(0, len(rows), step):
        size = np.diff(ends[k : k + step], prepend=ends[k - 1] if k else 0)
        mine = place[ends[k] - size[0] : ends[min(k + step, len(rows)) - 1]]
        cell = np.repeat(np.arange(len(size)), size) * len(grams) + mine
        count = np.bincount(cell, minlength=len(size) * len(grams)).astype(np.float32)
        out[rows[k : k + step]] = count.reshape(len(size), -1) @ bound
    return out


def fit(docs: DataFrame, bound: int = 12_000, dims: int = 512, n: int = 3, seed: int = 7, key: str = "doc_id") -> dict:
    """Language prototypes: the bundle of all n-grams of a language's documents.

    Learns from text and lang only, on at most `bound` rows of `docs` (those with the smallest
    key hashes; rows without text or lang give nothing). Each task sums its own documents.
    """
    ship(docs.sparkSession)
    ids = docs.where(F.col("lang").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"))
    ids = ids.distinct().orderBy(F.xxhash64("__key"), "__key").limit(bound)
    text = docs.select(F.col(key).alias("__doc"), "text", "lang").where(F.col("lang").isNotNull())
    rows = text.join(F.broadcast(ids), F.col("__doc") == F.col("__key")).groupBy("__key")
    rows = rows.agg(F.min(F.struct("text", "lang")).alias("r")).select("r.text", "r.lang")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, "text"):
            p = profiles(b.column("text").to_pylist(), dims, n, seed).astype(np.float64)
            langs = np.array(b.column("lang").to_pylist(), object)
            for k in set(langs):
                total[k] = total.get(k, 0) + p[langs == k].sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {"lang": list(total), "v": [x.tolist() for x in total.values()]},
            schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]),
        )

    total: dict[str, np.ndarray] = {}
    for r in cut_lineage(rows).mapInArrow(sums, "lang string, v array<double>").collect():
        total[r.lang] = total.get(r.lang, 0) + np.array(r.v)
    langs = sorted(k for k, v in total.items() if np.any(v))
    unit = np.array([total[k] / np.linalg.norm(total[k]) for k in langs], np.float32).reshape(len(langs), dims)
    return {"langs": langs, "unit": unit, "dims": dims, "n": n, "seed": seed}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (cosine with the nearest prototype, 0 to 1).

    NULL text, text without letters, or a model without languages: `und`, score 0. Ties go to
    the first language by name. A column named lang_pred or score is replaced. One row per
    input row, whole texts, no shuffle.
    """
    ship(docs.sparkSession)
    langs, unit, dims, n, seed = (model[k] for k in ("langs", "unit", "dims", "n", "seed"))

    @F.pandas_udf("lang_pred string, score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            names, scores = [], []
            for b in slices(iter([pa.RecordBatch.from_arrays([pa.array(s, pa.large_string())], ["t"])]), "t"):
                p = profiles(b.column("t").to_pylist(), dims, n, seed)
                size = np.linalg.norm(p, axis=1)
                cos = p @ unit.T / np.where(size == 0, 1, size)[:, None] if langs else np.zeros((len(p), 1))
                best = cos.argmax(axis=1)
                known = (size > 0) & bool(langs)
                names += [langs[j] if k else "und" for j, k in zip(best, known, strict=True)]
                scores.append(np.where(known, cos[np.arange(len(p)), best].clip(0, 1), 0.0))
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else []})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], guess(F.col(text)).alias("__guess"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "__guess.lang_pred", "__guess.score")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt without the held-out fold."""
    from .common import read

    docs = read(spark, sf_dir, "documents")
    held = fold_of("doc_id", 4) == 2
    model = fit(docs.where(~held))
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
