"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fold_of, labelled_sample, read, ship, slices

# Letters of other scripts, digits and signs that stand for Latin letters
LOOKALIKES = {
    "аɑα": "a", "в": "b", "сϲ": "c", "ԁ": "d", "еєε": "e", "ɡ": "g", "һн": "h", "іιї": "i", "јϳ": "j", "кκ": "k",
    "ӏ": "l", "м": "m", "ոпη": "n", "оοσ": "o", "рρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "тτ": "t", "υս": "u",
    "νѵ": "v", "ԝω": "w", "хχ": "x", "уγү": "y", "ᴢ": "z",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
HIDDEN = "­​‌‍⁠﻿"
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "pond scum", "not stupid", "not an idiot", "no idiot", "not a loser")
_CACHE: dict = {}


def fold_table() -> dict[int, str | None]:
    """Code point -> what it is folded to: marks go, look-alikes become Latin letters."""
    if "fold" not in _CACHE:
        table: dict[int, str | None] = {ord(c): None for c in HIDDEN}
        for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
            base = unicodedata.normalize("NFKD", chr(cp))[0].lower()
            if base != chr(cp) and base.isascii():
                table[cp] = base
        for cp in range(0xFF21, 0xFF5B):
            table[cp] = unicodedata.normalize("NFKC", chr(cp)).lower()
        table.update({cp: None for cp in range(0x300, 0x370)})
        for many, one in LOOKALIKES.items():
            table.update({ord(c): one for c in many})
        _CACHE["fold"] = table
    return _CACHE["fold"]


_WORD = re.compile(r"[^\W\d_]+")


def folded_words(text: str) -> list[str]:
    """Lower-cased, folded words of the text (runs of letters after folding)."""
    return _WORD.findall(text.lower().translate(fold_table()))


def stems_of(word: str, shortest: int = 4, longest: int = 10) -> list[str]:
    """What a lexicon entry can be: a beginning of the word, or the whole word and its end."""
    w = f"{word} "
    return [w[:k] for k in range(shortest, min(len(w), longest) + 1)] if len(w) > shortest else []


def learn_lexicon(
    sample: DataFrame, most: int = 1000, least_share: float = 0.01, least_docs: int = 3, odds: float = 20.0
) -> dict[str, float]:
    """Entry -> weight, from (text, label) rows: beginnings of words that stand in toxic texts at
    least `odds` times as often as in others.

    Texts that share their word pair of smallest hash (copies and most near copies) count once. An
    entry is dropped for a longer one that stands in nearly the
    same toxic texts. Of the rest those stay that stand in a tenth of the toxic texts, or, taken by
    that share, in at least two (and 0.3 %) that no entry before them matches: words that only
    happen to stand beside others go. At most `most` entries, the heaviest first.
    """
    ship(sample.sparkSession)

    def counts(wanted: frozenset | None):
        """(stem, n): texts that hold the stem, of all stems or those wanted."""

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                n: Counter[str] = Counter()
                for t in b.column("text").to_pylist():
                    own = {s for w in set(folded_words(t)) for s in stems_of(w)}
                    n.update(own if wanted is None else own & wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["stem", "n"])

        return emit

    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series([min((zlib.crc32(f"{a} {b}".encode()) for a, b in pairwise(folded_words(t))), default=zlib.crc32(t.encode())) for t in texts])

    marked = sample.where(F.col("text").isNotNull()).select("label", "text", mark("text").alias("mark"))
    once = marked.groupBy("mark", F.col("label") > 0).agg(F.max("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    once = cut_lineage(once.select("text", "label"))
    size = once.agg(F.count_if(F.col("label") > 0).alias("t"), F.count_if(F.col("label") <= 0).alias("c")).first()
    floor = max(least_docs, least_share * (size.t or 0))

    def table(label: bool, wanted: frozenset | None, least: float) -> dict[str, int]:
        rows = once.where((F.col("label") > 0) == label).mapInArrow(counts(wanted), "stem string, n long")
        total = rows.groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return {r["stem"]: r["n"] for r in total.collect()}

    # what toxic texts hold first, then how often all clean texts hold that: the same counts however
    # the rows are dealt to tasks. Both lists are bounded by the sample.
    toxic = table(True, None, floor)
    clean = table(False, frozenset(toxic), 0)
    rate = {s: (n / max(1, size.t or 0)) / ((clean.get(s, 0) + 0.5) / max(1, size.c or 0)) for s, n in toxic.items()}
    found = {s: (n, math.log(rate[s])) for s, n in toxic.items() if rate[s] >= odds}
    found = dict(sorted(found.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])))
    best = dict(found)
    for s in sorted(found, key=len):  # a beginning gives way to its continuation in the same texts
        longer = [x for x in found if len(x) == len(s) + 1 and x.startswith(s)]
        if any(found[x][0] >= 0.9 * found[s][0] for x in longer):
            best.pop(s, None)
    out: dict[str, float] = {}
    for s in sorted(best, key=lambda x: (len(x), x)):  # what a shorter entry already matches goes
        if not any(s.startswith(p) for p in out):
            out[s] = best[s][1]
    every = matcher(out, ())

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [f" {' '.join(folded_words(t))} " for t in b.column("text").to_pylist()]
            hits = [sorted({t[e - n + 2 : e + 1] for e, (n, _) in every.iter(t)}) for t in texts]
            yield pa.RecordBatch.from_pydict({"hits": pa.array(hits, pa.list_(pa.string()))})

    where: dict[str, set[int]] = {s: set() for s in out}
    if every is not None:
        toxic_texts = once.where(F.col("label") > 0)
        for i, r in enumerate(toxic_texts.mapInArrow(which, "hits array<string>").collect()):
            for s in r.hits:
                where[s].add(i)
    seen: set[int] = set()
    for s in sorted(where, key=lambda x: (-len(where[x]), x)):
        if len(where[s]) < 0.1 * (size.t or 0) and len(where[s] - seen) < max(2, 0.003 * (size.t or 0)):
            out.pop(s)
        else:
            seen |= where[s]
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:most])


def matcher(lexicon: dict[str, float], exceptions: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """Entries and exception phrases in one automaton; a space marks where a word starts."""
    a = ahocorasick.Automaton()
    for s, w in lexicon.items():
        a.add_word(f" {s}", (len(s) + 1, w))
    for p in exceptions:
        phrase = f" {' '.join(folded_words(p))} "
        if phrase.strip():
            a.add_word(phrase, (len(phrase), -1.0))
    if not len(a):
        return None
    a.make_automaton()
    return a


def density(text: str | None, automaton, smooth: float = 10.0) -> float:
    """Weight of the matched entries for each word of the text; matches that an exception phrase
    covers don't count. `smooth` words are added to each text."""
    if not text or automaton is None:
        return 0.0
    words = folded_words(text)
    hits, spared = [], []
    for end, (size, w) in automaton.iter(f" {' '.join(words)} "):
        (spared if w < 0 else hits).append((end - size + 1, end, w))
    weight = sum(w for a, z, w in hits if not any(p <= a and z <= q for p, q, _ in spared))
    return weight / (len(words) + smooth)


def densities(texts: pd.Series | list, model: dict) -> np.ndarray:
    key = ("automaton", model["id"])
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = matcher(model["lexicon"], model["exceptions"])
    return np.array([density(t if isinstance(t, str) else None, _CACHE[key]) for t in texts], np.float64)


def fit(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> dict:
    """Lexicon and the density at which a text is as likely toxic as not.

    `sample` has (text, label) and is bounded by the caller. The limit is the middle, on a log
    scale, of the two neighbouring densities between which fewest texts fall on the wrong side.
    """
    sample = cut_lineage(sample)
    lexicon = learn_lexicon(sample)
    model = {"lexicon": lexicon, "exceptions": tuple(exceptions), "id": hash((tuple(lexicon.items()), tuple(exceptions)))}

    @F.pandas_udf("double")
    def dense(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(densities(s, model))

    pairs = sample.select(dense("text").alias("d"), "label").collect()
    d = np.array([max(r.d, 1e-4) for r in pairs])
    y = np.array([r.label > 0 for r in pairs], bool)
    model["limit"] = 0.02
    if y.any() and not y.all():
        at = np.unique(d)
        cuts = np.sqrt(at * np.append(at[1:], at[-1] * 4))
        wrong = [(y & (d <= c)).sum() + (~y & (d > c)).sum() for c in cuts]
        model["limit"] = float(cuts[int(np.argmin(wrong))])
    return model


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from 0.5).

    score = d / (d + limit), d the weighted matches per word: 0 without a match, also for NULL
    and empty texts. Input columns named score or predicted are replaced. One row per input row,
    whole texts, no shuffle.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            d = densities(s, model)
            yield pd.Series(d / (d + model["limit"]))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*kept, rate(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fitted(spark, sf_dir: str, bound: int = 12_000) -> dict:
    """The model learnt from at most `bound` labelled documents outside the held-out fold."""
    sample = labelled_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "toxic", bound, fold_of("doc_id", 5) != 0)
    return fit(sample)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", held, "text"), fitted(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
