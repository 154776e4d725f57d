"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fold_of, labelled_sample, read, ship

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digit", "mark", "space", "symbol_words",
    "distinct_words", "top_word", "distinct_pairs", "upper_words", "repeated_lines", "line_words", "letter_entropy",
    "vowels", "marks_in_row",
)
_ROW = re.compile(r"[^\w\s]{2,}")
_CACHE: dict = {}


def char_kinds() -> np.ndarray:
    """Code point -> 0 other, 1 lower or other letter, 2 upper, 3 digit, 4 space, 5 mark or symbol."""
    if "kinds" not in _CACHE:
        kinds = np.zeros(0x110000, np.uint8)
        of = {"Lu": 2, "Lt": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Zl": 4, "Zp": 4}
        for cp in range(0x110000):
            c = unicodedata.category(chr(cp))
            kinds[cp] = of.get(c, {"L": 1, "M": 1, "P": 5, "S": 5}.get(c[0], 0))
        kinds[[9, 10, 11, 12, 13]] = 4
        _CACHE["kinds"] = kinds
    return _CACHE["kinds"]


def features(text: str | None) -> list[float]:
    """The FEATURES of one whole text; NULL counts as empty, an empty text gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = len(cps)
    kind = np.bincount(char_kinds()[cps], minlength=6)
    words = text.split()
    m = max(1, len(words))
    low = [w.lower() for w in words]
    count = Counter(low)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, kind[1] + kind[2])
    small = np.bincount(np.minimum(cps | 32, 255), minlength=256)[97:123]
    share = small[small > 0] / max(1, small.sum())
    return [
        math.log1p(n),
        math.log1p(len(words)),
        sum(map(len, words)) / m,
        sum(len(w) > 20 for w in words) / m,
        kind[2] / letters,
        kind[3] / n,
        kind[5] / n,
        kind[4] / n,
        sum(not w.isalpha() for w in words) / m,
        len(count) / m**0.8,
        max(count.values(), default=0) / m,
        len(set(zip(low, low[1:], strict=False))) / max(1, m - 1),
        sum(w.isupper() for w in words) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(len(words) / max(1, len(lines))),
        float(-(share * np.log(share)).sum()),
        int(small[[0, 4, 8, 14, 20]].sum()) / max(1, int(small.sum())),
        len(_ROW.findall(text)) / m,
    ]


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges: quantiles, each once."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values per bin of a tree over ordered bins, from gradient and weight sums per bin: the best
    cut is added until there are `leaves` leaves."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]

    def gain(a: int, z: int) -> tuple[float, int]:
        c = np.arange(a + 1, z)
        if not len(c):
            return 0.0, -1
        hl, hr = ch[c] - ch[a], ch[z] - ch[c]
        gl, gr = cg[c] - cg[a], cg[z] - cg[c]
        value = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -np.inf)
        k = int(np.argmax(value))
        return float(value[k] - (cg[z] - cg[a]) ** 2 / (ch[z] - ch[a] + 1)), int(c[k])

    while len(parts) < leaves:
        best = max(((*gain(a, z), a, z) for a, z in parts), key=lambda t: t[0])
        if not best[0] > 1e-9:
            break
        parts.remove((best[2], best[3]))
        parts += [(best[2], best[1]), (best[1], best[3])]
    out = np.zeros(len(g))
    for a, z in parts:
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Values of a two-level tree over a grid of bins: a cut of one feature, then a cut of the other
    on each side."""
    best, out = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for c in range(1, len(a)):
            value = np.zeros_like(a)
            for rows in (slice(0, c), slice(c, None)):
                value[rows] = shallow_tree(a[rows].sum(axis=0), b[rows].sum(axis=0), 2, least)[None, :]
            gain = float((2 * a * value - b * value**2).sum())
            if gain > best:
                best, out = gain, value.T if flip else value
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 32, leaves: int = 3, pairs: int = 6, pair_rounds: int = 40, pair_bins: int = 8) -> dict:
    """Cyclic boosting: in each round every feature in turn adds a small tree to its own table; then
    the same over the pairs of features that explain most of what remains."""
    d = x.shape[1]
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart
        base = 0.0 if len(y) == 0 else (4.0 if y.max() > 0 else -4.0)
        return {"base": base, "edges": [np.zeros(0)] * d, "tables": [np.zeros(1)] * d, "pairs": []}
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    f = np.full(len(y), base := math.log(p / (1 - p)))
    least = max(2.0, 0.0005 * len(y))

    def step() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    edges = [edges_of(x[:, j], bins) for j in range(d)]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(rounds):
        for j in range(d):
            g, h = step()
            size = len(tables[j])
            n = np.bincount(at[j], minlength=size)
            tree = shallow_tree(np.bincount(at[j], g, size), np.where(n > 0, np.bincount(at[j], h, size), 0), leaves, least * 0.01)
            tables[j] += rate * tree
            f += rate * tree[at[j]]
    coarse = [edges_of(x[:, j], pair_bins) for j in range(d)]
    cat = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    g, h = step()

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        m = len(coarse[j]) + 1
        return np.bincount(cat[i] * m + cat[j], v, (len(coarse[i]) + 1) * m).reshape(-1, m)

    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            a, b = grid(i, j, g), grid(i, j, h)
            gains.append((float((a**2 / (b + 1)).sum()), i, j))
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            g, h = step()
            tree = pair_tree(grid(i, j, g), grid(i, j, h), least * 0.01)
            table += rate * tree
            f += rate * tree[cat[i], cat[j]]
    return {"base": base, "edges": edges, "tables": tables, "pairs": [(i, j, coarse[i], coarse[j], t) for i, j, t in chosen]}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    """Probability of label 1: the sum of the looked-up values, squashed."""
    f = np.full(len(x), model["base"])
    for j, (e, t) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        f += t[np.searchsorted(e, x[:, j], side="right")]
    for i, j, ei, ej, t in model["pairs"]:
        f += t[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
    return 1 / (1 + np.exp(-f.clip(-40, 40)))


def fit(sample: DataFrame, **options) -> dict:
    """The model of a bounded (text, label) sample; features are computed in tasks, the bounded
    table of features is boosted on the driver. NULL texts count as empty."""
    ship(sample.sparkSession)

    @F.pandas_udf("array<double>")
    def describe(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([features(t if isinstance(t, str) else None) for t in s])

    rows = cut_lineage(sample.select(describe("text").alias("x"), "label")).collect()
    rows.sort(key=lambda r: (r.label, r.x))
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES))
    return boost(x, np.array([float(r.label > 0) for r in rows]), **options)


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1, label 1 likelier when higher) and predicted (1 from 0.5).

    NULL and empty texts get the score of a text without content. Input columns named score or
    predicted are replaced. One row per input row, whole texts, no shuffle.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            x = [features(t if isinstance(t, str) else None) for t in s]
            yield pd.Series(scores(np.array(x, np.float64).reshape(-1, len(FEATURES)), model))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*kept, rate(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fitted(spark, sf_dir: str, bound: int = 12_000) -> dict:
    """The model learnt from at most `bound` labelled documents outside the held-out fold."""
    sample = labelled_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", bound, fold_of("doc_id", 3) != 1)
    return fit(sample)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", held, "text"), fitted(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
