"""Periodic runs against a brute-force version."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wattloom.llm import runs
from wattloom.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, repeats=3):
    out, n = {}, len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def spans(rows):
    return [(r["start"], r["length"], r["period"]) for r in rows]


def texts():
    rng = random.Random(5)
    yield from ["", " \t\n ", "a", "a " * 23, "a " * 24, "b " + "a " * 5000 + "c", "ab ab " * 30]
    fib = ["x", "y"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    yield " ".join(fib[-1])
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    yield " ".join(thue)
    for _ in range(150):
        words = []
        while len(words) < rng.choice([20, 60, 300, 1200]):
            unit = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 90))]
            if rng.random() < 0.5:
                unit = [f"w{rng.randrange(10**6)}" for _ in unit]
            times = rng.choice([1, 1, 2, 3, 3, 4, 7])
            part = unit * times + unit[: rng.randrange(len(unit))]
            if rng.random() < 0.3 and len(part) > 5:
                part[rng.randrange(len(part))] = "odd"
            words += part
        yield "  ".join(words)


def test_runs_against_brute_force():
    given = list(texts())
    got = runs.find_runs([t.encode() for t in given])
    total = 0
    for t, (n, mine, left) in zip(given, got, strict=True):
        words = t.split()
        want = brute(words)
        assert n == len(words) and spans(mine) == want and left.decode() == collapsed(words, want)
        total += len(want)
    assert total > 100


@pytest.mark.parametrize("least, repeats", [(1, 3), (10, 4), (24, 5)])
def test_other_limits(least, repeats):
    given = list(texts())[:80]
    for t, (_, mine, _) in zip(given, runs.find_runs([t.encode() for t in given], least, repeats), strict=True):
        assert spans(mine) == brute(t.split(), least, repeats)


def test_a_run_needs_three_periods():
    with pytest.raises(ValueError):
        runs.periodic_runs(None, repeats=2)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def check(rows, texts):
    for r in rows:
        words = planted(r.doc_id, texts[r.doc_id])
        found = brute(words)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    return sum(r.n_runs > 0 for r in rows)


def test_query_against_brute_force(spark, sf):
    rows = runs.op13_periodic_runs(spark, sf).collect()
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    short = [r for r in rows if len((texts[r.doc_id] or "").split()) < 3000]
    assert check(short, texts) > 10


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (20, "one"), (5, "la li " * 100_000), (6, "naïve 日本 \U0001f600 x " * 9), (6, "naïve 日本 \U0001f600 x " * 9), (None, "x " * 40)]
    df = spark.createDataFrame(odd, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in ("runs", "key", "collapsed", "n_runs")])
    rows = runs.run_digests(runs.periodic_runs(runs.with_planted_runs(df))).collect()
    assert len(rows) == len(odd)
    check([r for r in rows if r.doc_id not in (5, None)], dict(odd))
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[5].start, by_id[5].length, by_id[5].period) == (0, 200_000, 2)
    assert (by_id[None].n_runs, by_id[None].length, by_id[None].period) == (1, 40, 1)
    assert by_id[1].start is None and by_id[1].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert runs.run_digests(runs.periodic_runs(runs.with_planted_runs(df.limit(0)))).count() == 0
    named = runs.periodic_runs(df.select(F.col("doc_id").alias("a.b"), F.col("text").alias("t t")), key="a.b", text="t t")
    assert named.columns == ["a.b", "n_words", "runs", "collapsed"] and named.count() == len(odd)
