"""Locally consistent parsing against a character-by-character version."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import parsing
from wattloom.llm.common import read

ODD = [(1, None), (2, ""), (3, "a"), (4, "ab"), (5, "aaaa"), (6, "aaaa"), (6, "aaaa"), (7, "naïve 日本 \U0001f600 x\x00y"), (8, "lo ng " * 60_000), (None, "no key"), (None, None), (-9, "ab" * 40)]


def toss(a):
    out = []
    for i, x in enumerate(a):
        bit = 0
        if i:
            while (x ^ a[i - 1]) >> bit & 1 == 0:
                bit += 1
        out.append(2 * bit + (x >> bit & 1))
    return out


def mix(x):
    return int(parsing._mix(np.array([x], np.uint64))[0])


def slow_levels(text):
    weight = [int(x) for x in parsing._WEIGHT]
    a = [ord(c) for c in text]
    level = 0
    while a:
        runs = []
        for x in a:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        a = [x if n == 1 else mix((x * weight[0] + n) % 2**64) for x, n in runs]
        yield level, [mix((x + weight[1]) % 2**64) for x in a] if level == 0 else a
        if len(a) == 1:
            return
        label = a
        for _ in range(4):
            label = toss(label)
        assert max(label) < 6
        cuts = [0] + [i for i in range(2, len(a) - 1) if label[i - 1] < label[i] >= label[i + 1]] + [len(a)]
        a = [mix(sum(x * weight[j] for j, x in enumerate(a[p:q])) % 2**64) for p, q in zip(cuts, cuts[1:], strict=False)]
        level += 1


def test_levels_against_the_slow_version():
    rng = random.Random(3)
    texts = ["", "a", "ab", "abc", "aaaa", "aabbaabb", "x" * 50, "日本語" * 9]
    texts += ["".join(rng.choice("abcd "[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    got = {}
    for level, name, text in parsing.levels(texts):
        for n, t in zip(name.tolist(), text.tolist(), strict=True):
            got.setdefault((t, level), []).append(n)
    want = {(i, level): names for i, t in enumerate(texts) for level, names in slow_levels(t)}
    assert got == want
    assert all(len(n) == 1 for (t, level), n in got.items() if (t, level + 1) not in got)


def test_equal_substrings_share_phrases_at_any_offset():
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    body = " ".join(words[:1500])
    moved = " ".join(words[1500:1500 + 37]) + body
    other = " ".join(words[1500:])
    s = parsing.sketches([body, moved, other])
    assert parsing.likeness(s[:1], s[1:2])[0] > 0.85 and parsing.likeness(s[:1], s[2:])[0] < 0.05
    sets = [{n for level, name, t in parsing.levels([x]) if level == 3 for n in name.tolist()} for x in (body, moved)]
    assert len(sets[0] - sets[1]) <= 6  # only phrases near the ends differ


def test_sketches_hold_what_fits():
    a = parsing.sketches(["abc", "", "abc", "x" * 10_000])
    assert (a[0] == a[2]).all() and not a[1].any() and a[3].any() and a.max() <= 4095
    assert parsing.spelled(a)[0] == "".join(f"{v:03x}" for v in a[0].tolist())
    assert parsing.likeness(a[1:2], a[1:2])[0] == 1 and parsing.likeness(a[:1], a[1:2])[0] == 0


def check(got, docs):
    ids = sorted((i for i in docs if i is not None), reverse=True)
    text = {i: docs[i] or "" for i in ids}
    by_id = {r.doc_id: r for r in got}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        r, t, n = by_id[i], text[i], len(text[i]) // 3
        edited = t[: len(t) - n] + text[j][:n]
        s = parsing.sketches([t, edited, text[j]])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == parsing.spelled(s[:2])
        near = parsing.likeness(s[[0, 0]], s[[1, 2]])
        assert (r.near_edited, r.near_next) == (near[0], near[1])


@pytest.mark.parametrize("parts", ["1", "4", "50"])
def test_query_against_a_sorted_list(spark, sf, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = parsing.op11_fingerprints(spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    docs = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    assert len(got) == len(docs)
    check(got, docs)
    near = [r for r in got if r.n_chars > 500]
    assert np.median([r.near_edited for r in near]) > 0.4 > 0.1 > np.median([r.near_next for r in near])


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in ("id", "block", "copy", "fingerprint", "a.b")])
    got = parsing.compare_with_edited(df).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in ODD)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {"0" * 384}
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    keyed = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(parsing.compare_with_edited(keyed).collect(), dict(ODD[:9] + ODD[-1:]))
    assert parsing.compare_with_edited(df.limit(0)).count() == 0
    one = parsing.compare_with_edited(df.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    nulls = parsing.compare_with_edited(df.where("doc_id is null")).collect()
    assert len(nulls) == 2
    plain = parsing.fingerprints(df, text="text").collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in plain) == sorted((str(r.doc_id), r.fingerprint) for r in got)
    assert parsing.fingerprints(df, key="a.b").columns == ["a.b", "n_chars", "fingerprint"]
