"""The training-data operators against the libraries, brute force and exact round trips, with NULLs,
empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import itertools
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wattloom.llm import embedding_dedup, html_text, language, nearest, packing, pieces, quality, simhash, token_counts, toxicity
from wattloom.llm.common import fold_of, read

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "One two three, four?"), (5, "One two three, four?"), (6, "naïve 日本 \U0001f600 x\x00y <|endoftext|> it's ½ 12a"), (7, "lo ng " * 40_000), (None, "no key")]
SCHEMA = "doc_id long, text string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    extra = ["score", "predicted", "n_tokens", "id", "key", "fp"]  # names that the outputs use too
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(c) for c in extra])


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, DATA, "documents")


def test_language(spark, docs, odd):
    model = language.fit(docs.where(fold_of("doc_id", 4) != 2))
    got = language.predict(docs.where(fold_of("doc_id", 4) == 2), model).where("lang is not null and length(text) > 200").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 0
    rows = language.predict(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}


@pytest.mark.parametrize("kind, module, parts, fold, least", [("quality", quality, 3, 1, 0.9), ("toxic", toxicity, 5, 0, 0.85)])
def test_classifiers_on_the_held_out_fold(spark, odd, kind, module, parts, fold, least):
    docs, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = module.fitted(spark, "/root/testdata/sf0.01")
    held = docs.where(fold_of("doc_id", parts) == fold).join(labels, "doc_id").where(f"{kind} is not null")
    got = module.score(held, model).collect()
    assert sum(r[kind] == r.predicted for r in got) >= least * len(got) > 0
    rows = module.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert module.score(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def toxic_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (read(spark, sf, t) for t in ("documents", "labels"))
    held = docs.where(fold_of("doc_id", 5) == 0).join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    return toxicity.score(held, toxicity.fitted(spark, sf)).select("toxic", "predicted", "text").collect()


def test_toxicity_recall_and_precision(toxic_rows):
    hit = sum(r.toxic == 1 == r.predicted for r in toxic_rows)
    toxic, called = sum(r.toxic == 1 for r in toxic_rows), sum(r.predicted for r in toxic_rows)
    assert toxic > 20 and hit >= 0.85 * toxic and hit >= 0.9 * called


def test_toxicity_model_does_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.01"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    models = []
    try:
        for n in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            models.append(toxicity.fitted(spark, sf))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert models[0]["lexicon"] and models[0] == models[1] == models[2]


def test_toxicity_folds_and_excepts():
    assert toxicity.folded_words("Y0u 1d10t") == toxicity.folded_words("you idiot")
    automaton = toxicity.matcher({"ass": 1.0}, ("pass",))
    assert toxicity.density("an ass", automaton) > 0 == toxicity.density("a pass", automaton)


def test_segmentations_are_drawn_without_replacement():
    lattice = pieces.lattice_of(PIECES, 1.0)

    def every(word):
        if not word:
            yield ()
        for j in range(1, len(word) + 1):
            if word[:j] in lattice.ids:
                for rest in every(word[j:]):
                    yield (lattice.ids[word[:j]], *rest)

    runs = pieces.runs_of(lattice.sp.normalize("the cat"))
    both = [sum(x, ()) for x in itertools.product(*[list(every(r)) for r in runs])]
    weight = np.array([sum(lattice.weight[i] for i in s) for s in both])
    p = dict(zip(both, np.exp(weight - np.logaddexp.reduce(weight)), strict=True))
    first, pair, total, n = Counter(), Counter(), 0.0, 4000
    for seed in range(n):
        got = pieces.segmentations(lattice, "the cat", 2, seed)
        a, b = (tuple(x[0].tolist()) for x in got)
        assert a != b and abs(got[0][1] - np.log(p[a])) < 1e-9 and abs(got[1][1] - np.log(p[b])) < 1e-9
        first[a] += 1
        pair[a, b] += 1
        total += sum(np.exp(x[1] - x[2]) for x in got)
    for a, c in first.most_common(3):
        assert abs(c / n - p[a]) < 4 * np.sqrt(p[a] / n)
    for (a, b), c in pair.most_common(3):
        q = p[a] * p[b] / (1 - p[a])
        assert abs(c / n - q) < 4 * np.sqrt(q / n)
    assert abs(total / n - 1) < 0.02  # probability over inclusion score is unbiased
    all_of = pieces.segmentations(lattice, "a b", 100, 1)
    assert {x[2] for x in all_of} == {0.0} and abs(sum(np.exp(x[1]) for x in all_of) - 1) < 1e-9


def test_sentencepiece_round_trip(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.sample_segmentations(odd, PIECES, k=3)
    got = rows.withColumn("back", pieces.decoded(F.col("ids"), PIECES)).collect()
    texts = dict(ODD)
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.back == sp.decode(sp.encode(t)) and 0 <= r.inclusion <= 1 and -np.inf < r.log_inclusion <= 0
        assert pieces.spell(pieces.lattice_of(PIECES, 1.0), r.ids) == (sp.normalize(t) if t else "")
    assert Counter(r.doc_id for r in got if r["rank"] == 1) == Counter(i for i, _ in ODD)
    assert pieces.sample_segmentations(odd.limit(0), PIECES).count() == 0
    key = lambda r: (str(r.doc_id), r["rank"], r.ids)
    assert sorted(map(key, rows.collect())) == sorted(map(key, got))


def test_nearest_against_brute_force(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    bad = spark.createDataFrame(
        [(-1, None, 1), (-50, [0.0] * 64, 1), (-3, [float("nan")] * 64, 1), (-4, [None] * 64, 1), (None, [1.0] * 64, 1), (-100, [1.0, 2.0], 1), (-101, [2.0, 4.0], None), (-102, [1.0, 2.0], 1)],
        "vec_id long, embedding array<float>, label int",
    )
    all_rows = v.unionByName(bad).unionByName(v.where("vec_id < 60").withColumn("vec_id", F.col("vec_id") + 100_000))
    got = nearest.search(all_rows.withColumn("rep", F.lit(1)), F.col("vec_id") % 50 == 0).collect()
    rows = [r for r in all_rows.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    hits = count = 0
    for q in (r for r in rows if r.vec_id % 50 == 0):
        x = np.array(q.embedding, float)
        others = [r for r in rows if len(r.embedding) == len(x) and r.vec_id != q.vec_id]
        sims = {r.vec_id: float(x @ np.array(r.embedding, float) / np.linalg.norm(x) / np.linalg.norm(np.array(r.embedding, float))) for r in others}
        true = sorted(sims, key=lambda i: (-round(sims[i], 12), i))[:5]
        mine = sorted((r for r in got if r.query_id == q.vec_id), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(true) + 1))
        assert all(abs(r.score - sims[r.vec_id]) < 1e-12 for r in mine)
        hits += len(set(true) & {r.vec_id for r in mine})
        count += len(true)
    assert hits >= 0.9 * count > 0
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == -100] == [-102, -101]
    assert nearest.search(v.limit(0), F.lit(True)).count() == 0


def test_nearest_lets_everything_in_a_crowded_bucket_compete(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = np.random.default_rng(1)
    near = 1 + 1e-3 * rng.standard_normal((300, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(near)] + [(1000 + i, near[0].tolist()) for i in range(20)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    zero = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0]
    assert zero == [1000, 1001, 1002, 1003, 1004]
    for q in (50, 100):
        mine = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        sims = {i: unit[q] @ unit[min(i, i % 1000 if i < 1000 else 0)] for i, _ in rows if i != q}
        assert mine == sorted(sims, key=lambda i: (-round(sims[i], 12), i))[:5]


def test_html(spark):
    page = "<html><head><title>t</title><script>bad()</script></head><body><nav><a href=x>Home</a> <a>Menu</a></nav><article><h1>A title of it</h1><p>The house &amp; the   garden were in the town and it was for the best of us all, as they had said to me before.</p></article><footer>Copyright</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>cut <b"), (4, "u", "<p>cut <b")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A title of it The house & the garden were in the town and it was for the best of us all, as they had said to me before."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert html_text.op5_html(spark, DATA).count() == spark.read.parquet(f"{DATA}/pages.parquet").count()


def test_token_counts(spark, docs, odd):
    t = Tokenizer.from_file(BYTES)
    rows = [*[(r.doc_id, r.text) for r in docs.collect()], *ODD]
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).withColumn("block", F.lit(1))
    got = token_counts.token_counts(table, BYTES).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(docs.limit(0), BYTES).count() == 0


def test_packing_is_an_exact_round_trip(spark, docs, odd):
    t = Tokenizer.from_file(WORDS)
    table = docs.select("doc_id", "text").where("doc_id > 10").unionByName(odd.select("doc_id", "text")).withColumn("length", F.lit(1))
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in table.collect()}
    rows = packing.pack(table, WORDS).collect()
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(ids[r.doc_id]) for r in table.select("doc_id").collect())
    end = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 2048 and sorted(end) == list(range(len(end)))
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowded", [20_000, 0])
def test_simhash_against_all_pairs(spark, docs, odd, monkeypatch, crowded):
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda c, m: links(c, m, crowded))
    table = docs.select("doc_id", "text").where("doc_id > 10").unionByName(odd.select("doc_id", "text"))
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in table.collect()]
    root = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in itertools.combinations([r for r in rows if r[0] is not None], 2):
            if (x ^ y).bit_count() <= 2 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = simhash.simhash_groups(table).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{x:016x}", root.get(i)) for i, x in rows)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(63, 2, replace=False):
            y ^= 1 << int(b)
        assert set(simhash.keys_of(np.array([x]), 2, False)[1]) & set(simhash.keys_of(np.array([y]), 2, True)[1])


def test_embedding_groups_against_sql(spark):
    got = embedding_dedup.op10_embedding_dedup(spark, DATA).toPandas().sort_values("vec_id", ignore_index=True)
    want = duckdb.sql(embedding_dedup.OP10_SQL.replace("FROM embeddings", f"FROM '{DATA}/embeddings.parquet'")).df().sort_values("vec_id", ignore_index=True)
    assert got[want.columns.tolist()].equals(want)


def test_embedding_groups_of_odd_and_crowded_rows(spark):
    rng = np.random.default_rng(2)
    near = (1 + 1e-3 * rng.standard_normal((150, 8))).tolist()
    rows = [(i + 10, x, 1) for i, x in enumerate(near)] + [(300, near[0], 1), (301, near[0], 2), (302, near[0], None), (303, None, 1), (304, [0.0] * 8, 1), (305, [float("inf")] * 8, 1), (306, [1.0, 1.0], 1)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i].n_links == 150 and got[i].component_id == 10 for i in [*range(10, 160), 300])
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(301, 307))


def test_pipeline_stages(spark, docs):
    sf = "/root/testdata/sf0.01"
    table = read(spark, sf, "documents").unionByName(spark.createDataFrame(ODD, SCHEMA), allowMissingColumns=True)
    labels = {r.doc_id: r for r in read(spark, sf, "labels").collect()}
    kept = corpus_pipeline.keep_quality(spark, table, sf)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = [i for i, r in labels.items() if r.quality == 1]
    assert len(ids & set(good)) >= 0.95 * len(good)
    clean = corpus_pipeline.drop_toxic(spark, table, sf)
    ids = {r.doc_id for r in clean.select("doc_id").collect()}
    fine = [i for i, r in labels.items() if r.toxic == 0]
    assert clean.columns == table.columns and len(ids & set(fine)) >= 0.98 * len(fine)
    one = corpus_pipeline.drop_near_copies(spark, table, sf)
    groups = simhash.simhash_groups(table).where("doc_id is not null")
    roots = {r.component_id for r in groups.collect()}
    assert one.columns == table.columns
    assert Counter(r.doc_id for r in one.select("doc_id").collect()) == Counter({**dict.fromkeys(roots, 1), None: 1})
    assert corpus_pipeline.pack_sequences(spark, one.limit(0), sf).count() == 0


def test_pipeline_leaves_given_columns_alone(spark):
    sf = "/root/testdata/sf0.01"
    table = read(spark, sf, "documents").limit(60).unionByName(spark.createDataFrame(ODD, SCHEMA), allowMissingColumns=True)
    table = table.withColumns({"score": F.lit(7.5), "predicted": F.lit(-1), "a.b": F.lit("dot"), "m": F.create_map(F.lit("k"), F.col("doc_id")), "__hash": F.lit(1), "text_": F.col("text")})
    table = table.checkpoint()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, table, sf)
        rows = out.collect()
        assert out.columns == table.columns and out.schema.simpleString() == table.schema.simpleString(), name
        assert rows and all(r.score == 7.5 and r.predicted == -1 and r["a.b"] == "dot" and r.m["k"] == r.doc_id for r in rows)
        assert stage(spark, table.limit(0), sf).count() == 0


def test_pipeline_run_against_its_stages(spark, tmp_path):
    """`run` on a small corpus with repeated rows, against the stages' decisions taken one by one."""
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents").where("n_chars < 3000").limit(150)
    twice = docs.unionByName(docs.limit(5)).unionByName(docs.limit(4).withColumn("doc_id", F.col("doc_id") + 1_000_000))
    twice.write.parquet(str(tmp_path / "documents.parquet"))
    read(spark, sf, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    small = str(tmp_path)
    got = corpus_pipeline.run(spark, small).collect()
    texts = {r.doc_id: r.text for r in twice.collect()}
    good = quality.score(twice, quality.fitted(spark, small)).where("predicted = 1").select("doc_id", "text").distinct()
    fine = toxicity.score(good, toxicity.fitted(spark, small)).where("predicted = 0").collect()
    prints = {r.doc_id: simhash.fingerprint(texts[r.doc_id]) for r in fine}
    root = {i: i for i in prints}  # the smallest reachable id, by plain sweeps
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    kept = {i for i in prints if root[i] == i}
    assert {r.doc_id for r in got} == kept
    t = Tokenizer.from_file(WORDS)
    ids = {i: np.array([*t.encode(texts[i], add_special_tokens=False).ids, 1], "<u4") for i in kept}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
