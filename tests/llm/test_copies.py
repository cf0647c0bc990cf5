"""Substring dedup, SimHash, vectors, quality, toxicity and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpus_fixtures import NORTH, ODD, SOUTH, no_docs, odd_docs, prose, rng  # noqa: F401
from panelwright.llm import components, passages, repeats, resample, simhash, stable_hash, vafile
from panelwright.llm.automaton import SuffixAutomaton
from panelwright.llm.queries import ORACLES, QUERIES


# Substring dedup

def cut_by_brute_force(rows, window):
    """Kept words by row, from all windows."""
    low = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        if doc is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                low[key] = min(low.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = set()
        if doc is not None:
            for i in range(len(w) - window + 1):
                if low[tuple(w[i : i + window])] < doc:
                    gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def test_automaton_matches_are_those_of_all_windows(rng):
    for _ in range(200):
        ref = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        windows = {tuple(ref[i : i + 4]) for i in range(len(ref) - 3)}
        want = {j for i in range(len(words) - 3) if tuple(words[i : i + 4]) in windows for j in range(i, i + 4)}
        got = {j for a, b in SuffixAutomaton(ref).matches(words, 4) for j in range(a, b)}
        assert got == want


@pytest.mark.parametrize("shard", [4, 256])
def test_repeats(spark, rng, monkeypatch, shard):
    monkeypatch.setattr(repeats, "SHARD", shard)
    passages_ = [prose(rng, n) for n in (7, 8, 9, 30, 60)]
    rows = []
    for i in range(150):
        parts = [prose(rng, rng.randint(0, 12), SOUTH) if rng.random() < 0.6 else rng.choice(passages_)
                 for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 120), " ".join(parts)))
    rows += [(3, rows[0][1]), (3, rows[0][1]), (None, rows[5][1]), *[(1000 + i, t) for i, t in enumerate(ODD)]]
    rows += [(2000 + i, "aa bb " * 40) for i in range(4)] + [(1, "aa bb " * 9)]
    rows += [(3000 + i, prose(rng, 9) + " x y z" * rng.randint(1, 12) + " " + prose(rng, 9)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.remove_repeats(docs, window=8, gram=3).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == cut_by_brute_force(rows, 8)


def test_repeats_in_slices_of_a_long_text(spark, rng, monkeypatch):
    monkeypatch.setattr(repeats, "_INDEX", 6)
    monkeypatch.setattr(repeats, "_SLICE", 64)
    whole = prose(rng, 500)
    part = " ".join(whole.split()[200:300])
    words, first = repeats.group_words([whole.encode()])
    found = [x for p, f, _ in repeats._slices(words, first, 8) for x in [len(p)]]
    assert len(found) > 1 and max(found) <= 64
    docs = [(1, whole), (2, part)]
    starts = set()
    for doc, t in docs:
        words, first = repeats.group_words([t.encode()])
        for p, f, at in repeats._slices(words, first, 8):
            for start, n in zip(*repeats.stretches(p, f, 8, 3)[3:5]):
                starts.update((doc, int(start + at + k)) for k in range(int(n)))
    assert starts == {(1, i) for i in range(493)} | {(2, i) for i in range(93)}


def test_repeats_odd_rows(odd_docs, no_docs):
    got = repeats.remove_repeats(odd_docs, window=8, gram=3)
    assert got.count() == odd_docs.count()
    assert {r.n_removed for r in got.collect()} == {0}
    assert set(got.columns) == set(odd_docs.columns) | {"n_words", "n_removed", "kept"}
    assert repeats.remove_repeats(no_docs).count() == 0


# SimHash

def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(ids, linked):
    """Smallest id reachable, by repeated passes."""
    low = list(ids)
    while True:
        new = [min([low[i], *(low[j] for j in linked[i])]) for i in range(len(ids))]
        if new == low:
            return low
        low = new


def test_fingerprint(spark, rng):
    texts = ODD + [prose(rng, n) for n in (1, 2, 3, 4, 70)]
    for t in texts:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t)
    long = prose(rng, 400)
    before = simhash.fingerprint(long)
    simhash._SLICE, kept = 16, simhash._SLICE
    try:
        assert simhash.fingerprint(long) == before
    finally:
        simhash._SLICE = kept
    # The JVM's hash with its fixed seed is the same function.
    assert spark.sql("SELECT xxhash64('some words') AS h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"some words", seed=42)


@pytest.mark.parametrize("segments", [8, 16])
@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_grid_join_finds_each_link_once(spark, segments, max_bits):
    rng = random.Random(segments)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame(list(zip(signed, range(len(prints)))), "fp long, id long")
    got = sorted((min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(frame, max_bits, segments).collect())
    want = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= max_bits]
    assert got == want


def test_entries_are_not_broadcast(spark, rng, monkeypatch):
    """Rows of fingerprints, grid entries and links meet by a merge, however small their files are."""
    plans = []

    def seen(module, name):
        keep = getattr(module, name)

        def noted(df, *rest):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return keep(df, *rest)

        monkeypatch.setattr(module, name, noted)

    seen(simhash, "materialize")
    seen(components, "materialize_at")
    base = prose(rng, 400).split()
    rows = [(i, " ".join(base[: 10 * i] + ["new"] + base[10 * i + 1 :])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.drop_near_copies(docs)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert 0 < kept.count() < 30
    assert len(plans) > 4 and "SortMergeJoin" in plans[1] and not any("BroadcastHashJoin" in x for x in plans[:-1])
    assert plans[-1].count("BroadcastHashJoin") == 2  # of join_spread's frequent keys, of which there are few whatever the data


def test_near_copies(spark, rng, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(ODD * 2 + [prose(rng, 3) for _ in range(20)])] + [(None, "word"), (4, "other id twice")]
    base = prose(rng, 400).split()
    for i in range(30):  # one word differs
        rows.append((200 + i, " ".join(base[: 10 * i] + ["new"] + base[10 * i + 1 :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [plain_fingerprint(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2] for i in range(len(rows))]
    big = 1 << 40
    low = groups_of([big if d is None else d for d, _ in rows], linked)
    want = sorted((str(d), p, str(None if c == big else c)) for (d, _), p, c in zip(rows, prints, low))
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in simhash.near_copies(docs).collect())
    assert got == want
    kept = simhash.drop_near_copies(docs).collect()
    assert sorted(map(str, {r.doc_id for r in kept})) == sorted(map(str, {d for (d, _), c in zip(rows, low) if d == c or c == big}))
    odd = simhash.drop_near_copies(odd_docs)
    assert odd.columns == odd_docs.columns
    assert simhash.near_copies(no_docs).count() == simhash.drop_near_copies(no_docs).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 301), (301, 302), (302, 300), (9, 9)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {301: 300, 302: 300}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Vectors

def vectors(seed=4, n=160, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((20, dim))
    rows = []
    for i in range(n):
        v = base[i % 20] * rng.uniform(0.5, 3) + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.3])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 3)))
    rows += [(500 + i, rows[0][1], 0) for i in range(30)]
    rows += [(600, None, 1), (601, [0.0] * dim, 1), (602, [float("nan")] * dim, 1), (603, rows[0][1], None),
             (604, [None] * dim, 1), (605, [float("inf")] + [0.0] * (dim - 1), 1), (606, [], 1), (607, [1.0, 2.0], 0),
             (608, [2.0, 4.0], 0), (None, rows[0][1], 0), (5, rows[7][1], 1)]
    return rows


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4, 1024])
def test_near_vectors(spark, block):
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in stable_hash.near_vectors(frame, block=block).collect())
    usable = [i for i, (d, v, l) in enumerate(rows) if d is not None and l is not None and good(v) and any(v)]
    linked = [[] for _ in rows]
    for i in usable:
        for j in usable:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                linked[i].append(j)
    low = groups_of([-1 if d is None else d for d, _, _ in rows], linked)
    want = sorted((str(d), len(linked[i]), str(None if d is None else low[i])) for i, (d, _, _) in enumerate(rows))
    assert got == want


def test_near_vectors_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    hasher = stable_hash.StableHash(stable_hash.TABLES, stable_hash.PER_TABLE, stable_hash.WIDTH)
    a = stable_hash.unit(rng.standard_normal((20_000, 64)))
    side = rng.standard_normal((20_000, 64))
    side = stable_hash.unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    met = (hasher.buckets(a) == hasher.buckets(b)).any(1).mean()
    assert met > 0.998


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert stable_hash.near_vectors(none).count() == vafile.top_k(none, F.lit(True)).count() == 0


@pytest.mark.parametrize("shard,block,bits", [(16, 4, 2), (1000, 1000, 5)])
def test_top_k(spark, shard, block, bits):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, score int")
    got = sorted(tuple(r) for r in vafile.top_k(frame, F.col("vec_id") % 7 == 0, 5, shard=shard, block=block, bits=bits).collect())
    usable = [(d, np.floor(256 * np.array(v, float)).astype(int)) for d, v, _ in rows if d is not None and good(v)]
    want = []
    for q, x in usable:
        if q % 7 == 0:
            best = sorted((-int(x @ y), d) for d, y in usable if d != q and len(y) == len(x))[:5]
            want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(best)]
    assert got == sorted(want)


def test_search_reads_few_exact_vectors_and_survives_ties():
    rng = np.random.default_rng(3)
    exact = rng.integers(-60, 60, (4000, 32))
    exact[100:400] = exact[0]
    ids = np.arange(4000)
    queries = exact[[0, 5, 9]]
    found, read = vafile.search(exact, ids, vafile.Approximation(exact, 6), queries, np.array([0, 5, 9]), 5, np.full(3, -np.inf))
    for q, (row, top) in enumerate(zip((0, 5, 9), found)):
        best = sorted((-int(s), i) for i, s in enumerate(exact @ exact[row]) if i != row)[:5]
        assert sorted(zip((-top[0]).tolist(), top[1].tolist())) == best
    assert read < 2000


# Quality

def test_resample_keeps_the_target_and_rejects_the_rest(spark, rng):
    rows = [(i, prose(rng, 40) if i % 4 else " ".join(w + "$$$" for w in prose(rng, 40).split())) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200, 3)] + [(None, 1), (7, None)], "doc_id long, quality int")
    sampler = resample.Sampler(docs, labels, bits=10)
    got = {r.doc_id: r.kept for r in sampler.weights.collect()}
    assert all(got[i] == (i % 4 > 0) for i, _ in rows)
    assert sorted(r.doc_id for r in sampler.rows().collect()) == sorted(i for i in got if got[i])


def test_resample_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (104, 0), (4, 0)], "doc_id long, quality int")
    rows = resample.Sampler(odd_docs, labels, bits=8)
    for r in rows.weights.collect():
        assert r.log_ratio is not None or not r.kept
    assert rows.rows().columns == odd_docs.columns
    none = resample.Sampler(odd_docs, labels.limit(0), bits=8).weights.collect()
    assert {r.log_ratio for r in none} == {0.0, None} and all(r.kept == (r.log_ratio is not None) for r in none)
    empty = resample.Sampler(no_docs, labels, bits=8)
    assert empty.weights.count() == empty.rows().count() == 0


def test_kth_largest_is_exact(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(3000)] + [5.0] * 40 + [-7.0] * 40
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 39, 41, 500, 3000, 3079, 3080, 9000):
        assert resample.kth_largest(frame, "x", k, gather=10, bins=16) == ordered[min(k, 3080) - 1]
    assert resample.kth_largest(frame, "x", 0) is None


# Toxicity

def all_maximal(scores):
    """Maximal-scoring segments by definition: take the best segment, then those left and right of it."""
    def go(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return go(a, i) + [(i, j)] + go(j, b)
    return go(0, len(scores))


def test_segments_are_the_maximal_ones(rng):
    for _ in range(300):
        scores = np.array([rng.uniform(-2, 1.5) for _ in range(rng.randint(0, 14))])
        assert [(a, b) for a, b, _ in passages.segments(scores)] == all_maximal(scores.tolist())


def test_decay_solves_its_equation():
    score, weight = np.array([-1.0, -0.2, 2.0]), np.array([5.0, 4.0, 1.0])
    lam = passages.decay(score, weight)
    assert lam > 0 and abs((weight / weight.sum() * np.exp(lam * score)).sum() - 1) < 1e-9


def toxic_docs(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, 60).split()
        toxic = i % 5 == 0
        if toxic:
            at = rng.randint(0, 50)
            words[at : at + 3] = [rng.choice(["vilstra", "vilno", "grumk"]) for _ in range(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_passages(spark, rng):
    rows, labels = toxic_docs(rng)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in passages.flag(docs, marks, bits=12).collect()}
    wrong = [i for i, t in labels if got[i].predicted != t]
    assert len(wrong) <= 0.03 * len(rows) and all(0 <= r.score <= 1 for r in got.values())
    clean = passages.drop_toxic(docs, marks, bits=12)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i in got if not got[i].predicted)
    model = passages.train(docs, marks, bits=12)
    spans = docs.filter("doc_id = 0").select(passages.passages(spark, model, F.col("text")).alias("p")).first().p
    words = rows[0][1].split()
    assert any(w in ("vilstra", "vilno", "grumk") for s in spans for w in words[s.start : s.stop])


def test_toxicity_labels_of_held_out_rows_are_not_used(spark, rng):
    rows, labels = toxic_docs(rng, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    other = marks.withColumn("toxic", F.when(passages.learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (sorted(map(tuple, passages.flag(docs, m, bits=10).select("doc_id", "score").collect())) for m in (marks, other))
    assert a == b


def test_toxicity_odd_rows(spark, odd_docs, no_docs, rng):
    rows, labels = toxic_docs(rng, 100)
    marks = spark.createDataFrame([(100 + i, t) for i, t in labels], "doc_id long, toxic int")
    for use in (marks, marks.limit(0), marks.withColumn("toxic", F.lit(1))):
        for r in passages.flag(odd_docs, use, bits=8).collect():
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert passages.flag(no_docs, marks, bits=8).count() == 0


# Registered queries and the pipeline

def test_queries_are_registered():
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) < set(QUERIES)


def test_pipeline_stages_keep_columns_and_agree_with_brute_force(spark, rng, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_docs(rng, 300)
    shared = prose(rng, 60, SOUTH)
    rows = [(i, t) for i, t in rows]
    rows += [(1000 + i, " ".join(w + "$$$" for w in prose(rng, 60).split())) for i in range(60)]
    rows += [(2000 + i, prose(rng, 80) + " " + shared + " " + prose(rng, 20)) for i in range(40)]
    rows += [(3000 + i, rows[i][1]) for i in range(1, 40)]
    quality = [(i, 1, t) for i, t in labels] + [(1000 + i, 0, 0) for i in range(0, 60, 2)] + [(2000 + i, 1, 0) for i in range(0, 40, 2)]
    docs = spark.createDataFrame(
        [(i, t, "x", "s", len(t), "clash") for i, t in rows] + [(None, None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quality, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert seen[name].columns == docs.columns
            seen[name].write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {i for i, t in labels if t}
    assert not [i for i in seen["quality"] if i is None or 1000 <= i < 2000]
    assert len(set(seen["quality"])) >= 0.97 * 379
    assert len(toxic & set(seen["toxicity"])) <= 5
    assert not [i for i in seen["near_copies"] if i >= 3000 and i - 3000 in seen["near_copies"]]
    before = sorted((i, r.text) for i, r in seen["near_copies"].items())
    want = {d: (n, k) for d, _, n, k in cut_by_brute_force(before, 50)}
    for i, r in seen["repeated_passages"].items():
        assert r.text == (want[i][1] if want[i][0] else seen["near_copies"][i].text) and r.n_chars == len(r.text)
    assert sum(n > 0 for n, _ in want.values()) >= 30
    packed = seen["packing"].toPandas()
    assert set(packed.doc_id) == set(seen["repeated_passages"]) and packed.groupby("sequence_id").length.sum().max() <= 2048
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        packed[["doc_id", "piece", "ids_crc32"]].itertuples(index=False, name=None))


def test_frequent_keys_join_like_others(spark, monkeypatch):
    """A key of a third of the rows, keys without a row in the table, null keys: the rows of a plain join."""
    from panelwright.llm import components as parts

    monkeypatch.setattr(parts, "FREQUENT", 5)
    rows = spark.createDataFrame([(i, 7 if i % 3 == 0 else (None if i % 11 == 0 else i % 40)) for i in range(300)], "id int, k int")
    n = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k is not null and k <> 12")
    table = n.select("k", (F.col("k") * 2).alias("v"), "n")
    for how in ("inner", "left"):
        got = parts.join_spread(rows, table, "k", "n", 300, how)
        want = rows.join(table.drop("n"), "k", how)
        assert got.columns == ["k", "id", "v"] and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
