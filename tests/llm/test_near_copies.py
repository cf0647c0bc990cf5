"""The pipeline's near copies against Jaccard similarities of all pairs."""

import numpy as np
from pyspark.sql import functions as F

from corpus_fixtures import ODD, no_docs, odd_docs, rng  # noqa: F401
from panelwright.llm import minhash, simhash
from panelwright.llm.components import components


def jaccard(a, b):
    a, b = ((t or "").encode().lower().split() for t in (a, b))
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(rows):
    """Smallest id of each row's group."""
    ids, part = [d for d, _ in rows], list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if part[i] != part[j] and jaccard(a, b) >= 0.8:
                part = [part[j] if p == part[i] else p for p in part]
    low = {}
    for d, p in zip(ids, part):
        low[p] = min(low.get(p, d), d)
    return [low[p] for p in part]


def planted(rng):
    """Texts, near copies with a tenth of the words' sequences changed, and chains that drift away step by step."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(120))) for i in range(30)]
    for i in range(30):
        w = rows[i][1].split()
        for at in rng.sample(range(120), 2):
            w[at] = word()
        rows.append((1000 + i, " ".join(w).upper()))
    w = rows[0][1].split()
    for i in range(40):
        w[rng.randrange(120)] = word()
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000 + i, t) for i, t in rows[:5]] + [(4000 + i, t) for i, t in enumerate(ODD)]
    return rows


def test_shingles_are_sets_of_word_sequences():
    group = [b"A b c d e F", b"", b"a b", b"a b c d e f", b"b a"]
    hashes, first, same = minhash.shingles(group)
    assert np.diff(first).tolist() == [2, 0, 1, 2, 1]
    assert hashes[:2].tolist() == hashes[3:5].tolist() and same[0] == same[3] and same[1] == 0
    assert len(set(hashes.tolist())) == 4
    keys = minhash.band_keys(hashes, first)
    assert (keys[0] == keys[3]).all() and not (keys[0] == keys[2]).any() and not keys[1].any()


def test_near_copies_are_those_of_all_pairs(spark, rng):
    rows = planted(rng)
    want = brute_force(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == want
    assert sum(d != w for d, w in zip((d for d, _ in rows), want)) >= 60


def test_pipeline_drops_planted_near_copies(spark, rng):
    import corpus_pipeline

    rows = planted(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == set(brute_force(rows))


def test_near_copies_odd_rows(odd_docs, no_docs):
    kept = minhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    words = {(None if not (t or "").split() else t.encode().lower()) for t in ODD}
    # Rows repeated in id and text stay; a null id goes with its copies.
    assert len({d for d, _ in found}) == len(words) and len(found) == 2 * len(words) and None not in {d for d, _ in found}
    assert minhash.near_copies(no_docs).count() == minhash.drop_near_copies(no_docs).count() == 0


def test_simhash_gives_candidates(spark, rng):
    """Near copies within two bits are found by their fingerprints alone; the exact test decides."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for i in range(8):
        w = [word() for _ in range(400)]
        rows.append((i, " ".join(w)))
        rows.append((100 + i, " ".join([*w, word()]).upper()))
    prints = {d: simhash.fingerprint(t, minhash.SHINGLE) for d, t in rows}
    close = {i for i in range(8) if (prints[i] ^ prints[100 + i]).bit_count() <= simhash.MAX_BITS}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = minhash.fingerprint_keys(docs)
    found = {r.doc_id: r.key for r in keys.collect()}
    assert close and close == {i for i in range(8) if found[i] == found[100 + i]}
    prints = keys.select("doc_id", "body", (F.col("doc_id") + 1).alias("same"), F.array("key").alias("keys"))
    linked = components(minhash.links(docs, prints)).collect()
    assert {(r.component - 1, r.id - 1) for r in linked} == {(i, 100 + i) for i in close}


def test_near_copies_take_fingerprints(spark, rng, monkeypatch):
    asked, keys = [], minhash.fingerprint_keys
    monkeypatch.setattr(minhash, "fingerprint_keys", lambda docs: asked.append(docs) or keys(docs))
    rows = planted(rng)[:40]
    kept = minhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(brute_force(rows)) and len(asked) == 1


def test_no_stage_table_is_broadcast(spark, rng, monkeypatch):
    """Keys, sets, pairs and parts meet by a merge, however small their files are."""
    plans = {}

    def noted(df, label, keep=minhash.materialize):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, label)

    monkeypatch.setattr(minhash, "materialize", noted)
    kept = minhash.drop_near_copies(spark.createDataFrame(planted(rng), "doc_id long, text string"))
    last = kept._jdf.queryExecution().executedPlan().toString()
    for label in ("near-buckets", "near-sets", "near-links", "near-parts", "near-rows", "near-labels"):
        assert "SortMergeJoin" in plans[label] and "BroadcastHashJoin" not in plans[label], label
    # The frequent keys of join_spread, of which there are few whatever the data.
    assert all(x.count("BroadcastHashJoin") <= 2 for x in (plans["near-prints"], plans["near-classes"], last))


def test_rows_without_an_id_are_compared(spark, rng):
    """Rows without an id go with their near copies, also as the link between two others, and among themselves."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    w = [[word() for _ in range(120)] for _ in range(5)]
    text = lambda words, at="", new="new": " ".join([x if i != at else new for i, x in enumerate(words)])
    # Two changes away from each other, by ten of 116 sequences and then as many of the other end.
    far = [" ".join(w[1]), " ".join(["new"] * 9 + w[1][9:]), " ".join(["new"] * 9 + w[1][9:-9] + ["end"] * 9)]
    rows = [
        (1, text(w[0])), (None, text(w[0], 60)),
        (2, far[0]), (None, far[1]), (3, far[2]),
        (None, text(w[2])), (None, text(w[2], 3)), (None, text(w[2], 100)),
        (None, text(w[3])), (None, text(w[3])), (4, text(w[4]))]
    assert jaccard(far[0], far[2]) < 0.8 <= min(jaccard(far[0], far[1]), jaccard(far[1], far[2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keys = minhash.fingerprint_keys(docs)
    assert keys.filter("doc_id is null").select("body").distinct().count() == len({t for d, t in rows if d is None})
    got = {(r.doc_id, r.text): r.component_id for r in minhash.near_copies(docs).join(
        docs.select("text", F.xxhash64("text").alias("body")).distinct(), "body").collect()}
    assert got == {(d, t): c for (d, t), c in zip(rows, [1, 1, 2, 2, 2, None, None, None, None, None, 4])}
    kept = [(r.doc_id, r.text) for r in minhash.drop_near_copies(docs).collect()]
    assert sorted(d for d, _ in kept if d) == [1, 2, 4]
    # One text of the three near copies without an id, and the text that comes twice.
    left = [t for d, t in kept if d is None]
    assert sorted(map(left.count, set(left))) == [1, 2] and left.count(text(w[3])) == 2


def test_simhash_links_rows_without_an_id(spark, rng):
    """A key of a fingerprint component doesn't depend on which of its rows have ids."""
    base = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    rows = [(i, " ".join(base[: 40 * i] + ["new"] + base[40 * i + 1 :])) for i in range(10)]
    some = [(d if d % 3 == 0 else None, t) for d, t in rows]
    keys = [{r.body: r.key for r in minhash.fingerprint_keys(spark.createDataFrame(x, "doc_id long, text string")).collect()}
            for x in (rows, some)]
    assert keys[0] == keys[1] and len(keys[0]) == 10 and len(set(keys[0].values())) < 10
