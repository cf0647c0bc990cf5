"""Words, tokenizers and language identification against brute force."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_fixtures import NORTH, ODD, SOUTH, no_docs, odd_docs, prose, rng  # noqa: F401
from panelwright.llm import langid, merge_replay, packing, piece_count, text

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_those_of_the_pattern(rng):
    texts = [t for t in ODD if t] + ["".join(rng.choice("ab \t\n\x0b\x1cé") for _ in range(60)) for _ in range(200)]
    for t in texts:
        want = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        hashes, first = text.group_words([t.encode()])
        assert len(hashes) == first[1] == len(want) and t.encode().split() == want
        by_word = dict(zip(want, hashes))
        assert all(by_word[w] == h for w, h in zip(want, hashes)) and len(set(by_word.values())) == len(by_word)


def test_word_hashes_do_not_depend_on_the_group(monkeypatch):
    texts = [b"one two three", b"", b"two", b"three one" * 50]
    together, first = text.group_words(texts)
    monkeypatch.setattr(text, "GROUP", 16)
    for i, t in enumerate(texts):
        assert (text.group_words([t])[0] == together[first[i] : first[i + 1]]).all()


def test_tokens_of_shapes():
    t = text.Tokens([b"The THE the tHE 42 !!", b"", b"x"], shapes=True, prefix=2)
    assert t.first.tolist() == [0, 6, 6, 7] and t.shape.tolist() == [1, 2, 0, 3, 4, 5, 0]
    assert len(set(t.hashes[:4].tolist())) == 1 and len(set(t.prefixes[:4].tolist())) == 1


# Token counts

def test_chunks_splice_to_the_whole(rng):
    coder = piece_count.PieceEncoder(PIECES, chunk=50, overlap=4)
    parts = ["the", "ing ", " ", "  ", "aaa", "é", "漢", "\U00010348", "\n", "2", "-", "tion"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [p * 400 for p in parts]
    for t in texts:
        assert coder.encode_long(t).tolist() == coder.model.encode(t)
    assert coder.widened  # some overlap had no two common borders


def test_work_on_a_text_grows_with_its_length(rng, monkeypatch):
    """Characters encoded and borders compared per chunk stay the same from 1 to 4 MB; no step handles more than a chunk."""
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(1, 11))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=700_000))[: 1 << 22]
    coder, real, plain = piece_count.PieceEncoder(PIECES), piece_count.PieceEncoder._encode, np.intersect1d
    encoded, compared = [], []
    monkeypatch.setattr(coder, "_encode", lambda t, a, b: (encoded.append(b - a), real(coder, t, a, b))[1])
    monkeypatch.setattr(np, "intersect1d", lambda a, b: (compared.append(len(a) + len(b)), plain(a, b))[1])
    work = []
    for size in (1 << 20, 1 << 21, 1 << 22):
        encoded.clear(), compared.clear()
        n = coder.count_long(text[:size])
        assert max(encoded) <= coder.chunk + coder.overlap and max(compared) <= 2 * coder.overlap
        work.append(sum(encoded) + sum(compared))
    assert work[1] <= 2.2 * work[0] and work[2] <= 2.2 * work[1]
    assert n == len(coder.model.encode(text))


def test_patterns_that_splice_late(rng):
    coder = piece_count.PieceEncoder(PIECES, chunk=1000, overlap=2)
    for p in ("aaaaaaab", "\u6f22", "the the ", "=" * 7, "0123456789", "\n \n", "\U00010348x"):
        t = (p * 3000)[:12_345]
        assert coder.encode_long(t).tolist() == coder.model.encode(t) and coder.count_long(t) == len(coder.model.encode(t))


def test_token_counts(spark, odd_docs, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = piece_count.count_tokens(odd_docs, PIECES, limit=1).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        n = len(model.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1)
    assert piece_count.count_tokens(no_docs, PIECES).count() == 0


# Merge replay

@pytest.fixture(scope="module")
def byte_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay(byte_encoding):
    rng = random.Random(2)
    coder = merge_replay.ByteCoder(RANKS, public_tokenizers.PATTERN)
    parts = ["a", "aa", "b", "'s", "t", " ", "\n", "ç", "漢", "\U0001f642", "1", "!", "the", "<|endoftext|>", "\x1c"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for t, (n, ids, back) in zip(texts, coder.rows(texts), strict=True):
        want = byte_encoding.encode_ordinary(t)
        assert (n, ids, back) == (len(want), " ".join(map(str, want)), t.encode())


def test_merge_order_when_a_lower_rank_appears():
    # (b, c) makes a pair with a of a lower rank than its own.
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 300, b"bc": 400, b"ca": 350}
    replay = merge_replay.MergeReplay(ranks)
    own = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks | {b"\0\0": 299, **{bytes([1, i]): 301 + i for i in range(49)},
                            **{bytes([2, i]): 351 + i for i in range(49)}}, special_tokens={})
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert replay.encode([word.encode()])[0] == own.encode_ordinary(word)


def test_encode_decode_frame(odd_docs, no_docs, byte_encoding):
    for r in merge_replay.encode_decode(odd_docs, RANKS, public_tokenizers.PATTERN).collect():
        want = byte_encoding.encode_ordinary(r.text or "")
        assert r.n_tokens == len(want) and r.ids == " ".join(map(str, want)) and bytes(r.decoded) == (r.text or "").encode()
    assert merge_replay.encode_decode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


# Packing

def laid_out(lengths, capacity):
    p = packing.Packing(lengths, capacity)
    table = p.table()
    key = table[:, 0] << 44 | table[:, 1]
    bins = {}
    for w, n in lengths.items():
        for rank in range(n):
            row = table[np.searchsorted(key, w << 44 | rank, "right") - 1]
            nth = rank - row[1]
            bins.setdefault(int(row[2] + nth // row[3]), []).append((int(row[4] + nth % row[3] * w), w))
    return p, bins


def fewest(items, capacity):
    """Exact number of bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] >= items[i]:
                go(i + 1, bins[:k] + [bins[k] - items[i]] + bins[k + 1 :])
        go(i + 1, bins + [capacity - items[i]])

    go(0, [])
    return best[0]


def test_packing_is_gapless_and_reduction_loses_nothing(rng):
    for _ in range(300):
        capacity = rng.randint(3, 30)
        lengths = {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        p, bins = laid_out(lengths, capacity)
        assert sorted(bins) == list(range(p.n_sequences))
        for placed in bins.values():
            at = 0
            for offset, w in sorted(placed):
                assert offset == at
                at += w
            assert at <= capacity
        items = [w for w, n in lengths.items() for _ in range(n)]
        if len(items) <= 8:
            left = [w for s, x in bins.items() if s >= p.n_fixed for _, w in x]
            # The sequences fixed by dominance are part of a best packing.
            assert p.n_fixed + fewest(left, capacity) == fewest(items, capacity)


def test_pack_frame(spark, odd_docs, no_docs, rng):
    import zlib

    own = Tokenizer.from_file(WORDS)
    docs = odd_docs.select("doc_id", "text").union(
        spark.createDataFrame([(500 + i, prose(rng, 10 * i)) for i in range(30)], "doc_id long, text string"))
    rows = packing.pack(docs, WORDS, capacity=64).toPandas()
    want = []
    for r in docs.collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, 64 * k, len(ids[64 * k : 64 * k + 64]), zlib.crc32(ids[64 * k : 64 * k + 64].tobytes()))
                 for k in range(-(-len(ids) // 64))]
    got = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group.offset == group.length.cumsum() - group.length).all() and group.length.sum() <= 64
    assert rows.sequence_id.nunique() <= 1.05 * -(-rows.length.sum() // 64) + 1
    assert packing.pack(no_docs, WORDS).count() == 0


# Language identification

def test_language_learned_from_the_rest(spark, rng):
    rows = [(i, prose(rng, 30, NORTH if i % 2 else SOUTH), "n" if i % 2 else "s") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert {r.held_out for r in got} == {True, False}
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got)


def test_language_of_held_out_rows_is_not_learned(spark, rng):
    rows = [(i, prose(rng, 20), "n") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "secret").otherwise(F.col("lang")))
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"n"}


def test_language_odd_rows(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
    assert langid.identify(no_docs).count() == 0
    nothing = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_language_of_a_long_text_is_scored_whole(monkeypatch, rng):
    texts = ["ab" * 40, prose(rng, 300), "a"]
    model = langid.Model(["x", "y"], np.zeros(2), np.random.default_rng(1).random((257, 2)), 8)
    whole = model.score(texts)
    monkeypatch.setattr(langid, "GROUP", 32)
    cut = model.score(texts)
    assert (whole.lang_pred == cut.lang_pred).all() and np.allclose(whole.score, cut.score)


def test_equal_scores_go_to_the_first_language():
    model = langid.Model(["a", "b"], np.zeros(2), np.zeros((257, 2)), 8)
    assert model.score(["word"]).values.tolist() == [["a", 0.5]]
