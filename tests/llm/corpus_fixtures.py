"""Texts and fixtures for the tests of this folder."""

import random

import pytest

#: Words of two invented languages.
NORTH = "skov elv bjerg snavs trold havn mark dyb".split()
SOUTH = "casa rio monte torre campo puerto luna sol".split()


def prose(rng, n, words=NORTH):
    return " ".join(rng.choice(words) + rng.choice(["", "e", "en", "a", "os"]) for _ in range(n))


#: Texts that every operator must take: null, empty, white space, marks, one word, one long word, other scripts.
ODD = [None, "", " \t\n", "!!! ...", "word", "x" * 5000, "漢字 \U0001f642 é", "a  b\x0bc\x0cd", "<|endoftext|> 's"]


@pytest.fixture()
def rng():
    return random.Random(5)


@pytest.fixture()
def odd_docs(spark):
    """Odd texts, each twice under one id and once more, a null id, and columns whose names clash."""
    rows = [(i, t) for i, t in enumerate(ODD)] * 2 + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "word")]
    names = ("body", "fp", "kept", "score", "label", "key", "n_tokens", "n_words", "spans", "lang")
    return spark.createDataFrame(
        [(i, t, *(["clash"] * len(names))) for i, t in rows],
        "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
