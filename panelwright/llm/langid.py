"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one pass that counts n-grams per language inside each task and adds
the counts up by (language, bucket); nothing is sampled. The model is a matrix
of log probabilities, languages x buckets, so its size depends on the number of
languages only; it is broadcast, and batches of texts are scored by gathering
rows of it and summing them per text.

Texts are lower-cased and every run of other characters than letters counts as
one space. Results for odd input: a null or empty text, or one without a letter,
is ``und`` with score 0; so is every text if nothing could be learned. Equal
scores go to the language that sorts first. Repeated rows are scored (and
learned from) as often as they appear. Long texts are read in pieces that
overlap by n-1 characters, so no n-gram is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
SIZES = (2, 3)
#: Characters handled at once; the arrays of a group stay in the processor's cache.
GROUP = 1 << 16
UNKNOWN = "und"
#: Largest model that is broadcast; about 500 languages at 2^16 buckets.
MAX_MODEL_BYTES = 256 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; built once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def normalise(text: str | None) -> np.ndarray:
    """Code points: lower-case letters with single spaces around and between words; empty without a letter."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters().take(points)
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    points = np.where(is_letter, points, np.uint32(32))
    is_letter[1:] |= is_letter[:-1]
    is_letter[0] = True  # the space before the text, whatever follows it
    points = points[is_letter]
    return points[1:] if points[1] == 32 else points


def pieces(texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owners, code points, offsets): groups of pieces of texts, of about GROUP characters each."""
    last, least = max(SIZES) - 1, min(SIZES) - 1
    owners: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def flush():
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) for x in parts], out=offsets[1:])
        return np.array(owners), np.concatenate(parts), offsets

    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - least), GROUP):
            part = text[at : at + GROUP + last]
            if parts and size + len(part) > GROUP + last:
                yield flush()
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield flush()


def buckets(points: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each n the bucket of the n-gram at each position; 2^bits where none starts.

    A piece owns the starts of its first GROUP characters; a shorter text owns all of its own.
    """
    n_points = len(points)
    starts = np.repeat(offsets[:-1].astype(np.int32), np.diff(offsets))
    left = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets))
    where = np.arange(n_points, dtype=np.int32)
    left -= where
    left[where - starts >= GROUP] = 0
    rolling = np.zeros(n_points, np.uint32)
    for n in range(1, max(SIZES) + 1):
        with np.errstate(over="ignore"):
            rolling[: n_points - n + 1] = rolling[: n_points - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
            if n not in SIZES:
                continue
            found = rolling * np.uint32(0x9E3779B1)
            found ^= found >> np.uint32(15)
            found *= np.uint32(0x85EBCA77)
        found >>= np.uint32(32 - bits)
        found[left < n] = 1 << bits
        yield found


def _counts(frames: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's texts; bucket -1 counts the texts."""
    width = 1 << bits
    held: dict[str, np.ndarray] = {}
    n_texts: dict[str, int] = {}
    for batch in frames:
        langs = batch.column("lang").to_pylist()
        cleaned = (normalise(x.as_py()) for x in batch.column("text"))
        for owners, points, offsets in pieces(cleaned):
            names = sorted({langs[o] for o in owners})
            code = np.array([names.index(langs[o]) for o in owners])
            row = np.repeat(code, np.diff(offsets)) * (width + 1)
            total = np.zeros(len(names) * (width + 1), np.int64)
            for found in buckets(points, offsets, bits):
                total += np.bincount(row + found, minlength=len(total))
            for k, name in enumerate(names):
                part = total[k * (width + 1) : (k + 1) * (width + 1) - 1]
                held[name] = held[name] + part if name in held else part.copy()
        for name in langs:
            n_texts[name] = n_texts.get(name, 0) + 1
    for name, n in n_texts.items():
        counts = held.get(name, np.zeros(width, np.int64))
        used = np.flatnonzero(counts[:width])
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([name] * (len(used) + 1), pa.string()),
            "bucket": pa.array(np.append(used, -1), pa.int32()),
            "n": pa.array(np.append(counts[used], n), pa.int64()),
        })


class Model:
    """Languages in order, log prior, and log probabilities by bucket (one zero row at the end)."""

    def __init__(self, langs: list[str], prior: np.ndarray, table: np.ndarray, bits: int):
        self.langs, self.prior, self.bits = langs, prior, bits
        self.columns = np.ascontiguousarray(table.T)

    def score(self, texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        cleaned = [normalise(x) for x in texts]
        total = np.zeros((n, len(self.langs)))
        for owners, points, offsets in pieces(cleaned):
            for found in buckets(points, offsets, self.bits):
                for k, column in enumerate(self.columns):
                    np.add.at(total[:, k], owners, np.add.reduceat(column.take(found), offsets[:-1]))
        names, score = np.full(n, UNKNOWN, object), np.zeros(n)
        known = np.array([len(x) > 0 for x in cleaned], bool)
        if self.langs and known.any():
            total = total[known] + self.prior
            best = total.argmax(1)
            names[known] = np.array(self.langs, object)[best]
            score[known] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return pd.DataFrame({"lang_pred": names, "score": score})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, alpha: float = 0.1) -> Model:
    """Naive Bayes from all rows of ``labelled`` whose ``lang`` is not null; ``alpha`` is added to each count."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null")
    counted = (
        rows.mapInArrow(lambda frames: _counts(frames, bits), "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .toArrow()
    )
    found, place, n = counted["lang"].to_numpy(), counted["bucket"].to_numpy(), counted["n"].to_numpy()
    langs = sorted(set(found))
    width = 1 << bits
    if len(langs) * width * 8 > MAX_MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages make too large a model to broadcast; use fewer bits")
    row = np.searchsorted(np.array(langs, object), found) if langs else np.zeros(0, int)
    counts, texts = np.zeros((len(langs), width)), np.zeros(len(langs))
    texts[row[place < 0]] = n[place < 0]
    counts[row[place >= 0], place[place >= 0]] = n[place >= 0]
    counts += alpha
    table = np.zeros((width + 1, len(langs)))
    if langs:
        table[:-1] = (np.log(counts) - np.log(counts.sum(1, keepdims=True))).T
    return Model(langs, np.log(texts / texts.sum()) if langs else np.zeros(0), table, bits)


def predict(spark, model: Model, text: Column) -> Column:
    """Struct (lang_pred, score) for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield shared.value.score(part)

    return scored.asNondeterministic()(text)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id's text modulo ``folds`` equals ``fold``; an id that is null is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify(docs: DataFrame, folds: int = 5, bits: int = BITS) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; columns of these names are replaced.

    The model learns from the rows that are not held out and have a language.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"), folds)), bits=bits)
    return (
        docs.withColumn("held_out", held_out(F.col("doc_id"), folds))
        .withColumn("_found", predict(docs.sparkSession, model, F.col("text")))
        .withColumn("lang_pred", F.col("_found.lang_pred"))
        .withColumn("score", F.col("_found.score"))
        .drop("_found")
    )
