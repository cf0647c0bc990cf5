"""Substring dedup: passages that a document with a smaller id already has are removed.

A passage is ``window`` consecutive words or more. The method is matching
statistics against suffix automata of reference shards. The corpus is its own
reference, so the shards can't all be sent everywhere; each goes only to the
documents that can match it:

1. Every window picks one of its ``gram``-word sequences by smallest hash, so
   equal windows pick the same one. Consecutive windows with the same pick form
   a *stretch*, one row (pick, hash of its words, document, place). Picks that
   occur in one document only are dropped; this is an aggregate with map-side
   sums, so a passage that a third of all documents share is one row per task.
2. Stretches with equal words meet by hash. Where a stretch is the first of its
   kind but its pick has other kinds too (the edges of shared passages), its
   windows meet one by one. Both give (place in a document, equal place in the
   document of smallest id). No pairs are formed: each row meets its group's first.
3. The reference document's text around those places is cut into shards of
   ``SHARD`` words. Each shard is sent to the tasks that hold candidates for it;
   they build its automaton and stream the candidate passages through it. Words
   covered by matches of ``window`` or more words are removed, so what the hashes
   suggested is decided by the words themselves.

Windows are judged on the input. Defined results: a null or empty text, or one
below ``window`` words, loses nothing; rows with equal ids don't remove each
other's words; a null id neither removes nor loses anything. Texts of any
length are handled, in slices of 2^24 words that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.automaton import SuffixAutomaton
from panelwright.llm.text import U64, group_words, grouped, mix, prefix_hash, range_hash, text_bytes
from panelwright.session import materialize

WINDOW = 50
GRAM = 12
#: Words of a reference shard; candidates may reach a stretch beyond its end.
SHARD = 256
_INDEX = 24
_SLICE = 1 << _INDEX

STRETCHES = "pick long, words_hash long, doc_id long, body long, start int, n int, unit int"


def stretches(words: np.ndarray, first: np.ndarray, window: int, gram: int):
    """(text, pick, hash, start, n, unit) arrays of the stretches of a group of texts.

    ``words`` are word hashes, ``first`` the index of each text's first word. A
    stretch that follows itself (text in which the same words go round) is one row:
    n windows in all, the first ``unit`` of which say everything.
    """
    n_words = np.diff(first)
    none = np.zeros(0, np.int64)
    if not len(words) or n_words.max() < window:
        return none, none.view(U64), none.view(U64), none, none, none
    sums, down = prefix_hash(words)
    at = np.arange(len(words) - gram + 1)
    grams = range_hash(sums, down, at, at + gram)
    # The order of grams must not depend on where they stand, but for ties: the leftmost wins.
    key = (grams & ~U64(_SLICE - 1)) | at.astype(U64)
    wide, span = window - gram + 1, 1
    while span * 2 <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[: len(key) - (wide - span)], key[wide - span :])
    spot = (key & U64(_SLICE - 1)).astype(np.int64)
    start = np.arange(len(spot))
    text = np.repeat(np.arange(len(n_words)), n_words)[: len(spot)]
    valid = start + window <= first[text + 1]
    start, spot, text = start[valid], spot[valid], text[valid]
    new = np.ones(len(start), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(start)))
    start, spot, text = start[begin], spot[begin], text[begin]
    whole = range_hash(sums, down, start, start + n + window - 1)
    with np.errstate(over="ignore"):
        whole = mix(whole + (spot - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    alone = np.ones(len(start), bool)
    alone[1:] = (whole[1:] != whole[:-1]) | (n[1:] != n[:-1]) | (text[1:] != text[:-1])
    kept = np.flatnonzero(alone)
    unit = n[kept]
    n = np.add.reduceat(n, kept) if len(kept) else unit
    return text[kept], grams[spot[kept]], whole[kept], (start - first[text])[kept], n, unit


def _slices(words: np.ndarray, first: np.ndarray, window: int):
    """(words, first, offset of its starts): slices of a text that is too long for one pass."""
    if len(words) <= _SLICE:
        yield words, first, 0
        return
    for at in range(0, len(words) - window + 1, _SLICE - window):
        part = words[at : at + _SLICE]
        yield part, np.array([0, len(part)]), at


def _scan(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        body = batch.column("body").to_numpy(zero_copy_only=False)
        texts = (x.as_py() for x in batch.column("text"))
        for origin, group in grouped(texts):
            words, first = group_words(group)
            for part, part_first, at in _slices(words, first, window):
                text, pick, whole, start, n, unit = stretches(part, part_first, window, gram)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (pick, whole)]
                        + [pa.array(doc[origin + text]), pa.array(body[origin + text])]
                        + [pa.array(x.astype(np.int32)) for x in (start + at, n, unit)],
                        names=["pick", "words_hash", "doc_id", "body", "start", "n", "unit"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """One row per window asked for: (window_hash, doc_id, body, start)."""
    for batch in batches:
        for doc, body, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "text", "asked"))):
            words, _ = group_words([text_bytes(text)])
            sums, down = prefix_hash(words)
            start = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in asked]))
            found = range_hash(sums, down, start, start + window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(np.full(len(start), doc)),
                 pa.array(np.full(len(start), body)), pa.array(start.astype(np.int32))],
                names=["window_hash", "doc_id", "body", "start"])


def _passages(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The words [start, stop) of each passage asked for, as bytes joined by spaces."""
    schema = pa.schema([("passage", pa.binary()), ("start", pa.int32())] + [
        (n, pa.int32() if n == "shard" else pa.int64()) for n in names])
    for batch in batches:
        rows: list[dict] = []
        size = 0
        for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
            words = text_bytes(text).split()
            for x in asked:
                passage = b" ".join(words[x["start"] : x["stop"]])
                rows.append({n: x[n] for n in names} | {"start": x["start"], "passage": passage})
                size += len(passage)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _matched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Stream candidate passages through the automata of their shards: (doc_id, body, start, stop)."""
    built: dict[bytes, SuffixAutomaton] = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("reference", "doc_id", "body", "start", "passage"))
        out: list[list] = [[], [], [], []]
        for reference, doc, body, start, passage in zip(*columns):
            automaton = built.get(reference)
            if automaton is None:
                if len(built) >= 64:  # rows of a shard come together; older automata aren't needed again
                    built.clear()
                automaton = built[reference] = SuffixAutomaton(reference.split(b" "))
            for a, b in automaton.matches(passage.split(b" "), window):
                for column, value in zip(out, (doc, body, start + a, start + b)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
             pa.array(out[3], pa.int32())], names=["doc_id", "body", "start", "stop"])


def _cut(batches: Iterator[pa.RecordBatch], new: list[str]) -> Iterator[pa.RecordBatch]:
    """Append (n_words, n_removed, kept), named ``new``, to rows of (..., text, _cut_spans)."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("_cut_spans").to_pylist()):
            words = text_bytes(text.as_py()).split()
            total = len(words)
            if spans:
                left, at = [], 0
                for x in sorted(spans, key=lambda s: (s["start"], s["stop"])):
                    left += words[at : max(at, x["start"])]
                    at = max(at, x["stop"])
                words = left + words[at:]
            n_words.append(total)
            n_removed.append(total - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        columns = [c for c in batch.schema.names if c != "_cut_spans"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in columns]
            + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            names=[*columns, *new])


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, body, start, stop): words of a document covered by windows that a smaller id has.

    ``body`` is the hash of the text, which tells rows with equal ids apart.
    Spans of a document may overlap. ``docs`` has the columns doc_id, text and body.
    """
    some = docs.filter("doc_id is not null and text is not null")
    by_doc = some.select("doc_id", "body", "text")
    found = materialize(
        by_doc.mapInArrow(lambda b: _scan(b, window, gram), STRETCHES), "stretches")

    shared = (found.groupBy("pick").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
              .filter("low < high").select("pick"))
    candidates = materialize(found.join(shared, "pick"), "shared-stretches")

    kinds = candidates.groupBy("pick", "words_hash").agg(
        F.min(F.struct("doc_id", "body", "start")).alias("f"))
    mixed = (kinds.groupBy("pick").agg(F.min("words_hash").alias("a"), F.max("words_hash").alias("b"))
             .filter("a < b").select("pick"))
    met = candidates.join(kinds.select("words_hash", F.col("pick").alias("_pick"), "f"), "words_hash").filter("pick = _pick")
    by_stretch = met.filter("f.doc_id < doc_id").select("doc_id", "body", "start", "n", "unit", "f")

    edges = (
        met.filter("f.doc_id = doc_id").join(mixed, "pick", "left_semi")
        .groupBy("doc_id", "body").agg(F.collect_list(F.struct("start", "n")).alias("asked")))

    windows = materialize(
        by_doc.join(edges.hint("shuffle_hash"), ["doc_id", "body"])
        .mapInArrow(lambda b: _windows(b, window), "window_hash long, doc_id long, body long, start int"),
        "edge-windows")
    firsts = (windows.groupBy("window_hash")
              .agg(F.min(F.struct("doc_id", "body", "start")).alias("f"), F.max("doc_id").alias("high"))
              .filter("f.doc_id < high").select("window_hash", "f"))
    by_window = (windows.join(firsts, "window_hash").filter("f.doc_id < doc_id")
                 .select("doc_id", "body", "start", F.lit(1).alias("n"), F.lit(1).alias("unit"), "f"))

    # Passages with one alignment to one shard of the reference document.
    candidate = (
        by_stretch.unionByName(by_window)
        .withColumn("shard", F.floor(F.col("f.start") / SHARD).cast("int"))
        .groupBy("doc_id", "body", F.col("f.doc_id").alias("ref_doc"), F.col("f.body").alias("ref_body"), "shard",
                 (F.col("start") - F.col("f.start")).alias("shift"))
        .agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) + window - 1).alias("stop"),
             F.min("f.start").alias("ref_start"), (F.max(F.col("f.start") + F.col("unit")) + window - 1).alias("ref_stop")))
    candidate = materialize(candidate, "candidate-passages")
    keys = ["ref_doc", "ref_body", "shard"]
    passages = (
        by_doc.join(candidate.groupBy("doc_id", "body")
                    .agg(F.collect_list(F.struct(*keys, "doc_id", "body", "start", "stop")).alias("asked"))
                    .hint("shuffle_hash"), ["doc_id", "body"])
        .select("text", "asked")
        .mapInArrow(lambda b: _passages(b, [*keys, "doc_id", "body"]),
                    "passage binary, start int, ref_doc long, ref_body long, shard int, doc_id long, body long"))
    references = (
        candidate.groupBy(*keys)
        .agg(F.min("ref_start").alias("start"), F.max("ref_stop").alias("stop"))
        .withColumns({"doc_id": F.col("ref_doc"), "body": F.col("ref_body")})
        .groupBy("doc_id", "body").agg(F.collect_list(F.struct(*keys, "start", "stop")).alias("asked")))
    shards = (
        by_doc.join(references.hint("shuffle_hash"), ["doc_id", "body"])
        .select("text", "asked")
        .mapInArrow(lambda b: _passages(b, keys),
                    "passage binary, start int, ref_doc long, ref_body long, shard int")
        .dropDuplicates(keys)
        .select(*keys, F.col("passage").alias("reference")))
    return (
        passages.join(shards, keys)
        .select("reference", "doc_id", "body", "start", "passage")
        .mapInArrow(lambda b: _matched(b, window), "doc_id long, body long, start int, stop int"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words left, joined by one space).

    The new columns' names get ``prefix``; input columns of these names are replaced.
    """
    new = [prefix + c for c in ("n_words", "n_removed", "kept")]
    own = [c for c in docs.columns if c not in new]
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in own], F.col("doc_id").cast("long").alias("_cut_doc"),
        F.xxhash64("text").alias("_cut_body"))
    spans = (
        repeated_spans(keyed.select(F.col("_cut_doc").alias("doc_id"), F.col("_cut_body").alias("body"), "text"),
                       window, gram)
        .groupBy(F.col("doc_id").alias("_cut_doc"), F.col("body").alias("_cut_body"))
        .agg(F.collect_list(F.struct("start", "stop")).alias("_cut_spans")))
    rows = (keyed.join(spans.hint("shuffle_hash"), ["_cut_doc", "_cut_body"], "left")
            .select(*[F.col(f"`{c}`") for c in own], "_cut_spans"))
    kinds = ("long", "long", "string")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_cut_spans"]
    fields += [f"`{n}` {k}" for n, k in zip(new, kinds)]
    return rows.mapInArrow(lambda b: _cut(b, new), ", ".join(fields))
