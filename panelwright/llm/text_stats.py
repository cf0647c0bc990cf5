"""Counts that describe a text: words, symbols, repeated lines and windows.

A word is a run of bytes other than space and 0x09-0x0D; a line is what lies between
line breaks, and counts if it has a word. Words and lines are told apart by Arrow's
dictionaries, so the counts are exact. Texts are handled in slices of about ``SLICE``
bytes; a longer text is a slice of its own, so memory follows the longest text.

Null and empty texts have zero everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 1 << 21
SYMBOLS = b"#*$%&|<>"
#: Words of a window whose repetitions count.
WINDOW = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals",
          "n_digits", "n_marks")

_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _places(chosen: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return table


_KINDS = {"n_symbols": _places(SYMBOLS), "n_capitals": _places(bytes(range(65, 91))),
          "n_digits": _places(bytes(range(48, 58))), "n_marks": _places(_MARKS)}


def _codes(parts: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each distinct string, and how many there are."""
    encoded = parts.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(encoded.dictionary), 1)


def _combined(keys: np.ndarray, size: int, more: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """A number for each pair of numbers; renumbered where the product would leave 64 bits."""
    if size * n >= 1 << 62:
        found, keys = np.unique(keys, return_inverse=True)
        size = max(len(found), 1)
    return keys * n + more, size * n


def _repeated(codes: np.ndarray, n_codes: int, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Whether each word lies in a window that its text has twice or more."""
    covered = np.zeros(len(codes), bool)
    starts = np.flatnonzero(doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1]) if len(doc) >= WINDOW else np.zeros(0, int)
    if len(starts):
        keys, size = doc[starts], n_docs
        for k in range(WINDOW):
            keys, size = _combined(keys, size, codes[starts + k], n_codes)
        _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = starts[times[place] >= 2]
        for k in range(WINDOW):
            covered[again + k] = True
    return covered


def slice_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of a slice of texts without nulls."""
    n = len(texts)
    out = {}
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()), np.uint8)
    for name, table in _KINDS.items():
        upto = np.searchsorted(np.flatnonzero(table[data]), ends)
        out[name] = np.diff(upto, prepend=0)

    words = pc.ascii_split_whitespace(texts)
    doc = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    words = words.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    codes, n_codes = _codes(words)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    out["n_words"] = np.bincount(doc, minlength=n)
    out["word_chars"] = np.bincount(doc, weights=chars, minlength=n).astype(np.int64)
    out["n_distinct"] = np.bincount(np.unique(doc * n_codes + codes) // n_codes, minlength=n)
    out["n_repeat_words"] = np.bincount(doc[_repeated(codes, n_codes, doc, n)], minlength=n)

    lines = pc.split_pattern(texts, "\n")
    doc = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = lines.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    lines, doc = lines.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    codes, n_codes = _codes(lines)
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(np.unique(doc * n_codes + codes) // n_codes, minlength=n)
    return out


def counts(texts: pa.Array) -> pa.StructArray:
    """The counts of a batch of texts, slice by slice."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, at = [], 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        parts.append(slice_counts(texts.slice(at, upto - at)))
        at = upto
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))


def text_counts(text: Column) -> Column:
    """A struct of ``COUNTS``, all long, of a text column."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield counts(part)

    return counted.asNondeterministic()(text)
