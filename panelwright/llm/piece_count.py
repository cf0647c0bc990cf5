"""Token counts with a sentence-piece model; huge documents by overlap resynchronisation.

A text above ``chunk`` characters is encoded in overlapping chunks with
offsets, and the encodings are spliced where the result is proven equal to the
encoding of the whole. The proof: merges run in priority order, and whether a
merge ever crosses a place depends only on what happens in the two tokens beside
it. Let the text so far (from the document's start) and the next chunk both have
token borders at x < y inside their overlap. What lies between x and y then
merges alone, in the same way, in both. In the text so far nothing crossed x,
from the true left side; in the chunk nothing crossed y, towards the true
right side; so in the whole nothing crosses x or y, and the encodings can be
joined at x. If an overlap has no two common borders, it is widened by half and one
more character, so that its start also moves against a pattern in the text, up to the
whole text so far. Only borders inside the overlap are compared, so the work grows
with the length of the text; of the text so far a task keeps its borders, four bytes each.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
OVERLAP = 256
_loaded: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """A model with an exact encoder for texts of any length."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0

    def _encode(self, text: str, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[begin:stop], and the place in the text at which each token ends."""
        found = self.model.encode(text[begin:stop], return_type="offset_mapping")
        return np.array(found["ids"], np.int32), np.array([b + begin for _, b in found["offsets"]], np.int32)

    def _stretches(self, text: str, with_ids: bool) -> list[tuple[np.ndarray | None, np.ndarray]]:
        """(ids or None, ends) of consecutive stretches of the text, one for each chunk or less."""

        def stretch(ids, ends, at=0):
            return (ids[at:] if with_ids else None), ends[at:]

        done = min(self.chunk, len(text))
        parts = [stretch(*self._encode(text, 0, done))]
        while done < len(text):
            overlap = self.overlap
            while True:
                begin, stop = max(0, done - overlap), min(len(text), done + max(self.chunk, overlap))
                ids, ends = self._encode(text, begin, stop)
                if begin == 0:  # no border to splice at: all of it is encoded anew
                    parts = [stretch(ids, ends)]
                    break
                first = len(parts) - 1
                while first and parts[first][1][:1].sum() > begin:
                    first -= 1
                known = np.concatenate([e for _, e in parts[first:]])
                # The ends of both texts are no borders of the whole.
                known, found = (e[(e > begin) & (e < done)] for e in (known, ends))
                common = np.intersect1d(known, found)
                if len(common) >= 2:
                    at = common[-2]
                    while parts[-1][1][:1].sum() > at:
                        parts.pop()
                    left = np.searchsorted(parts[-1][1], at, "right")
                    parts[-1] = tuple(x if x is None else x[:left] for x in parts[-1])
                    parts.append(stretch(ids, ends, np.searchsorted(ends, at, "right")))
                    break
                overlap += overlap // 2 + 1
                self.widened += 1
            done = stop
        return parts

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of the whole text, from overlapping chunks."""
        return np.concatenate([ids for ids, _ in self._stretches(text, True)])

    def count_long(self, text: str) -> int:
        return sum(len(ends) for _, ends in self._stretches(text, False))

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        short: list[int] = []
        size = 0

        def flush():
            found = self.model.encode([texts[i] for i in short], return_type="numpy", num_threads=1)
            out[short] = [len(x) for x in found]

        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = self.count_long(text)
                continue
            short.append(i)
            size += len(text)
            if size > 1 << 20:
                flush()
                short, size = [], 0
        if short:
            flush()
        return out


def encoder(path: str) -> PieceEncoder:
    """The encoder of a model file, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a text column; ``path`` names the model file on every machine."""

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(encoder(path).count([x or "" for x in part]), dtype="int64")

    return counted.asNondeterministic()(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; columns of these names are replaced."""
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
        .withColumn("n_tokens", token_count(F.col("text"), path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
