"""Byte-level BPE by replaying the merges over all distinct words at once.

The distinct words of a task's texts form one sequence of symbols. An inverted
index holds, for each merge, the places of the pairs it applies to. Merges are
taken in rank order; each is applied at all its places at once, in arrays, and only
the pairs with the two neighbours are looked up again and entered in the index. Where
a merge makes a pair of lower rank, that pair comes first: the word merges its first
place alone, and the others wait. Words that were met before in the task keep their
result (a bounded table that is emptied when full; that changes no result).

Null and empty texts have no tokens and decode to no bytes. Any text decodes to
its own UTF-8 bytes. Long texts are split like short ones.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.text import text_bytes

#: Words whose results a task keeps.
KEEP = 300_000
#: Characters of texts whose new words are replayed together.
GROUP = 1 << 23
_SHIFT = 20
_loaded: dict[tuple[str, str], "ByteCoder"] = {}


class MergeReplay:
    """Merges of a rank table: token bytes -> rank, which is the token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.none = max(ranks.values()) + 1
        # Pairs of ids in order, and the id of the merged token, for every way to cut a token in two.
        merge: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    merge[left << _SHIFT | right] = rank
        self.pairs = np.array(sorted(merge), np.int64)
        self.merged = np.array([merge[k] for k in self.pairs.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token of each pair, ``none`` without one."""
        if not len(self.pairs):
            return np.full(len(left), self.none)
        key = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], self.none)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        ids, ends = self.replay(words)
        flat, out, at = ids.tolist(), [], 0
        for end in ends.tolist():
            out.append(flat[at:end])
            at = end
        return out

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, and where each word's ids end."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        symbol = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        # The merge that the pair at each place allows.
        pair = np.full(n, self.none)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self._rank(symbol[inner], symbol[inner + 1])

        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Enter places in the index by the merge of their pair."""
            ranks = pair[places]
            places, ranks = places[ranks < self.none], ranks[ranks < self.none]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            for rank, start, stop in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(ranks)]):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(waiting, rank)
                index[rank].append(places[start:stop])

        enter(inner)
        while waiting:
            rank = heapq.heappop(waiting)
            held = index.pop(rank)
            places = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            # A neighbour's merge may have taken the pair away.
            places = places[pair[places] == rank]
            if not len(places):
                continue
            chosen = _apart(places, after)
            follower, left = after[chosen], before[chosen]
            end = after[follower]
            # What a merge from left to right would meet: the place before is merged already, the one behind not yet.
            beside = np.where(left == np.concatenate([[-2], follower[:-1]]), rank, symbol[left])
            lower = (left >= 0) & (self._rank(beside, np.full(len(left), rank)) < rank)
            lower |= (end >= 0) & (self._rank(np.full(len(end), rank), symbol[end]) < rank)
            if lower.any():
                # There the new pair comes first: such a word merges its first place, its others wait.
                owner = word[chosen]
                held_back = np.isin(owner, owner[lower])
                now = ~held_back | (np.diff(owner, prepend=-1) != 0)
                later = places[np.isin(word[places], owner[lower])]
                chosen, follower, end = chosen[now], follower[now], end[now]
            symbol[chosen], symbol[follower] = rank, -1
            after[chosen], pair[follower] = end, self.none
            there = end >= 0
            before[end[there]] = chosen[there]
            pair[chosen] = self.none
            pair[chosen[there]] = self._rank(symbol[chosen[there]], symbol[end[there]])
            left = before[chosen]
            left = left[left >= 0]
            pair[left] = self._rank(symbol[left], symbol[after[left]])
            enter(np.concatenate([chosen, left]))
            if lower.any():
                enter(later[pair[later] == rank])
        kept = symbol >= 0
        return symbol[kept], np.cumsum(np.bincount(word[kept], minlength=len(words)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap in a row, the first, third and so on."""
    joined = np.concatenate([[False], after[places[:-1]] == places[1:]])
    if not joined.any():
        return places
    at = np.arange(len(places))
    first = np.maximum.accumulate(np.where(joined, 0, at))
    return places[(at - first) % 2 == 0]


class ByteCoder:
    """Splits texts by a pattern, encodes the words by merge replay and decodes them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.replay = MergeReplay(ranks)
        self.pattern = regex.compile(pattern)
        self.clear()

    def clear(self) -> None:
        #: Word -> its number; by number: how many ids, ids in decimal joined by one space, decoded bytes.
        self.number: dict[str, int] = {}
        self.n_ids: list[int] = []
        self.ids: list[str] = []
        self.decoded: list[bytes] = []

    def _learn(self) -> None:
        """Encode and decode the words that have a number but no ids yet, all of them in one replay."""
        new = list(islice(self.number, len(self.ids), None))
        text: dict[int, str] = {}
        for ids in self.replay.encode([text_bytes(w) for w in new]):
            self.n_ids.append(len(ids))
            self.ids.append(" ".join([text.get(i) or text.setdefault(i, str(i)) for i in ids]))
            self.decoded.append(self.replay.decode(ids))

    def rows(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, ids in decimal joined by one space, decoded bytes) of each text."""
        group: list[np.ndarray] = []
        size = 0
        for i, text in enumerate(texts):
            number = self.number
            group.append(np.array([number.setdefault(w, len(number)) for w in self.pattern.findall(text)], np.int32))
            size += len(text)
            if size > GROUP or i + 1 == len(texts):
                self._learn()
                counts = np.array(self.n_ids, np.int64)
                for places in group:
                    at = places.tolist()
                    yield (int(counts[places].sum()), " ".join(map(self.ids.__getitem__, at)),
                           b"".join(map(self.decoded.__getitem__, at)))
                group, size = [], 0
                if len(self.number) > KEEP:
                    self.clear()


def coder(path: str, pattern: str) -> ByteCoder:
    """The coder of a rank file, loaded once per process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteCoder(path, pattern)
    return _loaded[path, pattern]


def recoded(text: Column, path: str, pattern: str) -> Column:
    """Struct (n_tokens, ids, decoded) of a text column; ``path`` names the rank file on every machine."""

    @F.pandas_udf("n_tokens long, ids string, decoded binary")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = coder(path, pattern).rows([x or "" for x in part])
            yield pd.DataFrame(rows, columns=["n_tokens", "ids", "decoded"])

    return found.asNondeterministic()(text)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with n_tokens, ids (decimal, joined by one space) and decoded; columns of these names are replaced."""
    return (
        docs.withColumn("_found", recoded(F.col("text"), path, pattern))
        .withColumns({c: F.col(f"_found.{c}") for c in ("n_tokens", "ids", "decoded")})
        .drop("_found")
    )
