"""Best-fit packing of tokenised documents into sequences, after Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so the instance is one count per
length, whatever the number of documents. On these counts the reduction
fixes sequences that dominate every other use of their longest piece:

- nothing else fits beside it: it stays alone;
- a piece fills the rest exactly: the two stay together;
- at most one more piece fits: the longest that does joins it;
- at most two more fit and no two of them are longer together than the longest
  single one: that one joins it.

What is left is packed best-fit decreasing, all pieces of a length at a time.
The outcome is a short list of placements (length, range of ranks, sequences,
offset): each length touches a sequence range at most once and opens two more, so
there are at most a few hundred thousand at 2048. The list is broadcast, and
each piece finds its place by its rank among the pieces of its length; ranks come
from per-task counters and one small sum over (task, length), so no length is
gathered anywhere.

Null and empty texts are documents of the separator alone. Repeated rows are
packed each. A document above the capacity is cut; its last piece may be shorter.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.text import text_bytes
from panelwright.session import materialize

CAPACITY = 2048
SEPARATOR = 0
#: Words whose ids a task keeps.
KEEP = 3 << 18
#: Marks that may separate words; the first that is one token does.
MARKS = "\u2b50\u2b07\u27a4\u27a1"
_loaded: dict[str, "WordCoder"] = {}
# A comma or full stop after an ASCII letter is a word of its own for the tokenizer.
_stop = re.compile(rb"(?<=[a-z])([,.])(?=[ \t\n\r\x0b\x0c]|\Z)")


class WordCoder:
    """Ids of whole texts from the ids of their words.

    The tokenizer drops white space and never merges across it, lowers case, and
    knows special strings only without white space, so a text's ids are its
    words' ids in turn. Each distinct word is encoded once per task; the table is
    emptied when full, which changes no result. ASCII letters are lowered before
    the words are looked up, but for texts that may hold a special string.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task uses one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A mark of one token, set between words that are encoded together.
        self.mark = next((m for m in MARKS if len(self._encode(m)) == 1), None)
        self.clear()

    def clear(self) -> None:
        #: Word -> its number; by number: where its ids start and how many there are.
        self.number: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in turn, and each word's number of ids.

        The words are encoded in one string with marks between them; one by one if a word has the mark's token.
        """
        if self.mark is not None:
            ids = self._encode(f" {self.mark} ".join([w.decode() for w in words]))
            marks = ids == self._encode(self.mark)[0]
            cuts = np.flatnonzero(marks)
            # As many as were set: then each is one of those.
            if len(cuts) == len(words) - 1:
                return ids[~marks], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return np.array([i for x in found for i in x.ids], "<u4"), np.array([len(x.ids) for x in found])

    def _learn(self) -> None:
        """Encode the words that have a number but no ids yet."""
        new = list(islice(self.number, len(self.sizes), None))
        parts = [self._encoded(new[at : at + (1 << 14)]) for at in range(0, len(new), 1 << 14)]
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])
        self.sizes = np.concatenate([self.sizes, *(n for _, n in parts)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def words(self, text) -> list[bytes]:
        raw = text_bytes(text)
        if b"<|" in raw:
            return raw.split()
        return _stop.sub(rb" \1", raw.lower()).split()

    def ids(self, texts: list) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        group: list[np.ndarray] = []
        size = 0
        for i, text in enumerate(texts):
            number = self.number
            group.append(np.array([number.setdefault(w, len(number)) for w in self.words(text)], np.int32))
            size += len(group[-1])
            if size > 1 << 19 or i + 1 == len(texts):
                self._learn()
                places = np.concatenate(group)
                sizes = self.sizes[places]
                upto = np.cumsum(sizes)
                total = int(upto[-1]) if len(upto) else 0
                raw = self.flat[np.repeat(self.starts[places] - (upto - sizes), sizes) + np.arange(total)].tobytes()
                ends = np.concatenate([[0], upto])[np.cumsum([len(x) for x in group])].tolist()
                at = 0
                for end in ends:
                    yield raw[4 * at : 4 * end]
                    at = end
                group, size = [], 0
                if len(self.number) > KEEP:
                    self.clear()


def coder(path: str) -> WordCoder:
    """The coder of a tokenizer file, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = WordCoder(path)
    return _loaded[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, separator: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a task's documents, with their rank among the task's pieces of the same length."""
    task = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    tail = np.array([separator], "<u4").tobytes()
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        rows: list[tuple] = []
        for doc, ids in zip(docs, coder(path).ids(batch.column("text").to_pylist())):
            ids += tail
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                n = len(part) // 4
                rows.append((doc, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                seen[n] += 1
        columns = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])


class Packing:
    """Placements of counted lengths; ``n_sequences`` is what they use."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.n_sequences, self.n_fixed = capacity, 0, 0
        self.left = {w: int(n) for w, n in counts.items() if n}
        self.placed = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self._reduce()
        self.n_fixed = self.n_sequences
        self._best_fit()

    def _place(self, w: int, first: int, bins: int, each: int, offset: int) -> None:
        """``each`` pieces of length w go to each of ``bins`` sequences."""
        self.rows.append((w, self.placed[w], first, each, offset))
        self.placed[w] += bins * each
        self.left[w] -= bins * each
        if not self.left[w]:
            del self.left[w]

    def _fix(self, w: int, k: int | None) -> None:
        """As many sequences {w, k} as there are pieces for; {w} if k is None."""
        first = self.n_sequences
        if k == w:
            n = self.left[w] // 2
            self._place(w, first, n, 2, 0)
        else:
            n = self.left[w] if k is None else min(self.left[w], self.left[k])
            self._place(w, first, n, 1, 0)
            if k is not None:
                self._place(k, first, n, 1, w)
        self.n_sequences += n

    def _others(self, w: int, ordered: list[int], n: int) -> list[int]:
        """The n shortest pieces besides one of length w."""
        out: list[int] = []
        for x in ordered:
            out += [x] * min(n - len(out), self.left[x] - (x == w))
            if len(out) >= n:
                break
        return out

    def _best_pair(self, w: int, room: int, ordered: list[int]) -> int:
        """The largest sum of two pieces besides w that fits in ``room``; 0 if none does."""
        best, low, high = 0, 0, len(ordered) - 1
        while low <= high:
            a, b = ordered[low], ordered[high]
            own = (a == w) + (b == w)
            if a == b and self.left[a] - (a == w) < 2 or own and self.left[w] - 1 < 1:
                if a == b:
                    break
                low, high = (low + 1, high) if a == w else (low, high - 1)
                continue
            if a + b > room:
                high -= 1
            else:
                best = max(best, a + b)
                low += 1
        return best

    def _dominating(self, w: int, ordered: list[int]) -> tuple[bool, int | None]:
        """Whether a sequence with w as longest piece dominates, and the piece that joins it."""
        room = self.capacity - w
        short = self._others(w, ordered, 3)
        if not short or short[0] > room:
            return True, None
        at = bisect.bisect_right(ordered, room) - 1
        if ordered[at] == w and self.left[w] < 2:
            at -= 1
        k = ordered[at]
        if k == room or len(short) < 2 or short[0] + short[1] > room:
            return True, k
        if (len(short) < 3 or sum(short) > room) and k >= self._best_pair(w, room, ordered):
            return True, k
        return False, None

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for w in sorted(self.left, reverse=True):
                while w in self.left:
                    sure, k = self._dominating(w, sorted(self.left))
                    if not sure:
                        break
                    self._fix(w, k)
                    changed = True

    def _best_fit(self) -> None:
        free: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def put(room: int, first: int, bins: int) -> None:
            if room and bins:
                if room not in free:
                    free[room] = []
                    bisect.insort(rooms, room)
                free[room].append((first, bins))

        for w in sorted(self.left, reverse=True):
            while w in self.left:
                n = self.left[w]
                at = bisect.bisect_left(rooms, w)
                if at == len(rooms):
                    each = min(n, self.capacity // w)
                    room, first, bins = self.capacity, self.n_sequences, n // each
                    self.n_sequences += bins
                    used = bins
                else:
                    room = rooms[at]
                    first, bins = free[room].pop()
                    if not free[room]:
                        del free[room], rooms[at]
                    each = min(n, room // w)
                    used = min(bins, n // each)
                self._place(w, first, used, each, self.capacity - room)
                put(room - each * w, first, used)
                if bins > used:
                    put(room, first + used, bins - used)

    def table(self) -> np.ndarray:
        """(length, first rank, first sequence, pieces in each, offset), by length and rank."""
        return np.array(sorted(self.rows), np.int64).reshape(-1, 5)


def _locate(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = table[:, 0] << 44 | table[:, 1]
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        row = table[np.searchsorted(key, length << 44 | rank, "right") - 1]
        nth = rank - row[:, 1]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            + [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Places of all pieces of ``docs`` (doc_id, text); further columns are not read.

    ``path`` names the tokenizer file on every machine. Returns doc_id, piece,
    start, length, ids_crc32, sequence_id and offset.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(
        rows.mapInArrow(
            lambda b: _pieces(b, path, capacity, separator),
            "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"),
        "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Packing(counts, capacity).table())
    return (
        pieces.join(bases, ["task", "length"])
        .withColumn("rank", F.col("base") + F.col("rank"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
        .mapInArrow(
            lambda b: _locate(b, shared.value),
            "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
