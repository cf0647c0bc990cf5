"""Words of UTF-8 texts as numpy arrays: positions, 64-bit hashes, n-gram hashes.

A word is a run of bytes other than space and 0x09-0x0D. Texts are handled in
groups of about ``GROUP`` bytes, so the arrays of a task stay small whatever
the number of texts; a longer text is a group of its own, hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
GROUP = 1 << 20

_rng = np.random.default_rng(20260729)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least; ``base`` is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, base, U64)]))
            inverse = pow(base, -1, 1 << 64)
            down = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, inverse, U64)]))
        have = _powers[base] = (up, down)
        if size > 4 * GROUP:
            del _powers[base]
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(32))


def prefix_hash(values: np.ndarray, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of ``values`` and the factors that align a range."""
    up, down = powers(len(values), base)
    sums = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up, out=sums[1:])
    return sums, down


def range_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each non-empty range [start, stop) of the values behind ``sums``."""
    with np.errstate(over="ignore"):
        return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U64) * U64(0x632BE59BD9B4E019))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; spans are sorted and don't overlap."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, origin + GROUP, "right")))
        sums, down = prefix_hash(_BYTE[data[origin : ends[upto - 1]]])
        out[at:upto] = range_hash(sums, down, starts[at:upto] - origin, ends[at:upto] - origin)
        at = upto
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(~_SPACE[data])


def text_bytes(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def grouped(texts: Iterable) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as bytes) for groups of about ``GROUP`` bytes."""
    group: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        raw = text_bytes(text)
        if group and size + len(raw) > GROUP:
            yield first, group
            first, group, size = i, [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield first, group


def joined(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line break after each text, and the texts' offsets in it (one more than texts)."""
    data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    offsets = np.zeros(len(group) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in group], out=offsets[1:])
    return data, offsets


def group_words(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a group, and the index of each text's first word (one more than texts)."""
    data, offsets = joined(group)
    starts, ends = word_spans(data)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


_KIND = np.full(256, 2, np.uint8)
_KIND[_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


class Tokens:
    """Tokens of a group of texts: runs of word bytes (letters, digits, _, non-ASCII) and runs of other marks.

    ``hashes`` ignore the case of ASCII letters; ``marks`` tells the runs of marks;
    ``shape`` is 0 lower case, 1 capitalised, 2 all capitals, 3 mixed, 4 a number,
    5 marks; ``prefixes`` are hashes of the first ``prefix`` bytes; ``first`` is the
    index of each text's first token (one more than texts).
    """

    def __init__(self, group: list[bytes], shapes: bool = False, prefix: int = 0):
        data, offsets = joined(group)
        kind = _KIND[data]
        cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts = np.append(0, cuts)
        ends = np.append(cuts, len(data))
        kept = kind[starts] > 0
        starts, ends = starts[kept], ends[kept]
        self.marks = kind[starts] == 2
        lower = _LOWER[data]
        self.hashes = span_hashes(lower, starts, ends)
        if prefix:
            self.prefixes = span_hashes(lower, starts, np.minimum(ends, starts + prefix))
        self.first = np.searchsorted(starts, offsets)
        if shapes:
            upper = np.zeros(len(data) + 1, np.int32)
            np.cumsum(_UPPER[data], out=upper[1:])
            n_upper = upper[ends] - upper[starts]
            size = ends - starts
            shape = np.where(n_upper == 0, 0, np.where((n_upper == size) & (size > 1), 2, 3))
            shape[(n_upper == 1) & _UPPER[data[starts]]] = 1
            shape[(data[starts] >= 48) & (data[starts] < 58)] = 4
            shape[self.marks] = 5
            self.shape = shape


def text_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.zeros(len(first) - 1)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        total[full] = np.add.reduceat(values, first[full])
    return total
