"""SimHash near-dedup by segment popcounts.

A fingerprint has a bit set where more than half of the text's shingle hashes
have it set. Fingerprints that differ in few bits are found by an embedding:
cut into ``SEGMENTS`` segments, a fingerprint becomes the vector of their bit
counts, and the Manhattan distance of two such vectors is at most the number of
differing bits. So all links lie among vectors at distance 2 or less, a range
join on the integer grid. Two vectors at distance 2 have a grid point at distance
1 from both: each fingerprint is entered at its own point and at its
neighbours, and an equi-join on the point finds every candidate, which is then
verified on all 64 bits. Which pair of entries may meet is fixed (see ``_meets``),
so each pair is compared at one point only.

Only distinct fingerprints are joined; a group of exact copies is one of them.
At most 2,080 other fingerprints lie within two bits of one, so links are linear
in the number of fingerprints whatever the data. Hot points are left to the
join's skew handling.

A null or empty text, or one without a word, has the fingerprint 0, linked like any
other. A text of fewer words than a shingle has one shingle, the whole sequence.
Texts of any length are hashed in slices. Repeated rows get equal results. A row
whose id is null belongs to its fingerprint's component, whose id is null if no
row has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.components import components, join_spread
from panelwright.llm.text import text_bytes
from panelwright.session import materialize

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 16
SEED = 42
_SLICE = 1 << 16


def fingerprint(text, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text; ASCII letters count in lower case."""
    words = text_bytes(text).lower().split()
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    total = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _SLICE):
        part = words[at : at + _SLICE + shingle - 1]
        rows = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [words]
        h = np.fromiter(map(hashed, map(b" ".join, rows)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([fingerprint(x, shingle) for x in part], dtype="int64")

    return hashed.asNondeterministic()(text)


def _bit_counts(fp: str, segments: int) -> Column:
    """Bit counts of all segments at once, each in the segment's own bits."""
    width = 64 // segments
    lowest = F.lit(sum(1 << at for at in range(0, 64, width))).cast("long")
    bits = [F.shiftrightunsigned(F.col(fp), k).bitwiseAND(lowest) for k in range(width)]
    return sum(bits[1:], bits[0])


def _entries(prints: DataFrame, segments: int) -> DataFrame:
    """(fp, id, point, role): a fingerprint's own point (role 0), the point one below it in
    segment i (role i + 1) and the point one above (role -i - 1)."""
    width = 64 // segments
    return (
        prints.select("fp", "id", _bit_counts("fp", segments).alias("own"),
                      F.explode(F.sequence(F.lit(-segments), F.lit(segments))).alias("role"))
        .withColumn("at", F.expr(f"{width} * (abs(role) - 1)"))
        .withColumn("n", F.expr(f"shiftrightunsigned(own, at) & {(1 << width) - 1}L"))
        .filter(f"role = 0 or (role > 0 and n > 0) or (role < 0 and n < {width})")
        .withColumn("point", F.expr("CASE WHEN role = 0 THEN own WHEN role > 0 THEN own - shiftleft(1L, at) "
                                    "ELSE own + shiftleft(1L, at) END"))
        .select("fp", "id", "point", "role"))


def _meets(a: Column, b: Column) -> Column:
    """Roles that compare a pair: equal points; one step apart; one up and one down; two steps
    up, at the midpoint of the lower segment first."""
    down = (a > 0) & (b > 0) & (a != b)
    up = ((a > 0) & (b < 0) & (-b <= a)) | ((a < 0) & (b > 0) & (-a <= b))
    return ((a == 0) & (b >= 0)) | ((a > 0) & (b == 0)) | down | up


def links(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): ids of rows of ``prints`` (fp, id; fp distinct) at ``max_bits`` differing bits or fewer."""
    if not 0 <= max_bits <= 2:
        raise ValueError("points of the grid are searched up to a distance of 2")
    if segments not in (8, 16):
        raise ValueError("a segment has 8 or 4 bits, so that its count fits beside the others")
    entries = _entries(prints, segments)
    # By its size check Spark would broadcast the entries, as it takes them for as many as the fingerprints.
    x, y = entries.alias("x"), entries.hint("merge").alias("y")
    return x.join(
        y,
        (F.col("x.point") == F.col("y.point"))
        & (F.col("x.fp") < F.col("y.fp"))
        & _meets(F.col("x.role"), F.col("y.role"))
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits),
    ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                segments: int = SEGMENTS, unnamed: bool = False) -> DataFrame:
    """(doc_id, body, fp, component_id) for each row of ``docs`` (doc_id, text); other columns aren't read.

    ``body`` is the hash of the text, which tells rows with equal ids apart. With ``unnamed`` the fingerprints of
    rows without an id are linked like any other, and ``component_id`` is the smallest fingerprint of the component.
    """
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"),
                    fingerprints(F.col("text"), shingle).alias("fp")),
        "fingerprints")
    counted = rows.groupBy("fp").agg(F.min("fp" if unnamed else "doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    prints = counted.select("fp", "id")
    found = components(links(prints.filter("id is not null"), max_bits, segments))
    classes = materialize(
        counted.join(found.hint("merge"), "id", "left")
        .select("fp", F.coalesce("component", "id").alias("component_id"), "n"), "classes")
    joined = join_spread(rows, classes, "fp", "n", rows.count())
    return joined.select("doc_id", "body", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their group; all columns stay.

    A row that repeats a kept one in id and text stays, as it is the same document.
    """
    kept = near_copies(docs, shingle, max_bits).filter("component_id is null or doc_id = component_id")
    kept = kept.select(F.col("doc_id").alias("_near_id"), F.col("body").alias("_near_body")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_near_id")) & (F.xxhash64(docs["text"]) == F.col("_near_body"))
    return docs.join(kept.hint("merge"), same, "left_semi")
