"""Nucleotide sequences as Column expressions: packing, distance, variants, slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: Longest sequence that a non-negative long can hold at two bits a base.
MAX_PACKED = 31
PHRED_OFFSET, MIN_QUALITY = 33, 10


def encode(seq: Column) -> Column:
    """A sequence of up to 31 bases as a long: A=0, C=1, G=2, T=3, the first base lowest. Any other letter counts as A."""
    clean = F.regexp_replace(seq, f"[^{BASES}]", "A")
    return F.conv(F.translate(F.reverse(clean), BASES, "0123"), 4, 10).cast("long")


def decode(packed: Column, length: Column | int) -> Column:
    """The sequence of `length` bases behind a packed long."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.translate(F.reverse(F.lpad(F.conv(packed.cast("string"), 10, 4), n, F.lit("0"))), "0123", BASES)


def packed_hamming(a: Column, b: Column) -> Column:
    """Bases in which two packed sequences of one length differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))


def hamming(a: Column, b: Column) -> Column:
    """Places in which two strings of one length differ; null for different lengths."""
    places = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(places, F.lit(0), lambda s, d: s + d))


def variants(seq: Column, length: int, letters: str = BASES) -> Column:
    """The sequence and every sequence with one base changed."""
    changed = lambda i: F.transform(
        F.filter(F.array(*map(F.lit, letters)), lambda c: c != seq.substr(i, F.lit(1))), lambda c: F.concat(seq.substr(F.lit(1), i - 1), c, seq.substr(i + 1, F.lit(length)))
    )
    return F.concat(F.array(seq), F.flatten(F.transform(F.sequence(F.lit(1), F.lit(length)), changed)))


def piece(seq: Column, start: Column | int, length: int) -> Column:
    """`length` letters from a 0-based start; null where the sequence does not reach that far."""
    at = F.lit(start) if isinstance(start, int) else start
    inside = (at >= 0) & (F.length(seq) >= at + length)
    return F.when(inside, seq.substr(at.cast("int") + 1, F.lit(length)))


def quality_passes(quality: Column, start: int, length: int) -> Column:
    """All letters of a stretch have Phred quality 10 at least. A missing or short quality string passes; letters below '!' fail."""
    low = "".join(chr(c) for c in range(1, PHRED_OFFSET + MIN_QUALITY))
    part = F.substring(quality, start + 1, length)
    return F.coalesce((F.length(quality) < start + length) | (F.length(F.translate(part, low, "")) == F.length(part)), F.lit(True))
