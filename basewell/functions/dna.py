"""Columns over DNA words: A C G T, two bits a base, the first base most significant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layout of a packed value: sequence number above, position below; a stored cell keeps 60 bits.
VALUE_BITS, POSITION_BITS, CELL_BITS = 28, 34, 60
_VALUE_MASK, _POSITION_MASK, _CELL_MASK = (1 << VALUE_BITS) - 1, (1 << POSITION_BITS) - 1, (1 << CELL_BITS) - 1


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(digits) -> Column:
    """The number of a word given as base-4 digits."""
    return F.conv(_col(digits), 4, 10).cast("long")


def encode(word) -> Column:
    """The number of a word of up to 31 bases."""
    return number(F.translate(_col(word), "ACGT", "0123"))


def decode(number, n: int) -> Column:
    """The word of n bases of a number."""
    return F.translate(F.lpad(F.conv(_col(number).cast("string"), 10, 4), n, "0"), "0123", "ACGT")


def revcomp(word) -> Column:
    return F.reverse(F.translate(_col(word), "ACGT", "TGCA"))


def middle(word, k: int, c: int) -> Column:
    """The c bases in the middle of k."""
    return F.substring(_col(word), (k - c) // 2 + 1, c)


def flanks(word, k: int, c: int) -> Column:
    """The k - c bases around the middle, left then right."""
    half = (k - c) // 2
    return F.concat(F.substring(_col(word), 1, half), F.substring(_col(word), half + c + 1, half))


def canonical(word) -> Column:
    """The lesser of a word and its reverse complement; the letters' order is the numbers' order."""
    return F.least(_col(word), revcomp(word))


def is_acgt(word) -> Column:
    return F.translate(_col(word), "ACGT", "") == ""


def closed_syncmer(core, c: int, s: int) -> Column:
    """Whether a least s-mer of the core stands first or last."""
    if s == 0 or s == c:
        return F.lit(True)
    smers = [F.substring(_col(core), i + 1, s) for i in range(c - s + 1)]
    return F.least(*smers).isin(smers[0], smers[-1]) if len(smers) > 1 else F.lit(True)


def closed_syncmer_number(key, c: int, s: int) -> Column:
    """The same of a numbered core: s-mers are bit fields."""
    if s == 0 or s == c:
        return F.lit(True)
    smers = [F.shiftright(_col(key), 2 * (c - s - i)).bitwiseAND(F.lit(4**s - 1)) for i in range(c - s + 1)]
    least = F.least(*smers)
    return (least == smers[0]) | (least == smers[-1])


def hamming(a, b) -> Column:
    """Differing bases of two encoded words of up to 16 bases."""
    x = _col(a).bitwiseXOR(_col(b))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x55555555))).cast("int")


def pack(value, position, cell_mask: bool = False) -> Column:
    out = F.shiftleft(_col(value).cast("long").bitwiseAND(F.lit(_VALUE_MASK)), POSITION_BITS).bitwiseOR(_col(position).cast("long").bitwiseAND(F.lit(_POSITION_MASK)))
    return out.bitwiseAND(F.lit(_CELL_MASK)) if cell_mask else out


def unpack(packed) -> Column:
    """struct(ref_id, pos)."""
    p = _col(packed)
    return F.struct(F.shiftrightunsigned(p, POSITION_BITS).bitwiseAND(F.lit(_VALUE_MASK)).alias("ref_id"), p.bitwiseAND(F.lit(_POSITION_MASK)).alias("pos"))


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**64, in 16-bit digits: a product of longs that overflows is an error in Spark."""
    digit = lambda v, i: F.shiftrightunsigned(v, 16 * i).bitwiseAND(F.lit(0xFFFF))
    low = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))
    own = [factor >> 16 * i & 0xFFFF for i in range(4)]
    # sums of the products that start at digit i; only 64 bits are kept
    at = [sum((digit(x, j) * own[i - j] for j in range(1, i + 1)), digit(x, 0) * own[i]) for i in range(4)]
    bottom = at[0] + F.shiftleft(low(at[1]), 16)
    top = F.shiftrightunsigned(at[1], 32) * 0x10000 + F.shiftrightunsigned(bottom, 32) + at[2] + F.shiftleft(low(at[3]), 16)
    return F.shiftleft(top, 32).bitwiseOR(low(bottom))


def finalised(key) -> Column:
    """The 64-bit finaliser of MurmurHash3 of a key, by which a hash layout finds its slot. The shifts and both factors."""
    x = _col(key).cast("long")
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = _times(x.bitwiseXOR(F.shiftrightunsigned(x, 33)), factor)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def range_cells(n, header_threshold: int) -> Column:
    """Cells that a range of n values takes, with two flanks to a cell if they are kept."""
    n = _col(n)
    return n + F.when(n > header_threshold, F.floor((n + 1) / 2)).otherwise(0)


def header_cells(cells, header_threshold: int) -> Column:
    """How many of a range's cells hold flanks."""
    z = _col(cells)
    return F.when(z > header_threshold, F.floor((z + 2) / 3)).otherwise(F.lit(0)).cast("long")
