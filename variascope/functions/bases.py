"""Column helpers for bases, counts and codons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base order of the eight count fields (forward then reverse strand).
BASES = "ATCG"

# The standard genetic code, codons in TCAG order of the first, second and third base.
CODE_BASES = "TCAG"
CODE_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

CODON_TO_AA = {
    a + b + c: CODE_AMINO[16 * i + 4 * j + k]
    for i, a in enumerate(CODE_BASES)
    for j, b in enumerate(CODE_BASES)
    for k, c in enumerate(CODE_BASES)
}


def nt(index: Column) -> Column:
    """Base letter of a call 0..3, ``?`` for a missing call."""
    return F.coalesce(F.substring(F.lit(BASES), index.cast("int") + 1, F.lit(1)), F.lit("?"))


def nt_index(letter: Column) -> Column:
    """Call 0..3 of a base letter, NULL for anything else."""
    at = F.instr(F.lit(BASES), letter) if isinstance(letter, str) else F.call_function("instr", F.lit(BASES), letter)
    return F.when((at > 0) & (F.length(letter) == 1), (at - 1).cast("int"))


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATCGatcg", "TAGCtagc"))


def complement(letter: Column) -> Column:
    return F.translate(letter, "ATCG", "TAGC")


def amino(codon: Column) -> Column:
    """Amino acid letter of a codon without a map lookup: index arithmetic into the code string."""
    code = F.lit(CODE_BASES)
    slots = [F.call_function("instr", code, F.substring(codon, F.lit(i), F.lit(1))) for i in (1, 2, 3)]
    at = (slots[0] - 1) * 16 + (slots[1] - 1) * 4 + slots[2]
    known = (F.length(codon) == 3) & (slots[0] > 0) & (slots[1] > 0) & (slots[2] > 0)
    return F.when(known, F.substring(F.lit(CODE_AMINO), at, F.lit(1)))


def triplets(seq: Column) -> Column:
    """Whole codons in order. One linear pass: repeated ``substring`` would rescan the string for every codon."""
    return F.regexp_extract_all(seq, F.lit("(?s)(.{3})"), F.lit(1))


def translate(seq: Column) -> Column:
    """Protein of the whole codons of ``seq``; unknown codons become X."""
    return F.array_join(F.transform(triplets(seq), lambda c: F.coalesce(amino(c), F.lit("X"))), "")


def ranked_counts(counts: Sequence[Column]) -> Column:
    """Array of (n, idx) structs, largest first, ties broken towards the higher index."""
    return F.sort_array(
        F.array(*[F.struct(c.cast("long").alias("n"), F.lit(i).alias("idx")) for i, c in enumerate(counts)]),
        asc=False,
    )


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)
