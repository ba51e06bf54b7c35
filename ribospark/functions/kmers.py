"""k-mer expressions: base-4 coding of DNA, substrings and their indices, as Column -> Column functions.

All are linear in the sequence: characters become an array once, and windows index it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, DIGITS = "ACGT", "0123"


def base4(sequence: Column, fold_case: bool = True) -> Column:
    """Digits for bases, ``N`` for anything else. ``fold_case=False`` takes upper-case bases only."""
    sequence = F.upper(sequence) if fold_case else sequence
    return F.translate(F.regexp_replace(sequence, "[^ACGT]", "N"), BASES, DIGITS)


def base4_list(sequences: Column, fold_case: bool = True) -> Column:
    return F.transform(sequences, lambda s: base4(s, fold_case))


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, computed once: a lambda evaluates what it refers to again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _letters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _starts(letters: Column, k: int) -> Column:
    n = F.size(letters) - k
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def all_kmers(sequence: Column, k: int = 8) -> Column:
    """Every substring of length ``k`` in order, repeats kept; none in a shorter sequence."""
    return let(_letters(sequence), lambda letters: F.transform(_starts(letters, k), lambda i: F.array_join(F.slice(letters, i + 1, k), "")))


def base4_to_index(kmers: Column) -> Column:
    """Index of each base-4 word, those with ``N`` dropped; order and repeats kept."""
    return F.transform(F.filter(kmers, lambda x: ~F.contains(x, F.lit("N"))), lambda x: F.conv(x, 4, 10).cast("int"))


def kmer_indices(digits: Column, k: int = 8) -> Column:
    """Index of each window of ``k`` digits, in order, repeats kept, windows with ``N`` dropped."""
    if not 1 <= k <= 15:
        raise ValueError("k must be from 1 to 15: indices are 32-bit")
    codes = F.transform(_letters(digits), lambda c: F.when(c != "N", c.cast("int")))

    def indices(codes: Column) -> Column:
        value = lambda i: sum((F.get(codes, i + j) * (4 ** (k - 1 - j)) for j in range(1, k)), F.get(codes, i) * (4 ** (k - 1)))
        return F.filter(F.transform(_starts(codes, k), value), lambda x: x.isNotNull())

    return let(codes, indices)


def kmer_set(digits: Column, k: int = 8) -> Column:
    """Sorted distinct indices."""
    return F.array_sort(F.array_distinct(kmer_indices(digits, k)))


def pad_kmers(kmers: Column, length: int = 1400) -> Column:
    """Right-padded with -1 to ``length``; longer input raises."""
    fits = F.size(kmers) <= length
    return F.when(fits, F.concat(kmers, F.array_repeat(F.lit(-1), F.lit(length) - F.size(kmers)))).otherwise(F.raise_error(F.lit("more k-mers than the padded length")))


def index_to_base4(index: Column, k: int = 8) -> Column:
    """The low ``k`` base-4 digits of an index, zero-filled."""
    return F.right(F.concat(F.lit("0" * k), F.conv(index.cast("string"), 10, 4)), F.lit(k))


def base4_to_nucleotide(digits: Column) -> Column:
    return F.translate(digits, DIGITS, BASES)


def base4_to_nucleotide_list(digits: Column) -> Column:
    return F.transform(digits, base4_to_nucleotide)
