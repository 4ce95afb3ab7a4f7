"""Column builders for sequences over A, C, G, T (and IUPAC codes). Positions are counted from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: IUPAC codes and their complements. W and S are their own; ``compat`` swaps them, as older programs do.
IUPAC = "ACGTRYKMSWBDHVN"
COMPLEMENT = {"correct": "TGCAYRMKSWVHDBN", "compat": "TGCAYRMKWSVHDBN"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq, iupac: str = "correct") -> Column:
    return F.reverse(F.translate(_col(seq), IUPAC, COMPLEMENT[iupac]))


def windows(seq, k: int, compat: bool = False) -> Column:
    """All k-mers in order; ``compat`` omits the last one."""
    seq = _col(seq)
    last = F.length(seq) - k - (1 if compat else 0)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(seq, i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def code(kmer) -> Column:
    """The number of a k-mer to base 4, first base most significant; -1 with any other letter."""
    kmer = _col(kmer)
    return F.when(kmer.rlike("^[ACGT]+$"), F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("long")).otherwise(F.lit(-1).cast("long"))


def from_code(number, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(number).cast("string"), 10, 4), k, "0"), "0123", BASES)


def canonical(kmer) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(_col(kmer), reverse_complement(kmer))


def expansions(pattern) -> Column:
    """All strings that a pattern with N stands for."""
    n = F.length(_col(pattern)) - F.length(F.replace(_col(pattern), F.lit("N")))
    parts = F.split(_col(pattern), "N")
    fill = lambda i: F.translate(F.lpad(F.conv(i.cast("string"), 10, 4), n, F.lit("0")), "0123", BASES)

    def one(i):
        letters = F.when(n > 0, F.split(fill(i), "")).otherwise(F.array().cast("array<string>"))
        return F.aggregate(F.zip_with(parts, letters, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), F.lit(""), lambda acc, x: F.concat(acc, x))

    return F.transform(F.sequence(F.lit(0), F.pow(F.lit(4), n).cast("int") - 1), one)


def neighbours(kmer, distance: int = 1) -> Column:
    """The k-mer, its reverse complement and all strings within so many substitutions of either."""
    found = F.array(_col(kmer), reverse_complement(kmer))
    for _ in range(distance):
        found = F.array_distinct(
            F.concat(found, F.flatten(F.transform(found, lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.transform(F.array(*map(F.lit, BASES)), lambda b: F.concat(F.substring(s, F.lit(1), i - 1), b, F.substring(s, i + 1, F.length(s)))))))))
        )
    return found


def mismatches(a, b) -> Column:
    """Places where two strings differ on their common length; N matches anything."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    differ = lambda i: F.when((F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) | (F.substring(a, i, F.lit(1)) == "N") | (F.substring(b, i, F.lit(1)) == "N"), 0).otherwise(1)
    return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(1), n), differ), F.lit(0), lambda s, x: s + x)).otherwise(0)


def mismatches_to(kmer, pattern: str) -> Column:
    """Places where a k-mer differs from a fixed pattern, N matching anything: one compiled sum, without arrays."""
    terms = [F.when(F.substring(_col(kmer), i + 1, 1) == c, 0).otherwise(1) for i, c in enumerate(pattern) if c != "N"]
    return sum(terms[1:], terms[0]) if terms else F.lit(0)


def hamming(a, b) -> Column:
    """Places where two strings differ on their common length."""
    return F.aggregate(F.zip_with(F.split(_col(a), ""), F.split(_col(b), ""), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def site(seq, position, size: int) -> Column:
    """``size`` letters from a position that may lie outside, padded with N; empty if it starts behind the end."""
    seq, position = _col(seq), _col(position)
    left = F.greatest(F.lit(0), -position)
    body = F.substring(seq, F.greatest(position, F.lit(0)) + 1, F.greatest(F.lit(size) - left, F.lit(0)))
    return F.when(position > F.length(seq), F.lit("")).otherwise(F.rpad(F.concat(F.repeat(F.lit("N"), F.least(left, F.lit(size)).cast("int")), body), size, "N"))


def cleaned_site(s) -> Column:
    """With an N in the first half, the first half becomes N; else, with an N in the second half, that does."""
    s = _col(s)
    half = F.floor(F.length(s) / 2).cast("int")
    head, tail = F.substring(s, F.lit(1), half), F.substring(s, half + 1, F.length(s))
    n = lambda c: F.repeat(F.lit("N"), F.length(c))
    return F.when(head.contains("N"), F.concat(n(head), tail)).when(tail.contains("N"), F.concat(head, n(tail))).otherwise(s)


def overwritten(seq, start, size, letter: str) -> Column:
    """The letters from a position overwritten by one letter."""
    seq = _col(seq)
    return F.concat(F.substring(seq, F.lit(1), start), F.repeat(F.lit(letter), size), F.substring(seq, start + size + 1, F.length(seq)))


def masked(seq, sites, letter: str = "N") -> Column:
    """All occurrences of the literal sites overwritten, site by site."""
    return F.aggregate(_col(sites), _col(seq), lambda s, x: F.replace(s, x, F.repeat(F.lit(letter), F.length(x))))
