"""BM25 and its quantised document lengths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75
#: A term in more than this share of the documents is left out of queries ...
CEILING = 0.5
#: ... of collections that have at least so many.
CEILING_DOCS = 1000
STEPS_PER_OCTAVE = 16


def idf(df: Column, n: Column) -> Column:
    """Inverse document frequency, never negative."""
    return F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25(tf: Column, length: Column, average: Column, weight: Column) -> Column:
    """Score of a term that occurs tf times in a document, weight being its idf."""
    return weight * (tf * F.lit(K1 + 1.0)) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * length / average))


def block_bound(max_tf: Column, min_length: Column, average: Column, weight: Column) -> Column:
    """A bound of the scores in a block of postings."""
    return bm25(max_tf, F.greatest(min_length, F.lit(1)), average, weight)


def encode_length(length: Column) -> Column:
    """One byte for a document length."""
    return F.least(F.lit(255), F.floor(F.log2(length + F.lit(1.0)) * STEPS_PER_OCTAVE)).cast("int")


def decode_length(norm: Column) -> Column:
    """The length that a byte stands for, at least 1 unless the byte is 0."""
    return F.when(norm == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.round(F.pow(F.lit(2.0), norm / F.lit(float(STEPS_PER_OCTAVE))) - 1.0).cast("int")))


def vbyte_size(value: Column) -> Column:
    """Bytes of a number written with seven bits a byte."""
    return F.when(value < 128, 1).when(value < 16384, 2).when(value < 2097152, 3).when(value < 268435456, 4).otherwise(5)


def vbyte_hex(value: Column) -> Column:
    """A number below 2**35 as hexadecimal bytes of seven bits, the lowest first; the last one has its high bit set."""

    def whole(size: int) -> Column:
        """The bytes of a number of so many as one number."""
        out = F.lit(128).cast("bigint")
        for k in range(size):
            out = out + F.shiftleft(F.shiftright(value, 7 * k).bitwiseAND(F.lit(127)), 8 * (size - 1 - k))
        return F.lpad(F.hex(out), 2 * size, "0")

    value = value.cast("bigint")
    size = vbyte_size(value)
    out = F.when(size == 1, whole(1))
    for k in range(2, 5):
        out = out.when(size == k, whole(k))
    return out.otherwise(whole(5))


def vbyte(value: Column) -> Column:
    """A number below 2**35 as bytes."""
    return F.unhex(vbyte_hex(value))


def vbyte_numbers(data: Column) -> Column:
    """The numbers that bytes written one after the other stand for."""

    def number(digits: Column) -> Column:
        whole, size = F.conv(digits, 16, 10).cast("bigint"), F.length(digits) / 2
        seven = lambda k: F.shiftright(whole, 8 * k).bitwiseAND(F.lit(127))
        # the byte of the lowest bits comes first
        of = lambda n: sum((F.shiftleft(seven(n - 1 - k), 7 * k) for k in range(1, n)), seven(n - 1))
        return F.when(size == 1, of(1)).when(size == 2, of(2)).when(size == 3, of(3)).when(size == 4, of(4)).otherwise(of(5))

    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(?:[0-7][0-9A-F])*+[89A-F][0-9A-F]"), F.lit(0)), number)


def total(score: Column) -> Column:
    """Sum of scores that doesn't depend on their order, to six places."""
    return F.round(F.sum(score.cast("decimal(18,9)")).cast("double"), 6)


def over_ceiling(df: Column, n: Column) -> Column:
    """Whether a term is too common to take part in a query."""
    return (n >= CEILING_DOCS) & (df / n > F.lit(CEILING))
