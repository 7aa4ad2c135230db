"""Columns and row generators over sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 256
#: Windows that one piece of a sequence yields: every window copies its piece once, so pieces are short.
PIECE = 256


def check_k(k: int, s: int | None = None) -> int:
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k must be from 1 to {LONGEST}")
    if s is not None and k > s:
        raise ValueError(f"k is {k}, but the index holds strings of up to {s} letters")
    return k


def upper(seq: Column) -> Column:
    """a, c, g, t in upper case; other letters stay, so places do not shift."""
    return F.translate(seq, "acgt", "ACGT")


def bases(text: Column) -> Column:
    """The letters A, C, G and T of a text, in upper case, without what stands between."""
    # the pattern goes over all letters at once; translate() would look up each, which takes twice as long
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]+", ""))


def revcomp(seq: Column) -> Column:
    """Reverse complement in upper case; other letters are only reversed."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCATGCA")


def acgt_runs(seq: Column) -> Column:
    """The maximal stretches of A, C, G, T, in upper case."""
    return F.regexp_extract_all(upper(seq), F.lit("[ACGT]+"), F.lit(0))


def _cut(df: DataFrame, seq: str, at: Column, place: str, size: Column) -> DataFrame:
    """A row for each of the places at (from 0), with the size letters of seq from there. The bytes of a sequence that
    is all ASCII are reached at once, however far in; whether it is, is told once for each sequence."""
    told = df.withColumn("__plain", F.octet_length(seq) == F.length(seq)).withColumn(place, F.explode(at))
    part = F.when(F.col("__plain"), F.substring(F.col(seq).cast("binary"), F.col(place) + 1, size).cast("string")).otherwise(F.substring(seq, F.col(place) + 1, size))
    return told.withColumn(seq, part).drop("__plain")


def pieces(df: DataFrame, seq: str, k: int, size: int = PIECE) -> DataFrame:
    """df with piece and offset, and seq cut to pieces that overlap by k - 1, so each has up to size windows of its own.

    Sequences shorter than k give no row.
    """
    n = F.length(seq)
    cut = _cut(df.where(n >= k), seq, F.sequence(F.lit(0), n - k, F.lit(size)), "offset", F.lit(size + k - 1))
    return cut.withColumn("piece", (F.col("offset") / size).cast("long"))


def windows(df: DataFrame, seq: str, k: int, out: str = "kmer", size: int = PIECE) -> DataFrame:
    """A row for each window of k letters, with pos (from 0) and piece in place of the sequence."""
    cut = pieces(df, seq, check_k(k), size)
    each = _cut(cut, seq, F.sequence(F.lit(0), F.length(seq) - k), "__at", F.lit(k))
    return each.withColumn(out, F.col(seq)).withColumn("pos", (F.col("offset") + F.col("__at")).cast("long")).drop(seq, "offset", "__at")


def both_strands(df: DataFrame, seq: str = "seq", forward_only: bool = False) -> DataFrame:
    """df with a second row for each sequence's other strand, from one scan."""
    return df if forward_only else df.withColumn(seq, F.explode(F.array(F.col(seq), revcomp(F.col(seq)))))


def runs_of(df: DataFrame, seq: str = "seq") -> DataFrame:
    """A row for each run of A, C, G, T in seq, in place of seq."""
    return df.withColumn(seq, F.explode(acgt_runs(F.col(seq))))
