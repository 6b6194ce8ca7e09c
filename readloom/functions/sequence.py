"""Column functions on sequences over A, C, G, T, N."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(seq: Column) -> Column:
    """Every letter but A, C, G, T as N; case-sensitive; cut at the first CR or LF."""
    return F.regexp_replace(F.regexp_replace(seq, "(?s)[\r\n].*", ""), "[^ACGT]", "N")


def alphabet_key(seq: Column) -> Column:
    """A text that sorts as A < C < G < T < N."""
    return F.translate(seq, "N", "Z")


def reverse_complement(seq: Column, strict: bool = True) -> Column:
    """Upper-case reverse complement; other letters than ACGT raise an error, or give null if not strict."""
    good = seq.rlike("^[ACGTacgt]*$")
    other = F.raise_error(F.concat(F.lit("not a sequence over ACGT: "), seq)) if strict else F.lit(None).cast("string")
    return F.when(seq.isNull(), F.lit(None).cast("string")).when(good, F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))).otherwise(other)


def mismatches(target: Column, read: Column) -> Column:
    """Positions, over the shorter length, where both have a letter of ACGT and they differ: N is wild on both sides."""
    letters = lambda s: F.split(F.regexp_replace(s, "[^ACGT]", "N"), "")
    n = F.least(F.length(target), F.length(read))
    t, r = letters(F.substring(target, F.lit(1), n)), letters(F.substring(read, F.lit(1), n))
    differ = F.zip_with(t, r, lambda a, b: F.when((a != b) & (a != "N") & (b != "N"), 1).otherwise(0))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(differ, F.lit(0).cast("long"), lambda s, x: s + x))


def majority(a: Column, c: Column, g: Column, t: Column, slop_div: int = 8) -> Column:
    """The letter whose votes f beat every other's by more than f div slop_div, the others' sum being at most f - f div slop_div; else null."""
    votes = {"C": c, "G": g, "A": a, "T": t}
    rule = F.lit(None).cast("string")
    for letter, f in votes.items():
        others = [v for k, v in votes.items() if k != letter]
        slop = F.floor(f / slop_div)
        rule = F.when((F.greatest(*others) + slop < f) & (others[0] + others[1] + others[2] <= f - slop), F.lit(letter)).otherwise(rule)
    return rule
