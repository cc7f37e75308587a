"""Coded neighbourhood status (P16, P17): 0 no, 1 yes, 9 mixed, 10 unobserved."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plotmark.functions.scalars import col

NO, YES, MIXED, UNOBSERVED = 0, 1, 9, 10


def cutoff_status(share: Column | str, lo: float = 0.2, hi: float = 0.6) -> Column:
    """Status of a group from its flagged share; a share on a cutoff takes the higher class."""
    share = col(share)
    return (
        F.when(share.between(hi, 1), YES)
        .when(share.between(lo, hi), MIXED)
        .when(share.between(0, lo), NO)
        .otherwise(UNOBSERVED)
    )


def fuse_status(a: Column | str, b: Column | str) -> Column:
    """Yes or no from either method unless the other says the opposite, else mixed."""
    a, b = col(a), col(b)

    def says(answer: int, opposite: int) -> Column:
        return ((a == answer) & (b != opposite)) | ((b == answer) & (a != opposite))

    return F.when(says(YES, NO), YES).when(says(NO, YES), NO).otherwise(MIXED)


def combined_flag(flags: list[Column], observed: Column) -> Column:
    """1 if any flag is set, 0 if none, null when the entity was never observed (A2)."""
    return F.when(observed > 0, F.array_max(F.array(*flags)).cast("int"))
