"""Positions on circular sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate_position(position: Column, cut: int, length: int | Column) -> Column:
    """The position after the circle was opened so that ``cut`` is 1."""
    return F.pmod(position - cut, F.lit(length)) + 1


def rotate_sequence(seq: Column, cut: int) -> Column:
    return F.concat(seq.substr(F.lit(cut), F.length(seq)), seq.substr(F.lit(1), F.lit(cut - 1)))


def shift_position(position: Column, by: int, length: int) -> Column:
    """A circular relabelling: ``by`` is added, positions stay in 1..length."""
    return F.pmod(position - 1 + by, F.lit(length)) + 1
