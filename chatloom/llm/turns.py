"""Turns of conversations in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.scan import numbered


def digest() -> Column:
    """A digest of role and text that no other pair of them shares; nulls count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def placed(turns: DataFrame, label: str) -> DataFrame:
    """``turns`` with ``place``, from 1: a conversation's turns by ``turn``, null first; turns of an equal number by their digests."""
    return numbered(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"], "place", label)
