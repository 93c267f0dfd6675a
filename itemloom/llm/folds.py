"""Deterministic folds by document id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))
