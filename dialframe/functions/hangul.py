"""Hangul helpers: the final-consonant test that picks a Korean particle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL_BASE = 0xAC00   # code point of the first precomposed syllable
FINALS = 28            # final-consonant slots per syllable


def last_code_point(s: Column) -> Column:
    """Code point of the last character (``ascii`` returns the full code point)."""
    return F.ascii(F.substring(s, -1, 1))


def has_final_consonant(s: Column) -> Column:
    """True when the last syllable has a final consonant.

    The offset is reduced with a floored modulo (``pmod``), so characters below the
    syllable block (for example ``)``) land on a positive slot, exactly as the
    floored ``%`` of the original tooling does; a truncating ``%`` would not.
    """
    return F.pmod(last_code_point(s) - F.lit(HANGUL_BASE), F.lit(FINALS)) > 0
