"""Text expressions that several operators share; JVM-side only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
#: A letter of a script that puts no spaces between words: Thai to Lao, Burmese, Khmer, kana and Chinese characters.
UNSPACED = f"[{_UNSPACED}]"
#: Whether a text may hold such a letter: one look for texts without any character so far up.
FAR_UP = r"[\x{0E00}-\x{10FFFF}]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is.

    A text whose byte and character counts agree is pure ASCII, where the fast
    ``lower`` does the same as the slower character map.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def token_count(text: Column) -> Column:
    """Words, where each letter of a script without spaces is a word of its own."""
    token = rf"{UNSPACED}|[^\x20\x09-\x0D{_UNSPACED}]+"
    return F.when(F.rlike(text, F.lit(FAR_UP)), F.regexp_count(text, F.lit(token)).cast("long")).otherwise(word_count(text))
