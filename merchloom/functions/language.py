"""Script and language tests by character class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchloom.functions.base import NOT_LATIN_LETTER, ColumnLike, col, first_reason, let, text_or_empty

# Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, CJK A, CJK, Hangul.
NON_LATIN = (
    r"[\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0900}-\x{097F}\x{0E00}-\x{0E7F}"
    r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
)
# Accented Latin-1 letters, without the multiplication and division signs.
ACCENTED = r"[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"
ARABIC = r"[\x{0600}-\x{06FF}]"
CJK = r"[\x{4e00}-\x{9fff}]"

MIN_LETTERS = 30
MIN_LATIN_RATIO = 0.6


def letters(value: ColumnLike) -> Column:
    """Number of letters of any script."""
    return F.length(F.regexp_replace(col(value), r"[^\p{L}]+", ""))


def latin_letters(value: ColumnLike) -> Column:
    return F.length(F.regexp_replace(col(value), NOT_LATIN_LETTER + "+", ""))


def has_non_latin(value: ColumnLike) -> Column:
    text = col(value)
    # one cheap range test settles most texts before the exact set of ranges is tried
    return text.rlike(r"[\x{0400}-\x{D7AF}]") & text.rlike(NON_LATIN)


def has_accent(value: ColumnLike) -> Column:
    return col(value).rlike(ACCENTED)


def contains_arabic(value: ColumnLike) -> Column:
    return F.coalesce(col(value).rlike(ARABIC), F.lit(False))


def is_non_english(value: ColumnLike) -> Column:
    """Foreign script, accented letters, or a low share of Latin letters in a longer text."""
    text = F.coalesce(col(value), F.lit(""))
    low_share = (letters(text) >= MIN_LETTERS) & (latin_letters(text) < MIN_LATIN_RATIO * letters(text))
    return F.when(has_non_latin(text), True).when(has_accent(text), True).otherwise(low_share)


def is_english(value: ColumnLike) -> Column:
    return ~is_non_english(value)


def non_english_reason(primary: Column, desc: Column, combined: Column) -> Column:
    """First reason to call a product non-English; inputs are already free of HTML."""
    primary_letters, primary_latin = letters(primary), latin_letters(primary)
    combined_letters, combined_latin = letters(combined), latin_letters(combined)
    weak_primary = (primary_letters < 8) | (primary_latin < 0.5 * primary_letters)
    return first_reason([
        ("non_latin_primary", has_non_latin(primary)),
        ("non_latin_desc_with_weak_primary", has_non_latin(desc) & weak_primary),
        ("low_latin_primary", (primary_letters >= 12) & (primary_latin < 0.55 * primary_letters)),
        ("low_latin_combined", (primary_latin < 8) & (combined_letters >= 80)
         & (combined_latin < 0.45 * combined_letters)),
        ("european_accent", has_accent(primary)),
    ])


def mostly_cjk(value: ColumnLike) -> Column:
    """At least 80 % CJK among CJK, Latin letters and digits, and no Latin letter."""
    def verdict(text: Column) -> Column:
        cjk = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]+", ""))
        digits = F.length(F.regexp_replace(text, r"\P{Nd}+", ""))
        return (cjk > 0) & (latin_letters(text) == 0) & (cjk >= 0.8 * (cjk + digits))

    return let(text_or_empty(value), verdict)
