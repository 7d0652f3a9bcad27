"""Keys for comparison: native folding of characters that a reader cannot tell apart, stand-ins for missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters, spaces that look like a plain space, letters drawn like a Latin letter.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
ODD_SPACES = "               　"
LOOKALIKE_LETTERS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ԝ": "w",
    "х": "x", "у": "y", "һ": "h", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ɑ": "a", "ɡ": "g",
    "ı": "i", "K": "K", "Å": "Å",
}
# What shops write in place of a missing value.
STAND_INS = ("", "-", "--", "---", "n/a", "na", "none", "null", "nil", "nan", "undefined", "unknown", "tbd", "tba", "?", "–", "—")

_FULL_WIDTH = [chr(c) for c in range(0xFF01, 0xFF5F)]
_FROM = "".join(_FULL_WIDTH) + "".join(ODD_SPACES) + "".join(LOOKALIKE_LETTERS) + "‐‑" + INVISIBLE
_TO = "".join(chr(ord(c) - 0xFEE0) for c in _FULL_WIDTH) + " " * len(ODD_SPACES) + "".join(LOOKALIKE_LETTERS.values()) + "--"
# Accented Latin letters and their base letter.
_BASE_OF = dict(
    [*zip("àáâãäåāăą", "a" * 9, strict=True), *zip("çćč", "c" * 3, strict=True), *zip("ďđ", "dd", strict=True)]
    + [*zip("èéêëēęě", "e" * 7, strict=True), *zip("ìíîïī", "i" * 5, strict=True), *zip("ñńň", "n" * 3, strict=True)]
    + [*zip("òóôõöøō", "o" * 7, strict=True), *zip("ùúûüūů", "u" * 6, strict=True), *zip("śšş", "s" * 3, strict=True)]
    + [*zip("ýÿ", "yy", strict=True), *zip("źžż", "zzz", strict=True), *zip("ťřł", "trl", strict=True)]
)
_COMBINING = "".join(chr(c) for c in range(0x300, 0x370))
# Latin ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def is_ascii(text: Column) -> Column:
    """As many characters as bytes, which is known without looking at each."""
    return F.length(text) == F.octet_length(text)


def fold_beyond_ascii(text: Column) -> Column:
    out = F.translate(text, _FROM, _TO)
    spelled = out
    for one, letters in LIGATURES.items():
        spelled = F.replace(spelled, F.lit(one), F.lit(letters))
    return F.when(out.rlike("[ﬀ-ﬆ]"), spelled).otherwise(out)


def fold_lookalikes(text: Column) -> Column:
    """Text with look-alike characters replaced one by one, for keys only: it also changes words of other scripts."""
    return F.when(is_ascii(text), text).otherwise(fold_beyond_ascii(text))


def bare_letters(lower_text: Column) -> Column:
    return F.translate(lower_text, "".join(_BASE_OF) + _COMBINING, "".join(_BASE_OF.values()))


def strip_accents(lower_text: Column) -> Column:
    return F.when(is_ascii(lower_text), lower_text).otherwise(bare_letters(lower_text))


def squeeze(text: Column) -> Column:
    """White space runs become one space; none is left outside."""
    # Single spaces aren't matched, so that most texts pass without a replacement.
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]", " "))


def is_stand_in(text: Column) -> Column:
    """True for null, blank and the usual words for a missing value."""
    # No stand-in is long, whatever surrounds it; only short texts are looked at.
    plain = F.lower(squeeze(fold_lookalikes(text)))
    return text.isNull() | F.when(text.rlike(r"\w{12}"), False).otherwise(plain.isin(*STAND_INS))
