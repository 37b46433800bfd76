"""Column functions of the text analysers: tokens, folding, markup."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN_CHARS = 255

# Scripts written without spaces: every such character is a token of its own.
_IDEO = (
    r"\x{3005}-\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}\x{3041}-\x{309F}\x{3400}-\x{4DBF}"
    r"\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{1B000}-\x{1B11F}\x{20000}-\x{3FFFF}"
)
_EXT = r"\p{M}\x{AD}\x{200C}\x{200D}"
_LETTER_JOIN = "[.':·’]"
# What neither goes on with a word of plain letters nor joins letters.
_PLAIN_END = r"(?=[\x00-&(-\-/;-@\[-^`{-\x7F]|\z)"
_DIGIT_JOIN = "[.,;'’]"


def _token_pattern(java: bool) -> str:
    """Unicode word rules: letters join over . ' : · and digits over . , ; ' between them.

    The JVM pattern uses possessive loops, which never recurse on long input; the other
    dialect has no such operator and matches the same strings. Plain letters are tried first there,
    since classes of all letters are slow: most words are plain and end at a plain separator.
    """
    p = "+" if java else ""
    letter = rf"[^\P{{L}}{_IDEO}]"
    if java:
        letter = rf"(?:[a-z]|{letter})"
        rest = rf"[a-z]*+[\p{{L}}{_EXT}&&[^{_IDEO}]]*+"
    else:
        rest = rf"(?:{letter}|[{_EXT}])*"
    letters = f"{letter}{rest}(?:{_LETTER_JOIN}{letter}{rest})*{p}"
    digits = rf"\p{{Nd}}[\p{{Nd}}{_EXT}]*{p}(?:{_DIGIT_JOIN}\p{{Nd}}[\p{{Nd}}{_EXT}]*{p})*{p}"
    word = f"_*{p}(?:{letters}|{digits})(?:{letters}|{digits}|_+{p})*{p}"
    every = rf"{word}|[{_IDEO}][{_EXT}]*{p}"
    return rf"(?![\x00-/:-@\[-^`{{-\x7F])(?:[a-z]++{_PLAIN_END}|{every})" if java else every


TOKEN = _token_pattern(java=True)
TOKEN_RE2 = _token_pattern(java=False)


def whole_words(text: Column) -> Column:
    """Lower-cased words of a text, in order, as an array, long ones too; texts are cut once."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def split_tokens(text: Column) -> Column:
    """Words of an already lower-cased text, in order, as an array."""
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    pieces = F.flatten(
        F.transform(
            words,
            lambda w: F.regexp_extract_all(w, F.lit("(?s).{1,%d}" % MAX_TOKEN_CHARS), F.lit(0)),
        )
    )
    too_long = F.exists(words, lambda w: F.length(w) > MAX_TOKEN_CHARS)
    return F.when(too_long, pieces).otherwise(words)


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, in order, as an array."""
    return split_tokens(F.lower(text))


# Letters whose plain form is not given by Unicode decomposition.
_PLAIN_FORMS = {
    "Æ": "AE", "Ð": "D", "Ø": "O", "Þ": "TH", "ß": "ss", "æ": "ae", "ð": "d", "ø": "o",
    "þ": "th", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "ĸ": "q", "Ł": "L", "ł": "l",
    "ŉ": "n", "Ŋ": "N", "ŋ": "n", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t", "ƀ": "b", "Ɓ": "B",
    "Ɔ": "O", "Ƈ": "C", "ƈ": "c", "Ɖ": "D", "Ɗ": "D", "Ƒ": "F", "ƒ": "f", "Ɠ": "G", "Ɨ": "I",
    "Ƙ": "K", "ƙ": "k", "ƚ": "l", "Ɲ": "N", "ƞ": "n", "Ƥ": "P", "ƥ": "p", "ƫ": "t", "Ƭ": "T",
    "ƭ": "t", "Ʈ": "T", "Ʋ": "V", "Ƴ": "Y", "ƴ": "y", "Ƶ": "Z", "ƶ": "z", "ẞ": "SS",
}

# Latin-1 and Latin Extended letters, Latin ligatures, full-width forms.
_FOLD_RANGES = ((0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF10, 0xFF5A))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    plain = dict(_PLAIN_FORMS)
    for low, high in _FOLD_RANGES:
        for code in range(low, high + 1):
            char = chr(code)
            if char in plain or unicodedata.category(char)[0] not in "LN":
                continue
            base = "".join(
                c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
            )
            if base.isascii() and base.isalnum():
                plain[char] = base
    single = {c: b for c, b in plain.items() if len(b) == 1}
    wide = {c: b for c, b in plain.items() if len(b) > 1}
    return "".join(single), "".join(single.values()), wide


FOLD_FROM, FOLD_TO, FOLD_WIDE = _fold_tables()


def ascii_fold(text: Column) -> Column:
    """Letters with diacritics, ligatures and full-width forms as plain ASCII letters."""
    folded = F.translate(text, FOLD_FROM, FOLD_TO)
    for char, plain in FOLD_WIDE.items():
        folded = F.replace(folded, F.lit(char), F.lit(plain))
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


# What markup escapes, the ampersand first.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def safe_highlight(text: Column) -> Column:
    """Escape a highlight for display and let only the emphasis marks through."""
    for char, escaped in HTML_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(escaped))
    for mark in ("em", "/em"):
        text = F.replace(text, F.lit(f"&lt;{mark}&gt;"), F.lit(f"<{mark}>"))
    return text
