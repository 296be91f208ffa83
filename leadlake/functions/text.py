"""Text normalisation with Python string semantics, written as Spark expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters Python's str.strip() and re's \s treat as white space, by rule.
SPACES = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())
# The same set for use inside a regular-expression character class.
SPACE_CHARS = r"\s\x1C-\x1F\x{85}\p{Z}"
SPACE = f"[{SPACE_CHARS}]"


def _single_char_folds(reduce) -> tuple[str, str]:
    """translate() arguments for every character that ``reduce`` turns into one other character."""
    source, target = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = reduce(unicodedata.normalize("NFD", ch))
        if len(folded) == 1 and folded != ch:
            source.append(ch)
            target.append(folded)
    return "".join(source), "".join(target)


def _without_marks(text: str) -> str:
    return "".join(ch for ch in text if unicodedata.category(ch) != "Mn")


_MARK_FOLDS = _single_char_folds(_without_marks)
_ASCII_FOLDS = _single_char_folds(lambda text: text.encode("ascii", "ignore").decode())
# Hangul syllables: 19 leading letters, 21 vowels, 28 trailing letters or none.
_HANGUL, _SYLLABLES = 0xAC00, 19 * 21 * 28
# The other characters that decompose into several letters, by rule.
_SEVERAL = {
    chr(cp): letters for cp in [*range(0x80, 0xAC00), *range(0xE000, 0x10000)]
    if len(letters := _without_marks(unicodedata.normalize("NFD", chr(cp)))) > 1
}
_DIGITS = [chr(cp) for cp in range(0x80, 0x10000) if unicodedata.category(chr(cp)) == "Nd"]
_DIGIT_FOLDS = ("".join(_DIGITS), "".join(str(unicodedata.digit(ch)) for ch in _DIGITS))


def _translate(col: Column, folds: tuple[str, str]) -> Column:
    return F.translate(col, *folds)


def absent_as_null(col: Column) -> Column:
    """Python truthiness of a string: '' counts as absent."""
    return F.nullif(col, F.lit(""))


def present(col: Column) -> Column:
    """True for a non-empty string, never null."""
    return F.coalesce(col != "", F.lit(False))


def trim_ws(col: Column) -> Column:
    """str.strip(): all Unicode white space, not only blanks."""
    return F.btrim(col, F.lit(SPACES))


def norm_text(col: Column) -> Column:
    """Lower case, strip, drop combining marks; null becomes ''.

    Letters without a canonical decomposition (``ł``, ``ø``, ``ß``) stay. Those that decompose into
    several letters (Hangul syllables and a few others) do so where a text has any.
    """
    folded = F.regexp_replace(_translate(trim_ws(F.lower(col)), _MARK_FOLDS), r"\p{Mn}", "")
    several = f"[{chr(_HANGUL)}-{chr(_HANGUL + _SYLLABLES - 1)}{''.join(_SEVERAL)}]"
    return F.coalesce(F.when((F.octet_length(col) > F.length(col)) & col.rlike(several), _in_letters(folded)).otherwise(folded), F.lit(""))


def _in_letters(col: Column) -> Column:
    """Every letter that stands for several replaced by them; syllables by arithmetic on their code points."""
    known = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])

    def letter(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def parts(c: Column) -> Column:
        place = F.ascii(c) - _HANGUL
        trailing = F.when(place % 28 > 0, letter((0x11A7 + place % 28).cast("long"))).otherwise("")
        lead, vowel = F.floor(place / 588), F.floor(place % 588 / 28)
        syllable = F.concat(letter(lead + 0x1100), letter(vowel + 0x1161), trailing)
        return F.when((place >= 0) & (place < _SYLLABLES), syllable).otherwise(F.coalesce(F.try_element_at(known, c), c))

    return F.array_join(F.transform(F.split(col, ""), parts), "")


@F.pandas_udf(StringType())
def norm_text_exact(texts: pd.Series) -> pd.Series:
    """:func:`norm_text` including multi-letter decompositions (Arrow batches)."""
    lowered = texts.fillna("").str.lower().str.strip().str.normalize("NFD")
    return lowered.map(_without_marks)


def ascii_fold(col: Column) -> Column:
    """Decompose, drop everything outside ASCII, lower, strip: ``Łódź`` becomes ``odz``."""
    return trim_ws(_ascii_lower(col))


def ascii_fold_inner(col: Column) -> Column:
    """:func:`ascii_fold` without the final strip, for substring search in longer texts."""
    return _ascii_lower(col)


def _ascii_lower(col: Column) -> Column:
    folded = _translate(F.coalesce(col, F.lit("")), _ASCII_FOLDS)
    return F.lower(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))


def ascii_digits(col: Column) -> Column:
    """Decimal digits of any script as 0-9, so that casts accept what int() accepts."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), _translate(col, _DIGIT_FOLDS)).otherwise(col)


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, r"\P{Nd}", "")


def title_case(col: Column) -> Column:
    """str.title(): every run of letters starts upper case (``o'neil`` gives ``O'Neil``)."""
    runs = F.regexp_extract_all(
        col, F.lit(r"([\p{Lu}\p{Lt}\p{IsLowercase}]+|[^\p{Lu}\p{Lt}\p{IsLowercase}]+)"), F.lit(1)
    )
    cased = F.transform(
        runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substring(run, 2, 1 << 30)))
    )
    return F.array_join(cased, "")


def phone_key(col: Column) -> Column:
    """Comparison key of a phone: digits, without a leading 55 when 12 or more remain; null gives ''."""
    digits = digits_only(F.coalesce(col, F.lit("")))
    national = F.substring(digits, 3, 1 << 30)
    return F.when((F.length(digits) >= 12) & digits.startswith("55"), national).otherwise(digits)


def clean_phone(col: Column) -> Column:
    """Keep digits, white space and ``()-+``, strip, at most 20 characters; null gives ''."""
    kept = F.regexp_replace(col, rf"[^\p{{Nd}}{SPACE_CHARS}()\-+]", "")
    return F.coalesce(F.left(trim_ws(kept), F.lit(20)), F.lit(""))


def phone_out(col: Column) -> Column:
    """The delivered phone: the cleaned text, or null when empty."""
    return absent_as_null(col)
