"""Unicode folding as native column expressions.

Spark has no normalisation function.  The single-character part of NFKD folding
(thousands of code points) is a `translate` whose two strings are computed here
from `unicodedata`, so whole tables are folded inside code generation.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it.

    Expression trees copy what they name, so without this a long chain of functions
    over a chain grows exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_HANGUL = range(0xAC00, 0xD7A4)


def _folding() -> tuple[str, str, dict[str, str], list[int]]:
    """Folded characters, for text in lower case (capitals matter where the JVM knows fewer of them), and those that go."""
    src, dst, multi, gone = [], [], {}, []
    for cp in range(0xA0, 0x110000):
        ch = chr(cp)
        if cp in _HANGUL or 0xD800 <= cp <= 0xDFFF:
            continue
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c)
        )
        if folded == ch:
            continue
        if len(folded) == 1:
            src.append(ch)
            dst.append(folded)
        elif folded:
            multi[ch] = folded
        else:
            gone.append(cp)
    return "".join(src), "".join(dst), multi, gone


_SRC, _DST, _MULTI, _GONE = _folding()


def _char_class(code_points: list[int]) -> str:
    ranges: list[list[int]] = []
    for cp in sorted(code_points):
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


_MULTI_TEXT = "\u0001".join(f"{k}\u0002{v}" for k, v in _MULTI.items())
_MULTI_CLASS = _char_class([*map(ord, _MULTI), *_HANGUL])
_COMBINING = _char_class(_GONE)
# One-range tests that spare almost every row the long classes above.
_BEYOND_LATIN = "[\\x{300}-\\x{10FFFF}]"
_MAYBE_MULTI = "[\\x{BC}-\\x{BE}\\x{132}-\\x{10FFFF}]"


def _jamo(syllable: Column) -> Column:
    """The letters of a Hangul syllable, by the standard's arithmetic (21 vowels, 27 tails and none)."""
    at = F.ascii(syllable) - F.lit(_HANGUL.start)

    def letter(first: int, many: int, place: Column) -> Column:
        return F.substr(F.lit("".join(map(chr, range(first, first + many)))), place + 1, F.lit(1))

    tail = F.when(at % 28 > 0, letter(0x11A8, 27, at % 28 - 1)).otherwise("")
    return F.concat(letter(0x1100, 19, F.floor(at / 588).cast("int")), letter(0x1161, 21, F.floor(at % 588 / 28).cast("int")), tail)


def fold(text: Column, wide: bool = False) -> Column:
    """Lower case, compatibility-decompose, drop combining marks.

    `wide=True` also expands the characters that decompose to several
    (ligatures, fractions, Hangul syllables).
    """
    base = let(
        F.translate(F.lower(text), _SRC, _DST),
        lambda b: F.when(b.rlike(_BEYOND_LATIN), F.regexp_replace(b, _COMBINING, "")).otherwise(b))
    if not wide:
        return base

    def spelled(b: Column) -> Column:
        # one literal that folds to a map, instead of a node per entry
        table = F.str_to_map(F.lit(_MULTI_TEXT), F.lit("\u0001"), F.lit("\u0002"))
        hangul = lambda c: c.between(F.lit(chr(_HANGUL.start)), F.lit(chr(_HANGUL.stop - 1)))
        return F.array_join(F.transform(F.split(b, ""), lambda c: F.when(hangul(c), _jamo(c)).otherwise(
            F.coalesce(F.try_element_at(table, c), c))), "")

    return let(base, lambda b: F.when(b.rlike(_MAYBE_MULTI) & b.rlike(_MULTI_CLASS), spelled(b)).otherwise(b))


# Characters that NFKC leaves alone whatever surrounds them: ASCII and the Latin letters.
_NFKC_SAFE = "[^\\x00-\\x7F\\x{A1}-\\x{A7}\\x{A9}\\x{AB}-\\x{AE}\\x{B0}\\x{B1}\\x{B6}\\x{B7}\\x{BB}\\x{BF}-\\x{131}]"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC.  Only rows with a character outside the safe Latin set carry data to
    the Arrow function; for all others the argument is NULL and costs nothing."""
    needs = (F.octet_length(text) != F.char_length(text)) & text.rlike(_NFKC_SAFE)
    return F.coalesce(_nfkc(F.when(needs, text)), text)
