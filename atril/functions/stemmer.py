"""Spanish suffix stripping after the published Snowball description.

Used on one word at a time inside an Arrow function with a per-worker memo; the
suffix inventories are linguistic constants of the published algorithm.
"""

from __future__ import annotations

from functools import lru_cache

VOWELS = set("aeiouáéíóúü")

# Suffix inventories of the published algorithm.
PRONOUNS = ["selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo"]
GERUND_ACCENTED = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
GERUND_PLAIN = ["iendo", "ando", "ar", "er", "ir"]
SUFFIX_DELETE = ["anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible",
                 "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento",
                 "imientos"]
SUFFIX_IC = ["adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"]
SUFFIX_REPLACE = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente",
                  "encias": "ente"}
VERB_Y = ["ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos"]
VERB_GU = ["en", "es", "éis", "emos"]
VERB = ["arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos", "ará", "aré",
        "erían", "erías", "erán", "erás", "eríais", "ería", "eréis", "eríamos", "eremos", "erá", "eré",
        "irían", "irías", "irán", "irás", "iríais", "iría", "iréis", "iríamos", "iremos", "irá", "iré",
        "aba", "ada", "ida", "ía", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an",
        "aban", "ían", "aran", "ieran", "asen", "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo",
        "ió", "ar", "er", "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases", "ieses",
        "ís", "áis", "abais", "íais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis", "ados",
        "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos", "ásemos"]
RESIDUAL = ["os", "a", "o", "á", "í", "ó"]


def _region_after_vc(word: str, start: int) -> int:
    """Start of the part after the first consonant that follows a vowel, from `start`."""
    seen_vowel = False
    for i in range(start, len(word)):
        if word[i] in VOWELS:
            seen_vowel = True
        elif seen_vowel:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    n = len(word)
    if n < 3:
        return n
    first, second = word[0] in VOWELS, word[1] in VOWELS
    if not second:
        return next((i + 1 for i in range(2, n) if word[i] in VOWELS), n)
    if first:
        return next((i + 1 for i in range(2, n) if word[i] not in VOWELS), n)
    return 3


def _longest(word: str, suffixes, region: int) -> str | None:
    fits = [s for s in suffixes if word.endswith(s) and len(word) - len(s) >= region]
    return max(fits, key=len) if fits else None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    rv = _rv(word)
    r1 = _region_after_vc(word, 0)
    r2 = _region_after_vc(word, r1)
    word = _attached_pronoun(word, rv)
    after = _standard_suffix(word, r1, r2)
    if after is None:
        after = _verb_suffix(word, rv)
    word = _residual(after, rv)
    return word.translate(str.maketrans("áéíóú", "aeiou"))


def _attached_pronoun(word: str, rv: int) -> str:
    pronoun = _longest(word, PRONOUNS, rv)
    if pronoun is None:
        return word
    base = word[: -len(pronoun)]
    accented = _longest(base, GERUND_ACCENTED, rv)
    if accented is not None:
        return base[: -len(accented)] + GERUND_ACCENTED[accented]
    if _longest(base, GERUND_PLAIN, rv) is not None:
        return base
    if base.endswith("yendo") and len(base) - 5 >= rv and base.endswith("uyendo"):
        return base
    return word


def _drop(word: str, suffixes, region: int) -> str:
    found = _longest(word, suffixes, region)
    return word[: -len(found)] if found else word


def _standard_suffix(word: str, r1: int, r2: int) -> str | None:
    known = [*SUFFIX_DELETE, *SUFFIX_IC, *SUFFIX_REPLACE, "amente", "mente", "idad", "idades",
             "iva", "ivo", "ivas", "ivos"]
    found = _longest(word, known, 0)
    if found is None:
        return None
    base = word[: -len(found)]
    if found == "amente":
        if len(base) < r1:
            return None
        if base.endswith("iv") and len(base) - 2 >= r2:
            return _drop(base[:-2], ["at"], r2)
        return _drop(base, ["os", "ic", "ad"], r2)
    if len(base) < r2:
        return None
    if found in SUFFIX_REPLACE:
        return base + SUFFIX_REPLACE[found]
    if found in SUFFIX_IC:
        return _drop(base, ["ic"], r2)
    if found == "mente":
        return _drop(base, ["ante", "able", "ible"], r2)
    if found in ("idad", "idades"):
        return _drop(base, ["abil", "ic", "iv"], r2)
    if found in ("iva", "ivo", "ivas", "ivos"):
        return _drop(base, ["at"], r2)
    return base


def _verb_suffix(word: str, rv: int) -> str:
    y_form = _longest(word, VERB_Y, rv)
    if y_form and word[: -len(y_form)].endswith("u"):
        return word[: -len(y_form)]
    found = _longest(word, [*VERB, *VERB_GU], rv)
    if found is None:
        return word
    base = word[: -len(found)]
    if found in VERB_GU and base.endswith("gu"):
        base = base[:-1]
    return base


def _residual(word: str, rv: int) -> str:
    found = _longest(word, RESIDUAL, rv)
    if found:
        return word[: -len(found)]
    found = _longest(word, ["e", "é"], rv)
    if found:
        base = word[:-1]
        if base.endswith("gu") and len(base) - 1 >= rv:
            base = base[:-1]
        return base
    return word
