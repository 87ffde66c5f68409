"""English stems by Porter's published algorithm, and texts without diacritics."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Endings of the algorithm's steps 2 to 4 with what they become (fixed values of the published algorithm).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Longer tokens are left as they are.
_LONGEST = 64
_WORD = re.compile(r"[^\W_]+")


def _shape(stem: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Whether it ends in consonant, vowel and a consonant other than w, x, y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _replaced(word: str, endings: dict[str, str], least: int) -> str:
    """With the longest of the endings replaced if what is before it has a measure above least."""
    end = max((e for e in endings if word.endswith(e)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > least:
        return word[: -len(end)] + endings[end]
    return word


def _plurals(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    end = next((e for e in ("ed", "ing") if word.endswith(e)), None)
    if not end or "v" not in _shape(word[: -len(end)]):
        return word
    stem = word[: -len(end)]
    if stem.endswith(("at", "bl", "iz")) or (_measure(stem) == 1 and _short_end(stem)):
        return stem + "e"
    return stem[:-1] if _double(stem) and stem[-1] not in "lsz" else stem


def _long_endings(word: str) -> str:
    end = max((e for e in _STEP4 if word.endswith(e)), key=len, default=None)
    if not end:
        return word
    stem = word[: -len(end)]
    return stem if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))) else word


def _last_letters(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters, and those with other characters than a to z, stay."""
    if not 2 < len(word) <= _LONGEST or not (word.isascii() and word.isalpha()):
        return word
    word = _past(_plurals(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _last_letters(_long_endings(_replaced(_replaced(word, _STEP2, 0), _STEP3, 0)))


def plain(text: str) -> str:
    """Lower-cased, without the marks above and below letters."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the plain text."""
    return _WORD.findall(plain(text or ""))
