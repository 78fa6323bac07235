"""The suffix stripper of M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980.

Works on UTF-8 bytes, as full-text engines do: each byte beyond ASCII counts as a consonant. Words under three or over
64 bytes stay as they are; a suffix must leave something before it.
"""

from __future__ import annotations

from functools import lru_cache

# The paper's suffixes with their replacements.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _kinds(word: str) -> str:
    """c or v for each letter: y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return _kinds(word).count("vc")


def _cvc(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s) and len(word) > len(s)), None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    word = word.encode().decode("latin-1")
    if 3 <= len(word) <= 64:
        word = _stem(word)
    return word.encode("latin-1").decode("utf-8", "ignore")


def _stem(word: str) -> str:
    # plurals
    if word.endswith("sses") and len(word) > 4 or word.endswith("ies") and len(word) > 3:
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive forms
    if word.endswith("eed") and len(word) > 3:
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending):
                base = word[: -len(ending)]
                if "v" in _kinds(base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif base[-2:-1] == base[-1:] and _kinds(base)[-1] == "c" and base[-1] not in "lsz":
                        base = base[:-1]
                    elif _measure(base) == 1 and _cvc(base):
                        base += "e"
                    word = base
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(word, table)
        if s and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    s = _longest(word, STEP4)
    if s:
        base = word[: -len(s)]
        if _measure(base) > 1 and (s != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _cvc(base):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
