"""English lexemes: stop words and the Porter2 stemmer, for distinct words one at a time."""

from __future__ import annotations

import re

#: Words that full-text search leaves out.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now".split()
)
#: Fixed values of the Porter2 rules: whole words, then suffixes of each step and what they become.
WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy]|[^aeiouy][aeiouy])[^aeiouy]$")
_VOWEL = re.compile("[aeiouy]")


def _after(word: str, at: int) -> int:
    found = _REGION.search(word, at)
    return found.end() if found else len(word)


def _short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(_SHORT.search(word)) and (len(word) == 2 or word[-1] not in "wxY")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in WORDS or word in KEPT:
        return WORDS.get(word, word)
    word = re.sub("(?:^|(?<=[aeiouy]))y", "Y", word)
    head = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(head) if head else _after(word, 0)
    r2 = _after(word, r1)
    word = re.sub("'(?:s'?)?$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT_LATER:
        return word
    # past and present participles
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            word = word[:-1]
        elif r1 >= len(word) and _short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # derivations
    end = _longest(word, STEP_2)
    if end and len(word) - len(end) >= r1 and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3:-2] in tuple("cdeghkmnrt")):
        word = word[: -len(end)] + STEP_2[end]
    end = _longest(word, STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short(word[:-1]))) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def lexeme(word: str, config: str = "english") -> str | None:
    """The lexeme of a lower-case word, or None for a stop word; the simple configuration keeps every word as it is."""
    if config == "simple":
        return word
    return None if word in STOP else stem(word)
