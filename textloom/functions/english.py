"""The English text-search configuration: stop words and Porter's second stemmer, from its published rules."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lexemes

# The stop words of the English configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Words with stems of their own, words that stay, and words that stay once the first suffixes are off.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
UNCHANGED_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Suffixes of the second, third and fourth step.
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_EARLY = re.compile(r"^(gener|commun|arsen)")
_SHORT_END = re.compile(r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_VOWEL = re.compile(r"[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: each behind the first non-vowel that follows a vowel (in the first region, for the second)."""
    early = _EARLY.match(word)
    first = early.end() if early else (m.end() if (m := _REGION.search(word)) else len(word))
    second = m.end() if (m := _REGION.search(word, first)) else len(word)
    return first, second


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _short(word: str, first: int) -> bool:
    return first >= len(word) and _SHORT_END.search(word) is not None


def _plural(word: str) -> str:
    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if end == "s" and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= first else word
    if end is None or not _VOWEL.search(word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _DOUBLE.search(word):
        return word[:-1]
    return word + "e" if _short(word, first) else word


def _derived(word: str, first: int, second: int) -> str:
    """Steps two to five."""
    end = _ending(word, (*STEP_2, "ogi", "li"))
    if end is not None and len(word) - len(end) >= first:
        before = word[: -len(end)]
        if end == "ogi":
            word = before + "og" if before.endswith("l") else word
        elif end == "li":
            word = before if before.endswith(tuple("cdeghkmnrt")) else word
        else:
            word = before + STEP_2[end]
    end = _ending(word, (*STEP_3, "ative"))
    if end is not None and len(word) - len(end) >= first:
        if end != "ative":
            word = word[: -len(end)] + STEP_3[end]
        elif len(word) - len(end) >= second:
            word = word[: -len(end)]
    end = _ending(word, (*STEP_4, "ion"))
    if end is not None and len(word) - len(end) >= second and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) - 1 >= second or len(word) - 1 >= first and not _SHORT_END.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if word in UNCHANGED:
        return word
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    first, second = _regions(word)
    word = _plural(word)
    if word in UNCHANGED_LATER:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    return _derived(word, first, second).lower()


_STOPS = frozenset(STOP_WORDS)


def _stems(texts: pd.Series) -> pd.Series:
    return texts.map(lambda words: None if words is None else [stem(w) for w in words if w not in _STOPS])


def english_lexemes(text: Column) -> Column:
    """Stems of the words of a text in order, without stop words; in Arrow batches, each word once for a worker's cache. Null: empty."""
    return F.pandas_udf(_stems, "array<string>")(lexemes(text))
