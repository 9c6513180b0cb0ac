"""Numbers written as words. Each word becomes a letter for its kind, a regular expression over the letters finds the runs that
are numbers, and a run is added up from the left."""

from __future__ import annotations

import re
from functools import cache, lru_cache

from textloom.functions import lexicon as lex

#: Kinds: U adds, D a digit, T a ten that a joiner may follow, C hundreds, H times a hundred, S a scale, M a scale that stands alone, O one before a scale,
#: N a whole number in one word, J joiner.
RUNS = {
    "en": re.compile(r"(?:U|O(?=[HS]))(?:[UHS]|(?<=[HS])J(?=U))*"),
    "es": re.compile(r"(?:[UDTCM]|O(?=[MS]))(?:[UDTCMS]|(?<=T)J(?=D))*"),
    "it": re.compile(r"(?:N|O(?=S))(?:S(?:S|JN)*)?"),
}


def add_up(parts) -> float:
    """parts: (kind, value). A scale multiplies what came since the last one; K is a thousand that takes nothing before it."""
    total = rest = 0.0
    for kind, value in parts:
        if kind == "H":
            rest = (rest or 1) * 100
        elif kind in "SM":
            total, rest = total + (rest or 1) * value, 0.0
        elif kind == "K":
            total, rest = total + value, 0.0
        elif kind != "J":
            rest += value
    return total + rest


@cache
def kinds(lang: str) -> dict[str, tuple[str, float]]:
    """Words to (kind, value). Italian's are the parts of its one-word numbers."""
    if lang == "en":
        table = {w: ("U", v) for w, v in lex.EN_UNITS.items()} | {w: ("H", 100) for w in lex.EN_HUNDRED} | {w: ("O", 1) for w in lex.EN_ONE}
    elif lang == "es":
        letter = lambda v: "D" if 0 < v < 10 else "T" if v >= 30 and v % 10 == 0 else "U"
        table = {w: (letter(v), v) for w, v in lex.ES_UNITS.items()} | {w: ("C", v) for w, v in lex.ES_HUNDREDS.items()} | {w: ("O", 1) for w in lex.ES_ONE}
    else:
        table = {w: ("U", v) for w, v in lex.IT_UNITS.items()} | {w: ("H", 100) for w in lex.IT_HUNDRED} | {lex.IT_THOUSAND: ("K", 1000), lex.IT_THOUSANDS: ("S", 1000)}
    table |= {w: ("S", v) for w, v in lex.SCALES[lang].items()}
    return table | ({"mil": ("M", 1000)} if lang == "es" else {}) | {lex.JOINER[lang]: ("J", 0)}


@cache
def italian_parts() -> re.Pattern:
    """Longest part first and none given back, as results depend on it."""
    return re.compile("|".join(sorted((w for w, (kind, _) in kinds("it").items() if kind != "J"), key=len, reverse=True)))


@lru_cache(maxsize=1 << 16)
def italian(word: str) -> float | None:
    """The value of a number in one word (duemila, ventitré), or None."""
    if word in lex.IT_NOT_ALONE or word in lex.IT_SCALES or word == lex.IT_THOUSANDS or not word:
        return None
    parts = italian_parts().findall(word)
    return add_up(kinds("it")[p] for p in parts) if "".join(parts) == word else None


def kind_of(word: str, lang: str) -> tuple[str, float]:
    if lang != "it":
        return kinds(lang).get(word, (".", 0))
    if word in lex.IT_SCALES:
        return "S", lex.IT_SCALES[word]
    if word == lex.JOINER["it"]:
        return "J", 0
    value = italian(word)
    return ("N", value) if value is not None else ("O", 1) if word in lex.IT_ONE else (".", 0)


def values(words: list[str], lang: str) -> list[float]:
    """The value of each run of number words, which are in lower case."""
    found = [kind_of(w, lang) for w in words]
    return [add_up(found[m.start() : m.end()]) for m in RUNS[lang].finditer("".join(kind for kind, _ in found))]
