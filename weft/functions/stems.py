"""Russian stems by the published Snowball algorithm, and concept tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from weft.functions import text as T

VOWELS = "аеиоуыэюя"
# The algorithm's endings, group 1 (after а or я) and group 2 of each class.
GERUND_1, GERUND_2 = ["вшись", "вши", "в"], ["ившись", "ывшись", "ивши", "ывши", "ив", "ыв"]
ADJECTIVE = ["ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею"]
PARTICIPLE_1, PARTICIPLE_2 = ["ем", "нн", "вш", "ющ", "щ"], ["ивш", "ывш", "ующ"]
REFLEXIVE = ["ся", "сь"]
VERB_1 = ["ете", "йте", "ешь", "нно", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н"]
VERB_2 = ["уйте", "ейте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю"]
NOUN = ["иями", "ями", "ами", "ией", "иям", "ием", "иях", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я"]
SUPERLATIVE, DERIVATIONAL = ["ейше", "ейш"], ["ость", "ост"]


def _cut(word: str, start: int, plain: list[str], after_a: list[str] = ()) -> str | None:
    """The word without its longest ending within the region; endings of after_a need а or я before them."""
    region = word[start:]
    for ending in sorted([*plain, *after_a], key=len, reverse=True):
        if region.endswith(ending):
            if ending in plain:
                return word[: -len(ending)]
            before = region[: -len(ending)]
            if before.endswith(("а", "я")):
                return word[: -len(ending)]
            return None
    return None


def stem(word: str) -> str:
    word = word.lower().replace("ё", "е")
    first = next((i for i, c in enumerate(word) if c in VOWELS), None)
    if first is None:
        return word
    rv = first + 1
    pattern = re.compile(f"[{VOWELS}][^{VOWELS}]")
    one = pattern.search(word)
    r1 = one.end() if one else len(word)
    two = pattern.search(word, r1)
    r2 = two.end() if two else len(word)
    done = _cut(word, rv, GERUND_2, GERUND_1)
    if done is None:
        word = _cut(word, rv, REFLEXIVE) or word
        adjective = _cut(word, rv, ADJECTIVE)
        if adjective is not None:
            done = _cut(adjective, rv, PARTICIPLE_2, PARTICIPLE_1) or adjective
        else:
            done = _cut(word, rv, VERB_2, VERB_1)
            if done is None:
                done = _cut(word, rv, NOUN)
    word = done if done is not None else word
    word = _cut(word, rv, ["и"]) or word
    word = _cut(word, r2, DERIVATIONAL) or word
    if word[rv:].endswith("нн"):
        return word[:-1]
    shorter = _cut(word, rv, SUPERLATIVE)
    if shorter is not None:
        return shorter[:-1] if shorter[rv:].endswith("нн") else shorter
    return _cut(word, rv, ["ь"]) or word


def token_stem(token: str) -> str:
    """Pure Cyrillic tokens of five letters or more, if three letters stay; others as they are."""
    if len(token) < 5 or not re.fullmatch("[а-яё]+", token):
        return token
    short = stem(token)
    return short if len(short) >= 3 else token


@F.pandas_udf(ArrayType(StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return tokens.map(lambda ts: None if ts is None else [known[t] if t in known else known.setdefault(t, token_stem(t)) for t in ts])


def stems(text: Column) -> Column:
    """Index tokens with Russian ones stemmed; only texts with Cyrillic letters leave the JVM's values unchanged path."""
    tokens = T.tokens(text)
    return F.when(text.rlike("[а-яёА-ЯЁ]"), _stems(tokens)).otherwise(tokens)


def concept_tokens(text: Column, concepts: dict[str, list[str]]) -> Column:
    """Tokens of the concepts any of whose aliases the text holds. The table is part of the configuration, and small."""
    low = F.lower(text)
    found = []
    for concept, aliases in sorted(concepts.items()):
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | T.contains_exact(low, alias.lower())
        found.append(F.when(hit, T.concept_token(F.lit(concept))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
