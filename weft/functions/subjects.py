"""Query understanding: subjects, probes, expansions, request plans. Small and on the driver; results are joined as tables."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from datetime import UTC, datetime

from weft.functions.text import STOP_WORDS

TICKET = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]+-[0-9]+(?![A-Za-z0-9_])")
# Patterns of tickets, permalinks and post ids.
PERMALINK = re.compile(r"/pl/([a-z0-9]{26})(?:[/?#]|$)", re.I)
POST_ID = re.compile(r"[a-z0-9]{26}")
MOST_TERMS, MOST_EXPANSIONS, MOST_SYNONYMS = 8, 24, 8
# Letters that look alike in Latin and Cyrillic, in the same order.
LATIN_ALIKE, CYRILLIC_ALIKE = "aceopxyABCEHKMOPTXY", "асеорхуАВСЕНКМОРТХУ"
# Keys of the English and the Russian keyboard layout, in the same order.
ENGLISH_KEYS, RUSSIAN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,.`", "йцукенгшщзхъфывапролджэячсмитьбюё"
# Latin letter groups for Cyrillic letters, longest first.
TRANSLITERATION = [
    ("shch", "щ"), ("yo", "ё"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("a", "а"), ("b", "б"), ("v", "в"), ("g", "г"), ("d", "д"), ("e", "е"), ("z", "з"), ("i", "и"), ("y", "й"),
    ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("f", "ф"), ("h", "х"), ("c", "к"), ("j", "й"), ("w", "в"), ("x", "кс"), ("q", "к"),
]


class InvalidSubject(ValueError):
    pass


def normalize(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().replace("ё", "е")


@dataclass(frozen=True)
class Subject:
    kind: str
    value: str


@dataclass(frozen=True)
class Probe:
    value: str
    kind: str = "generic"
    phrases: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    expansions: tuple[tuple[str, str, str], ...] = field(default=())


def classify(text: str | None, ticket: str | None = None) -> Subject:
    """A ticket given as such, else a permalink, a post id, a text that is a ticket key, or free text."""
    if ticket is not None:
        if not TICKET.fullmatch(ticket.strip()):
            raise InvalidSubject(f"not a ticket key: {ticket!r}")
        return Subject("ticket", ticket.strip().upper())
    value = (text or "").strip()
    if not value:
        raise InvalidSubject("a subject is needed")
    if found := PERMALINK.search(value):
        return Subject("post", found[1].lower())
    if POST_ID.fullmatch(value):
        return Subject("post", value)
    if TICKET.fullmatch(value):
        return Subject("ticket", value.upper())
    return Subject("text", value)


def mixed_script(token: str) -> str | None:
    """The token in its major script, if it mixes letters that look alike."""
    latin, cyrillic = sum("a" <= c.lower() <= "z" for c in token), sum("а" <= c.lower() <= "я" for c in token)
    if not latin or not cyrillic:
        return None
    table = str.maketrans(LATIN_ALIKE, CYRILLIC_ALIKE) if cyrillic >= latin else str.maketrans(CYRILLIC_ALIKE, LATIN_ALIKE)
    return token.translate(table)


def other_layout(token: str) -> str | None:
    """What was meant if a Russian word was typed on an English layout: no vowels, or keys that hold no Latin letter."""
    letters = [c for c in token.lower() if "a" <= c <= "z"]
    if len(letters) < 4 or not set(token.lower()) <= set(ENGLISH_KEYS):
        return None
    if any(c in "aeiou" for c in letters) and not set(token) & set("[];',.`"):
        return None
    return token.lower().translate(str.maketrans(ENGLISH_KEYS, RUSSIAN_KEYS))


def transliterate(token: str) -> str | None:
    """Latin letters as Cyrillic, longest groups first; only tokens that hold a group of a Russian sound."""
    low = token.lower()
    if not low.isascii() or not low.isalpha() or not re.search("shch|zh|kh|ts|ch|sh|yu|ya|yo", low):
        return None
    out, at = [], 0
    while at < len(low):
        for latin, letter in TRANSLITERATION:
            if low.startswith(latin, at):
                out.append(letter)
                at += len(latin)
                break
        else:
            return None
    return "".join(out)


def expansions(terms: list[str], synonyms: list[list[str]] = ()) -> list[tuple[str, str, str]]:
    """(term, value, kind): synonyms, then repaired scripts, layouts and transliterations, without repeats."""
    out: list[tuple[str, str, str]] = []
    groups = [[normalize(w) for w in g] for g in synonyms]
    for kind, make in (("synonym", lambda t: [w for g in groups if t in g for w in g if w != t][:MOST_SYNONYMS]), ("mixed_script", lambda t: [mixed_script(t)]), ("keyboard_layout", lambda t: [other_layout(t)]), ("transliteration", lambda t: [transliterate(t)])):
        for term in terms:
            for value in make(normalize(term)):
                if value and value != term and value not in [v for _, v, _ in out]:
                    out.append((term, value, kind))
    return out[:MOST_EXPANSIONS]


def probe(value: str, kind: str = "generic", synonyms: list[list[str]] = ()) -> Probe:
    """Quoted parts are phrases; the rest gives terms. Technical probes are not expanded."""
    phrases = tuple(p.strip() for p in re.findall(r'"([^"]+)"', value) if p.strip())
    terms = []
    for t in re.findall(r"[\w-]+", normalize(re.sub(r'"[^"]*"', " ", value) if phrases else value)):
        if len(t) > 1 and t not in STOP_WORDS and t not in terms:
            terms.append(t)
    terms = terms[:MOST_TERMS]
    plain = kind not in ("repository", "file_path", "symbol", "error_message") and "/" not in value
    return Probe(value, kind, phrases, tuple(terms), tuple(expansions(terms, synonyms)) if plain else ())


def resolve(subject: Subject, queries: list[str] = (), typed: list[tuple[str, str]] = (), synonyms: list[list[str]] = ()) -> list[Probe]:
    """Probes of a subject and further queries; a typed probe takes the place of an equal generic one."""
    chosen: dict[str, Probe] = {}
    for value, kind in [*([(subject.value, "generic")] if subject.kind != "post" else []), *((q, "generic") for q in queries), *typed]:
        key = normalize(value)
        if key and (key not in chosen or kind != "generic"):
            chosen[key] = probe(value, kind, synonyms)
    return list(chosen.values())


def requests(p: Probe) -> list[tuple[str, str]]:
    """(channel, value): phrases or the whole probe; with several terms, all and any of them; each term; no repeats."""
    out = [("exact_phrase", x) for x in (p.phrases or (p.value,))]
    if len(p.terms) > 1:
        out += [("strict_fts", " ".join(p.terms)), ("broad_fts", " ".join(p.terms))]
    out += [("term_fts", t) for t in p.terms]
    return list(dict.fromkeys(out))


def typo_channels(term: str) -> list[str]:
    """Fallbacks of an uncovered term: identifiers by prefix first, Cyrillic by likeness alone, Latin words of five letters by likeness."""
    if re.search(r"[\d_-]", term):
        return ["prefix_fts", "trigram"]
    if re.search("[а-я]", term):
        return ["trigram"] if len(term) >= 5 else []
    return ["trigram"] if len(term) >= 5 else ["prefix_fts"] if len(term) >= 4 else []


def trigram_policy(term: str) -> tuple[float, int] | None:
    """(least likeness, most edits) of a term, None if it is too short or long."""
    if not 5 <= len(term) <= 64:
        return None
    if re.search("[а-я]", term):
        return 0.5, 3 if len(term) >= 10 else 2
    return 0.6, 2 if len(term) >= 8 else 1


def filter_date(text: str) -> int:
    """Epoch milliseconds of a date (midnight UTC) or of a time with a zone."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1000)
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("a time needs a zone")
    return int(at.timestamp() * 1000)


def filter_dates(after: str | None, before: str | None) -> tuple[int | None, int | None]:
    a, b = (filter_date(x) if x else None for x in (after, before))
    if a is not None and b is not None and a >= b:
        raise ValueError("after must come before before")
    return a, b
