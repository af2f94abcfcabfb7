"""Text functions as Column expressions; only Unicode normalisation needs Python, and only for non-ASCII text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English and Russian stop words, normalised.
STOP_WORDS = (
    "a an and are for from in is of on or the to with "
    "без более был была были было быть вам вас весь все всего всех во вы где даже для до его ее если есть еще же за здесь или им их как ко когда кто ли либо мне может мы над надо наш не него нее нет ни но ну он от по под почему при про со так "
    "также такой там тем того тоже только уже хотя чем что чтобы эта эти это"
).split()
# Patterns of tickets, addresses, permalinks and words, with ASCII borders.
TICKET = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]+-[0-9]+(?![A-Za-z0-9_])"
URL = r"(?i)https?://[^\s<>()]+"
PERMALINK = r"(?i)/pl/([a-z0-9]{26})(?:[/?#]|$)"
TRACKER = r"(?:tracker\.|jira\.|[^/\s]*\.(?:tracker|jira)\.|[^/\s]*youtrack|(?:[^/\s]*\.)?atlassian\.net)"
WORD = r"[\p{L}\p{N}]+"
QUERY_WORD = r"[\p{L}\p{N}_-]+"
# Patterns of entity kinds: (kind, pattern, group).
ENTITY_PATTERNS = [
    ("commit", r"(?i)(?<![A-Za-z0-9_])[0-9a-f]{7,40}(?![A-Za-z0-9_])", 0),
    ("pull_request", r"(?i)(?<![A-Za-z0-9_])(?:PR|MR)\s*[#!][0-9]{1,7}(?![A-Za-z0-9_])", 0),
    ("file_path", r"(?iu)(?:^|[\s(\"'`])((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+\.(?:[cm]?[jt]sx?|py|go|rs|java|kt|rb|php|cs|cpp|h|hpp|sql|ya?ml|json|toml|ini|conf|md))(?![\p{L}\p{N}_])", 1),
    ("package", r"(?:^|\s)(@[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)(?=$|\s|[),.;:])", 1),
    ("symbol", r"`([A-Za-z_$][A-Za-z0-9_$.]{2,})`", 1),
    ("symbol", r"(?<![A-Za-z0-9_])([A-Za-z_$][A-Za-z0-9_$]{2,})\s*\(", 1),
    ("error_code", r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+(?![A-Za-z0-9_])", 0),
    ("username", r"(?:^|\s)@([A-Za-z0-9._-]{2,64})(?![A-Za-z0-9_])", 1),
    ("repository", r"(?iu)(?:^|[\s(])(?:repo(?:sitory)?|репозитор(?:ий|ия))\s*[:=]?\s*([A-Za-z0-9][A-Za-z0-9_./-]{1,100})", 1),
    ("service", r"(?iu)(?:^|[\s(])(?:service|сервис)\s*[:=]?\s*([A-Za-z0-9][A-Za-z0-9_./-]{1,100})", 1),
]
CODE_HOST = r"(?i)^https?://[^/]*(?:github\.com|gitlab\.)[^/]*/+([^/?#]+)/+([^/?#]+)"
# Phrases whose values are blanked, applied in this order.
SECRETS = [
    (r"(?iu)(password|passwd|пароль|pass)\s*[:=]\s*\S+", "$1: [REDACTED]"),
    (r"(?iu)(login|логин|username|user|email)\s*[:=]\s*\S+", "$1: [REDACTED]"),
    (r"(?iu)(token|api[_-]?key|secret|bearer)\s*[:=]\s*\S+", "$1: [REDACTED]"),
    (r"(?<![A-Za-z0-9_])(Bearer)\s+[A-Za-z0-9._\-+=/]{8,}", "$1 [REDACTED]"),
]


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else x)


def normalize(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, lower case, ё as е. ascii_only promises text that NFKC leaves alone, and stays in the JVM."""
    return F.translate(F.lower(text if ascii_only else _nfkc(text)), "ё", "е")


def tokens(text: Column) -> Column:
    """Index tokens: letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_terms(text: Column, most: int = 8) -> Column:
    """Distinct query words over one character that are no stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(QUERY_WORD), F.lit(0)))
    return F.slice(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)), 1, most)


def bounded(needle: str) -> str:
    """A pattern for a needle that is not part of a longer token, on the sides where it is itself a token."""
    token = r"[\p{L}\p{N}_]"
    inner = needle.strip()
    left = rf"(?<!{token})" if inner[:1].isalnum() or inner[:1] == "_" else ""
    right = rf"(?!{token})" if inner[-1:].isalnum() or inner[-1:] == "_" else ""
    return rf"{left}\Q{inner}\E{right}"


def contains_exact(text: Column, needle: str) -> Column:
    """Whether the text holds the needle as a token sequence; an empty needle is held by nothing."""
    return text.rlike(bounded(needle)) if needle.strip() else F.lit(False)


def ticket_keys(text: Column) -> Column:
    """Distinct upper-case ticket keys in order; URLs outside of trackers are masked first."""
    masked = F.regexp_replace(text, rf"(?i)https?://(?!{TRACKER})[^\s<>()]+", " ")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(TICKET), F.lit(0)), F.upper)))


def permalink_id(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, PERMALINK, 1))


def urls(text: Column) -> Column:
    """Addresses without the punctuation behind them."""
    return F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?\])}]+$", ""))


def entities(text: Column) -> Column:
    """Array of (kind, value) of all kinds, with repeats: addresses and permalinks, repositories, tickets, and what the patterns name."""
    found = urls(text)
    link = F.transform(found, lambda u: F.struct(F.when(u.rlike(PERMALINK), "permalink").otherwise("url").alias("kind"), u.alias("value")))
    hosted = F.transform(F.filter(found, lambda u: u.rlike(CODE_HOST)), lambda u: F.struct(F.lit("repository").alias("kind"), F.concat(F.regexp_extract(u, CODE_HOST, 1), F.lit("/"), F.regexp_extract(u, CODE_HOST, 2)).alias("value")))
    lists = [link, hosted, F.transform(ticket_keys(text), _tagged("ticket"))]
    for kind, pattern, group in ENTITY_PATTERNS:
        lists.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), _tagged(kind)))
    return F.concat(*lists)


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def redact(text: Column) -> Column:
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text


def excerpt(text: Column, most: int = 240) -> Column:
    """Redacted, cut to a number of code points with an ellipsis."""
    clean = redact(text)
    return F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most - 1)), F.lit("…"))).otherwise(clean)


def snippet(text: Column, needle: str, around: int = 100) -> Column:
    """The text around the first match, if it is long."""
    at = F.instr(F.lower(text), needle.lower())
    cut = F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(needle)))
    return F.when(F.length(text) <= 240, text).when(at == 0, F.left(text, F.lit(240))).otherwise(cut)


def trigrams(text: Column) -> Column:
    """Distinct trigrams; none for fewer than three characters."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.length(text) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigram_similarity(token: Column, probe: str, most_edits: int) -> Column:
    """Dice likeness of trigram sets, 0 beyond the edit distance."""
    own = F.array(*[F.lit(g) for g in dict.fromkeys(probe[i : i + 3] for i in range(len(probe) - 2))])
    dice = 2 * F.size(F.array_intersect(trigrams(token), own)) / (F.size(trigrams(token)) + F.size(own))
    return F.when((F.levenshtein(token, F.lit(probe), most_edits) >= 0) & (F.length(token) >= 3), dice).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    """Parts that end with . ! ? or a line break, with it; a blank tail is dropped."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$"), F.lit(0)), lambda s: s.rlike(r"[.!?\n]$") | (F.trim(s) != ""))


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def concept_token(concept: Column) -> Column:
    return F.concat(F.lit("zzconcept"), F.lower(F.hex(F.encode(concept, "UTF-8"))))


def confidence(weights: Column) -> Column:
    return F.round(F.least(F.lit(0.95), F.array_max(weights) + F.least(F.lit(0.25), (F.size(weights) - 1) * 0.08)), 2)


def csv_field(text: Column, delimiter: str = ",") -> Column:
    return F.when(text.rlike(f'["\r\n{delimiter}]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def file_kind(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp"), "image").when(ext.isin("csv", "tsv", "xlsx", "xls", "ods", "json", "ndjson", "log", "sql", "txt"), "data").when(ext.isin("mp3", "mp4", "wav", "mov"), "media").otherwise("other")
