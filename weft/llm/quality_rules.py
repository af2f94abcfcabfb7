"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule is a named ratio of a document's measures with a lower and an upper bound.
compile_rules() turns the table into one boolean column; adding a rule is adding a row.

Null text counts as empty: no words, so the document fails on its length. Rows are
judged one by one; repeated rows get equal verdicts, and an empty table gives an empty
result. Columns other than the text are passed through untouched; in quality_rules()
the measures replace columns of the same name, in keep_good() nothing does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import named

SEPARATORS = r"[\x20\x09-\x0D]+"
WINDOW = 8

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be as with by this are at an from or not have had he she they we you "
    "le la les de des du un une et est en que qui dans pour pas sur au avec ce il elle "
    "der die das und ist von zu den mit ein eine nicht sich auf dem im es auch "
    "el los las y del que un una por con para no se lo su al como más o"
).split()
#: Hyphens, stars and bullets that begin list lines; ends of lines that were cut.
BULLET, ELLIPSIS = r"^[ \t]*[-*•‣▪]", r"(\.\.\.|…)[ \t]*$"


@dataclass(frozen=True)
class Rule:
    """Passes when low <= measure <= high; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.
RULES = (
    Rule("words", "n_words", 20, None),
    Rule("repeated words", "100 * n_repeat_words / n_words", None, 30),
    Rule("mean word length", "word_chars / n_words", 2.5, 14),
    Rule("symbols to words", "n_symbols / n_words", None, 0.25),
    Rule("stop words", "n_stop_words / n_words", 0.05, None),
    Rule("upper-case letters", "n_upper_letters / word_chars", None, 0.3),
    Rule("words said again at once", "n_stutters / n_words", None, 0.2),
    Rule("exclamations", "n_exclamations / n_words", None, 0.3),
    Rule("duplicate lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("bullet lines", "n_bullet_lines / n_lines", None, 0.9),
    Rule("cut lines", "n_cut_lines / n_lines", None, 0.3),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_stop_words", "n_upper_letters", "n_stutters", "n_exclamations", "n_bullet_lines", "n_cut_lines")


def repeat_words(starts: Column) -> Column:
    """Words covered by the windows that begin at these ascending places."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def _joined(of: str, step: int):
    return lambda x, i: F.xxhash64(x, F.get(F.col(of), i + step))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns plus BASE and MORE as long columns. Scratch columns have names that no input is likely to hold."""
    t = F.coalesce(named(text), F.lit(""))
    w, h, lines = F.col("__weft_words"), F.col("__weft_hashes"), F.col("__weft_lines")
    out = docs.withColumns({"__weft_words": F.filter(F.split(t, SEPARATORS), lambda x: x != ""), "__weft_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    out = out.withColumn("__weft_wh", F.transform(w, lambda x: F.xxhash64(x)))
    wh = F.col("__weft_wh")
    # Window hashes by doubling: pairs, then fours, then eights. slice() copies its whole array, so it must not stand inside a lambda.
    for name, of, step in (("__weft_h2", "__weft_wh", 1), ("__weft_h4", "__weft_h2", 2), ("__weft_h8", "__weft_h4", 4)):
        out = out.withColumn(name, F.transform(of, _joined(of, step)))
    out = out.withColumn("__weft_hashes", F.slice("__weft_h8", 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))))
    # Each step below is a column of its own: an expression inside a lambda would be evaluated again for each element.
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("__weft_pairs", F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    pairs = F.col("__weft_pairs")
    at = lambda k: F.get(pairs, k)["h"]
    twice = F.filter(pairs, lambda p, k: F.coalesce(p["h"] == at(k - 1), F.lit(False)) | F.coalesce(p["h"] == at(k + 1), F.lit(False)))
    out = out.withColumn("__weft_starts", F.array_sort(F.transform(twice, lambda p: p["i"])))
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeat_words(F.col("__weft_starts")),
            "n_lines": F.size(lines).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            "n_upper_letters": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
            "n_stutters": F.size(F.filter(wh, lambda x, i: F.coalesce(x == F.get(wh, i - 1), F.lit(False)))).cast("long"),
            "n_exclamations": F.regexp_count(t, F.lit("!")).cast("long"),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(BULLET))).cast("long"),
            "n_cut_lines": F.size(F.filter(lines, lambda x: x.rlike(ELLIPSIS))).cast("long"),
        }
    )
    return out.drop("__weft_words", "__weft_lines", "__weft_wh", "__weft_hashes", "__weft_h2", "__weft_h4", "__weft_h8", "__weft_pairs", "__weft_starts")


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """(kept, the names of failed rules). A ratio of nothing (division by zero) passes; the length rule catches empty texts."""
    failed = []
    for rule in rules:
        value = F.expr(re_divide(rule.measure))
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < F.lit(rule.low))
        if rule.high is not None:
            bad = bad | (value > F.lit(rule.high))
        failed.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule.name)))
    names = F.array_compact(F.array(*failed))
    return F.size(names) == 0, names


def re_divide(measure: str) -> str:
    """a / b as try_divide(a, b), so that an empty denominator gives null instead of an error."""
    a, slash, b = measure.partition(" / ")
    return f"try_divide({a}, {b})" if slash else a


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """All columns, the measures, base_failed, kept, and failed_rules (array of names)."""
    out = measures(docs, text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept, names = compile_rules(rules)
    return out.withColumns({"base_failed": base, "kept": ~base & kept, "failed_rules": names})


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever their names.

    The optimiser would copy the measures into a filter behind them, and evaluate them
    there element by element. It leaves a condition alone that it takes for not
    deterministic, so the verdict is joined with one that always holds; a test reads the plan.
    """
    # Columns go by number while they are judged, so that none can clash with a measure.
    scratch = [f"__weft_own{i}" for i in range(len(docs.columns))]
    judged = quality_rules(docs.toDF(*scratch), scratch[docs.columns.index(text)], rules)
    kept = judged.withColumn("__weft_keep", F.col("kept") & (F.monotonically_increasing_id() >= 0)).where("__weft_keep")
    return kept.select(*(F.col(a).alias(b) for a, b in zip(scratch, docs.columns, strict=True)))
