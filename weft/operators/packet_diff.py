"""Structural comparison of nested rows: every leaf becomes a row of its path, and two sides are joined by path.

Modes are the projections that a packet is given out in, each a set of paths, so that one
flattening serves them all. Fields of the wall clock are masked: they differ between any two runs.
Everything is expressions and one full join by key and path, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

MASK = "<masked>"
#: Wall-clock fields, wherever they stand.
CLOCK = r"(^|\.)(observed_at|age_seconds)$"
#: Nine ways in which a packet is given out, by the paths they show.
MODES = {
    "human": r"^(total_posts|posts\[\d+\]\.(author|excerpt))",
    "brief": r"^(total_posts|tickets|posts\[[0-2]\]\.)",
    "timeline": r"^posts\[\d+\]\.(id|create_at)$",
    "agent": r"^(total_posts|observed_at|tickets|posts\[\d+\]\.(id|author|excerpt))",
    "json": r"^(?!.*\.signals)",
    "agent_signals": r"^(total_posts|observed_at|tickets|posts\[\d+\]\.(id|author|excerpt|signals))",
    "json_full_posts": r"",
    "agent_brief": r"^(total_posts|observed_at|tickets|posts\[[0-2]\]\.(id|author|excerpt))",
    "agent_navigate": r"^(total_posts|posts\[\d+\]\.id)",
}


def leaves(value: Column, kind: DataType, path: Column) -> Column:
    """array<struct<path, value>> of a value's leaves: fields by name, elements by number, entries by key; a null anywhere is one leaf without value."""
    none = F.array(F.struct(path.alias("path"), F.lit(None).cast("string").alias("value")))
    below = lambda own, sign: F.when(path == "", own).otherwise(F.concat(path, F.lit(sign), own))
    if isinstance(kind, StructType):
        parts = [leaves(value.getField(f.name), f.dataType, below(F.lit(f.name), ".")) for f in kind.fields]
        return F.when(value.isNull(), none).otherwise(F.concat(*parts))
    if isinstance(kind, ArrayType):
        each = F.transform(value, lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(value.isNull(), none).otherwise(F.flatten(each))
    if isinstance(kind, MapType):
        each = F.transform(F.map_entries(value), lambda e: leaves(e["value"], kind.valueType, below(e["key"].cast("string"), ".")))
        return F.when(value.isNull(), none).otherwise(F.flatten(each))
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))


def flattened(rows: DataFrame, keys: list[str], masks: str = CLOCK) -> DataFrame:
    """(keys, path, value): all leaves of the columns that are no keys, masked values in place of the clock's."""
    parts = [leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in rows.schema.fields if f.name not in keys]
    each = rows.select(*keys, F.explode(F.concat(*parts)).alias("leaf")).select(*keys, "leaf.path", "leaf.value")
    return each.withColumn("value", F.when(F.col("path").rlike(masks), MASK).otherwise(F.col("value")))


def differences(before: DataFrame, after: DataFrame, keys: list[str], masks: str = CLOCK) -> DataFrame:
    """(keys, path, before, after, change): leaves that one side alone has (removed, added) or that differ (changed)."""
    one = lambda df, name: flattened(df, keys, masks).select(*keys, "path", F.struct("value").alias(name))
    both = one(before, "b").join(one(after, "a"), [*keys, "path"], "full")
    change = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(~F.col("a.value").eqNullSafe(F.col("b.value")), "changed")
    return both.select(*keys, "path", F.col("b.value").alias("before"), F.col("a.value").alias("after"), change.alias("change")).where("change IS NOT NULL")


def by_mode(changes: DataFrame, keys: list[str], modes: dict[str, str] = MODES) -> DataFrame:
    """(keys, mode, added, removed, changed): how each mode's packet differs; modes without a difference have no row."""
    shown = F.array_compact(F.array(*[F.when(F.col("path").rlike(p), m) for m, p in modes.items()]))
    each = changes.select(*keys, "change", F.explode(shown).alias("mode"))
    return each.groupBy(*keys, "mode").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")))
