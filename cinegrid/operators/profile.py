"""Profiles of results: field statistics, histograms, correlations, words, sequences."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegrid.functions.scalars import bound, content_words, log_scaled, number

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DecimalType)
BINS = 60
MOST_BINS = 1000


def numeric_fields(df: DataFrame, *without: str) -> list[str]:
    """Columns that hold numbers (booleans count), in the table's order."""
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in without]


def tall(df: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """(key, field, value): one row per number that is there; nulls and NaN are not."""
    fields = numeric_fields(df, key) if fields is None else fields
    cells = F.array(*(F.struct(F.lit(f).alias("field"), number(F.col(f"`{f}`")).alias("value")) for f in fields)) if fields else F.array().cast("array<struct<field:string,value:double>>")
    return df.select(F.col(key), F.explode(cells).alias("c")).select(key, "c.field", "c.value").where("value is not null")


def field_stats(values: DataFrame) -> DataFrame:
    """(field, min, max, count) of tall values; values of a field from several sources count all."""
    return values.groupBy("field").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(1.0)
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), ((v - lo) / width).cast("int")))


def histograms(values: DataFrame, axes: DataFrame, bins: int = BINS) -> DataFrame:
    """(field, bin, count): equal bins between the axis' min and max, zeros included; what lies outside counts in the outer
    bins. ``axes``: (field, min, max), one row per field, so every field of it comes out even if it has no value."""
    if not 1 <= bins <= MOST_BINS:
        raise ValueError(f"bins must be from 1 to {MOST_BINS}")
    axes = axes.select("field", "min", "max")
    hits = values.join(F.broadcast(axes), "field").groupBy("field", _bin(F.col("value"), F.col("min"), F.col("max"), bins).alias("bin")).agg(F.count("*").alias("n"))
    every = axes.select("field", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(hits, ["field", "bin"], "left").select("field", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def panel_histogram(df: DataFrame, value: str, bins: int = 20, log: bool = False) -> DataFrame:
    """(bin, count) of the panel's small histograms: the position is taken before it is multiplied by the bins, an order of
    operations of its own; a range of zero counts as one."""
    v = number(F.col(value))
    rows = df.select((log_scaled(v) if log else v).alias("v")).where("v is not null")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    at = F.floor((F.col("v") - F.col("lo")) / span * bins).cast("int")
    hits = rows.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(hits, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def summaries(values: DataFrame) -> DataFrame:
    """(field, mean, min, max, std) with the population's deviation."""
    v = F.col("value")
    return values.groupBy("field").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))


def summary_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(field, difference): mean in a minus mean in b, for fields of both."""
    a = summaries(a).select("field", F.col("mean").alias("a"))
    b = summaries(b).select("field", F.col("mean").alias("b"))
    return a.join(b, "field").select("field", (F.col("a") - F.col("b")).alias("difference"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over the rows that have both; 0 for fewer than two rows or a constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def correlations(df: DataFrame, fields: list[str]) -> DataFrame:
    """(x, y, r) for all pairs of fields, in one pass over the rows."""
    pairs = list(combinations(fields, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    row = df.agg(*(correlation(number(F.col(f"`{x}`")), number(F.col(f"`{y}`"))).alias(f"r{i}") for i, (x, y) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def status_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, before, after) of the counts that differ; keys of one side only are no change."""
    a, b = before.toDF("key", "before"), after.toDF("key", "after")
    return a.join(b, "key").where("before <> after")


def widened(*ranges: DataFrame) -> DataFrame:
    """(field, min, max, count): ranges that only grow over several result sets."""
    every = ranges[0]
    for r in ranges[1:]:
        every = every.unionByName(r)
    return every.groupBy("field").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.max("count").alias("count"))


# -- words

def word_frequency(df: DataFrame, caption: str, top: int = 30) -> DataFrame:
    """(word, count, pct): content words by occurrences, ties by word; pct is the share of all rows (null captions too) that hold
    the word."""
    # one pass: every occurrence counts once, every distinct word of a row once
    def cells(words: Column, n: int, rows: int) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(n).alias("n"), F.lit(rows).alias("rows")))

    both = bound(content_words(F.col(caption)), lambda words: F.concat(cells(words, 1, 0), cells(F.array_distinct(words), 0, 1)))
    held = df.select(F.explode(both).alias("c")).select("c.*")
    counts = held.groupBy("word").agg(F.sum("n").alias("count"), F.sum("rows").alias("rows"))
    total = df.agg(F.count("*").alias("total"))
    best = counts.orderBy(F.desc("count"), "word").limit(top)
    return best.crossJoin(F.broadcast(total)).select("word", "count", (F.col("rows") / F.col("total")).alias("pct"))


def word_difference(a: DataFrame, b: DataFrame, caption: str, top: int = 150) -> DataFrame:
    """(word, count, pct, difference): the top words of a with the share they lack in b (0 where b's top words, twice as many, do not
    hold it), by absolute difference, ties by word."""
    mine = word_frequency(a, caption, top)
    other = word_frequency(b, caption, 2 * top).select("word", F.col("pct").alias("pct_b"))
    diff = mine.join(other, "word", "left").withColumn("difference", F.col("pct") - F.coalesce("pct_b", F.lit(0.0)))
    return diff.orderBy(F.desc(F.abs("difference")), "word").limit(top).drop("pct_b")


# -- sequences

def sequence_summary(df: DataFrame, key: str, value: str, decimals: int = 4) -> DataFrame:
    """(key, mean, max, min, std): population deviation; zeros where a key has no value."""
    v = number(F.col(value))
    parts = {"mean": F.avg(v), "max": F.max(v), "min": F.min(v), "std": F.stddev_pop(v)}
    return df.groupBy(key).agg(*(F.round(F.coalesce(c, F.lit(0.0)), decimals).alias(n) for n, c in parts.items()))


def sequence_variability(df: DataFrame, key: str, order: list[str], value: str, decimals: int = 4) -> DataFrame:
    """(key, variability): population deviation of the first differences; 0 for fewer than two values."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = df.withColumn("step", F.col(value) - F.lag(value).over(w))
    return steps.groupBy(key).agg(F.round(F.coalesce(F.stddev_pop("step"), F.lit(0.0)), decimals).alias("variability"))


def path_length(df: DataFrame, group: str, order: list[str], value: str, decimals: int = 3) -> DataFrame:
    """(group, path): the sum of the absolute steps of each sequence, null for fewer than two values."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("step", step).groupBy(group).agg(F.round(F.sum(F.abs("step")), decimals).alias("path"))


def consecutive(df: DataFrame, key: str, order: list[str], value: str, distance) -> DataFrame:
    """(key, order..., distance) between each value and the one before it; a key's first value has none."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = df.select(key, *order, distance(F.lag(value).over(w), F.col(value)).alias("distance"))
    return pairs.where("distance is not null")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def magnitude(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def per_source(sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(source, key, field, value): the numbers of several sources, none of them dropped where names collide."""
    out = None
    for name, df in sources.items():
        part = tall(df, key).select(F.lit(name).alias("source"), F.col(key).cast("string").alias("key"), "field", "value")
        out = part if out is None else out.unionByName(part)
    return out
