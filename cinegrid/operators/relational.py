"""Filters, keyed views, set operations and ranking of catalogue tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegrid.functions.scalars import number, random_key

Range = tuple[float | None, float | None]


# -- filters

def in_ranges(ranges: Mapping[str, Range], columns: Iterable[str]) -> Column:
    """True where every field lies within its bounds, both inclusive. A field that is missing in the row (null, NaN, or no
    column at all) fails; a field without any bound is not asked."""
    have = set(columns)
    tests = [F.lit(True)]
    for field, (lo, hi) in ranges.items():
        if lo is None and hi is None:
            continue
        if field not in have:
            return F.lit(False)
        v = number(F.col(f"`{field}`"))
        tests.append(v.isNotNull())
        tests += [v >= lo] if lo is not None else []
        tests += [v <= hi] if hi is not None else []
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def parse_ranges(parameters: Mapping[str, object]) -> dict[str, Range]:
    """min_* and max_* parameters as ranges; nulls and empty texts are no bound. Junk raises ValueError."""
    out: dict[str, list[float | None]] = {}
    for key, value in parameters.items():
        side = {"min_": 0, "max_": 1}.get(key[:4])
        if side is not None and value not in (None, ""):
            out.setdefault(key[4:], [None, None])[side] = float(value)
    return {k: (v[0], v[1]) for k, v in out.items()}


def only_active(ranges: Mapping[str, Range], active: Iterable[str]) -> dict[str, Range]:
    """Ranges of fields that are hidden just now are dropped before planning."""
    shown = set(active)
    return {k: v for k, v in ranges.items() if k in shown}


def ternary(df: DataFrame, members: DataFrame, choice: str, key: str) -> DataFrame:
    """``any``: all rows; ``only``: rows whose key is a member; ``none``: the others. Null keys are no members."""
    if choice == "any":
        return df
    how = {"only": "left_semi", "none": "left_anti"}.get(choice)
    if how is None:
        raise ValueError(f"unknown choice {choice!r}")
    return df.join(members.select(key).distinct(), key, how)


def selected(df: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """Selected rows as often as they are selected; what is selected but not there is ignored."""
    return selection.select(key).join(df, key)


def incomplete(samples: DataFrame, artifacts: DataFrame, expected: list[str]) -> DataFrame:
    """Samples that lack at least one of the expected artifacts."""
    wanted = samples.select("sample_id").distinct().select("sample_id", F.explode(F.array(*map(F.lit, expected))).alias("artifact"))
    return wanted.join(artifacts.select("sample_id", "artifact").distinct(), ["sample_id", "artifact"], "left_anti").select("sample_id").distinct()


def fresh(scanned: DataFrame, included: DataFrame, key: str) -> DataFrame:
    """(key): what was scanned and is not taken in yet, each once; a null key is nothing."""
    return scanned.select(key).where(F.col(key).isNotNull()).distinct().join(included.select(key), key, "left_anti")


def available(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The rows whose file is there, each as often as it stands in ``rows``, however often the file is listed."""
    return rows.join(files.select(key).distinct(), key)


def named(rows: DataFrame, *fields: str) -> DataFrame:
    """The rows in which none of the fields is null or an empty text: what a source must have to be taken."""
    return rows.where(reduce(Column.__and__, (F.coalesce(F.col(f) != "", F.lit(False)) for f in fields)))


# -- keyed views

def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that comes last by ``order``, then by the other columns; null comes before everything. An
    aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"row.`{c}`").alias(c) for c in [*order, *rest]))


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key: the first one by ``ordinal``, which is unique. Null keys count as equal."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.col(ordinal)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"row.`{c}`").alias(c) for c in rest))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A keyed view updated field by field: the new value where there is one, else the old one."""
    fields = list(dict.fromkeys(c for c in [*old.columns, *new.columns] if c != key))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *(F.col(f"`{c}`").alias(f"{name}_{i}") for i, c in enumerate(fields) if c in df.columns))

    both = side(old, "old").join(side(new, "new"), key, "full_outer")
    pick = [F.coalesce(*(F.col(c) for c in (f"new_{i}", f"old_{i}") if c in both.columns)).alias(f) for i, f in enumerate(fields)]
    return both.select(key, *pick)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A keyed view with whole rows replaced."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


# -- ranking

def sorted_by(df: DataFrame, field: str, direction: str = "desc", ordinal: str = "ordinal", name: str = "video_name", seed: int = 0) -> list[Column]:
    """Sort keys: by name, shuffled by a seed, by a number with missing values last in both directions, or as they stand.
    Always stable: equal rows keep the order of ``ordinal``."""
    down = direction != "asc"
    if not field:
        return [F.col(ordinal).asc()]
    if field == "random":
        return [random_key(seed, F.col(name)).asc(), F.col(ordinal).asc()]
    if field == "name":
        return [F.col(name).desc() if down else F.col(name).asc(), F.col(ordinal).asc()]
    if field not in df.columns:
        return [F.col(ordinal).asc()]
    v = number(F.col(f"`{field}`"))
    return [v.desc_nulls_last() if down else v.asc_nulls_last(), F.col(ordinal).asc()]


def page(df: DataFrame, order: list[Column], number_: int, size: int) -> DataFrame:
    """The rows of a page, from 1 on; beyond the end none. Only the rows up to the page's end are sorted."""
    if number_ < 1 or size < 1:
        raise ValueError("page and size must be at least 1")
    return df.orderBy(*order).offset((number_ - 1) * size).limit(size)


def sample(df: DataFrame, n: int, seed: int, name: str, ordinal: str) -> DataFrame:
    """n rows without replacement, the same for the same seed: the first ones of a shuffle by hash."""
    return df.orderBy(random_key(seed, F.col(name).cast("string")), F.col(ordinal)).limit(n)


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Numbers consecutive slices of ``size`` rows in a column ``batch``. Ranks come from a range sort with counted parts, so no
    row passes through a single task."""
    return positions(df, order).withColumn("batch", F.floor(F.col("position") / size).cast("int")).drop("position")


def positions(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Adds the column ``position``: each row's place, from 0, in the order. Two passes: parts are range-sorted and counted;
    each row's place is its place in the part plus the rows of the parts before."""
    from cinegrid.scratch import written

    parted = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parted = written(parted, "parts")
    counts = parted.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    before = counts.select("part", before)  # one row per part
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parted.withColumn("within", within).join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.col("within")).drop("part", "within", "before")


def numbered(df: DataFrame, order: list, size: int) -> DataFrame:
    """Adds the column ``page``: on which page, from 1, each row stands in the order."""
    return positions(df, order).withColumn("page", (F.floor(F.col("position") / size) + 1).cast("int")).drop("position")


def with_eta(df: DataFrame, group: str, order: list[str], done: str, seconds: str) -> DataFrame:
    """Adds the columns ``done_so_far``, ``elapsed`` and ``eta``: of the batches of a run, in their order, what is done and how long it took up
    to each, and the seconds that the rest will take at that rate. null before anything is done; null counts as nothing."""
    w = Window.partitionBy(group)
    to_here = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n, took = F.coalesce(F.col(done), F.lit(0)), F.coalesce(F.col(seconds), F.lit(0.0))
    rows = df.withColumns({"done_so_far": F.sum(n).over(to_here), "elapsed": F.sum(took).over(to_here), "all": F.sum(n).over(w)})
    return rows.withColumn("eta", F.try_divide((F.col("all") - F.col("done_so_far")) * F.col("elapsed"), F.col("done_so_far"))).drop("all")


def split(df: DataFrame, order: list[str], parts: int, name: str) -> DataFrame:
    """Numbers equal consecutive shares in a column ``name``; what is left over goes to the last."""
    n = F.lit(df.count())
    share = F.greatest(F.floor(n / parts), F.lit(1))
    return positions(df, order).withColumn(name, F.least(F.floor(F.col("position") / share), F.lit(parts - 1)).cast("int")).drop("position")


# -- sets

def union_of(*sides: DataFrame) -> DataFrame:
    """The distinct values of one-column tables; null is a value."""
    return reduce(DataFrame.union, sides).distinct()


def shared(requested: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """What both have, each once; null is a value."""
    return requested.select(key).intersect(there.select(key))


def without(all_: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """What the first has and the second has not, each once; null is a value."""
    return all_.select(key).subtract(skipped.select(key))


def toggled(selection: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The names in one of the two but not in both."""
    a, b = selection.select(key).distinct(), names.select(key).distinct()
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n): values that occur more than once, for checks of disjointness."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
