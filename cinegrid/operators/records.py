"""Delimited records that fail to parse.

Every column is first a nullable text; casts and constraints are columns that name what is wrong, gathered in an array
of errors; a record without errors is valid. All of it is one projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegrid.functions.scalars import bound

#: The forms a record must have.
CLIP_FILE = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.mp4\z"
NUMBER = r"\A *(?:[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)? *\z"
BAD_SIGN = r"[\x00-\x08\x0B\x0C\x0E-\x1F�]"


@dataclass(frozen=True)
class Field:
    """A column of the record: its type once valid, and what makes its text unacceptable (None: nothing)."""

    name: str
    kind: str = "string"
    broken: Callable[[Column], Column] | None = None


#: The layout of ``short.csv``.
SHORT_CSV = (
    Field("clip_id", broken=lambda c: ~c.rlike(CLIP_FILE)),
    Field("Brief Description"),
    Field("Summarized Description", broken=lambda c: c.rlike(BAD_SIGN)),
    Field("vtss_score", "double", lambda c: ~c.rlike(NUMBER)),
    Field("motion_score", "double"),
    Field("video_clip_score", "double"),
)


def _quoting_holds(pieces: Column) -> Column:
    """Of a record split at its quotes: pieces at odd places lie within quotes. Between two quoted stretches stands
    either nothing (a doubled quote) or text that begins and ends at a comma."""
    last = F.size(pieces) - 1

    def wrong(piece: Column, at: Column) -> Column:
        opens = (at == 0) | piece.startswith(",")
        closes = (at == last) | piece.endswith(",")
        return (at % 2 == 0) & (last > 0) & (piece != "") & ~(opens & closes)

    return (last % 2 == 0) & (F.size(F.filter(pieces, wrong)) == 0)


def _fields(pieces: Column) -> Column:
    """The fields of a well-quoted record, without enclosing quotes, doubled quotes halved."""
    last = F.size(pieces) - 1

    def kept(piece: Column, at: Column) -> Column:
        plain = F.replace(piece, F.lit("~"), F.lit("~0"))
        doubled = (at > 0) & (at < last) & (piece == "")
        return F.when(at % 2 == 1, F.replace(plain, F.lit(","), F.lit("~1"))).when(doubled, F.lit('"')).otherwise(plain)

    cells = F.split(F.concat_ws("", F.transform(pieces, kept)), ",", -1)
    return F.transform(cells, lambda c: F.replace(F.replace(c, F.lit("~1"), F.lit(",")), F.lit("~0"), F.lit("~")))


def parsed(df: DataFrame, key: str, raw: str, layout: tuple[Field, ...] = SHORT_CSV) -> DataFrame:
    """(key, record struct of nullable texts, errors and warnings array<struct<reason, column>>), one row per row of ``df``.

    Reasons in order: ``quoting``, ``columns``, ``value``. After broken quoting or a wrong number of fields the
    later rules are not asked and ``record`` is null. A null or empty text is a record with one empty field, so it fails
    with ``columns``. Warnings don't make a record fail: ``junk`` names a column of numbers without a rule whose text is no number,
    so that its value will be null. Repeated rows stay. Columns of ``df`` besides the two are ignored.
    """
    pieces = F.split(F.coalesce(F.col("raw"), F.lit("")), '"', -1)
    read = bound(pieces, lambda p: F.when(_quoting_holds(p), _fields(p)))
    # behind the explode nothing is evaluated a second time for a filter
    cells = df.select(F.col(key).alias("id"), F.col(raw).alias("raw")).select("id", F.explode(F.array(read)).alias("cells"))
    quoted, counted = F.col("cells").isNotNull(), F.size("cells") == len(layout)

    def error(when: Column, reason: str, column: str | None) -> Column:
        return F.when(when, F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column")))

    rules = [error(~quoted, "quoting", None), error(quoted & ~counted, "columns", None)]
    rules += [error(quoted & counted & f.broken(F.get("cells", F.lit(i))), "value", f.name) for i, f in enumerate(layout) if f.broken]
    record = F.when(quoted & counted, F.struct(*(F.get("cells", F.lit(i)).alias(f.name) for i, f in enumerate(layout))))

    def junk(i: int, f: Field) -> Column:
        text = F.trim(F.get("cells", F.lit(i)))
        return quoted & counted & (text != "") & text.try_cast(T._parse_datatype_string(f.kind)).isNull()

    doubts = [error(junk(i, f), "junk", f.name) for i, f in enumerate(layout) if f.kind != "string" and not f.broken]
    none = F.array().cast("array<struct<reason:string,column:string>>")
    warnings = F.array_compact(F.array(*doubts)) if doubts else none
    found = F.struct(record.alias("record"), F.array_compact(F.array(*rules)).alias("errors"), warnings.alias("warnings"))
    return cells.select(F.col("id").alias(key), F.explode(F.array(found)).alias("found")).select(key, "found.record", "found.errors", "found.warnings")


def rejected(df: DataFrame, key: str, raw: str, layout: tuple[Field, ...] = SHORT_CSV) -> DataFrame:
    """(key, reason, errors) of the records that fail, with the first reason that applies."""
    bad = parsed(df, key, raw, layout).where(F.size("errors") > 0)
    return bad.select(key, F.get("errors", F.lit(0))["reason"].alias("reason"), "errors")


def valid(df: DataFrame, key: str, raw: str, layout: tuple[Field, ...] = SHORT_CSV) -> DataFrame:
    """The records without errors as typed rows: (key, one column per field). A number's text that is empty, blank or
    (where no rule forbids it) no number gives null."""
    good = parsed(df, key, raw, layout).where(F.size("errors") == 0)

    def typed(f: Field) -> Column:
        cell = F.col("record")[f.name]
        if f.kind == "string":
            return cell.alias(f.name)
        return F.trim(cell).try_cast(T._parse_datatype_string(f.kind)).alias(f.name)

    return good.select(key, *(typed(f) for f in layout))
