"""Pairs of rows from pairs of classes of equal rows.

Equal rows are worked on once, by a representative. ``class_pairs`` turns the result back into pairs of rows. A class,
or two linked classes, with at most ``expand`` pairs come out as all their pairs; with ``expand`` None all do. Beyond it the
pairs of a class grow with the square of its rows, so it comes out as a star: each row with the representative. No
link between different contents is lost in either form, and each row is in some pair. A star is for rows that are
equal in every respect; where a class holds different contents, or every pair is a case, ``expand`` must be None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPAND = 250_000
#: Rows of one class in a part of its pairs.
PART = 1024


def paired(left: DataFrame, right: DataFrame, on: str, n: str) -> DataFrame:
    """``left`` and ``right`` joined by ``on``, a large class in parts: its ``n`` rows of the right side are cut into parts of about
    PART, and each left row goes to every part, so that no task has all pairs of a class."""
    parts = F.greatest(F.ceil(F.col(n) / PART), F.lit(1)).cast("int")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    columns = [c for c in right.columns if c not in (on, n)]
    right = right.withColumn("part", F.pmod(F.xxhash64(*columns), parts).cast("int")).drop(n)
    return left.join(right, [on, "part"]).drop("part")


def class_pairs(members: DataFrame, links: DataFrame | None = None, expand: int | None = EXPAND) -> DataFrame:
    """``members``: (rep, id), one row per row of the classes of two rows or more, the representative included.
    ``links``: (rep_a, rep_b), different representatives, each pair once. Returns (a, b), a < b, each pair once.

    Null ids take no part. Empty inputs give no rows. Columns besides these are ignored.
    """
    members = members.select("rep", "id").where("rep is not null and id is not null")
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    members = members.join(sizes, "rep")
    whole = F.lit(True) if expand is None else F.col("n") * (F.col("n") - 1) / 2 <= expand
    few = members.where(whole)
    left, right = few.select("rep", F.col("id").alias("a"), "n"), few.select("rep", F.col("id").alias("b"), "n")
    within = paired(left, right, "rep", "n").where("a < b").select("a", "b")
    star = members.where(~whole).where("id <> rep")
    result = within.unionByName(star.select(F.least("rep", "id").alias("a"), F.greatest("rep", "id").alias("b")))
    if links is None:
        return result
    sides = links.select("rep_a", "rep_b")
    for side in ("a", "b"):
        sides = sides.join(sizes.select(F.col("rep").alias(f"rep_{side}"), F.col("n").alias(f"n_{side}")), f"rep_{side}", "left")
        sides = sides.withColumn(f"n_{side}", F.coalesce(f"n_{side}", F.lit(1)))
    whole = F.lit(True) if expand is None else F.col("n_a") * F.col("n_b") <= expand

    def rows(linked: DataFrame, side: str) -> DataFrame:
        own = members.select(F.col("rep").alias(f"rep_{side}"), F.col("id").alias(side))
        return linked.join(own, f"rep_{side}", "left").withColumn(side, F.coalesce(side, f"rep_{side}"))

    many = sides.where(~whole)
    across = rows(rows(sides.where(whole), "a"), "b").select("a", "b")
    across = across.unionByName(rows(many, "a").select("a", F.col("rep_b").alias("b")))
    across = across.unionByName(rows(many, "b").where("b <> rep_b").select(F.col("rep_a").alias("a"), "b"))
    return result.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
