"""Exact vector search over a table of vectors, in expressions of the JVM or, for wide vectors, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrid.functions.scalars import bound

#: From this width on a matrix product over Arrow batches is faster than an expression.
WIDE = 256


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double in the order of the values."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length in double; a zero vector stays as it is."""
    return bound(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def literal(q: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in q))


def _unit(q: Sequence[float]) -> list[float]:
    n = float(np.sqrt(sum(x * x for x in map(float, q))))
    return [float(x) / n for x in q] if n > 0 else [float(x) for x in q]


def _products(query: Sequence[float], normalise: bool):
    q = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1)
            rows = [None if v is None else np.asarray(v, np.float64) for v in cells.to_pylist()] if cells.null_count else None
            if rows is None and len(batch) and (np.diff(cells.offsets.to_numpy()) == len(q)).all():
                m = cells.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(np.float64)
                out = m @ q
                if normalise:
                    out = out / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-300)
                scores = pa.array(out)
            else:
                scores = pa.array([None if v is None or len(v) != len(q) else float(v @ q / (np.maximum(np.sqrt(v @ v), 1e-300) if normalise else 1)) for v in (rows or map(np.asarray, cells.to_pylist()))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["id", "score"])

    return run


def scored(vectors: DataFrame, query: Sequence[float], key: str = "video_name", vector: str = "embedding", score: str = "score", normalise: bool = False) -> DataFrame:
    """(key, score): the inner product of each vector with the normalised query. Stored vectors count as they are, or
    normalised where asked. A null vector has a null score."""
    q = _unit(query)
    if len(q) >= WIDE:
        kind = vectors.schema[key].dataType.simpleString()
        out = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInArrow(_products(q, normalise), f"id {kind}, score double")
        return out.select(F.col("id").alias(key), F.col("score").alias(score))
    v = normalised(F.col(vector)) if normalise else F.col(vector)
    return vectors.select(key, F.when(F.col(vector).isNotNull(), dot(v, literal(q))).alias(score))


def top(vectors: DataFrame, query: Sequence[float], k: int, key: str = "video_name", vector: str = "embedding") -> DataFrame:
    """The k best scores, ties by key; fewer if there are fewer vectors."""
    return scored(vectors, query, key, vector).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def centroid(vectors: DataFrame, selection: DataFrame, key: str = "video_name", vector: str = "embedding") -> list[float]:
    """The mean of the selected vectors as they are, then made a unit. A row selected twice weighs twice; unknown ones are
    ignored. ValueError if none is left. What is collected is one vector."""
    rows = selection.select(key).join(vectors.select(key, vector), key).where(F.col(vector).isNotNull())
    means = rows.select(F.posexplode(vector).alias("at", "x")).groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    found = sorted((r["at"], r["m"]) for r in means.collect())
    if not found:
        raise ValueError("no selected row has a vector")
    return _unit([m for _, m in found])


def centroid_search(vectors: DataFrame, selection: DataFrame, key: str = "video_name", vector: str = "embedding") -> DataFrame:
    """(key, score): cosine of every vector with the selection's centroid; the selected ones are not left out."""
    return scored(vectors, centroid(vectors, selection, key, vector), key, vector, normalise=True)


def diversity(vectors: DataFrame, group: str, vector: str = "embedding", decimals: int = 6) -> DataFrame:
    """(group, diversity): the mean of 1 - cosine over all ordered pairs of different rows of a group; null for one row.

    With unit vectors the sum of all cosines is the squared length of their sum, so the pairs need not be made: one
    aggregation per position."""
    n_of = vectors.where(F.col(vector).isNotNull())
    length = F.greatest(norm(F.col(vector)), F.lit(1e-8))
    units = bound(length, lambda n: F.transform(vector, lambda x: x.cast("double") / n))
    unit_of = n_of.select(group, units.alias("u"), norm(F.col(vector)).alias("l"))
    own = F.pow(F.col("l") / F.greatest(F.col("l"), F.lit(1e-8)), 2)
    counts = unit_of.groupBy(group).agg(F.count("*").alias("n"), F.sum(own).alias("own"))
    sums = unit_of.select(group, F.posexplode("u").alias("at", "x")).groupBy(group, "at").agg(F.sum("x").alias("s"))
    square = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    pairs = F.col("n") * (F.col("n") - 1)
    value = F.when(F.col("n") > 1, F.round(1 - (F.col("square") - F.col("own")) / pairs, decimals))
    return counts.join(square, group).select(group, value.alias("diversity"))
