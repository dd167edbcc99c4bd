"""What the enrichment steps compute from a record's sizes, stream and sequences, as expressions over arrays: no shuffle, and
Python only where an image model is injected.

Sequences are short (25 frames): an array per record. Fewer than two values have no differences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrid.functions.scalars import bound, sampled_frames, target_size
from cinegrid.operators.profile import hamming
from cinegrid.operators.vectors import normalised


#: Loads an image model: a function from images to one vector each.
Loader = Callable[[], Callable[[list[bytes]], np.ndarray]]
#: The heights of the compressed copies.
HEIGHTS = (144, 240, 360, 480, 720, 1080)


def compressed_sizes(df: DataFrame) -> DataFrame:
    """(sample_id, sizes map<int, struct<width, height>>): the sizes of the copies of a video with ``width`` and ``height``, smallest
    first; none is larger than the video, and none where a side is not known."""
    width, height = F.col("width").cast("int"), F.col("height").cast("int")
    small = F.least(width, height)
    cells = F.array_compact(F.array(*(F.when(small >= h, F.struct(F.lit(h).alias("k"), target_size(width, height, h).alias("v"))) for h in HEIGHTS)))
    return df.select("sample_id", F.map_from_entries(F.when(width.isNotNull() & height.isNotNull(), cells).otherwise(F.slice(cells, 1, 0))).alias("sizes"))


def ingested(df: DataFrame) -> DataFrame:
    """(sample_id, width, height, fps, num_frames, duration, file_size_mb, frames): what is known of a video from its stream's figures
    (``raw_frames``, ``rate``, ``seconds``, ``bytes``), and the frames to decode; none where there are none."""
    from cinegrid.sources.catalogue import probed

    rows = probed(df, "raw_frames", "rate", "seconds", "bytes")
    frames = F.when(F.col("num_frames") > 0, sampled_frames(F.col("num_frames"))).otherwise(F.array().cast("array<int>"))
    return rows.select("sample_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "fps", "num_frames", "duration", "file_size_mb", frames.alias("frames"))


def encoded(name: str, load: Loader) -> Callable[[DataFrame], DataFrame]:
    """A transform that gives (sample_id, {name}_embedding, {name}_std) from the images of a sample's frames in the column ``images``: the
    unit mean of their unit vectors, and how far they differ. Samples none of whose images can be encoded have no row."""
    from cinegrid.sources.catalogue import encode_images

    def transform(df: DataFrame) -> DataFrame:
        images = df.select("sample_id", F.explode("images").alias("image"))
        vectors = encode_images(images, "sample_id", "image", load).groupBy("sample_id").agg(F.collect_list("embedding").alias("v"))  # a few frames a sample
        total = F.aggregate(F.slice("v", 2, 1_000_000), F.get("v", F.lit(0)), lambda s, u: F.zip_with(s, u, lambda a, b: a + b))
        return vectors.select("sample_id", normalised(total).alias(f"{name}_embedding"), spread(F.col("v")).alias(f"{name}_std"))

    return transform


def pairwise(values: Column, distance: Callable[[Column, Column], Column]) -> Column:
    """The distance of each value to the one before it; an array one shorter, empty for fewer than two values."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), distance)


def summary(values: Column, decimals: int = 4) -> Column:
    """Struct of mean, max, min and the population's std of an array of numbers, rounded; zeros if it is empty or null."""
    def average(v: Column, of_one: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + of_one(x)), F.size(v)), F.lit(0.0))

    def of(v: Column) -> Column:
        return bound(average(v, lambda x: x), lambda mean: parts(v, mean))

    def parts(v: Column, mean: Column) -> Column:
        var = average(v, lambda x: (x - mean) * (x - mean))
        found = {"mean": mean, "max": F.coalesce(F.array_max(v), F.lit(0.0)), "min": F.coalesce(F.array_min(v), F.lit(0.0)), "std": F.sqrt(var)}
        return F.struct(*(F.round(c, decimals).alias(n) for n, c in found.items()))

    numbers = F.transform(F.coalesce(values, F.array().cast("array<double>")), lambda x: x.cast("double"))
    return bound(numbers, of)


def variability(values: Column, decimals: int = 4) -> Column:
    """Population deviation of the first differences; 0 for fewer than two values."""
    return summary(pairwise(values, lambda a, b: b.cast("double") - a.cast("double")), decimals)["std"]


def spread(vectors: Column, decimals: int = 6) -> Column:
    """Mean of 1 - cosine over all ordered pairs of an array of vectors, from the squared length of the sum of the units; null for
    fewer than two vectors."""
    def of(units: Column) -> Column:
        total = F.aggregate(F.slice(units, 2, 1_000_000), F.get(units, F.lit(0)), lambda s, u: F.zip_with(s, u, lambda a, b: a + b))
        square = F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x)
        n = F.size(units)
        return F.when(n > 1, F.round(1 - (square - n) / (n * (n - 1)), decimals))

    return bound(F.transform(vectors, normalised), of)


def hash_fields(df: DataFrame, key: str = "sample_id", hashes: str = "hashes") -> DataFrame:
    """(key, phash_mean_change, phash_max_change, phash_std_change, phash_temporal_std) from 64-bit hashes of the frames."""
    steps = pairwise(F.col(hashes), lambda a, b: hamming(a, b).cast("double"))
    rows = df.select(key, steps.alias("steps"))
    rows = rows.select(key, summary(F.col("steps")).alias("s"), variability(F.col("steps")).alias("phash_temporal_std"))
    return rows.select(key, F.col("s.mean").alias("phash_mean_change"), F.col("s.max").alias("phash_max_change"), F.col("s.std").alias("phash_std_change"), "phash_temporal_std")


def flow_fields(df: DataFrame, key: str = "sample_id", magnitudes: str = "magnitudes") -> DataFrame:
    """(key, flow_*_magnitude, flow_temporal_std) from the mean flow between consecutive frames."""
    rows = df.select(key, summary(F.col(magnitudes)).alias("s"), variability(F.col(magnitudes)).alias("flow_temporal_std"))
    return rows.select(key, *(F.col(f"s.{p}").alias(f"flow_{p}_magnitude") for p in ("mean", "max", "min", "std")), "flow_temporal_std")


def spread_field(name: str) -> Callable[[DataFrame], DataFrame]:
    """A transform that gives (sample_id, {name}_std) from the vectors of a sample's frames in the column ``frames``."""
    return lambda df: df.select("sample_id", spread(F.col("frames")).alias(f"{name}_std"))
