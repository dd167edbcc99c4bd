"""Many small JSON files into a few sorted ones, each record once.

Steps: a digest of what a body says (not how it is spelt), one row per record, range partitioning by the clustering keys
with sampled boundaries and as many parts as the target bytes ask for, sorted files in a staging folder, and beside them which
row of the input went into which record; a reconciliation of counts between the input and what the staged files hold, and
only then the swap of the folder as a whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.operators.copies import EXPAND, class_pairs
from cinegrid.scratch import hadoop_path, new_path, written

TARGET_BYTES = 128 << 20
KEYS = ("sample_id", "artifact", "file_id")


def _no_constant(name: str):
    raise ValueError(name)


def _plain(value):
    """Numbers without a sign on zero, so that equal values are spelt alike."""
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def digest(body: str | None) -> bytes | None:
    """16 bytes, equal for JSON objects with the same keys and equal values: numbers as doubles, strings exactly, any key
    order, spacing and escapes. None for what is no JSON object (null, empty, cut off, arrays, NaN literals). Of a key
    that stands twice the last value counts, as in Spark's reader."""
    if not body:
        return None
    try:
        value = json.loads(body, parse_int=float, parse_constant=_no_constant)
        if not isinstance(value, dict):
            return None
        text = json.dumps(_plain(value), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([digest(x) for x in batch.column(4).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "digest"])


def records(files: DataFrame) -> DataFrame:
    """(file_id, file_path, sample_id, artifact, body, video_name, fps, digest) per row of ``files``.

    video_name comes from the bodies of origins.json, fps from those of metadata.json; null where the body has none.
    """
    rows = files.select("file_id", "file_path", "sample_id", "artifact", "body")
    schema = "file_id long, file_path string, sample_id string, artifact string, body string, digest binary"
    rows = rows.mapInArrow(_digests, schema)
    name = F.get_json_object("body", "$.video_name")
    fps = F.get_json_object("body", "$.fps").try_cast("double")
    good = F.col("digest").isNotNull()
    return rows.withColumns({"video_name": F.when(good, name), "fps": F.when(good & ~F.isnan(fps), fps)})


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rep``, the smallest file_id with the same sample, artifact and digest, and ``copies``, how many rows share it.

    Bodies that are no JSON object stand for themselves. The count is pre-aggregated before the shuffle and joined
    back, so a sample that holds a third of all rows is spread by its digests.
    """
    key = [F.col("sample_id").eqNullSafe(F.col("s")), F.col("artifact").eqNullSafe(F.col("t")), F.col("digest") == F.col("d")]
    first = rows.where("digest is not null").groupBy(F.col("sample_id").alias("s"), F.col("artifact").alias("t"), F.col("digest").alias("d")).agg(
        F.min("file_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    found = rows.join(first, key, "left").drop("s", "t", "d")
    return found.withColumns({"rep": F.coalesce("rep", "file_id"), "copies": F.coalesce("copies", F.lit(1))})


@dataclass(frozen=True)
class Report:
    """What a compaction read and wrote."""

    path: str
    rows_in: int
    records: int
    copies: int
    broken: int
    files: int


def compact(files: DataFrame, path: str, target_bytes: int = TARGET_BYTES, keys: tuple[str, ...] = KEYS) -> Report:
    """Writes the records of ``files`` below the folder ``path``: in ``records`` sorted files of about ``target_bytes`` of bodies, with
    the column ``copies`` (rows of the input that hold the record), and in ``members`` (file_id, rep, copies) of every row of the
    input, sorted likewise.

    Each record of a sample (equal digests) stands once, under its smallest file_id. Bodies that are no JSON object are
    kept as they are, one row each, with a null digest: none is lost. Null keys sort first. An empty input gives
    empty folders. Both parts are staged and swapped in together, and only if the staged records and the sum of their copies equal
    the input's and each row of the input is a member of a staged record; else ValueError is raised and ``path`` stays as it was.
    """
    spark = files.sparkSession
    rows = written(placed(written(records(files), "digests")), "records")
    own = F.expr("file_id = rep")
    size = rows.agg(F.count("*").alias("c"), F.sum(F.when(own, F.octet_length("body"))).alias("b"), F.count_if(own).alias("n"), F.count_if(F.expr("digest is null")).alias("broken")).first()
    parts = max(1, -(-(size.b or 0) // target_bytes))
    order = [k if k in rows.columns else "file_id" for k in keys]
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    rows.where(own).drop("rep").repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(f"{staged}/records")
    # ids are a tenth of the bodies or less
    members = rows.select("file_id", "rep", "copies", *(k for k in order if k != "file_id")).repartitionByRange(max(1, parts // 4), *order).sortWithinPartitions(*order)
    members.select("file_id", "rep", "copies").write.parquet(f"{staged}/members")
    there = spark.read.parquet(f"{staged}/records").agg(F.count("*").alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("c"), F.count_if(F.expr("digest is null")).alias("broken")).first()
    kept = spark.read.parquet(f"{staged}/members").groupBy(F.col("rep").alias("file_id")).agg(F.count("*").alias("held"))
    wrong = kept.join(spark.read.parquet(f"{staged}/records").select("file_id", "copies"), "file_id", "full_outer").where("not (held <=> copies)").limit(1).count()
    if (there.n, there.c, there.broken) != (size.n, size.c, size.broken) or wrong:
        drop(spark, staged)
        raise ValueError(f"staged {there} but read {size}; nothing was swapped")
    swap(spark, staged, path)
    return Report(path, size.c, there.n, size.c - there.n, size.broken, parts)


def drop(spark: SparkSession, path: str) -> None:
    where, fs = hadoop_path(spark, path)
    fs.delete(where, True)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Puts the staged folder in place of ``path``; the old one goes only after the new one stands."""
    new, fs = hadoop_path(spark, staged)
    place, _ = hadoop_path(spark, path)
    old, _ = hadoop_path(spark, f"{path}.old-{uuid.uuid4().hex}")
    fs.mkdirs(place.getParent())
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"can't move {path} away")
    if not fs.rename(new, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"can't put the staged files at {path}")
    if had:
        fs.delete(old, True)


def copies(files: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES, expand: int | None = EXPAND) -> DataFrame:
    """(file_a, file_b): rows of ``files`` that hold the same record, as the members of the compacted folder say."""
    report = compact(files, path or new_path(files.sparkSession, "compacted"), target_bytes)
    members = files.sparkSession.read.parquet(f"{report.path}/members").where("copies > 1")
    pairs = class_pairs(members.select("rep", F.col("file_id").alias("id")), expand=expand)
    return pairs.select(F.col("a").alias("file_a"), F.col("b").alias("file_b"))
