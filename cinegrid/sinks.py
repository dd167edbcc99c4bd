"""Writing results: staged tables, manifests, favourites, exports, downloads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.functions.scalars import sample_path
from cinegrid.operators.compaction import swap
from cinegrid.scratch import hadoop_path


def staged(df: DataFrame, path: str, format: str = "parquet", files: int | None = None) -> None:
    """Writes beside ``path`` and swaps the folders at the end, so that readers see the old table or the new one. ``df`` may read
    the old table."""
    beside = f"{path}.staging-{uuid.uuid4().hex}"
    (df if files is None else df.repartition(files)).write.format(format).save(beside)
    swap(df.sparkSession, beside, path)


def manifest(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines, null members left out."""
    staged(entries, path, "json")


def vector_view(vectors: DataFrame, path: str, key: str = "video_name") -> None:
    """Vectors sorted by name."""
    beside = f"{path}.staging-{uuid.uuid4().hex}"
    vectors.repartitionByRange(key).sortWithinPartitions(key).write.parquet(beside)
    swap(vectors.sparkSession, beside, path)


def favourites(table: DataFrame, dataset: str, names: DataFrame, action: str) -> DataFrame:
    """The favourites after adding or removing names of a dataset; what is there or not there already changes nothing."""
    given = names.select(F.lit(dataset).alias("dataset"), "video_name").distinct()
    rest = table.select("dataset", "video_name").distinct().join(given, ["dataset", "video_name"], "left_anti")
    if action == "add":
        return rest.unionByName(given)
    if action == "remove":
        return rest
    raise ValueError(f"unknown action {action!r}")


def load_favourites(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, video_name) of the saved favourites; none if there is no such file yet."""
    where, fs = hadoop_path(spark, path)
    schema = "dataset string, video_name string"
    return spark.read.schema(schema).json(path) if fs.exists(where) else spark.createDataFrame([], schema)


def save_favourites(table: DataFrame, path: str) -> None:
    staged(table.select("dataset", "video_name"), path, "json", 1)


def sample_sizes(files: DataFrame, sample_id: str) -> DataFrame:
    """(artifact, size_bytes) of the files of one sample."""
    return files.where(F.col("sample_id") == sample_id).select("artifact", "size_bytes")


def export_paths(samples: DataFrame, artifact: str | None = None) -> DataFrame:
    """(video_name, path) sorted by name: the folder of each sample, or one artifact in it. ``samples``: dataset, video_name."""
    path = sample_path(F.concat_ws("_", "dataset", "video_name"), F.lit(artifact) if artifact else None)
    return samples.select("video_name", path.alias("path")).orderBy("video_name", "path")


def as_lines(df: DataFrame, column: str) -> DataFrame:
    """(text): one line per row, in order."""
    return df.select(F.coalesce(F.col(column), F.lit("")).alias("text"))


def as_json(df: DataFrame) -> DataFrame:
    """(text): one JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("text"))


def download_size(files: DataFrame, selection: DataFrame, artifact: str | None = None) -> DataFrame:
    """(bytes, files) of the selection, which counts a name as often as it is selected; samples without files count nothing."""
    rows = files if artifact is None else files.where(F.col("artifact") == artifact)
    rows = selection.select("sample_id").join(rows.select("sample_id", "size_bytes"), "sample_id")
    return rows.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("files"))


def archive_name(dataset: Column, name: Column, file: Column, single: bool) -> Column:
    """An archive's entry: the file in the sample's folder, or for a single artifact the sample's name with its extension."""
    sample = F.concat_ws("_", dataset, name)
    return F.concat(sample, F.regexp_extract(file, r"(\.[^.]*)?$", 0)) if single else F.concat_ws("/", sample, file)


def link_status(entries: DataFrame, present: DataFrame, linked: DataFrame) -> DataFrame:
    """(status, count): entries whose media are linked already (skipped), can be (linked), or are not there (missing)."""
    rows = entries.select("source_path", "sample_id")
    rows = rows.join(present.select(F.col("path").alias("source_path")).distinct().withColumn("there", F.lit(True)), "source_path", "left")
    rows = rows.join(linked.select("sample_id").distinct().withColumn("done", F.lit(True)), "sample_id", "left")
    status = F.when(F.col("done"), "skipped").when(F.col("there"), "linked").otherwise("missing")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("count"))
