"""Reading catalogues: manifests, CSV lists, listings, sample folders, artifacts."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegrid.functions.scalars import frame_indices, media_fields, or_else, parsed_number, sampled_frames
from cinegrid.operators.relational import first_wins, positions
from cinegrid.scratch import hadoop_path

#: Numeric columns of the two CSV layouts, folders of clips by priority, proxies by preference.
HUMAN_FIELDS = ("luminance_min", "luminance_max", "blur_min", "blur_max", "aesthetic", "technical_score", "global_motion")
ULTRA_FIELDS = ("vtss_score", "motion_score", "video_clip_score")
CLIP_FOLDERS = ("clips_short_1920", "clips_short_960", "clips_short")
PROXIES = (480, 720, 360, 1080, 240, 144)
SERVED = (720, 480, 1080)

MANIFEST = "ordinal long, video_name string, caption string, source_path string"


def manifest(spark: SparkSession, path: str, fields: Sequence[str] = (), ordinal: str | None = None, lines: bool = False) -> DataFrame:
    """Entries of a JSON manifest: an array of objects, or with ``lines`` one object per line. ``fields`` are the numbers the dataset has
    of its own. ``ordinal`` names the member that holds the position; without one it is the place in the file as read.
    Broken files raise."""
    schema = "video_name string, caption string, source_path string" + "".join(f", `{f}` double" for f in fields) + (f", `{ordinal}` long" if ordinal else "")
    # an array is one document and one task; large catalogues come as lines with their position as a member
    rows = spark.read.option("multiLine", not lines).option("mode", "FAILFAST").schema(schema).json(path)
    if ordinal:
        return rows.select(F.col(ordinal).alias("ordinal"), "video_name", "caption", "source_path", *fields)
    # the place in the file and the files' order do not move with how the files are split among tasks
    at = {"at_file": F.col("_metadata.file_path"), "at_block": F.col("_metadata.file_block_start"), "at_row": F.monotonically_increasing_id()}
    placed = positions(rows.withColumns(at), list(at))
    return placed.select(F.col("position").alias("ordinal"), "video_name", "caption", "source_path", *fields)


def csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV with a header as texts: quoted fields may hold separators and line breaks, doubled quotes stand for one."""
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def csv_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``csv``, of files that are known to hold no line break in a field: large ones are split among tasks."""
    return spark.read.options(header=True, escape='"').csv(path)


def csv_parts(spark: SparkSession, folder: str, parts: Sequence[str], stem: str = "OpenHumanVid") -> DataFrame:
    """The rows of the files ``{stem}_{part}.csv`` (or folders of that name) whose part is among ``parts``, with the part. Only the names
    below ``folder`` are listed; files of other parts are never opened. No such file: no rows, no columns but the part."""
    where, fs = hadoop_path(spark, folder)
    there = {f.getPath().getName() for f in fs.listStatus(where)} if fs.exists(where) else set()
    paths = [f"{folder}/{stem}_{p}.csv" for p in sorted(set(parts)) if f"{stem}_{p}.csv" in there]
    if not paths:
        return spark.createDataFrame([], "part string")
    return csv(spark, paths).withColumn("part", F.regexp_extract(F.input_file_name(), r"_(part_\d+)\.csv", 1))


def datasets(spark: SparkSession, folder: str, registered: Iterable[str] = ()) -> list[str]:
    """Names of the datasets: the registered ones, and every folder below ``folder`` that holds a manifest."""
    where, fs = hadoop_path(spark, folder)
    below = [f.getPath() for f in fs.listStatus(where) if f.isDirectory()] if fs.exists(where) else []
    found = {p.getName() for p in below if fs.exists(hadoop_path(spark, f"{p.toString()}/manifest.json")[0])}
    return sorted({*registered, *found})


def vector_index(spark: SparkSession, folder: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The vectors of all spaces below ``folder`` (prefix, and the columns of the views), and the spaces' prefixes. A view lies in the
    folder of its prefix; folders without a finished view are left out."""
    where, fs = hadoop_path(spark, folder)
    below = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()] if fs.exists(where) else []
    prefixes = tuple(sorted(n for n in below if fs.exists(hadoop_path(spark, f"{folder}/{n}/_SUCCESS")[0])))
    if not prefixes:
        raise ValueError(f"no vectors below {folder}")
    parts = [spark.read.parquet(f"{folder}/{p}").withColumn("prefix", F.lit(p)) for p in prefixes]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return every, prefixes


def human_entries(rows: DataFrame) -> DataFrame:
    """path, clip_id, caption and the numbers that are there: an empty cell is missing, as is junk."""
    return rows.select(F.col("clip_id").alias("video_name"), "caption", F.col("path").alias("source_path"), *(parsed_number(F.col(f)).alias(f) for f in HUMAN_FIELDS))


def parted(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of ``OpenHumanVid_part_NNN.csv`` files whose part is extracted. ``rows`` has file_name, ``parts`` has part."""
    part = F.regexp_extract("file_name", r"(part_\d+)", 1)
    return rows.withColumn("part", part).join(parts.select("part").distinct(), "part", "left_semi")


def ultra_entries(rows: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """clip_id and its caption: the summarised description, or the brief one where that is empty. With a listing only clips that
    are there, with their path."""
    caption = or_else(F.col("Summarized Description"), F.coalesce("Brief Description", F.lit("")))
    name = F.regexp_replace("clip_id", r"\.mp4$", "")
    out = rows.select(name.alias("video_name"), caption.alias("caption"), *(parsed_number(F.col(f)).alias(f) for f in ULTRA_FIELDS))
    return out if listing is None else out.join(listing.select("video_name", F.col("path").alias("source_path")), "video_name")


def web_entries(rows: DataFrame, base: str) -> DataFrame:
    """videoid and name, renamed, with a path made from the id."""
    return rows.select(F.col("videoid").alias("video_name"), F.col("name").alias("caption"), F.concat(F.lit(f"{base}/"), F.col("videoid"), F.lit(".mp4")).alias("source_path"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length): the files below a folder that are not empty; their contents are not read."""
    return spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(path).select("path", "length")


def by_priority(files: DataFrame, folders: Sequence[str] = CLIP_FOLDERS) -> DataFrame:
    """(video_name, path): of files with the same name the one in the first of the folders, flat or nested; ties by path."""
    rank = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(folders))):
        rank = F.when(F.col("path").contains(f"/{f}/"), i).otherwise(rank)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("video_name"), "path", rank.alias("rank")).where("rank is not null")
    return named.groupBy("video_name").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))


def nested(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of a JSON object of objects of objects, one per file or with ``lines`` one per line. Records without a name or a path are left out; the caption is the first of
    the list, or empty; of a repeated name the first counts, in the order of the keys."""
    return nested_records(spark.read.option("wholetext", not lines).text(path))


def nested_records(text: DataFrame) -> DataFrame:
    """As ``nested``, of documents in the column ``value``."""
    leaf = "struct<video_name:string,video_caption:array<string>,cleancode_pexels_path:string>"
    outer = text.select(F.explode(F.map_entries(F.from_json("value", f"map<string,map<string,{leaf}>>"))).alias("o"))
    inner = outer.select(F.col("o.key").alias("k1"), F.explode(F.map_entries("o.value")).alias("i")).select("k1", F.col("i.key").alias("k2"), "i.value.*")
    kept = inner.where("video_name <> '' and cleancode_pexels_path <> ''")
    rows = kept.select(F.struct("k1", "k2").alias("ordinal"), "video_name", F.coalesce(F.get("video_caption", F.lit(0)), F.lit("")).alias("caption"), F.col("cleancode_pexels_path").alias("source_path"))
    return first_wins(rows, ["video_name"], "ordinal").select("ordinal", "video_name", "caption", "source_path")


def samples(files: DataFrame) -> DataFrame:
    """(sample_id, folder) of the samples: folders two levels down that hold an ``origins.json``. ``files``: (path, ...)."""
    at = files.where(F.col("path").endswith("/origins.json")).select(F.regexp_extract("path", r"^(.*)/origins\.json$", 1).alias("folder"))
    deep = at.where(F.col("folder").rlike(r"/[0-9a-f]{2}/[0-9a-f]{2}/[^/]+$"))
    return deep.select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("sample_id"), "folder").distinct()


def artifacts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(sample_id, content): the bytes of one artifact of every sample that has it."""
    rows = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=name).load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sample_id"), "content")


def json_artifact(samples_: DataFrame, content: DataFrame, schema: str) -> DataFrame:
    """Samples with their artifact's members; nulls where it is missing or broken. ``content``: (sample_id, body)."""
    body = F.col("body").cast("string")
    whole = F.when(F.try_parse_json(body).isNotNull(), body)
    parsed = content.select("sample_id", F.from_json(whole, schema).alias("j"))
    return samples_.join(parsed, "sample_id", "left").select(*samples_.columns, "j.*")


def _npy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for cell in batch.column(1).to_pylist():
            try:
                out.append(None if cell is None else np.load(io.BytesIO(cell), allow_pickle=False).astype(np.float32).ravel())
            except (ValueError, EOFError, OSError):
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=["sample_id", "embedding"])


def npy_artifact(content: DataFrame) -> DataFrame:
    """(sample_id, embedding array<float>) from the bytes of .npy files; null where they are missing or broken."""
    return content.select("sample_id", "content").mapInArrow(_npy, "sample_id string, embedding array<float>")


def chosen_source(sizes: dict[int, Column], original: Column, preference: Sequence[int] = PROXIES) -> Column:
    """What to decode, or with the preference SERVED to show: the first proxy, by preference, that has bytes; else the original if it
    exists. ``sizes``: resolution -> size column; ``original``: its size column. Null if there is none."""
    tests = [F.when(F.coalesce(sizes[r], F.lit(0)) > 0, F.lit(f"compress_{r}p.mp4")) for r in preference if r in sizes]
    return F.coalesce(*tests, F.when(original.isNotNull(), F.lit("video.mp4")))


def probed(df: DataFrame, frames: str, fps: str, seconds: str, size: str) -> DataFrame:
    """Adds num_frames, fps, duration, file_size_mb from a stream's raw figures: without a frame count it is made from the
    duration; without a rate it is 30."""
    rate = F.round(F.coalesce(F.when(F.col(fps) > 0, F.col(fps)), F.lit(30.0)), 3)
    n = F.when(F.coalesce(F.col(frames), F.lit(0)) > 0, F.col(frames)).otherwise(F.floor(F.coalesce(F.col(seconds), F.lit(0.0)) * rate)).cast("int")
    duration, mb = media_fields(n, rate, F.col(size))
    return df.withColumns({"num_frames": n, "fps": rate, "duration": duration, "file_size_mb": mb})


def frames(df: DataFrame, key: str, n: str) -> DataFrame:
    """(key, frame, at): which frames a video's sampling decodes; ``at`` lists the places of the frame in the sprite."""
    own = frame_indices(F.col(n))
    places = lambda f: F.filter(F.transform(own, lambda x, i: F.when(x == f, i)), lambda i: i.isNotNull())
    return df.select(key, n, F.explode(sampled_frames(F.col(n))).alias("frame")).select(key, "frame", places(F.col("frame")).alias("at"))


def decoded(df: DataFrame, decode: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """One video to many frames, by an injected decoder over Arrow batches: loaded once per task."""
    return df.mapInArrow(decode, schema)


def encode_images(df: DataFrame, key: str, image: str, load: Callable[[], Callable[[list[bytes]], np.ndarray]], batch: int = 32) -> DataFrame:
    """(key, embedding): unit vectors of images by an injected model, loaded once per task. Images that fail are left out, never
    replaced by zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                out, keys = [], []
                cells = part.column(1).to_pylist()
                try:
                    rows = list(model(cells))
                except Exception:  # one by one, to leave out what fails
                    rows = []
                    for c in cells:
                        try:
                            rows.append(model([c])[0])
                        except Exception:
                            rows.append(None)
                for k, v in zip(part.column(0).to_pylist(), rows):
                    if v is not None and np.linalg.norm(v) > 0:
                        keys.append(k)
                        out.append((v / np.linalg.norm(v)).astype(np.float16).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(out, pa.list_(pa.float32()))], names=["key", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, image).mapInArrow(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


def object_fields(df: DataFrame, body: str) -> DataFrame:
    """(field): the members that any of the JSON objects has; bodies that are no object have none."""
    good = df.where(F.try_parse_json(F.col(body)).isNotNull())
    return good.select(F.explode(F.json_object_keys(F.col(body))).alias("field")).distinct()


def parsed_objects(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, ok, error): whether each body is a JSON object; no Python."""
    text = F.coalesce(F.col(body), F.lit(""))
    kind = F.expr(f"schema_of_variant(try_parse_json(coalesce(`{body}`, '')))")
    error = F.when(F.try_parse_json(text).isNull(), "no JSON").when(~kind.startswith("OBJECT"), "no object")
    return df.select(key, error.isNull().alias("ok"), error.alias("error"))


def per_device(df: DataFrame, device: str, devices: int, work: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs ``work(number, batches)`` over the rows of each device, in a process of its own; rows of a device stay together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index(device)
            for number in np.unique(b.column(at).to_numpy()).tolist():
                yield from work(number, iter([b.filter(pa.compute.equal(b.column(at), number))]))

    return df.repartition(devices, device).mapInArrow(run, schema)


def mapped(df: DataFrame, key: str, work: Callable[[dict], object]) -> DataFrame:
    """(key, ok, error): a Python function over rows, with its errors caught."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, errors = [], []
            for row in b.to_pylist():
                try:
                    work(row)
                    ok.append(True)
                    errors.append(None)
                except Exception as x:  # reported per row
                    ok.append(False)
                    errors.append(f"{type(x).__name__}: {x}")
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index(key)), pa.array(ok), pa.array(errors, pa.string())], names=["key", "ok", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.mapInArrow(run, f"key {kind}, ok boolean, error string").withColumnRenamed("key", key)
