"""Folding new artifacts into views, batch by batch or as a stream.

Each rule keeps its own view and its own record of the samples it has taken in, so an artifact that comes late is taken in when
it comes, whatever other rules have done. Taking in a batch again changes nothing.

A view is a folder of buckets by key, each written by some version, and of one state file per version, which says where
each bucket lies. State files and buckets are never changed once written; the greatest state file counts. So a run that
ends at any point leaves the version before it whole, and what it left behind is never read nor written over. A batch rewrites
only the buckets its keys fall in, and appends its keys to the record of what is taken in.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegrid.operators.relational import last_wins, merged, upserted
from cinegrid.scratch import hadoop_path

BUCKETS = 8
#: Versions whose files stay, for readers that have begun; and parts of the record of samples before they are put together.
KEPT = 3
PARTS = 32


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def _rename(spark: SparkSession, old: str, new: str) -> bool:
    where, fs = hadoop_path(spark, old)
    to, _ = hadoop_path(spark, new)
    return not fs.exists(to) and fs.rename(where, to)


class View:
    """A keyed view in a folder. ``kind``: json_dict merges field by field, vector_index replaces rows. ``buckets`` counts for a new
    view and at a rebuild: a batch rewrites those it touches, so a large view wants many, with some hundred MB each."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "json_dict", key: str = "video_name", buckets: int = BUCKETS):
        if kind not in ("json_dict", "vector_index"):
            raise ValueError(f"unknown kind {kind!r}")
        self.spark, self.path, self.kind, self.key, self.buckets = spark, path.rstrip("/"), kind, key, buckets

    def _names(self) -> list[str]:
        where, fs = hadoop_path(self.spark, self.path)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self) -> list[int]:
        """The versions that were finished, ascending."""
        return sorted(int(n[6:-5]) for n in self._names() if n.startswith("state-") and n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        """version, count, time, and where the buckets lie; empty before the first batch."""
        if version is None:
            found = self.versions()
            if not found:
                return {}
            version = found[-1]
        where, fs = hadoop_path(self.spark, f"{self.path}/state-{version}.json")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _read(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.path}/view-{v}/bucket={b}" for b, v in state["buckets"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        state = self.state()
        return self._read(state) if state else None

    def included(self) -> DataFrame | None:
        """The keys of the samples that this rule has taken in, each once."""
        state = self.state()
        if not state:
            return None
        paths = [f"{self.path}/included-{v}" for v in state["included"]]
        kind = T.StructType([f for f in T.StructType.fromJson(state["schema"]) if f.name == self.key])
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def fresh(self, samples: DataFrame) -> DataFrame:
        """Samples that this rule has not taken in."""
        done = self.included()
        return samples if done is None else samples.join(done, self.key, "left_anti")

    def take(self, rows: DataFrame, order: list[str], rebuild: bool = False) -> dict:
        """Takes in a batch of (key, order..., fields...): of rows with the same key the last one counts. Rows without any value
        contribute nothing and are not marked as taken in. Returns the new state. Another writer's batch at the same time
        makes the later one raise."""
        if missing := {self.key, *order} - set(rows.columns):
            raise ValueError(f"rows lack {sorted(missing)}")
        fields = [c for c in rows.columns if c != self.key and c not in order]
        some = F.coalesce(*(F.when(F.col(f).isNotNull(), True) for f in fields)) if fields else F.lit(False)
        new = last_wins(rows.where(some).where(F.col(self.key).isNotNull()), [self.key], order).select(self.key, *fields)
        state = {} if rebuild else self.state()
        names = self._names()
        version = 1 + max((int(n.split("-")[1].split(".")[0]) for n in names if n.startswith(("state-", "view-", "included-"))), default=0)
        count = state.get("buckets_of", self.buckets)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(count)).cast("int")
        counts, touched, view = dict(state.get("counts", {})), [], new
        if state:
            # the batch is read once: its keys and values lie beside the view until the version stands
            batch = f"{self.path}/batch-{version}-{uuid.uuid4().hex}"
            _write(new.withColumn("bucket", bucket), batch)
            new = self.spark.read.parquet(batch)
            touched = sorted(str(r[0]) for r in new.select("bucket").distinct().collect())  # at most as many as there are buckets
            new = new.drop("bucket")
            view = (merged if self.kind == "json_dict" else upserted)(self._read(state, touched), new, self.key)
        if touched or not state:
            place = f"{self.path}/view-{version}"
            _write_buckets(view.withColumn("bucket", bucket), place)
            there = self.spark.read.schema(T.StructType([*view.schema, T.StructField("bucket", T.IntegerType())])).parquet(place)
            found = {str(r[0]): r[1] for r in there.groupBy("bucket").count().collect()}
            counts, touched = counts | found, sorted(found)
            new = new if state else there
        added = new.select(self.key)
        if state and len(state["included"]) < PARTS:
            added, parts = self.fresh(added), state["included"]
        elif state:
            added, parts = self.included().unionByName(self.fresh(added)), []
        else:
            parts = []
        _write(added, f"{self.path}/included-{version}")
        out = {"version": version, "count": sum(counts.values()), "time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "schema": json.loads(view.schema.json()),
               "buckets_of": count, "buckets": state.get("buckets", {}) | dict.fromkeys(touched, version), "counts": counts, "included": [*parts, version]}
        self._publish(out)
        self._clean()
        return out

    def _publish(self, state: dict) -> None:
        """The state file comes into being whole, by a rename that never replaces one."""
        beside, final = f"{self.path}/new-{uuid.uuid4().hex}", f"{self.path}/state-{state['version']}.json"
        where, fs = hadoop_path(self.spark, beside)
        out = fs.create(where, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not _rename(self.spark, beside, final):
            fs.delete(where, False)
            raise OSError(f"version {state['version']} of {self.path} was written by another run")

    def _clean(self) -> None:
        """Removes what the last KEPT versions don't need: older states first, then the folders no state names."""
        kept = self.versions()[-KEPT:]
        states = [self.state(v) for v in kept]
        used = {f"view-{v}" for s in states for v in s["buckets"].values()} | {f"included-{v}" for s in states for v in s["included"]}
        names = self._names()
        old = [n for n in names if n.startswith("state-") and int(n[6:-5]) < kept[0]]
        old += [n for n in names if n.startswith(("view-", "included-")) and n not in used and int(n.split("-")[1]) < kept[-1]]
        old += [n for n in names if n.startswith(("batch-", "new-"))]
        for name in old:
            where, fs = hadoop_path(self.spark, f"{self.path}/{name}")
            fs.delete(where, True)


def _write_buckets(df: DataFrame, path: str) -> None:
    df.repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def aggregate(views: dict[str, tuple[View, list[str]]], rows: dict[str, DataFrame], only: list[str] | None = None, rebuild: bool = False) -> dict[str, dict]:
    """Each rule takes in what it has not yet: rule -> its state. ``only``: the rules of the named steps; the others stay as they
    are. A rule with nothing new is left alone."""
    out = {}
    for name, (view, order) in views.items():
        if only is not None and name not in only or name not in rows:
            continue
        batch = rows[name] if rebuild or not view.versions() else view.fresh(rows[name])
        if rebuild or batch.limit(1).count():
            out[name] = view.take(batch, order, rebuild)
    return out


def reported(views: dict[str, tuple[View, list[str]]], rows: dict[str, DataFrame], **options) -> Iterator[tuple[str, str]]:
    """As ``aggregate``, telling how it goes: (progress, rule) before each rule that has rows, at last (result, the states' counts as
    JSON). An error ends it with (error, text)."""
    counts = {}
    try:
        for name in views:
            if name in rows:
                yield "progress", name
                done = aggregate({name: views[name]}, rows, **options)
                counts |= {n: s["count"] for n, s in done.items()}
    except Exception as e:  # told to who listens
        yield "error", f"{type(e).__name__}: {e}"
        return
    yield "result", json.dumps(counts)


def stream(source: DataFrame, view: View, order: list[str], checkpoint: str):
    """Takes in a streaming table until nothing is left; what is done stays done over restarts."""
    def batch(df: DataFrame, _: int) -> None:
        view.take(df, order)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Served:
    """A view as a server holds it: the version it has read, until it is told to reload."""

    def __init__(self, view: View):
        self.view, self.version, self.table = view, 0, None
        self.reload()

    def reload(self) -> bool:
        """Reads the newest version; whether there was a newer one. Who still reads the old one is not disturbed."""
        state = self.view.state()
        newer = state.get("version", 0) > self.version
        if newer:
            self.version, self.table = state["version"], self.view._read(state)
        return newer


def status(views: dict[str, View]) -> dict[str, int]:
    """How many rows each view has."""
    return {name: v.state().get("count", 0) for name, v in views.items()}


def status_record(spark: SparkSession, views: dict[str, View]) -> DataFrame:
    """(key, count), read fresh: ``total_samples`` that any rule has taken in, and the rows of each view under its name without
    ``.json``."""
    done = [d.select(F.col(v.key).alias("sample")) for v in views.values() if (d := v.included()) is not None]
    total = 0
    if done:
        every = done[0]
        for d in done[1:]:
            every = every.unionByName(d)
        total = every.distinct().count()
    rows = [("total_samples", total), *((n.removesuffix(".json"), c) for n, c in status(views).items())]
    return spark.createDataFrame(rows, "key string, count long")


def load(spark: SparkSession, folder: str, fallback: tuple[str, ...] = ("video_metadata", "video_stats")) -> dict[str, View]:
    """The views below a folder, by name: those its list of targets names (targets.json, a JSON array), or without one the fallback
    names; only those that have a finished version."""
    names = list(fallback)
    where, fs = hadoop_path(spark, f"{folder}/targets.json")
    if fs.exists(where):
        stream_ = fs.open(where)
        names = json.loads(bytes(stream_.readAllBytes()).decode())
        stream_.close()
    found = {n: View(spark, f"{folder}/{n.removesuffix('.json')}") for n in names}
    return {n: v for n, v in found.items() if v.versions()}


def save_targets(spark: SparkSession, folder: str, names: list[str]) -> None:
    where, fs = hadoop_path(spark, f"{folder}/targets.json")
    out = fs.create(where, True)
    out.write(bytearray(json.dumps(sorted(names)).encode()))
    out.close()
