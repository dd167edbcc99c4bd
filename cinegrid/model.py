"""What a catalogue is made of: fields, datasets and enrichment steps (processors), their registry and its checks."""

from __future__ import annotations

import graphlib
import importlib.util
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.functions.scalars import FIELD_ORDER, SPRITE_COLUMNS, SPRITE_ROWS
from cinegrid.operators import processors
from cinegrid.sources.catalogue import HUMAN_FIELDS, ULTRA_FIELDS

#: Columns that every entry has; the caption may be null.
REQUIRED = ("video_name", "caption", "source_path")


@dataclass(frozen=True)
class Field:
    label: str
    description: str = ""
    dtype: str = "float"
    dynamic: bool = False
    range: tuple[float, float] | None = None


@dataclass(frozen=True)
class Rule:
    """How an artifact is folded into a view: ``json_dict`` into a keyed one, ``vector_index`` into one of vectors."""

    kind: str
    source: str
    target: str


@dataclass(frozen=True)
class Section:
    """A part of the detail view."""

    type: str
    label: str
    priority: int = 100


Transform = Callable[[DataFrame], DataFrame]
Encoder = Callable[[str], "list[float] | None"]


@dataclass(frozen=True)
class Processor:
    """An enrichment step. ``transform`` turns the samples into its outputs; steps that need a model or a decoder get it
    injected there. ``encode`` turns a query's text into a vector of the step's space."""

    name: str
    human_name: str = ""
    depends_on: tuple[str, ...] = ()
    artifacts: dict[str, str] = field(default_factory=dict)
    fields: dict[str, Field] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    space: tuple[str, int] | None = None
    sections: tuple[Section, ...] = ()
    transform: Transform | None = None
    encode: Encoder | None = None


@dataclass(frozen=True)
class Dataset:
    name: str
    human_name: str = ""
    fields: dict[str, Field] = field(default_factory=dict)
    sections: tuple[Section, ...] = ()
    entries: Callable[[SparkSession, str], DataFrame] | None = None


def validated(entries: DataFrame) -> DataFrame:
    """The entries, if they have the required columns; else ValueError names the first that is missing."""
    for name in REQUIRED:
        if name not in entries.columns:
            raise ValueError(f"entries lack {name!r}")
    return entries


class Registry:
    """Processors and datasets by name. Adding one checks that artifacts, fields and vector prefixes stay disjoint."""

    def __init__(self, processors: Iterable[Processor] = (), datasets: Iterable[Dataset] = ()):
        self.processors: dict[str, Processor] = {}
        self.datasets: dict[str, Dataset] = {}
        for p in processors:
            self.add(p)
        for d in datasets:
            self.add_dataset(d)

    def add(self, new: Processor) -> None:
        for p in [*self.processors.values(), *self.datasets.values()]:
            if p.name == new.name:
                raise ValueError(f"there is a {new.name!r} already")
            for what in ("artifacts", "fields"):
                if both := set(getattr(p, what, {})) & set(getattr(new, what)):
                    raise ValueError(f"{new.name} and {p.name} share {what}: {sorted(both)}")
            if new.space and getattr(p, "space", None) and p.space[0] == new.space[0]:
                raise ValueError(f"{new.name} and {p.name} share the prefix {new.space[0]!r}")
        self.processors[new.name] = new

    def add_dataset(self, new: Dataset) -> None:
        for p in self.processors.values():
            if both := set(p.fields) & set(new.fields):
                raise ValueError(f"{new.name} and {p.name} share fields: {sorted(both)}")
        self.datasets[new.name] = new

    def known(self, names: Iterable[str]) -> list[str]:
        names = list(names)
        if unknown := [n for n in names if n not in self.processors]:
            raise ValueError(f"unknown processors: {unknown}")
        return names

    def order(self, names: Iterable[str] | None = None) -> list[str]:
        """The named processors and all they depend on, dependencies first, ties by name."""
        wanted, todo = {}, sorted(self.processors if names is None else names)
        while todo:
            name = todo.pop()
            if name not in self.processors:
                raise ValueError(f"unknown processor {name!r}")
            if name not in wanted:
                wanted[name] = set(self.processors[name].depends_on)
                todo += wanted[name]
        sorter, out = graphlib.TopologicalSorter(wanted), []
        try:
            sorter.prepare()
        except graphlib.CycleError as e:
            raise ValueError(f"dependencies of {e.args[1][0]!r} run in a circle") from e
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            out += ready
            sorter.done(*ready)
        return out

    def enabled(self, process: Iterable[str] | None, skip: Iterable[str]) -> list[str]:
        """What runs: the asked ones without the skipped; what those depend on comes back."""
        skip = set(self.known(skip))
        return self.order(n for n in (self.processors if process is None else self.known(process)) if n not in skip)

    def rules(self, names: Iterable[str] | None = None) -> dict[str, list[tuple[str, Rule]]]:
        """Rules by kind, in the order of their processors."""
        out: dict[str, list[tuple[str, Rule]]] = {}
        for name in self.order(names):
            for rule in self.processors[name].rules:
                out.setdefault(rule.kind, []).append((name, rule))
        return out

    def field_catalogue(self, dataset: str | None = None) -> dict[str, tuple[str, Field]]:
        """field -> (where it is from, what it is); later ones override."""
        out = {k: (p.name, f) for p in self.processors.values() for k, f in p.fields.items()}
        if dataset in self.datasets:
            out |= {k: (dataset, f) for k, f in self.datasets[dataset].fields.items()}
        return out

    def artifact_catalogue(self) -> dict[str, dict[str, str]]:
        """Artifacts apart by type: image, data."""
        out: dict[str, dict[str, str]] = {"image": {}, "data": {}}
        for p in self.processors.values():
            for name, kind in p.artifacts.items():
                out.setdefault(kind, {})[name] = p.name
        return out

    def sections(self, dataset: str | None = None) -> list[Section]:
        every = [s for p in self.processors.values() for s in p.sections]
        every += self.datasets[dataset].sections if dataset in self.datasets else ()
        return sorted(every, key=lambda s: s.priority)

    def spaces(self) -> dict[str, tuple[str, int]]:
        """prefix -> (processor, width)."""
        return {p.space[0]: (p.name, p.space[1]) for p in self.processors.values() if p.space}

    def encode(self, prefix: str, query: str) -> list[float]:
        """The query's unit vector in a space; ValueError says what is missing."""
        if prefix not in self.spaces():
            raise ValueError(f"no vectors named {prefix!r}; there are {sorted(self.spaces())}")
        p = self.processors[self.spaces()[prefix][0]]
        v = p.encode(query) if p.encode else None
        if v is None:
            raise ValueError(f"{p.name} has no encoder of texts; give it one")
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n > 0 else list(v)

    def run(self, samples: DataFrame, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """Applies the transforms in order; each sees the samples joined with the outputs it depends on."""
        out: dict[str, DataFrame] = {}
        for name in self.order(names):
            p, seen = self.processors[name], samples
            for other in p.depends_on:
                if other in out:
                    new = [c for c in out[other].columns if c == "sample_id" or c not in seen.columns]
                    seen = seen.join(out[other].select(new), "sample_id")
            if p.transform:
                out[name] = p.transform(seen)
        return out


def tiers(samples: DataFrame, artifacts: DataFrame, needed: dict[str, list[str]]) -> DataFrame:
    """(sample_id, tier): how many of the steps whose artifacts are named have all of them."""
    steps = [(s, a) for s, names in needed.items() for a in names]
    want = samples.sparkSession.createDataFrame(steps, "step string, artifact string")
    have = artifacts.select("sample_id", "artifact").distinct().join(F.broadcast(want), "artifact")
    sizes = {s: len(set(names)) for s, names in needed.items()}
    full = F.create_map(*(x for s, n in sizes.items() for x in (F.lit(s), F.lit(n))))
    met = have.groupBy("sample_id", "step").agg(F.count_distinct("artifact").alias("n")).where(F.col("n") == F.try_element_at(full, "step"))
    per = met.groupBy("sample_id").agg(F.count("*").alias("tier"))
    return samples.select("sample_id").distinct().join(per, "sample_id", "left").select("sample_id", F.coalesce("tier", F.lit(0)).cast("long").alias("tier"))


def sorted_fields(names: Iterable[str], dynamic: Iterable[str] = ()) -> list[str]:
    """Dynamic fields first, as they come, then the canonical order, then the rest by name."""
    names, dynamic = list(names), set(dynamic)
    rest = [n for n in names if n not in dynamic]
    return [*(n for n in names if n in dynamic), *(f for f in FIELD_ORDER if f in rest), *sorted(n for n in rest if n not in FIELD_ORDER)]


def config() -> dict[str, int]:
    return {"sprite_columns": SPRITE_COLUMNS, "sprite_rows": SPRITE_ROWS, "sprite_frames": SPRITE_COLUMNS * SPRITE_ROWS}


def discovered(folder: str) -> Registry:
    """A registry of all processors and datasets that the Python files of a folder define, in the order of the files' names; files that
    begin with an underscore are left out. A file that fails, or two that clash, raise ValueError with the file's name."""
    found = Registry()
    for path in sorted(Path(folder).glob("[!_]*.py")):
        spec = importlib.util.spec_from_file_location(f"cinegrid_plugin_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(module)
            for value in vars(module).values():
                if isinstance(value, Processor):
                    found.add(value)
                elif isinstance(value, Dataset):
                    found.add_dataset(value)
        except Exception as e:
            raise ValueError(f"{path.name}: {e}") from e
    return found


def letters(width: int) -> Encoder:
    """Stands in for a text encoder where no model is installed: how often each of the first ``width`` letters occurs."""
    return lambda text: [float(text.lower().count(chr(97 + i))) for i in range(width)]


def _encoder(name: str, human: str, score: str, width: int, top: float, model: processors.Loader | None) -> Processor:
    data = f"{name}.json"
    fields = {f"{name}_std": Field(f"{human} spread"), score: Field(f"{human} score", dynamic=True, range=(0.0, top))}
    return Processor(name, human, ("ingest",), {data: "data", f"{name}_embedding.npy": "data"}, fields, (Rule("json_dict", data, "video_stats"), Rule("vector_index", f"{name}_embedding.npy", name)), (name, width), transform=processors.encoded(name, model) if model else processors.spread_field(name))


def standard(models: dict[str, processors.Loader] | None = None) -> Registry:
    """The known steps, with the fields they give. ``models``: per vector space what loads its image model; without one a step takes
    vectors of frames as they come. What follows from sizes, streams, sequences and vectors is computed here."""
    models = models or {}
    media = {"width": Field("Width", dtype="int"), "height": Field("Height", dtype="int"), "fps": Field("FPS"), "num_frames": Field("Frames", dtype="int"), "duration": Field("Duration"), "file_size_mb": Field("Size (MB)")}
    hashes = {f"phash_{n}": Field(l) for n, l in (("mean_change", "Mean change"), ("max_change", "Max change"), ("std_change", "Std of change"), ("temporal_std", "Temporal std"))}
    flow = {f"flow_{n}": Field(l) for n, l in (("mean_magnitude", "Mean flow"), ("max_magnitude", "Max flow"), ("min_magnitude", "Min flow"), ("std_magnitude", "Std of flow"), ("temporal_std", "Temporal std"))}
    return Registry([
        Processor("compress", "Compression", artifacts={"compress_480p.mp4": "image"}, transform=processors.compressed_sizes),
        Processor("ingest", "Ingest", ("compress",), {"metadata.json": "data", "thumb_middle.jpg": "image"}, media, (Rule("json_dict", "metadata.json", "video_metadata"),), transform=processors.ingested),
        _encoder("clip", "CLIP", "score", 512, 1.0, models.get("clip")),
        _encoder("siglip", "SigLIP", "siglip_score", 1152, 1.0, models.get("siglip")),
        _encoder("gve", "GVE", "gve_score", 2048, 1.0, models.get("gve")),
        Processor("phash", "Perceptual hash", ("ingest",), {"phash.json": "data"}, hashes, (Rule("json_dict", "phash.json", "video_stats"),), transform=processors.hash_fields),
        Processor("raft_flow", "Optical flow", ("ingest",), {"raft_flow.json": "data"}, flow, (Rule("json_dict", "raft_flow.json", "video_stats"),), transform=processors.flow_fields),
    ], [
        Dataset("openhumanvid", "OpenHumanVid", {n: Field(n) for n in HUMAN_FIELDS}),
        Dataset("ultravideo", "UltraVideo", {n: Field(n) for n in ULTRA_FIELDS}),
    ])
