"""The whole way of a query: match, score, filter, enrich, sort, count, profile, page. One lazy plan per question."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrid.functions.scalars import number, sort_key
from cinegrid.operators import profile, relational, textquery, vectors
from cinegrid.operators.relational import Range
from cinegrid.scratch import written

#: Scores of the vector spaces by prefix, and their declared range.
SCORES = {"clip": "score", "siglip": "siglip_score", "gve": "gve_score"}
SCORE_RANGE = (0.0, 1.0)
#: Points of a scatter plot: by default, and at most.
SCATTER, SCATTER_MOST = 5000, 10_000


@dataclass(frozen=True)
class Request:
    """What a client asks for."""

    dataset: str = ""
    query: str = ""
    index: str = "clip"
    page: int = 1
    page_size: int = 200
    sort: str = ""
    direction: str = "desc"
    thumbs: str = "any"
    favourites: str = "any"
    seed: int = 0
    ranges: Mapping[str, Range] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Request:
        """From a URL's query. Junk numbers raise ValueError."""
        p = dict(parse_qsl(text))
        sort, direction = sort_key(p.get("sort", ""))
        return cls(p.get("dataset", ""), p.get("q", ""), p.get("index", "clip"), int(p.get("page", 1)), int(p.get("pageSize", 200)), sort, direction or "desc",
                   p.get("thumb", "any"), p.get("fav", "any"), int(p.get("seed", 0)), relational.parse_ranges(p))

    def text(self) -> str:
        """As a URL's query, without what is at its default."""
        sort = f"{self.sort}_{self.direction}" if self.sort and self.sort != "random" else self.sort
        p = {"dataset": self.dataset, "q": self.query, "index": self.index if self.index != "clip" else "", "page": self.page if self.page > 1 else "", "pageSize": self.page_size if self.page_size != 200 else "",
             "sort": sort, "thumb": self.thumbs if self.thumbs != "any" else "", "fav": self.favourites if self.favourites != "any" else "", "seed": self.seed or ""}
        for name, (lo, hi) in self.ranges.items():
            p |= {f"min_{name}": "" if lo is None else lo, f"max_{name}": "" if hi is None else hi}
        return urlencode({k: v for k, v in p.items() if v != ""})


@dataclass(frozen=True)
class Catalogue:
    """One dataset's tables. ``entries``: ordinal, video_name, caption, source_path and its own numbers; ``metadata`` and ``stats``:
    keyed by video_name; ``vectors``: prefix, video_name, embedding; ``favourites``: video_name."""

    name: str
    entries: DataFrame
    metadata: DataFrame | None = None
    stats: DataFrame | None = None
    vectors: DataFrame | None = None
    favourites: DataFrame | None = None
    #: The vector spaces there are, where that is known; asking for another one is an error.
    prefixes: tuple[str, ...] = ()

    def own_fields(self) -> list[str]:
        return profile.numeric_fields(self.entries, "ordinal")

    def enriched(self, rows: DataFrame, only: Collection[str] | None = None, names: DataFrame | None = None) -> DataFrame:
        """Rows with the fields of all sources. Of a name that several sources have, the entries' value counts, then the stats',
        then the metadata's. ``only``: the fields that are wanted; a source with none of them is not joined. ``names``: a few
        rows with the video_names of ``rows``, by which the sources are cut down first."""
        own = self.own_fields()
        sources = [(s, df) for s, df in (("stats", self.stats), ("metadata", self.metadata)) if df is not None]
        sides = {s: profile.numeric_fields(df, "video_name") for s, df in sources}
        rows = rows.drop(*({f for fs in sides.values() for f in fs} - set(own)))  # from an enrichment before
        for name, df in sources:
            fields = [f for f in sides[name] if only is None or f in only]
            if not fields:
                continue
            if names is not None:
                df = df.join(F.broadcast(names.select("video_name").distinct()), "video_name", "left_semi")
            side = df.select("video_name", *(number(F.col(f)).alias(f"{name}${f}") for f in fields))
            rows = rows.join(side, "video_name", "left")
        fields: dict[str, list[Column]] = {f: [number(F.col(f))] for f in own if f in rows.columns}
        for c in rows.columns:
            source, mark, f = c.partition("$")
            if mark:
                fields.setdefault(f, []).append(F.col(f"`{c}`"))
        kept = [c for c in rows.columns if "$" not in c and c not in fields]
        return rows.select(*kept, *(F.coalesce(*cs).alias(f) for f, cs in fields.items()))

    @cached_property
    def _axes(self) -> list[tuple]:
        parts = [profile.tall(self.entries.drop("ordinal"), "video_name")]
        parts += [profile.tall(df, "video_name") for df in (self.metadata, self.stats) if df is not None]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return [tuple(r) for r in profile.field_stats(every).collect()]  # one row per field

    def axes(self) -> DataFrame:
        """(field, min, max, count) over the whole dataset: the axes of every histogram, computed once for a catalogue."""
        return self.entries.sparkSession.createDataFrame(self._axes, "field string, min double, max double, count long")

    def index(self, prefix: str) -> DataFrame:
        if self.vectors is None:
            raise ValueError(f"{self.name} has no vectors")
        if self.prefixes and prefix not in self.prefixes:
            raise ValueError(f"{self.name} has no vectors named {prefix!r}; there are {sorted(self.prefixes)}")
        return self.vectors.where(F.col("prefix") == prefix)


@dataclass(frozen=True)
class Result:
    """``slim``: everything that is left, with the fields that ranges and order need; ``page``, ``total``, ``rows``, ``histograms`` and
    ``export`` derive from it when asked. Only a page's rows are enriched for a page."""

    catalogue: Catalogue
    request: Request
    slim: DataFrame
    order: list[Column]
    score: str | None = None

    @property
    def rows(self) -> DataFrame:
        """All that is left, with the fields of all sources."""
        return self.catalogue.enriched(self.slim)

    @property
    def page(self) -> DataFrame:
        some = written(relational.page(self.slim, self.order, self.request.page, self.request.page_size), "page")
        return self.catalogue.enriched(some, names=some).orderBy(*self.order)

    @property
    def total(self) -> int:
        return self.slim.count()

    def histograms(self, bins: int = profile.BINS) -> DataFrame:
        """Over all rows before paging, on the dataset's axes, so that the shape does not depend on the query; a score's
        axis is its declared range."""
        rows = self.rows
        fields = profile.numeric_fields(rows, "ordinal", "base_order")
        axes = self.catalogue.axes().select("field", "min", "max").where(F.col("field").isin(fields))
        if self.score:
            axes = axes.unionByName(rows.sparkSession.createDataFrame([(self.score, *SCORE_RANGE)], "field string, min double, max double"))
        return profile.histograms(profile.tall(rows, "video_name", fields), axes, bins)

    def export(self) -> DataFrame:
        """Names and paths of all pages in the same order."""
        return self.slim.orderBy(*self.order).select("video_name", "source_path")


def finished(catalogue: Catalogue, request: Request, rows: DataFrame, score: str | None = None) -> Result:
    """The part that all kinds of search share: ranges (the query's own score too), thumbs, favourites, order. Only the sources that
    ranges or order name are joined. ``rows`` has base_order: the order that counts where nothing else does."""
    rows = catalogue.enriched(rows, {*request.ranges, request.sort})
    rows = rows.where(relational.in_ranges(request.ranges, rows.columns))
    for choice, members in ((request.thumbs, catalogue.metadata), (request.favourites, catalogue.favourites)):
        if choice != "any":
            if members is None:
                raise ValueError("the catalogue lacks the table that the choice asks for")
            rows = relational.ternary(rows, members, choice, "video_name")
    order = relational.sorted_by(rows, request.sort, request.direction, "base_order", seed=request.seed)
    return Result(catalogue, request, rows, order, score)


def text_search(catalogue: Catalogue, request: Request, vector: Sequence[float] | None = None) -> Result:
    """Entries whose caption matches. With the query's vector each that has one in the index also gets its score."""
    rows = textquery.search(catalogue.entries, request.query).withColumn("base_order", F.col("ordinal"))
    score = None
    if vector is not None and request.query.strip():
        score = SCORES.get(request.index, "score")
        rows = rows.join(vectors.scored(catalogue.index(request.index), vector, score=score), "video_name", "left")
    return finished(catalogue, request, rows, score)


def _by_score(catalogue: Catalogue, request: Request, scores: DataFrame, score: str) -> Result:
    """Vector hits joined with their entries, if they have one (else with an empty caption), best first, ties by name."""
    first = relational.first_wins(catalogue.entries, ["video_name"], "ordinal")
    rows = scores.where(F.col(score).isNotNull()).join(first, "video_name", "left")
    rows = rows.withColumns({"caption": F.coalesce("caption", F.lit("")), "base_order": F.struct((-F.col(score)).alias("s"), F.col("video_name").alias("n"))})
    return finished(catalogue, request, rows, score)


def semantic_search(catalogue: Catalogue, request: Request, vector: Sequence[float]) -> Result:
    """All vectors of the index, by their inner product with the query's vector."""
    score = SCORES.get(request.index, "score")
    return _by_score(catalogue, request, vectors.scored(catalogue.index(request.index), vector, score=score), score)


def centroid_search(catalogue: Catalogue, request: Request, selection: DataFrame) -> Result:
    """All vectors of the index, by their cosine with the selection's centroid."""
    score = SCORES.get(request.index, "score")
    found = vectors.centroid_search(catalogue.index(request.index), selection)
    return _by_score(catalogue, replace(request, query=""), found.withColumnRenamed("score", score), score)


def scatter(result: Result, x: str, y: str, size: int = SCATTER, seed: int = 0) -> DataFrame:
    """(ordinal, video_name, x, y) of a sample of at most ``size`` rows, never more than SCATTER_MOST; rows that lack a value are dropped
    after sampling."""
    some = written(relational.sample(result.slim, max(0, min(size, SCATTER_MOST)), seed, "video_name", "base_order"), "sample")
    rows = result.catalogue.enriched(some, {x, y}, names=some)
    none = F.lit(None).cast("double")
    rows = rows.select("ordinal", "video_name", *((number(F.col(f)) if f in rows.columns else none).alias(n) for f, n in ((x, "x"), (y, "y"))))
    return rows.where("x is not null and y is not null")


def shaped(rows: DataFrame, base: str = "/thumbnails") -> DataFrame:
    """Result rows with the address of their picture. ``rows``: dataset, video_name and more."""
    return rows.withColumn("thumb_url", F.concat(F.lit(f"{base}/"), "dataset", F.lit("/"), "video_name", F.lit("/thumb_middle.jpg")))


def datasets(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """(dataset, n, has_metadata): the entries of each dataset, and whether any has metadata. Both by dataset and video_name."""
    has = metadata.select("dataset", "video_name").distinct().withColumn("h", F.lit(True))
    rows = entries.select("dataset", "video_name").join(has, ["dataset", "video_name"], "left")
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("h", F.lit(False))).alias("has_metadata"))


def detail(catalogue: Catalogue, name: str) -> DataFrame:
    """One record with all it has: the first entry of the name; no row if there is none."""
    rows = catalogue.entries.where(F.col("video_name") == name).orderBy("ordinal").limit(1)
    return catalogue.enriched(rows, names=rows)
