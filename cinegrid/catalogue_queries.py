"""One query per operator of the catalogue engine, under the operator's identifier, each with its SQL."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegrid import model, sinks
from cinegrid.functions import scalars as S
from cinegrid.functions.vectors import usable
from cinegrid.operators import profile as P
from cinegrid.operators import records as rec
from cinegrid.operators import relational as R
from cinegrid.operators import textquery as Q
from cinegrid.operators import vectors as V
from cinegrid.plans import search as plan
from cinegrid.queries import _RECORDS, ask, table
from cinegrid.scratch import hadoop_path, new_path, written
from cinegrid.sources import catalogue as src
from cinegrid.streaming import incremental as inc

META = ("width", "height", "fps", "num_frames", "duration", "file_size_mb")


# -- the tables in the engine's terms, and the same in SQL

def entries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "manifest").select(F.col("entry_id").alias("ordinal"), F.concat("dataset", F.lit("_"), "video_name").alias("video_name"), "caption", "source_path",
                                          S.number(F.col("aesthetic")).alias("aesthetic"), S.number(F.col("global_motion")).alias("global_motion"))


def metadata(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "metadata").select(F.concat("dataset", F.lit("_"), "video_name").alias("video_name"), "merged_at", *(S.number(F.col(c)).alias(c) for c in META))
    return R.last_wins(rows, ["video_name"], ["merged_at"]).drop("merged_at")


def stats(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select(F.concat("dataset", F.lit("_"), "video_name").alias("video_name"), "created_at", "doc_id", F.col("n_chars").cast("double").alias("text_chars"))
    return R.last_wins(rows.where("video_name is not null"), ["video_name"], ["created_at", "doc_id"]).select("video_name", "text_chars")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.lit("clip").alias("prefix"), F.col("vec_id").cast("string").alias("video_name"), "embedding", "vec_id", "label")


def favourites(s: SparkSession, d: str) -> DataFrame:
    return entries(s, d).where("ordinal % 7 = 0").select("video_name").distinct()


@lru_cache(maxsize=8)
def catalogue(s: SparkSession, d: str) -> plan.Catalogue:
    """One catalogue per folder, as a server holds it: its axes are computed once."""
    return plan.Catalogue("manifest", entries(s, d), metadata(s, d), stats(s, d), vectors(s, d), favourites(s, d))


def by_number(s: SparkSession, d: str) -> plan.Catalogue:
    """The catalogue with entries named by their number, as the vectors are."""
    return plan.Catalogue("numbered", entries(s, d).withColumn("video_name", F.col("ordinal").cast("string")), vectors=vectors(s, d))


def first_vector(s: SparkSession, d: str) -> list[float]:
    return table(s, d, "embeddings").where("vec_id = 0").first()["embedding"]


_N = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE CAST({c} AS DOUBLE) END AS {c}"
_M = ", ".join(f"{c} DESC NULLS LAST" for c in META)
BASE = f"""
WITH e AS (
  SELECT entry_id AS ordinal, dataset || '_' || video_name AS video_name, caption, source_path, {_N('aesthetic')}, {_N('global_motion')} FROM manifest
), m0 AS (
  SELECT dataset || '_' || video_name AS video_name, merged_at, width::DOUBLE AS width, height::DOUBLE AS height, {_N('fps')}, num_frames::DOUBLE AS num_frames, {_N('duration')}, {_N('file_size_mb')} FROM metadata
), m AS (
  SELECT * EXCLUDE (merged_at) FROM m0 QUALIFY row_number() OVER (PARTITION BY video_name ORDER BY merged_at DESC NULLS LAST, {_M}) = 1
), st AS (
  SELECT dataset || '_' || video_name AS video_name, n_chars::DOUBLE AS text_chars FROM documents WHERE dataset || '_' || video_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dataset || '_' || video_name ORDER BY created_at DESC NULLS LAST, doc_id DESC) = 1
), fav AS (
  SELECT DISTINCT video_name FROM e WHERE ordinal % 7 = 0
), x AS (
  SELECT e.*, text_chars, width, height, fps, num_frames, duration, file_size_mb FROM e LEFT JOIN st USING (video_name) LEFT JOIN m USING (video_name)
), tall AS (
  UNPIVOT (SELECT video_name, aesthetic, global_motion FROM e) ON aesthetic, global_motion INTO NAME field VALUE value
  UNION ALL UNPIVOT m ON width, height, fps, num_frames, duration, file_size_mb INTO NAME field VALUE value
  UNION ALL UNPIVOT st ON text_chars INTO NAME field VALUE value
), q0 AS (
  SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0
), qv AS (
  SELECT list_transform(q, lambda y: y / sqrt(list_dot_product(q, q))) AS q FROM q0
)
"""
LOW = "lower(coalesce(caption, ''))"


def slim(df: DataFrame) -> DataFrame:
    return df.select("ordinal")


# -- text queries

def _text(query: str):
    return lambda s, d: slim(Q.search(entries(s, d), query))


for _name, _query, _where in (
    ("flt_2", "river", f"contains({LOW}, 'river')"),
    ("flt_3", "the !of", f"contains({LOW}, 'the') AND NOT contains({LOW}, 'of')"),
    ("flt_4", "drone|glow a", f"(contains({LOW}, 'drone') OR contains({LOW}, 'glow')) AND contains({LOW}, 'a')"),
    ("flt_5", "'warm golden glow'", f"contains({LOW}, 'warm golden glow')"),
    ("flt_1", "'soft morning' Clip|take !drone x||y a", f"contains({LOW}, 'soft morning') AND (contains({LOW}, 'clip') OR contains({LOW}, 'take')) AND NOT contains({LOW}, 'drone') AND (contains({LOW}, 'x') OR contains({LOW}, 'y')) AND contains({LOW}, 'a')"),
):
    ask(_name, f"{BASE} SELECT ordinal FROM e WHERE {_where}")(_text(_query))

ask("flt_6", BASE + f"SELECT ordinal FROM e WHERE contains({LOW}, 'the') ORDER BY ordinal LIMIT 25")(lambda s, d: slim(Q.search(entries(s, d), "the", limit=25)))


# -- filters

RANGES = {"aesthetic": (4.0, 7.5), "width": (720.0, None)}
ask("flt_7", BASE + "SELECT ordinal FROM x WHERE aesthetic >= 4 AND aesthetic <= 7.5 AND width >= 720")(
    lambda s, d: slim(plan.finished(catalogue(s, d), plan.Request(ranges=RANGES), entries(s, d).withColumn("base_order", F.col("ordinal"))).rows))
ask("jn_12", BASE + "SELECT ordinal, text_chars, fps FROM x WHERE text_chars >= 300 AND fps <= 30")(
    lambda s, d: catalogue(s, d).enriched(entries(s, d), ["text_chars", "fps"]).where(R.in_ranges({"text_chars": (300, None), "fps": (None, 30)}, ["text_chars", "fps"])).select("ordinal", "text_chars", "fps"))
ask("flt_8", BASE + "SELECT ordinal FROM e WHERE global_motion >= 2.5")(
    lambda s, d: slim(entries(s, d).where(R.in_ranges(R.parse_ranges({"min_global_motion": "2.5", "max_global_motion": "", "sort": "x"}), ["global_motion"]))))
ask("flt_15", BASE + "SELECT ordinal FROM e WHERE aesthetic <= 6")(
    lambda s, d: slim(entries(s, d).where(R.in_ranges(R.only_active({"aesthetic": (None, 6.0), "hidden": (1.0, 2.0)}, ["aesthetic"]), ["aesthetic"]))))
for _name, _of, _how, _where in (
    ("flt_9", "metadata", "only", "IN (SELECT video_name FROM m)"), ("jn_7", "metadata", "none", "NOT IN (SELECT video_name FROM m WHERE video_name IS NOT NULL)"),
    ("flt_10", "favourites", "only", "IN (FROM fav)"), ("jn_8", "favourites", "none", "NOT IN (FROM fav)"),
):
    ask(_name, f"{BASE} SELECT ordinal FROM e WHERE video_name {_where}")(
        lambda s, d, of=_of, how=_how: slim(R.ternary(entries(s, d), {"metadata": metadata, "favourites": favourites}[of](s, d), how, "video_name")))


@ask("flt_11", "SELECT DISTINCT sample_id FROM sample_files GROUP BY sample_id HAVING count(DISTINCT artifact) < 2")
def flt_11(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "sample_files")
    return R.incomplete(files, files, ["origins.json", "metadata.json"])


ask("flt_13", BASE + "SELECT ordinal FROM e WHERE source_path IN (SELECT source_path FROM origins)")(
    lambda s, d: slim(R.ternary(entries(s, d), table(s, d, "origins"), "only", "source_path")))
ask("flt_14", BASE + "SELECT ordinal FROM e WHERE video_name IN (FROM fav) AND contains(" + LOW + ", 'the')")(
    lambda s, d: slim(R.ternary(Q.search(entries(s, d), "the"), favourites(s, d), "only", "video_name")))
ask("flt_16", "SELECT entry_id AS ordinal FROM manifest WHERE video_name <> '' AND source_path <> ''")(
    lambda s, d: slim(R.named(entries(s, d), "video_name", "source_path")))
_W = "string_split_regex(" + LOW + r""", '[\s,.;:!?''"()\[\]{}\-/\\]+')"""
_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "]"
_CONTENT = f"list_filter({_W}, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"
ask("flt_18", f"{BASE} SELECT ordinal FROM e WHERE list_contains({_CONTENT}, 'glow')")(lambda s, d: slim(entries(s, d).where(Q.holds_word(F.col("caption"), "Glow"))))
ask("flt_17", "SELECT vec_id FROM embeddings WHERE vec_id % 400 = 3 AND vec_id IN (SELECT entry_id FROM manifest)")(
    lambda s, d: R.selected(vectors(s, d), table(s, d, "manifest").where("entry_id % 400 = 3").select(F.col("entry_id").cast("string").alias("video_name")), "video_name").select("vec_id"))


# -- joins and projections

ask("jn_1", BASE + "SELECT ordinal, width, fps FROM e LEFT JOIN m USING (video_name)")(lambda s, d: entries(s, d).join(metadata(s, d), "video_name", "left").select("ordinal", "width", "fps"))
ask("jn_2", BASE + "SELECT ordinal, text_chars FROM e LEFT JOIN st USING (video_name)")(lambda s, d: entries(s, d).join(stats(s, d), "video_name", "left").select("ordinal", "text_chars"))
ask("jn_3", BASE + "SELECT ordinal, aesthetic, text_chars, height FROM x")(lambda s, d: catalogue(s, d).enriched(entries(s, d)).select("ordinal", "aesthetic", "text_chars", "height"))
ask("prj_3", BASE + "SELECT ordinal, aesthetic, global_motion, text_chars, width, height, fps, num_frames, duration, file_size_mb FROM x WHERE contains(" + LOW + ", 'the')")(
    lambda s, d: plan.text_search(catalogue(s, d), plan.Request(query="the")).rows.select("ordinal", "aesthetic", "global_motion", "text_chars", *META))
ask("jn_4", BASE + "SELECT vec_id, coalesce(caption, '') AS caption FROM embeddings LEFT JOIN e ON vec_id = ordinal")(
    lambda s, d: plan.semantic_search(by_number(s, d), plan.Request(), first_vector(s, d)).rows.select(F.col("video_name").cast("long").alias("vec_id"), "caption"))
_DOT = "list_dot_product(embedding::DOUBLE[], q)"
ask("jn_5", BASE + f"SELECT ordinal, round({_DOT}, 6) AS score FROM e LEFT JOIN embeddings ON vec_id = ordinal, qv WHERE contains({LOW}, 'the')")(
    lambda s, d: plan.text_search(by_number(s, d), plan.Request(query="the"), first_vector(s, d)).rows.select("ordinal", F.round("score", 6).alias("score")))
ask("jn_6", "SELECT vec_id, label FROM embeddings, range(2) WHERE vec_id % 50 = 0")(
    lambda s, d: R.selected(vectors(s, d), vectors(s, d).where("vec_id % 50 = 0").select("video_name", F.explode(F.array(F.lit(1), F.lit(2)))).select("video_name"), "video_name").select("vec_id", "label"))
ask("jn_9", "SELECT DISTINCT sample_id FROM sample_files WHERE sample_id NOT IN (SELECT sample_id FROM origins WHERE seen_at < TIMESTAMP '2024-07-01' AND sample_id IS NOT NULL)")(
    lambda s, d: R.fresh(table(s, d, "sample_files"), table(s, d, "origins").where("seen_at < timestamp'2024-07-01'"), "sample_id"))
ask("jn_14", "SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events QUALIFY step IS NOT NULL")(
    lambda s, d: P.consecutive(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_id", lambda a, b: b - a).select("event_id", F.col("distance").alias("step")))
ask("prj_1", "SELECT entry_id AS ordinal, caption, '/thumbnails/' || dataset || '/' || video_name || '/thumb_middle.jpg' AS thumb_url FROM manifest")(
    lambda s, d: plan.shaped(table(s, d, "manifest")).select(F.col("entry_id").alias("ordinal"), "caption", "thumb_url"))
ask("prj_2", BASE + "SELECT field, count(*) AS n, count(DISTINCT video_name) AS names FROM tall GROUP BY field")(
    lambda s, d: P.per_source({"e": entries(s, d).drop("ordinal"), "m": metadata(s, d), "s": stats(s, d)}, "video_name").groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("key").alias("names")))
ask("prj_4", BASE + "SELECT ordinal, caption, aesthetic, width, text_chars FROM x WHERE video_name = (SELECT video_name FROM e WHERE ordinal = 3) ORDER BY ordinal LIMIT 1")(
    lambda s, d: plan.detail(catalogue(s, d), entries(s, d).where("ordinal = 3").first()["video_name"]).select("ordinal", "caption", "aesthetic", "width", "text_chars"))
ask("prj_5", BASE + "SELECT ordinal, coalesce(text_chars, width) AS v FROM x")(
    lambda s, d: plan.Catalogue("c", entries(s, d), metadata(s, d).select("video_name", F.col("width").alias("v")), stats(s, d).select("video_name", F.col("text_chars").alias("v"))).enriched(entries(s, d)).select("ordinal", "v"))
ask("prj_6", BASE + "SELECT ordinal, coalesce(width, aesthetic, text_chars) AS v FROM x")(
    lambda s, d: catalogue(s, d).enriched(entries(s, d)).select("ordinal", F.coalesce("width", "aesthetic", "text_chars").alias("v")))
ask("prj_7", "SELECT dataset, count(*) AS n, bool_or(h) AS has_metadata FROM (SELECT dataset, (dataset, video_name) IN (SELECT (dataset, video_name) FROM metadata WHERE dataset IS NOT NULL AND video_name IS NOT NULL) AS h FROM manifest) GROUP BY dataset")(
    lambda s, d: plan.datasets(table(s, d, "manifest"), table(s, d, "metadata")))
ask("prj_13", "SELECT file_id, round(frames / greatest(fps, 1e-6), 3) AS duration, round(size_bytes / 1048576.0, 2) AS mb FROM (SELECT file_id, size_bytes, (file_id % 900 + 1) AS frames, 24.0 + file_id % 7 AS fps FROM sample_files)")(
    lambda s, d: table(s, d, "sample_files").select("file_id", *(c.alias(n) for c, n in zip(S.media_fields((F.col("file_id") % 900 + 1).cast("double"), (F.lit(24.0) + F.col("file_id") % 7), F.col("size_bytes")), ("duration", "mb")))))
ask("prj_15", BASE + "SELECT field, row_number() OVER (ORDER BY coalesce(nullif(list_position(['" + "','".join(S.FIELD_ORDER) + "'], field), 0), 99), field) AS place FROM (SELECT DISTINCT field FROM tall)")(
    lambda s, d: P.field_stats(P.per_source({"e": entries(s, d).drop("ordinal"), "m": metadata(s, d), "s": stats(s, d)}, "video_name").select("field", "value"))
    .select("field", F.row_number().over(Window.orderBy(*S.canonical_rank(F.col("field")))).cast("long").alias("place")))  # one row per field
ask("prj_16", BASE + f"SELECT ordinal, aesthetic, round({_DOT}, 6) AS score FROM e JOIN embeddings ON vec_id = ordinal, qv")(
    lambda s, d: by_number(s, d).enriched(entries(s, d).withColumn("video_name", F.col("ordinal").cast("string"))).join(V.scored(vectors(s, d), first_vector(s, d)), "video_name").select("ordinal", "aesthetic", F.round("score", 6).alias("score")))


# -- profiles

def _values(s: SparkSession, d: str) -> DataFrame:
    return P.per_source({"e": entries(s, d).drop("ordinal"), "m": metadata(s, d), "s": stats(s, d)}, "video_name")


ask("agg_1", BASE + "SELECT field, min(value) AS min, max(value) AS max, count(*) AS count FROM tall GROUP BY field")(lambda s, d: catalogue(s, d).axes())
ask("set_7", BASE + "SELECT field, value FROM tall")(lambda s, d: _values(s, d).select("field", "value"))


def _histogram_sql(values: str, axes: str, bins: int) -> str:
    return f"""{BASE}, v AS ({values}), ax AS ({axes}), hits AS (
  SELECT field, least({bins - 1}, greatest(0, CAST(trunc((value - lo) / CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1 END) AS INT))) AS bin, count(*) AS n FROM v JOIN ax USING (field) GROUP BY ALL
) SELECT field, CAST(b AS INT) AS bin, coalesce(n, 0) AS count FROM ax CROSS JOIN range({bins}) r(b) LEFT JOIN hits USING (field) WHERE FALSE
UNION ALL SELECT ax.field, CAST(b AS INT), coalesce(n, 0) FROM ax CROSS JOIN range({bins}) r(b) LEFT JOIN hits ON hits.field = ax.field AND hits.bin = b"""


_AXES = "SELECT field, min(value) AS lo, max(value) AS hi FROM tall GROUP BY field"
_ON_DATA = _histogram_sql("SELECT field, value FROM tall", _AXES, 60).replace("SELECT field, CAST(b AS INT) AS bin, coalesce(n, 0) AS count FROM ax CROSS JOIN range(60) r(b) LEFT JOIN hits USING (field) WHERE FALSE\nUNION ALL SELECT ax.field, CAST(b AS INT), coalesce(n, 0)", "SELECT ax.field, CAST(b AS INT) AS bin, coalesce(n, 0) AS count")
_RESULT = "SELECT field, value FROM (UNPIVOT (SELECT aesthetic, global_motion, text_chars, width, height, fps, num_frames, duration, file_size_mb FROM x WHERE contains(" + LOW + ", 'glow')) ON COLUMNS(*) INTO NAME field VALUE value)"


@ask("agg_2", """WITH ax AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), hits AS (
  SELECT least(59, greatest(0, CAST(trunc((o_totalprice - lo) / ((hi - lo) / 60)) AS INT))) AS b, count(*) AS n FROM orders, ax GROUP BY ALL)
SELECT CAST(r.b AS INT) AS bin, coalesce(n, 0) AS count FROM range(60) r(b) LEFT JOIN hits USING (b)""")
def agg_2(s: SparkSession, d: str) -> DataFrame:
    values = P.tall(table(s, d, "orders"), "o_orderkey", ["o_totalprice"])
    return P.histograms(values, P.field_stats(values)).select("bin", "count")


ask("agg_3", _ON_DATA)(lambda s, d: P.histograms(_values(s, d), catalogue(s, d).axes()))
ask("agg_4", _ON_DATA.replace("v AS (SELECT field, value FROM tall)", f"v AS ({_RESULT})"))(lambda s, d: plan.text_search(catalogue(s, d), plan.Request(query="glow")).histograms())
ask("agg_5", BASE + f"SELECT count(*) AS total FROM e WHERE contains({LOW}, 'glow')")(lambda s, d: plan.text_search(catalogue(s, d), plan.Request(query="glow")).rows.agg(F.count("*").alias("total")))
_SEQ = "coalesce(round({}, 4), 0)"
ask("agg_6", "SELECT user_id, round(avg(value), 4) AS mean, round(max(value), 4) AS max, round(min(value), 4) AS min, round(stddev_pop(value), 4) AS std FROM events GROUP BY user_id")(
    lambda s, d: P.sequence_summary(table(s, d, "events"), "user_id", "value"))
_STEP = "SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events"
ask("agg_7", f"SELECT user_id, round(coalesce(stddev_pop(step), 0), 4) AS variability FROM ({_STEP}) GROUP BY user_id")(
    lambda s, d: P.sequence_variability(table(s, d, "events"), "user_id", ["ts", "event_id"], "value"))
ask("win_1", f"SELECT user_id, round(sum(abs(step)), 3) AS path FROM ({_STEP}) GROUP BY user_id")(
    lambda s, d: P.path_length(table(s, d, "events"), "user_id", ["ts", "event_id"], "value"))
_PAIRS = "SELECT label, round(avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS diversity FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id GROUP BY label"
ask("win_8", """SELECT event_id, round((sum(event_id % 5) OVER w - sum(event_id % 5) OVER t) * sum(event_id % 7 + 1) OVER t / nullif(sum(event_id % 5) OVER t, 0), 4) AS eta FROM events
  WINDOW w AS (PARTITION BY user_id), t AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")(
    lambda s, d: R.with_eta(table(s, d, "events").withColumns({"done": F.col("event_id") % 5, "took": F.col("event_id") % 7 + 1}), "user_id", ["ts", "event_id"], "done", "took").select("event_id", F.round("eta", 4).alias("eta")))
ask("agg_8", _PAIRS)(lambda s, d: V.diversity(table(s, d, "embeddings"), "label", decimals=5))
ask("jn_15", _PAIRS)(lambda s, d: V.diversity(table(s, d, "embeddings"), "label", decimals=5))
ask("agg_9", "SELECT user_id, arg_max(CAST(props->>'$.k' AS INT), {'t': ts, 'e': event_id}) AS k FROM events GROUP BY user_id")(
    lambda s, d: R.last_wins(table(s, d, "events").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), ["user_id"], ["ts", "event_id"]).select("user_id", "k"))
ask("agg_10", "SELECT vec_id, CASE WHEN vec_id >= 250 THEN label + 100 ELSE label END AS label FROM embeddings")(
    lambda s, d: R.upserted(vectors(s, d).where("vec_id < 300").select("vec_id", "label"), vectors(s, d).where("vec_id >= 250").select("vec_id", (F.col("label") + 100).alias("label")), "vec_id"))
_CENTROID = """
, c AS (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) WHERE vec_id % 50 = 0 GROUP BY i
), cv AS (SELECT list(m / l ORDER BY i) AS q FROM c, (SELECT sqrt(sum(m * m)) AS l FROM c))
"""


def _picked(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).where("vec_id % 50 = 0").select("video_name")


ask("agg_11", BASE + _CENTROID + "SELECT i AS place, round(q[i], 6) AS x FROM cv, range(1, 65) r(i)")(
    lambda s, d: s.createDataFrame([(i + 1, x) for i, x in enumerate(V.centroid(vectors(s, d), _picked(s, d)))], "place long, x double").select("place", F.round("x", 6).alias("x")))
_WORDS = f"""
, words AS (SELECT ordinal, unnest({_CONTENT}) AS word FROM e
), freq AS (SELECT word, count(*) AS count, count(DISTINCT ordinal) / (SELECT count(*) FROM e) AS pct FROM words GROUP BY word ORDER BY count DESC, word LIMIT 150)
"""
ask("agg_12", BASE + _WORDS + "SELECT word, count, round(pct, 9) AS pct FROM freq")(lambda s, d: P.word_frequency(entries(s, d), "caption", 150).withColumn("pct", F.round("pct", 9)))
ask("srt_9", BASE + _WORDS + "SELECT word, count FROM freq ORDER BY count DESC, word LIMIT 20")(lambda s, d: P.word_frequency(entries(s, d), "caption", 20).select("word", "count"))
ask("agg_13", BASE + f"SELECT ordinal, array_to_string(list_sort(list_distinct({_CONTENT})), ' ') AS words FROM e")(
    lambda s, d: entries(s, d).select("ordinal", F.concat_ws(" ", F.array_sort(F.array_distinct(S.content_words(F.col("caption"))))).alias("words")))
_DIFF = f"""{BASE}
, a AS (SELECT * FROM e WHERE contains({LOW}, 'glow')), wa AS (SELECT ordinal, unnest({_CONTENT}) AS word FROM a), wb AS (SELECT ordinal, unnest({_CONTENT}) AS word FROM e
), fa AS (SELECT word, count(*) AS count, count(DISTINCT ordinal) / (SELECT count(*) FROM a) AS pct FROM wa GROUP BY word ORDER BY count DESC, word LIMIT 150
), fb AS (SELECT word, count(DISTINCT ordinal) / (SELECT count(*) FROM e) AS pct FROM wb GROUP BY word ORDER BY count(*) DESC, word LIMIT 300)
SELECT word, count, round(fa.pct, 9) AS pct, round(fa.pct - coalesce(fb.pct, 0), 9) AS difference FROM fa LEFT JOIN fb USING (word)"""
for _name in ("agg_14", "jn_16"):
    ask(_name, _DIFF)(lambda s, d: P.word_difference(Q.search(entries(s, d), "glow"), entries(s, d), "caption").withColumns({"pct": F.round("pct", 9), "difference": F.round("difference", 9)}))
_SUM = "SELECT field, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 4) AS std FROM tall GROUP BY field"
ask("agg_15", BASE + _SUM)(lambda s, d: P.summaries(_values(s, d)).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)}))
ask("agg_16", BASE + "SELECT field, round(avg(value) FILTER (video_name IN (FROM fav)) - avg(value), 4) AS difference FROM tall GROUP BY field")(
    lambda s, d: P.summary_difference(_values(s, d).join(favourites(s, d).withColumnRenamed("video_name", "key"), "key", "left_semi"), _values(s, d)).withColumn("difference", F.round("difference", 4)))
ask("agg_17", "SELECT round(corr(p_size, p_retailprice), 6) AS r FROM part")(lambda s, d: table(s, d, "part").agg(F.round(P.correlation(F.col("p_size").cast("double"), F.col("p_retailprice")), 6).alias("r")))
_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ask("agg_18", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))(
    lambda s, d: P.correlations(table(s, d, "lineitem"), list(_CORR)).withColumn("r", F.round("r", 6)))
ask("agg_19", """WITH ax AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), hits AS (
  SELECT least(19, greatest(0, CAST(floor((o_totalprice - lo) / (hi - lo) * 20) AS INT))) AS b, count(*) AS n FROM orders, ax GROUP BY ALL)
SELECT CAST(r.b AS INT) AS bin, coalesce(n, 0) AS count FROM range(20) r(b) LEFT JOIN hits USING (b)""")(lambda s, d: P.panel_histogram(table(s, d, "orders"), "o_totalprice"))
ask("agg_20", "SELECT dataset AS key, a AS before, b AS after FROM (SELECT dataset, count(*) AS a FROM manifest GROUP BY dataset) JOIN (SELECT dataset, count(*) AS b FROM origins GROUP BY dataset) USING (dataset) WHERE a <> b")(
    lambda s, d: P.status_changed(table(s, d, "manifest").groupBy("dataset").count(), table(s, d, "origins").groupBy("dataset").count()))
ask("set_6", "SELECT dataset FROM manifest INTERSECT SELECT dataset FROM origins")(lambda s, d: R.shared(table(s, d, "manifest"), table(s, d, "origins"), "dataset"))
_TIER = "SELECT sample_id, count(DISTINCT artifact) AS tier FROM sample_files WHERE artifact IN ('origins.json', 'metadata.json') GROUP BY sample_id"


def _tiers(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "sample_files")
    return model.tiers(files, files, {"a": ["origins.json"], "b": ["metadata.json"]})


ask("agg_21", f"SELECT tier, count(*) AS count FROM ({_TIER}) GROUP BY tier")(lambda s, d: _tiers(s, d).groupBy("tier").count())
ask("jn_17", _TIER)(_tiers)
ask("agg_22", BASE + "SELECT field, min(value) AS min, max(value) AS max, count(*) AS count FROM tall GROUP BY field")(
    lambda s, d: P.widened(catalogue(s, d).axes(), P.field_stats(_values(s, d).where("source = 'm'"))))
ask("agg_24", "SELECT json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT' AS ok, count(*) AS count FROM (SELECT coalesce(body, '') AS body FROM sample_files) GROUP BY ok")(
    lambda s, d: src.parsed_objects(table(s, d, "sample_files"), "file_id", "body").groupBy("ok").count())
for _name in ("agg_25", "win_3"):
    ask(_name, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")(
        lambda s, d: R.first_wins(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("place")), ["l_orderkey"], "place").drop("place"))
ask("agg_26", "SELECT DISTINCT unnest(json_keys(body)) AS field FROM (SELECT body FROM sample_files WHERE json_valid(body)) WHERE json_type(body) = 'OBJECT'")(
    lambda s, d: src.object_fields(table(s, d, "sample_files"), "body"))
ask("agg_27", "SELECT count(*) AS selected FROM embeddings WHERE vec_id % 50 = 0")(lambda s, d: R.selected(vectors(s, d), _picked(s, d), "video_name").agg(F.count("*").alias("selected")))


def _must_parse(row: dict) -> None:
    import json

    if not isinstance(json.loads(row["body"] or ""), dict):
        raise ValueError("no object")


# -- vectors

ask("vec_1", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda y: y / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")(
    lambda s, d: vectors(s, d).select("vec_id", F.round(F.aggregate(V.normalised(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 6).alias("total")))
for _name in ("vec_2", "srt_8"):
    ask(_name, BASE + f"SELECT vec_id, round({_DOT}, 9) AS score FROM embeddings, qv ORDER BY {_DOT} DESC, vec_id::VARCHAR LIMIT 20")(
        lambda s, d: V.top(vectors(s, d), first_vector(s, d), 20).select(F.col("video_name").cast("long").alias("vec_id"), F.round("score", 9).alias("score")))
ask("vec_10", BASE + f"SELECT vec_id, round({_DOT}, 9) AS score FROM embeddings, qv WHERE vec_id < 30")(  # more are asked for than there are
    lambda s, d: V.top(vectors(s, d).where("vec_id < 30"), first_vector(s, d), 200).select(F.col("video_name").cast("long").alias("vec_id"), F.round("score", 9).alias("score")))
ask("vec_3", BASE + f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings LEFT JOIN e ON vec_id = ordinal, qv WHERE {_DOT} >= 0.1")(
    lambda s, d: plan.semantic_search(by_number(s, d), plan.Request(ranges={"score": (0.1, None)}), first_vector(s, d)).rows.select(F.col("video_name").cast("long").alias("vec_id"), F.round("score", 6).alias("score")))
ask("vec_4", BASE + _CENTROID + "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, cv")(
    lambda s, d: plan.centroid_search(by_number(s, d), plan.Request(), _picked(s, d)).rows.select(F.col("video_name").cast("long").alias("vec_id"), F.round("score", 6).alias("score")))
ask("vec_5", BASE + f"SELECT ordinal, round({_DOT}, 6) AS score FROM e LEFT JOIN embeddings ON vec_id = ordinal, qv WHERE contains({LOW}, 'glow')")(
    lambda s, d: plan.text_search(by_number(s, d), plan.Request(query="glow"), first_vector(s, d)).rows.select("ordinal", F.round("score", 6).alias("score")))


def _stored_vectors(s: SparkSession, d: str) -> str:
    """Two spaces written as views, and a folder that was never finished."""
    path = new_path(s, "vectors")
    sinks.vector_view(vectors(s, d).drop("prefix"), f"{path}/clip")
    sinks.vector_view(vectors(s, d).where("vec_id % 2 = 0").drop("prefix"), f"{path}/siglip")
    where, fs = hadoop_path(s, f"{path}/gve")
    fs.mkdirs(where)
    return path


@ask("src_12", "SELECT 'clip' AS prefix, vec_id, label FROM embeddings UNION ALL SELECT 'siglip', vec_id, label FROM embeddings WHERE vec_id % 2 = 0")
def src_12(s: SparkSession, d: str) -> DataFrame:
    return src.vector_index(s, _stored_vectors(s, d))[0].select("prefix", "vec_id", "label")


@ask("vec_6", "SELECT 'siglip' AS index, 'found' AS answer, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'gve', 'stored has no vectors named ''gve''; there are [''clip'', ''siglip'']', 0")
def vec_6(s: SparkSession, d: str) -> DataFrame:
    """An index that is there, and one that is not: the answer says which there are."""
    found, prefixes = src.vector_index(s, _stored_vectors(s, d))
    c = plan.Catalogue("stored", entries(s, d), vectors=found, prefixes=prefixes)
    rows = []
    for name in ("siglip", "gve"):
        try:
            rows.append((name, "found", c.index(name).count()))
        except ValueError as e:
            rows.append((name, str(e), 0))
    return s.createDataFrame(rows, "index string, answer string, n long")


ask("vec_7", BASE + f"SELECT vec_id, round({_DOT}, 6) AS siglip_score FROM embeddings, qv")(
    lambda s, d: plan.semantic_search(plan.Catalogue("x", by_number(s, d).entries, vectors=vectors(s, d).withColumn("prefix", F.lit("siglip"))), plan.Request(index="siglip"), first_vector(s, d)).rows
    .select(F.col("video_name").cast("long").alias("vec_id"), F.round("siglip_score", 6).alias("siglip_score")))
ask("vec_8", "SELECT l_suppkey, round(avg(sqrt(l_discount * l_discount + l_tax * l_tax)), 6) AS magnitude FROM lineitem GROUP BY l_suppkey")(
    lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(P.magnitude(F.col("l_discount"), F.col("l_tax"))), 6).alias("magnitude")))
for _name in ("vec_9", "win_2"):
    ask(_name, "SELECT event_id, bit_count(xor(event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::INT AS distance FROM events QUALIFY distance IS NOT NULL")(
        lambda s, d: P.consecutive(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_id", P.hamming).select("event_id", "distance"))


@ask("vec_11", "SELECT vec_id, len(embedding)::INT AS width, true AS unit, true AS same FROM embeddings WHERE vec_id % 17 <> 0")
def vec_11(s: SparkSession, d: str) -> DataFrame:
    """Images in batches through a model: unit vectors in half precision; every seventeenth image is broken and left out."""
    images = vectors(s, d).select("vec_id", "embedding", F.encode(F.when(F.col("vec_id") % 17 == 0, F.lit("broken")).otherwise(F.to_json("embedding")), "utf-8").alias("image"))
    found = src.encode_images(images, "vec_id", "image", _json_model).join(images.select("vec_id", F.col("embedding").alias("given")), "vec_id")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("embedding", V.normalised(F.col("given")), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return found.select("vec_id", F.size("embedding").alias("width"), (F.abs(length - 1) < 1e-3).alias("unit"), (F.abs(dot - 1) < 2e-3).alias("same"))


def _json_model():
    """Stands in for an image model: the image's bytes are the vector."""
    import json

    import numpy as np

    return lambda images: np.array([json.loads(b) for b in images])


# the same over the clips' own vectors: 512 values, some of them unusable

def clips(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "clip_embedding").where(usable(F.col("embedding"), 512))
    return rows.select(F.lit("clip").alias("prefix"), F.col("vec_id").cast("string").alias("video_name"), "embedding", "vec_id")


def first_anchor(s: SparkSession, d: str) -> list[float]:
    return table(s, d, "cluster_anchors").orderBy("anchor_id").first()["embedding"]


_CLIPS = """
WITH ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM clip_embedding
  WHERE embedding IS NOT NULL AND len(embedding) = 512 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), a AS (
  SELECT embedding::DOUBLE[] AS q FROM cluster_anchors ORDER BY anchor_id LIMIT 1
), near AS (
  SELECT vec_id, list_dot_product(v, q) / sqrt(list_dot_product(q, q)) AS score FROM ok, a
)
"""
ask("vec_2_clips", _CLIPS + "SELECT vec_id, round(score, 5) AS score FROM near ORDER BY score DESC, vec_id::VARCHAR LIMIT 20")(
    lambda s, d: V.top(clips(s, d), first_anchor(s, d), 20).select(F.col("video_name").cast("long").alias("vec_id"), F.round("score", 5).alias("score")))
ask("vec_3_clips", _CLIPS + "SELECT vec_id, round(score, 5) AS score FROM near WHERE score >= 0.3")(
    lambda s, d: plan.semantic_search(plan.Catalogue("clips", by_number(s, d).entries, vectors=clips(s, d)), plan.Request(ranges={"score": (0.3, None)}), first_anchor(s, d)).rows.select(F.col("video_name").cast("long").alias("vec_id"), F.round("score", 5).alias("score")))
ask("vec_4_clips", _CLIPS + """, c AS (SELECT i, avg(v[i]) AS m FROM ok, range(1, 513) r(i) WHERE vec_id % 50 = 0 GROUP BY i
), cv AS (SELECT list(m ORDER BY i) AS q FROM c) SELECT vec_id, round(list_cosine_similarity(v, q), 5) AS score FROM ok, cv""")(
    lambda s, d: V.centroid_search(clips(s, d), clips(s, d).where("vec_id % 50 = 0").select("video_name")).select(F.col("video_name").cast("long").alias("vec_id"), F.round("score", 5).alias("score")))


# -- order, pages, samples

def _page(order: str, size: int, offset: int) -> str:
    return f"{BASE} SELECT ordinal FROM x ORDER BY {order} LIMIT {size} OFFSET {offset}"


def _sorted(sort: str, direction: str, page: int, size: int, seed: int = 0):
    return lambda s, d: slim(plan.text_search(catalogue(s, d), plan.Request(sort=sort, direction=direction, page=page, page_size=size, seed=seed)).page)


ask("srt_1", _page("aesthetic DESC NULLS LAST, ordinal", 50, 300))(_sorted("aesthetic", "desc", 7, 50))
ask("srt_2", _page("video_name DESC, ordinal", 40, 40))(_sorted("name", "desc", 2, 40))
ask("srt_3", _page("md5('7_' || video_name), ordinal", 40, 0))(_sorted("random", "desc", 1, 40, 7))
ask("srt_4", _page("ordinal", 30, 30))(_sorted("", "desc", 2, 30))
ask("srt_6", _page("duration ASC NULLS LAST, ordinal", 100, 1400))(_sorted("duration", "asc", 15, 100))
ask("win_5", BASE + "SELECT ordinal, CAST((row_number() OVER (ORDER BY duration ASC NULLS LAST, ordinal) - 1) // 100 + 1 AS INT) AS page FROM x")(
    lambda s, d: R.numbered(catalogue(s, d).enriched(entries(s, d), ["duration"]), [F.col("duration").asc_nulls_last(), F.col("ordinal")], 100).select("ordinal", "page"))
ask("win_6", BASE + f"SELECT ordinal, count(*) OVER () AS total FROM e WHERE contains({LOW}, 'glow') ORDER BY ordinal LIMIT 10")(
    lambda s, d: slim(Q.search(entries(s, d), "glow", limit=10)).crossJoin(F.broadcast(Q.search(entries(s, d), "glow").agg(F.count("*").alias("total")))))
ask("win_4", "SELECT dataset || '_' || video_name AS video_name, caption FROM manifest QUALIFY row_number() OVER (PARTITION BY dataset || '_' || video_name ORDER BY entry_id DESC) = 1")(
    lambda s, d: R.last_wins(entries(s, d).select("video_name", "ordinal", "caption"), ["video_name"], ["ordinal"]).select("video_name", "caption"))
ask("srt_5", f"SELECT sample_id, tier FROM ({_TIER}) ORDER BY tier DESC, md5('3_' || sample_id) LIMIT 100")(lambda s, d: _tiers(s, d).orderBy(F.desc("tier"), S.random_key(3, F.col("sample_id"))).limit(100))
ask("srt_7", BASE + "SELECT ordinal FROM e ORDER BY ordinal LIMIT 12")(lambda s, d: slim(Q.search(entries(s, d), " ", limit=12)))
ask("srt_11", BASE + "SELECT ordinal, row_number() OVER (ORDER BY md5('9_' || video_name), ordinal) - 1 AS place FROM e")(
    lambda s, d: R.positions(entries(s, d).withColumn("key", S.random_key(9, F.col("video_name"))), ["key", "ordinal"]).select("ordinal", F.col("position").alias("place")))
for _name in ("srt_10",):
    ask(_name, BASE + "SELECT ordinal, aesthetic AS x, width AS y FROM x WHERE aesthetic IS NOT NULL AND width IS NOT NULL AND ordinal IN (SELECT ordinal FROM e ORDER BY md5('5_' || video_name), ordinal LIMIT 500)")(
        lambda s, d: plan.scatter(plan.text_search(catalogue(s, d), plan.Request()), "aesthetic", "width", 500, 5).select("ordinal", "x", "y"))
ask("srt_12", BASE + "SELECT ordinal, CAST((row_number() OVER (ORDER BY ordinal) - 1) // 500 AS INT) AS batch FROM e")(lambda s, d: R.chunked(entries(s, d), ["ordinal"], 500).select("ordinal", "batch"))
ask("srt_14", BASE + f"SELECT video_name, source_path FROM x WHERE contains({LOW}, 'glow')")(lambda s, d: plan.text_search(catalogue(s, d), plan.Request(query="glow", sort="aesthetic")).export())
ask("srt_15", BASE + f"SELECT greatest(1, ceil(count(*) / 200))::BIGINT AS pages FROM e WHERE contains({LOW}, 'the')")(lambda s, d: Q.search(entries(s, d), "the").agg(S.page_count(F.count("*"), 200).alias("pages")))


# -- sets

ask("set_1", "SELECT video_name FROM manifest UNION SELECT video_name FROM metadata")(lambda s, d: R.union_of(table(s, d, "manifest").select("video_name"), table(s, d, "metadata").select("video_name")))
ask("set_2", "SELECT sample_id FROM origins UNION SELECT sample_id FROM sample_files")(lambda s, d: R.union_of(table(s, d, "origins").select("sample_id"), table(s, d, "sample_files").select("sample_id")))
ask("set_3", "SELECT video_name FROM manifest EXCEPT SELECT video_name FROM metadata")(lambda s, d: R.without(table(s, d, "manifest"), table(s, d, "metadata"), "video_name"))
ask("set_4", "SELECT sample_id FROM origins INTERSECT SELECT sample_id FROM sample_files")(lambda s, d: R.shared(table(s, d, "origins"), table(s, d, "sample_files"), "sample_id"))
ask("set_5", "(SELECT video_name FROM manifest EXCEPT SELECT video_name FROM metadata) UNION (SELECT video_name FROM metadata EXCEPT SELECT video_name FROM manifest)")(lambda s, d: R.toggled(table(s, d, "manifest"), table(s, d, "metadata"), "video_name"))
ask("set_8", "SELECT video_name, count(*) AS n FROM metadata GROUP BY video_name HAVING count(*) > 1")(lambda s, d: R.repeated(table(s, d, "metadata"), "video_name"))


# -- scalar functions

def _scalar(name: str, sql: str, /, **columns) -> None:
    cells = ", ".join(f"{v[1]} AS {k}" for k, v in columns.items())
    ask(name, f"{BASE} SELECT ordinal, {cells} FROM {sql}")(lambda s, d: catalogue(s, d).enriched(entries(s, d)).select("ordinal", *(v[0]().alias(k) for k, v in columns.items())))


_C = F.col
_scalar("s_1", "x", low=(lambda: F.lower("caption"), "lower(caption)"))
_scalar("s_2", "x", hit=(lambda: F.contains(_C("caption"), F.lit("Clip")), "contains(caption, 'Clip')"))
_scalar("s_5", "x", n=(lambda: F.size(S.content_words(_C("caption"))), f"len({_CONTENT})::INT"))
_scalar("s_6", "x", short=(lambda: S.truncated(_C("caption")), "CASE WHEN length(caption) > 120 THEN caption[1:120] || '...' ELSE coalesce(caption, '') END"))
_ESC = "replace(replace(replace(coalesce(caption, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_scalar("s_7", "x", html=(lambda: S.highlighted(_C("caption"), "'warm golden' glow|clip !x"), f"regexp_replace({_ESC}, '(warm golden|glow|clip)', '<b><u>\\1</u></b>', 'gi')"))
_scalar("s_8", "x", shard=(lambda: S.shard(_C("video_name")), "sha256(video_name)[1:2] || '/' || sha256(video_name)[3:4]"))
_scalar("s_9", "x", key=(lambda: S.random_key(7, _C("video_name")), "md5('7_' || video_name)"))
_scalar("s_10", "x", name=(lambda: S.without_prefix(_C("video_name")), "CASE WHEN instr(video_name, '_') > 0 THEN video_name[instr(video_name, '_') + 1:] ELSE video_name END"))
_scalar("s_11", "x", r=(lambda: S.half_even(_C("aesthetic"), 1), "round_even(aesthetic, 1)"), half=(lambda: S.half_even(_C("ordinal") / 2, 0), "round_even(ordinal / 2, 0)"))
_scalar("s_12", "x", q=(lambda: S.quantised(_C("aesthetic"), F.lit(0.0), F.lit(10.0)), "CASE WHEN aesthetic IS NOT NULL THEN greatest(0, least(255, round_even(aesthetic / 10 * 255, 0)))::INT END"))
_scalar("s_13", "x", v=(lambda: F.round(S.dequantised((_C("ordinal") % 256), F.lit(-5.0), F.lit(20.0)), 9), "round(-5 + (ordinal % 256) / 255.0::DOUBLE * 25, 9)"))
_scalar("s_14", "x", v=(lambda: F.round(S.log_scaled(_C("text_chars")), 9), "CASE WHEN text_chars > 0 THEN round(log10(text_chars), 9) WHEN text_chars IS NOT NULL THEN 0 END"), p=(lambda: F.round(F.log1p("num_frames"), 9), "round(ln(1 + num_frames), 9)"))
_FS = "CASE WHEN {v} = floor({v}) THEN floor({v})::BIGINT || '{u}' ELSE printf('%.1f', {v} + 1e-9) || '{u}' END"
_scalar("s_15", "(SELECT ordinal, (ordinal * ordinal * 37)::DOUBLE AS b FROM e)", size=(lambda: S.file_size(_C("ordinal") * _C("ordinal") * 37), "CASE " + " ".join(f"WHEN b / {1024**i} < 1024 THEN {_FS.format(v=f'(b / {1024**i})', u=u)}" for i, u in enumerate(("B", "KB", "MB", "GB"))) + " END"))
# ties are rounded up, as the shortest decimal form of the number says
_SHOWN = "CASE WHEN {0} IS NULL THEN '' WHEN {0} = floor({0}) THEN floor({0})::BIGINT::VARCHAR ELSE printf('%.{1}f', {0} + 1e-9) END"
_scalar("s_16", "x", text=(lambda: S.shown(_C("aesthetic"), 3), _SHOWN.format("aesthetic", 3)))
_scalar("s_18", "x", c=(lambda: S.bin_centre(_C("ordinal") % 60, F.lit(0.0), F.lit(30.0), 60), "(ordinal % 60 + 0.5::DOUBLE) * 30 / 60"), snap=(lambda: S.snapped(_C("aesthetic"), 0.1), "round(aesthetic, 1)"))
_scalar("s_19", "x", i=(lambda: S.clamped((_C("ordinal") - 20).cast("int"), 25), "least(24, greatest(0, ordinal - 20))::INT"))
_scalar("s_20", "x", x=(lambda: S.sprite_cell(_C("ordinal") % 25)["x"], "(ordinal % 25 % 5 * 25)::DOUBLE"), y=(lambda: S.sprite_cell(_C("ordinal") % 25)["y"], "(ordinal % 25 // 5 * 25)::DOUBLE"))
_scalar("s_21", "x", cells=(lambda: F.aggregate(S.grid_cells(_C("width").cast("int"), _C("height").cast("int")), F.lit(0).cast("long"), lambda a, c: a + c["x"] * 3 + c["y"] * 5 + c["width"] * c["height"]),
        "CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN list_sum(list_transform(range(25), lambda i: (i % 5) * (width // 5) * 3 + (i // 5) * (height // 5) * 5 + (width // 5) * (height // 5)))::BIGINT END"),
        sprite=(lambda: S.composed((_C("ordinal") % 30).cast("int"), 160, 90)["height"], "CASE WHEN ordinal % 30 > 0 THEN (ceil(ordinal % 30 / 5) * 90)::INT END"),
        last=(lambda: F.element_at(S.composed((_C("ordinal") % 30).cast("int"), 160, 90)["cells"], -1)["x"], "CASE WHEN ordinal % 30 > 0 THEN ((ordinal % 30 - 1) % 5 * 160)::INT END"),
        x=(lambda: S.contained(_C("width"), _C("height"), 320, 180)["x"], "CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN floor((320 - greatest(1, trunc(width * least(320::DOUBLE / width, 180::DOUBLE / height)))) / 2)::INT END"),
        w=(lambda: S.contained(_C("width"), _C("height"), 320, 180)["width"], "CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN greatest(1, trunc(width * least(320::DOUBLE / width, 180::DOUBLE / height)))::INT END"))
_scalar("s_22", "x", small=(lambda: F.least(S.target_size(_C("width").cast("int"), _C("height").cast("int"), 480)["width"], S.target_size(_C("width").cast("int"), _C("height").cast("int"), 480)["height"]), "CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN least(width, height, 480)::INT END"))
_scalar("s_23", "x", path=(lambda: S.sample_path(_C("video_name"), F.lit("video.mp4")), "'samples/' || sha256(video_name)[1:2] || '/' || sha256(video_name)[3:4] || '/' || video_name || '/video.mp4'"), ext=(lambda: F.regexp_extract("source_path", r"(\.[^.]*)$", 1), "regexp_extract(source_path, '(\\.[^.]*)$', 1)"))
_scalar("s_24", "x", c=(lambda: S.or_else(_C("caption"), F.lit("none")), "coalesce(nullif(caption, ''), 'none')"))
_scalar("s_25", "x", n=(lambda: S.parsed_number(F.concat(F.lit(" "), F.col("aesthetic").cast("decimal(9,4)").cast("string"), F.lit(" "))), "aesthetic::DECIMAL(9, 4)::DOUBLE"))
_scalar("s_27", "x", total=(lambda: F.aggregate(S.frame_indices(F.greatest(_C("num_frames").cast("int"), F.lit(1))), F.lit(0).cast("long"), lambda a, x: a + x), "list_sum(list_transform(range(25), lambda i: trunc(i * (greatest(coalesce(num_frames, 1), 1) - 1) / 24)))::BIGINT"))
_scalar("s_28", "x", step=(lambda: S.filter_step(F.lit(False), F.lit(0.0), _C("width") / 100), "CASE WHEN width IS NULL THEN 0.01 WHEN width / 100 <= 1 THEN 0.001 WHEN width / 100 <= 10 THEN 0.01 WHEN width / 100 <= 100 THEN 0.1 ELSE 1.0 END::DOUBLE"))
_scalar("s_31", "x", badge=(lambda: S.badge(_C("aesthetic"), _C("global_motion")), f"CASE WHEN aesthetic IS NOT NULL THEN {_SHOWN.format('aesthetic', 2)} WHEN global_motion IS NOT NULL THEN {_SHOWN.format('(global_motion * 100)', 1)} ELSE '' END"))
ask("s_26", "SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "map<string,double>")["k"].alias("k")))
ask("s_30", "SELECT column_name AS field FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')")(lambda s, d: s.createDataFrame([(f,) for f in P.numeric_fields(table(s, d, "lineitem"))], "field string"))


# -- sources

@ask("src_1", "SELECT entry_id AS ordinal, dataset || '_' || video_name AS video_name, caption, source_path FROM manifest")
def src_1(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "manifest.json")
    sinks.manifest(entries(s, d), path)
    return src.manifest(s, path, ["aesthetic"], ordinal="ordinal", lines=True).select("ordinal", "video_name", "caption", "source_path")


@ask("src_2", f"SELECT video_name, coalesce(caption, '') AS caption, source_path, {_N('aesthetic')}, {_N('global_motion')} FROM manifest")
def src_2(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "human.csv")
    rows = table(s, d, "manifest").select(F.col("source_path").alias("path"), F.col("video_name").alias("clip_id"), "caption", *((S.number(F.col(f)) if f in ("aesthetic", "global_motion") else F.lit(None)).cast("string").alias(f) for f in src.HUMAN_FIELDS))
    rows.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return src.human_entries(src.csv(s, path)).select("video_name", F.coalesce("caption", F.lit("")).alias("caption"), "source_path", "aesthetic", "global_motion")




@ask("src_3", "SELECT entry_id, 'part_00' || entry_id % 10 AS part FROM manifest WHERE entry_id % 10 < 5")
def src_3(s: SparkSession, d: str) -> DataFrame:
    """Ten CSV parts on disk of which five are extracted: the other five are not opened."""
    folder = new_path(s, "parts")
    rows = table(s, d, "manifest").select("entry_id", "video_name", "caption")
    for i in range(10):
        rows.where(F.col("entry_id") % 10 == i).write.options(header=True, escape='"', quoteAll=True).csv(f"{folder}/OpenHumanVid_part_00{i}.csv")
    return src.csv_parts(s, folder, [f"part_00{i}" for i in (*range(5), 77)]).select(F.col("entry_id").cast("long").alias("entry_id"), "part")


for _name in ("jn_11",):
    ask(_name, "SELECT entry_id FROM manifest WHERE entry_id % 10 < 5")(
        lambda s, d: src.parted(table(s, d, "manifest").select("entry_id", F.concat(F.lit("OpenHumanVid_part_00"), F.col("entry_id") % 10, F.lit(".csv")).alias("file_name")),
                                s.createDataFrame([(f"part_00{i}",) for i in range(5)], "part string")).select("entry_id"))
ask("src_4", _RECORDS + "SELECT regexp_replace(f[1], '\\.mp4$', '') AS video_name, coalesce(nullif(f[3], ''), f[2], '') AS caption, TRY_CAST(trim(f[4]) AS DOUBLE) AS vtss_score FROM judged WHERE reason IS NULL")(
    lambda s, d: src.ultra_entries(rec.valid(table(s, d, "short_csv"), "line_id", "raw_line").withColumn("vtss_score", F.col("vtss_score").cast("string")).withColumns({c: F.col(c).cast("string") for c in ("motion_score", "video_clip_score")})).select("video_name", "caption", "vtss_score"))
ask("src_5", "SELECT video_name, caption, '/web/' || video_name || '.mp4' AS source_path FROM manifest")(
    lambda s, d: src.web_entries(table(s, d, "manifest").select(F.col("video_name").alias("videoid"), F.col("caption").alias("name")), "/web"))


def _touched(s: SparkSession, d: str, path: Callable) -> tuple[str, str]:
    """A small tree of files, some for each row of the table nation (25 at every scale)."""
    base = new_path(s, "tree")
    for n in table(s, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect():
        for name in path(n):
            where, fs = hadoop_path(s, f"{base}/{name}")
            out = fs.create(where, True)
            out.write(bytearray(b"{}"))
            out.close()
    return base, "regexp_replace(path, '^.*/tree/', '')"


@ask("src_6", "SELECT n_name AS video_name, CASE WHEN n_nationkey % 3 = 0 THEN 'clips_short_1920' WHEN n_nationkey % 2 = 0 THEN 'clips_short_960/nested' ELSE 'clips_short' END || '/' || n_name || '.mp4' AS path FROM nation")
def src_6(s: SparkSession, d: str) -> DataFrame:
    """Clips on disk, flat and nested, in up to three folders: the first folder wins."""
    base, name = _touched(s, d, lambda n: [f"clips_short/{n.n_name}.mp4", *([f"clips_short_960/nested/{n.n_name}.mp4"] if n.n_nationkey % 2 == 0 else []), *([f"clips_short_1920/{n.n_name}.mp4"] if n.n_nationkey % 3 == 0 else []), f"other/{n.n_name}.mp4"])
    return src.by_priority(src.listing(s, base, "*.mp4")).select(F.expr("replace(video_name, '%20', ' ')").alias("video_name"), F.expr(f"replace({name}, '%20', ' ')").alias("path"))


for _name in ("win_7",):
    ask(_name, "SELECT 'v' || entry_id // 2 AS video_name, arg_min('/d/' || f || '/v' || entry_id // 2 || '.mp4', entry_id % 3) AS path FROM (SELECT entry_id, ['clips_short_1920', 'clips_short_960', 'clips_short'][entry_id % 3 + 1] AS f FROM manifest) GROUP BY ALL")(
        lambda s, d: src.by_priority(table(s, d, "manifest").select(F.concat(F.lit("/d/"), F.get(F.array(*map(F.lit, src.CLIP_FOLDERS)), (F.col("entry_id") % 3).cast("int")), F.lit("/v"), F.floor(F.col("entry_id") / 2).cast("string"), F.lit(".mp4")).alias("path"))))
ask("jn_10", "SELECT entry_id FROM manifest WHERE source_path IN (SELECT source_path FROM origins)")(
    lambda s, d: R.available(table(s, d, "manifest"), table(s, d, "origins"), "source_path").select("entry_id"))


@ask("src_7", "SELECT video_name, coalesce(caption, '') AS caption, source_path FROM manifest WHERE video_name <> '' AND source_path <> '' QUALIFY row_number() OVER (PARTITION BY video_name ORDER BY dataset, lpad(entry_id::VARCHAR, 12, '0')) = 1")
def src_7(s: SparkSession, d: str) -> DataFrame:
    leaf = F.struct("video_name", F.when(F.col("caption").isNotNull(), F.array("caption")).alias("video_caption"), F.col("source_path").alias("cleancode_pexels_path"))
    path = new_path(s, "nested")
    table(s, d, "manifest").select(F.to_json(F.create_map("dataset", F.create_map(F.lpad(F.col("entry_id").cast("string"), 12, "0"), leaf))).alias("value")).write.text(path)
    return src.nested(s, path, lines=True).select("video_name", "caption", "source_path")


@ask("src_8", "SELECT 'd_' || n_name AS sample_id FROM nation WHERE n_nationkey % 3 > 0")
def src_8(s: SparkSession, d: str) -> DataFrame:
    """Sample folders on disk, by their hash; those without an origins.json, or not at this depth, are no samples."""
    def files(n) -> list[str]:
        sid = f"d_{n.n_name}"
        h = hashlib.sha256(sid.encode()).hexdigest()
        return [f"{h[:2]}/{h[2:4]}/{sid}/metadata.json", *([f"{h[:2]}/{h[2:4]}/{sid}/origins.json"] if n.n_nationkey % 3 else []), f"flat_{sid}/origins.json"]

    base, _ = _touched(s, d, files)
    return src.samples(src.listing(s, base)).select(F.expr("replace(sample_id, '%20', ' ')").alias("sample_id"))


ask("src_9", "SELECT file_id AS sample_id, CAST(CASE WHEN json_valid(body) THEN body->>'$.width' END AS DOUBLE)::INT AS width, CAST(CASE WHEN json_valid(body) THEN body->>'$.fps' END AS DOUBLE) AS fps FROM sample_files WHERE artifact = 'metadata.json'")(
    lambda s, d: src.json_artifact(table(s, d, "sample_files").where("artifact = 'metadata.json'").select(F.col("file_id").alias("sample_id")), table(s, d, "sample_files").select(F.col("file_id").alias("sample_id"), "body"), "width double, fps double").withColumn("width", F.col("width").cast("int")))
ask("src_10", "SELECT vec_id::VARCHAR AS sample_id, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")(
    lambda s, d: src.npy_artifact(_as_npy(vectors(s, d))).select("sample_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total")))


def _as_npy(df: DataFrame) -> DataFrame:
    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                f = io.BytesIO()
                np.save(f, np.array(v, np.float32))
                out.append(f.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["sample_id", "content"])

    return df.select("video_name", "embedding").mapInArrow(run, "sample_id string, content binary")




@ask("src_13", "SELECT DISTINCT dataset FROM manifest UNION SELECT 'registered'")
def src_13(s: SparkSession, d: str) -> DataFrame:
    """Folders with a manifest on disk, and a registered dataset; a folder without a manifest is none."""
    folder = new_path(s, "datasets")
    for r in table(s, d, "manifest").select("dataset").distinct().collect():  # a handful of datasets
        sinks.manifest(entries(s, d).where(F.col("video_name").startswith(f"{r.dataset}_")), f"{folder}/{r.dataset}/manifest.json")
    where, fs = hadoop_path(s, f"{folder}/empty")
    fs.mkdirs(where)
    return s.createDataFrame([(n,) for n in src.datasets(s, folder, ["registered"])], "dataset string")


ask("src_15", "SELECT num_frames AS raw, CASE WHEN coalesce(num_frames, 0) > 0 THEN num_frames ELSE floor(coalesce(duration, 0) * round(CASE WHEN fps > 0 AND NOT isnan(fps) THEN fps ELSE 30 END, 3)) END::INT AS num_frames, round(CASE WHEN fps > 0 AND NOT isnan(fps) THEN fps ELSE 30 END, 3) AS fps FROM metadata")(
    lambda s, d: src.probed(table(s, d, "metadata").select(F.col("num_frames").alias("raw"), S.number(F.col("fps")).alias("rate"), "duration", F.lit(1 << 20).alias("bytes")), "raw", "rate", "duration", "bytes").select("raw", "num_frames", "fps"))
ask("src_16", "SELECT count(*) AS decoded, sum(f) AS total FROM (SELECT DISTINCT entry_id, f FROM (SELECT entry_id, unnest(list_concat([0, n // 2, greatest(0, n - 1)], list_transform(range(25), lambda i: i * (n - 1) // 24))) AS f FROM (SELECT entry_id, entry_id % 400 + 1 AS n FROM manifest)))")(
    lambda s, d: src.decoded(src.frames(table(s, d, "manifest").select("entry_id", (F.col("entry_id") % 400 + 1).cast("int").alias("n")), "entry_id", "n").select("entry_id", "frame"), _decoder, "entry_id long, frame int, image binary")
    .agg(F.count("*").alias("decoded"), F.sum(F.conv(F.hex("image"), 16, 10).cast("long")).alias("total")))


def _decoder(batches):
    """Stands in for a video decoder: the image of a frame is its number."""
    import pyarrow as pa

    for b in batches:
        images = [int(f).to_bytes(4, "big") for f in b.column(1).to_numpy()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(images, pa.binary())], names=["entry_id", "frame", "image"])


ask("udf_9", "SELECT entry_id, count(DISTINCT f) AS frames FROM (SELECT entry_id, unnest(list_concat([0, n // 2, greatest(0, n - 1)], list_transform(range(25), lambda i: i * (n - 1) // 24))) AS f FROM (SELECT entry_id, entry_id % 400 + 1 AS n FROM manifest)) GROUP BY entry_id")(
    lambda s, d: src.frames(table(s, d, "manifest").select("entry_id", (F.col("entry_id") % 400 + 1).cast("int").alias("n")), "entry_id", "n").groupBy("entry_id").agg(F.count("*").alias("frames")))
ask("src_17", "SELECT entry_id, CASE WHEN entry_id % 5 > 0 THEN 'compress_480p.mp4' WHEN entry_id % 3 > 0 THEN 'compress_360p.mp4' WHEN entry_id % 2 = 0 THEN 'video.mp4' END AS source FROM manifest")(
    lambda s, d: table(s, d, "manifest").select("entry_id", src.chosen_source({480: F.col("entry_id") % 5, 360: F.when(F.col("entry_id") % 3 > 0, F.col("entry_id"))}, F.when(F.col("entry_id") % 2 == 0, 0)).alias("source")))
ask("snk_13", "SELECT entry_id, CASE WHEN entry_id % 4 = 0 THEN 'compress_720p.mp4' WHEN entry_id % 3 = 0 THEN 'compress_480p.mp4' WHEN entry_id % 5 = 0 THEN 'compress_1080p.mp4' WHEN entry_id % 2 = 0 THEN 'video.mp4' END AS served FROM manifest")(
    lambda s, d: table(s, d, "manifest").select("entry_id", src.chosen_source({1080: (F.col("entry_id") % 5 == 0).cast("int"), 720: (F.col("entry_id") % 4 == 0).cast("int"), 480: F.when(F.col("entry_id") % 3 == 0, 7)}, F.when(F.col("entry_id") % 2 == 0, 0), src.SERVED).alias("served")))
ask("src_18", BASE + "SELECT ordinal FROM e")(lambda s, d: slim(model.validated(entries(s, d))))
ask("udf_7", "SELECT file_id, NOT coalesce(json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT', FALSE) AS failed FROM sample_files")(
    lambda s, d: src.mapped(table(s, d, "sample_files").select("file_id", "body"), "file_id", _must_parse).select("file_id", (~F.col("ok")).alias("failed")))  # the operator under test runs Python
ask("udf_10", _PAIRS)(lambda s, d: V.diversity(table(s, d, "embeddings"), "label", decimals=5))


# -- sinks

_SELECTED = "SELECT sample_id FROM (SELECT dataset || '_' || video_name AS sample_id FROM manifest WHERE entry_id % 7 = 0)"
for _name in ("snk_10", "agg_23"):
    ask(_name, f"SELECT coalesce(sum(size_bytes), 0)::BIGINT AS bytes, count(*) AS files FROM sample_files JOIN ({_SELECTED}) USING (sample_id)")(
        lambda s, d: sinks.download_size(table(s, d, "sample_files"), entries(s, d).where("ordinal % 7 = 0").select(F.col("video_name").alias("sample_id"))))
ask("snk_11", "SELECT file_id, sample_id || '/' || artifact AS entry FROM sample_files")(
    lambda s, d: table(s, d, "sample_files").select("file_id", sinks.archive_name(F.substring_index("sample_id", "_", 1), S.without_prefix(F.col("sample_id")), F.col("artifact"), False).alias("entry")))
ask("snk_12", "SELECT artifact, size_bytes FROM sample_files WHERE sample_id = 'stockreel_1000001'")(lambda s, d: sinks.sample_sizes(table(s, d, "sample_files"), "stockreel_1000001"))
ask("snk_7", BASE + f"SELECT video_name, source_path FROM e WHERE contains({LOW}, 'the')")(lambda s, d: plan.text_search(catalogue(s, d), plan.Request(query="the", sort="name")).export())
ask("snk_8", "SELECT video_name, 'samples/' || sha256(dataset || '_' || video_name)[1:2] || '/' || sha256(dataset || '_' || video_name)[3:4] || '/' || dataset || '_' || video_name AS path FROM manifest")(
    lambda s, d: sinks.export_paths(table(s, d, "manifest").select("dataset", "video_name")))
ask("snk_9", "SELECT video_name AS text FROM manifest")(lambda s, d: sinks.as_lines(table(s, d, "manifest"), "video_name"))
ask("snk_6", "SELECT DISTINCT dataset, video_name FROM (SELECT dataset, video_name FROM manifest WHERE entry_id % 7 = 0 UNION SELECT 'sphere', video_name FROM manifest WHERE entry_id % 11 = 0)")(
    lambda s, d: sinks.favourites(table(s, d, "manifest").where("entry_id % 7 = 0"), "sphere", table(s, d, "manifest").where("entry_id % 11 = 0"), "add"))
ask("snk_14", "SELECT CASE WHEN dataset || '_' || video_name IN (SELECT sample_id FROM sample_files WHERE sample_id IS NOT NULL) THEN 'skipped' WHEN source_path IN (SELECT source_path FROM origins) THEN 'linked' ELSE 'missing' END AS status, count(*) AS count FROM manifest GROUP BY ALL")(
    lambda s, d: sinks.link_status(entries(s, d).select("source_path", F.col("video_name").alias("sample_id")), table(s, d, "origins").select(F.col("source_path").alias("path")), table(s, d, "sample_files").select("sample_id")))


@ask("snk_1", "SELECT entry_id AS ordinal, caption FROM manifest")
def snk_1(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "manifest.json")
    sinks.manifest(entries(s, d), path)
    return s.read.schema("ordinal long, caption string").json(path)


@ask("snk_2", "SELECT vec_id, label + 1 AS label FROM embeddings")
def snk_2(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "swapped")
    sinks.staged(table(s, d, "embeddings").select("vec_id", "label"), path)
    sinks.staged(s.read.parquet(path).withColumn("label", F.col("label") + 1), path)
    return s.read.parquet(path)


@ask("snk_4", "SELECT vec_id FROM embeddings")
def snk_4(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "vectors")
    sinks.vector_view(vectors(s, d), path)
    return s.read.parquet(path).select("vec_id")


# -- incremental views

_LAST = "SELECT user_id::VARCHAR AS video_name, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY user_id"


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").cast("string").alias("video_name"), "ts", "event_id", "value")


def _two_batches(s: SparkSession, d: str) -> inc.View:
    rows = _events(s, d)
    half = rows.agg(F.percentile_approx("event_id", 0.5).alias("m")).first()["m"]
    view = inc.View(s, new_path(s, "view"))
    view.take(rows.where(F.col("event_id") <= half), ["ts", "event_id"])
    view.take(rows.where(F.col("event_id") > half), ["ts", "event_id"])
    return view


ask("inc_2", _LAST)(lambda s, d: _two_batches(s, d).read())


@ask("inc_4", _LAST)
def inc_4(s: SparkSession, d: str) -> DataFrame:
    """The last batch comes three times: the view stays as it is."""
    view = _two_batches(s, d)
    for _ in range(2):
        view.take(_events(s, d).where("event_id % 3 > 0"), ["ts", "event_id"])
        view.take(_events(s, d), ["ts", "event_id"])
    return view.read()


@ask("snk_3", "SELECT user_id::VARCHAR AS video_name, arg_max(value, {'t': ts, 'e': event_id}) FILTER (event_id % 2 = 0) AS value, arg_max(event_id, {'t': ts, 'e': event_id}) FILTER (event_id % 2 = 1) AS odd FROM events GROUP BY user_id")
def snk_3(s: SparkSession, d: str) -> DataFrame:
    """Two artifacts with fields of their own merge into one view, field by field."""
    view, rows = inc.View(s, new_path(s, "view")), _events(s, d)
    view.take(rows.where("event_id % 2 = 0"), ["ts", "event_id"])
    view.take(rows.where("event_id % 2 = 1").select("video_name", "ts", F.col("event_id").alias("place"), F.col("event_id").alias("odd")), ["ts", "place"])
    return view.read()


@ask("src_11", _LAST.replace("SELECT", "SELECT 'video_stats' AS target,") + " UNION ALL " + _LAST.replace("SELECT", "SELECT 'extra.json',").replace("FROM events", "FROM events WHERE event_id % 2 = 0"))
def src_11(s: SparkSession, d: str) -> DataFrame:
    """Views found by their list of targets; one that is named but not there is left out, and without a list the fixed names count."""
    folder, rows = new_path(s, "views"), _events(s, d)
    for name, some in (("video_stats", rows), ("extra", rows.where("event_id % 2 = 0"))):
        inc.View(s, f"{folder}/{name}").take(some, ["ts", "event_id"])
    fixed = inc.load(s, folder)
    inc.save_targets(s, folder, ["extra.json", "gone.json"])
    named = inc.load(s, folder)
    parts = [v.read().select(F.lit(n).alias("target"), "video_name", "value") for n, v in (fixed | named).items()]
    return parts[0].unionByName(parts[1])


@ask("inc_1", _LAST)
def inc_1(s: SparkSession, d: str) -> DataFrame:
    """As a stream over a folder's files: what is new is taken in; the second run finds nothing."""
    path, view = new_path(s, "incoming"), inc.View(s, new_path(s, "view"))
    _events(s, d).repartitionByRange(4, "ts", "event_id").write.parquet(path)
    rows, checkpoint = s.readStream.schema("video_name string, ts timestamp, event_id long, value double").parquet(path), new_path(s, "checkpoint")
    for _ in range(2):
        inc.stream(rows, view, ["ts", "event_id"], checkpoint).awaitTermination()
    return view.read()


@ask("inc_5", "SELECT count(DISTINCT user_id) AS included FROM events WHERE value > 100")
def inc_5(s: SparkSession, d: str) -> DataFrame:
    view = inc.View(s, new_path(s, "view"))
    view.take(_events(s, d).withColumn("value", F.when(F.col("value") > 100, F.col("value"))), ["ts", "event_id"])
    return view.included().agg(F.count("*").alias("included"))


@ask("inc_3", f"SELECT 'values' AS name, * FROM ({_LAST}) UNION ALL SELECT 'other', * FROM ({_LAST.replace('FROM events', 'FROM events WHERE event_id % 5 = 0')})")
def inc_3(s: SparkSession, d: str) -> DataFrame:
    """Only the named rule takes in what is new: the other one keeps its view and its record of samples."""
    rows = _events(s, d)
    views = {n: (inc.View(s, new_path(s, n)), ["ts", "event_id"]) for n in ("values", "other")}
    for view, order in views.values():
        view.take(rows.where("event_id % 5 = 0"), order)
    inc.aggregate(views, {n: rows for n in views}, only=["values"], rebuild=True)
    parts = [v.read().select(F.lit(n).alias("name"), "video_name", "value") for n, (v, _) in views.items()]
    return parts[0].unionByName(parts[1])


@ask("inc_6", _LAST.replace("FROM events", "FROM events WHERE value > 50"))
def inc_6(s: SparkSession, d: str) -> DataFrame:
    """A rebuild holds nothing of what was there before."""
    view = _two_batches(s, d)
    inc.aggregate({"values": (view, ["ts", "event_id"])}, {"values": _events(s, d).where("value > 50")}, rebuild=True)
    return view.read()


@ask("snk_5", "SELECT 2 AS version, user_id::VARCHAR AS video_name, (SELECT count(DISTINCT user_id) FROM events) AS count FROM events GROUP BY user_id")
def snk_5(s: SparkSession, d: str) -> DataFrame:
    """The checkpoint: version, count and the samples taken in, as another process reads them."""
    view = inc.View(s, _two_batches(s, d).path)
    state = view.state()
    return view.included().select(F.lit(state["version"]).alias("version"), "video_name", F.lit(state["count"]).cast("long").alias("count"))


@ask("prj_14", "SELECT 'total_samples' AS key, count(*) AS count FROM (SELECT user_id::VARCHAR FROM events UNION SELECT vec_id::VARCHAR FROM embeddings) UNION ALL SELECT 'video_stats', count(DISTINCT user_id) FROM events UNION ALL SELECT 'clip', count(*) FROM embeddings")
def prj_14(s: SparkSession, d: str) -> DataFrame:
    clip = inc.View(s, new_path(s, "clip"), "vector_index")
    clip.take(vectors(s, d).select("video_name", "label"), [])
    return inc.status_record(s, {"video_stats.json": _two_batches(s, d), "clip": clip})


@ask("inc_7", "SELECT 'served' AS read, count(DISTINCT user_id) AS n FROM events WHERE event_id % 9 = 0 UNION ALL SELECT 'still', count(DISTINCT user_id) FROM events WHERE event_id % 9 = 0 UNION ALL SELECT 'reloaded', count(DISTINCT user_id) FROM events")
def inc_7(s: SparkSession, d: str) -> DataFrame:
    """A served view stays what it is while a batch is taken in, and is swapped by a reload."""
    view, rows = inc.View(s, new_path(s, "view")), _events(s, d)
    view.take(rows.where("event_id % 9 = 0"), ["ts", "event_id"])
    served = inc.Served(view)
    out = [("served", served.table.count())]
    view.take(rows, ["ts", "event_id"])
    out.append(("still", served.table.count()))
    served.reload()
    return s.createDataFrame([*out, ("reloaded", served.table.count())], "read string, n long")


# -- registries and parsers, as small tables

def _rows(names: str, rows) -> tuple:
    """A query of fixed rows and the SQL that spells them out. ``rows``: made by the engine; the SQL holds literals."""
    kinds = " ,".join(f"{n} string" for n in names.split())
    return lambda s, d: s.createDataFrame([tuple(map(str, r)) for r in rows()], kinds)


def _values_sql(names: str, rows: list[tuple]) -> str:
    cells = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {cells}) v({', '.join(names.split())})"




@ask("src_14", "SELECT DISTINCT dataset, video_name FROM manifest WHERE entry_id % 7 = 0")
def src_14(s: SparkSession, d: str) -> DataFrame:
    """Favourites saved and loaded; a file that is not there yet holds none."""
    path, none = new_path(s, "favourites.json"), sinks.load_favourites(s, new_path(s, "none.json"))
    sinks.save_favourites(table(s, d, "manifest").where("entry_id % 7 = 0").select("dataset", "video_name").distinct(), path)
    return sinks.load_favourites(s, path).unionByName(none)


_BANANA = [(str(i), str(round(x, 6))) for i, x in enumerate((3 / 14**0.5, 1 / 14**0.5, 0.0, 2 / 14**0.5))]


def _letters() -> model.Registry:
    return model.Registry([model.Processor("e", space=("e", 4), encode=lambda q: [float(q.count(c)) for c in "abcn"]), model.Processor("mute", space=("m", 2))])


ask("src_19", _values_sql("place x", _BANANA))(_rows("place x", lambda: [(i, round(x, 6)) for i, x in enumerate(_letters().encode("e", "banana"))]))


def _hooks() -> list[tuple[str, str]]:
    """What a space with an encoder, one without, and an unknown one answer."""
    out = []
    for prefix in ("e", "m", "x"):
        try:
            out.append((prefix, str(len(_letters().encode(prefix, "text")))))
        except ValueError as e:
            out.append((prefix, str(e)))
    return out


ask("udf_5", _values_sql("prefix answer", [("e", "4"), ("m", "mute has no encoder of texts; give it one"), ("x", "no vectors named 'x'; there are ['e', 'm']")]))(_rows("prefix answer", _hooks))
ask("prj_8", _values_sql("field source", [("vtss_score", "ultravideo"), ("score", "clip"), ("fps", "ingest")]))(
    _rows("field source", lambda: [(f, src_) for f, (src_, _) in model.standard().field_catalogue("ultravideo").items() if f in ("vtss_score", "score", "fps")]))
ask("prj_9", _values_sql("artifact kind", [("metadata.json", "data"), ("thumb_middle.jpg", "image"), ("compress_480p.mp4", "image"), ("phash.json", "data"), ("raft_flow.json", "data")]))(
    _rows("artifact kind", lambda: [(a, k) for k, names in model.standard().artifact_catalogue().items() for a in names if not a.startswith(("clip", "siglip", "gve"))]))
ask("prj_10", _values_sql("place label", [("0", "first"), ("1", "plain"), ("2", "own")]))(
    _rows("place label", lambda: enumerate(x.label for x in model.Registry([model.Processor("a", sections=(model.Section("t", "plain"), model.Section("t", "first", 1)))], [model.Dataset("d", sections=(model.Section("t", "own"),))]).sections("d"))))
for _name in ("prj_11",):
    ask(_name, _values_sql("prefix width", [("clip", "512"), ("siglip", "1152"), ("gve", "2048")]))(_rows("prefix width", lambda: [(p, w) for p, (_, w) in model.standard().spaces().items()]))
ask("prj_12", _values_sql("name value", [("sprite_columns", "5"), ("sprite_rows", "5"), ("sprite_frames", "25")]))(_rows("name value", lambda: model.config().items()))
ask("flt_12", _values_sql("name", [("clip",), ("phash",)]))(_rows("name", lambda: [(n,) for n in model.standard().known(["clip", "phash"])]))
ask("udf_1", _values_sql("name label after artifacts", [("clip", "CLIP", "ingest", "clip.json,clip_embedding.npy"), ("compress", "Compression", "", "compress_480p.mp4"), ("gve", "GVE", "ingest", "gve.json,gve_embedding.npy"), ("ingest", "Ingest", "compress", "metadata.json,thumb_middle.jpg"),
    ("phash", "Perceptual hash", "ingest", "phash.json"), ("raft_flow", "Optical flow", "ingest", "raft_flow.json"), ("siglip", "SigLIP", "ingest", "siglip.json,siglip_embedding.npy")]))(
    _rows("name label after artifacts", lambda: [(p.name, p.human_name, ",".join(p.depends_on), ",".join(sorted(p.artifacts))) for p in model.standard().processors.values()]))


def _plugins() -> list[tuple[str, str]]:
    """Two files dropped into a folder, found; then a third one that clashes with the first."""
    out, head = [], "from cinegrid.model import Dataset, Field, Processor\n"
    with tempfile.TemporaryDirectory() as folder:  # on the driver, which is where plugins are read
        for name, text in (("a.py", "P = Processor('first', fields={'f': Field('F')})"), ("b.py", "D = Dataset('second')"), ("_c.py", "raise OSError")):
            (Path(folder) / name).write_text(head + text)
        found = model.discovered(folder)
        out += [("processor", n) for n in found.processors] + [("dataset", n) for n in found.datasets]
        (Path(folder) / "d.py").write_text(head + "P = Processor('third', fields={'f': Field('G')})")
        try:
            model.discovered(folder)
        except ValueError as e:
            out.append(("clash", str(e)))
    return out


ask("udf_2", _values_sql("kind name", [("processor", "first"), ("dataset", "second"), ("clash", "d.py: third and first share fields: ['f']")]))(_rows("kind name", _plugins))
for _name in ("udf_3",):
    ask(_name, _values_sql("place name", [(str(i), n) for i, n in enumerate(("compress", "ingest", "clip", "phash"))]))(_rows("place name", lambda: enumerate(model.standard().order(["phash", "clip"]))))
ask("udf_4", _values_sql("kind name", [("vector_index", n) for n in ("clip", "gve", "siglip")]))(_rows("kind name", lambda: [("vector_index", n) for n, _ in model.standard().rules()["vector_index"]]))
ask("udf_6", "SELECT entry_id AS ordinal FROM manifest")(
    lambda s, d: slim(model.Registry(datasets=[model.Dataset("m", entries=entries)]).datasets["m"].entries(s, d)))
_PARSED = [("exact", "blue sky"), ("not", "rain"), ("or", "cat/dog"), ("and", "bird")]
for _name in ("s_3", "s_4"):
    ask(_name, _values_sql("kind words", _PARSED))(_rows("kind words", lambda: [(t.kind, "/".join(t.words)) for t in Q.tokens("cat|DOG !rain 'Blue sky'  bird")]))
ask("s_17", _values_sql("field direction", [("file_size_mb", "asc"), ("random", "desc"), ("plain", "desc")]))(_rows("field direction", lambda: [S.sort_key(k) for k in ("file_size_mb_asc", "random", "plain")]))
ask("s_29", _values_sql("text", [("dataset=d&q=a+b&page=2&sort=fps_asc&min_fps=24.0",)]))(_rows("text", lambda: [(plan.Request.parse("q=a+b&dataset=d&page=2&sort=fps_asc&min_fps=24&max_fps=").text(),)]))
ask("jn_13", BASE + f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings, qv")(
    lambda s, d: V.scored(vectors(s, d), first_vector(s, d)).select(F.col("video_name").cast("long").alias("vec_id"), F.round("score", 6).alias("score")))


def _on_device(number, batches):
    """What a process of one device does: here it only counts."""
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([b.num_rows], pa.int64()), pa.array([int(b.column(0).to_numpy().sum())], pa.int64())], names=["device", "rows", "total"])


ask("udf_8", "SELECT device, count(*) AS rows, sum(entry_id)::BIGINT AS total FROM (SELECT entry_id, least(p // (n // 8), 7)::INT AS device FROM (SELECT entry_id, row_number() OVER (ORDER BY entry_id) - 1 AS p, count(*) OVER () AS n FROM manifest)) GROUP BY device")(
    lambda s, d: src.per_device(R.split(entries(s, d), ["ordinal"], 8, "device").select("ordinal", "device"), "device", 8, _on_device, "device int, rows long, total long").groupBy("device").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")))
for _name in ("srt_13",):
    ask(_name, "SELECT least(p // (n // 8), 7)::INT AS device, count(*) AS rows FROM (SELECT row_number() OVER (ORDER BY entry_id) - 1 AS p, count(*) OVER () AS n FROM manifest) GROUP BY ALL")(
        lambda s, d: R.split(entries(s, d), ["ordinal"], 8, "device").groupBy("device").agg(F.count("*").alias("rows")))


@ask("inc_9", """SELECT 'progress' AS kind, 'values' AS text UNION ALL SELECT 'progress', 'other' UNION ALL
  SELECT 'result', '{"values": ' || count(DISTINCT user_id) || ', "other": ' || count(DISTINCT user_id) FILTER (event_id % 5 = 0) || '}' FROM events UNION ALL SELECT 'progress', 'bad' UNION ALL SELECT 'error', 'ValueError: rows lack [''gone'']'""")
def inc_9(s: SparkSession, d: str) -> DataFrame:
    """What a listener is told while two rules take in their rows, and when a rule fails."""
    rows = _events(s, d)
    views = {n: (inc.View(s, new_path(s, n)), ["ts", "event_id"]) for n in ("values", "other")}
    told = list(inc.reported(views, {"values": rows, "other": rows.where("event_id % 5 = 0")}))
    bad = list(inc.reported({"bad": (inc.View(s, new_path(s, "bad"), key="gone"), [])}, {"bad": rows}))
    return s.createDataFrame([*told, *bad], "kind string, text string")


@ask("inc_8", "SELECT 'values' AS key, count(DISTINCT user_id) FILTER (event_id <= m) AS before, count(DISTINCT user_id) AS after FROM events, (SELECT min(event_id) + 20 AS m FROM events) HAVING before <> after")
def inc_8(s: SparkSession, d: str) -> DataFrame:
    """What a poll sees between two batches."""
    rows, view = _events(s, d), inc.View(s, new_path(s, "view"))
    first = rows.agg(F.min("event_id").alias("m")).first()["m"] + 20
    seen = []
    for part in (rows.where(F.col("event_id") <= first), rows.where(F.col("event_id") > first)):
        view.take(part, ["ts", "event_id"])
        seen.append(s.createDataFrame(list(inc.status({"values": view}).items()), "key string, n long"))
    return P.status_changed(*seen)


_FRAMES = "SELECT user_id, bit_count(xor(event_id, lag(event_id) OVER w)) AS step, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@ask("udf_11", f"""SELECT user_id::VARCHAR AS sample_id, least(500 + user_id % 7 * 100, 480)::INT AS small, greatest(user_id % 900, 0)::INT AS num_frames, len(list_distinct(list_concat([0, user_id % 900 // 2, greatest(0, user_id % 900 - 1)], list_transform(range(25), lambda i: i * (user_id % 900 - 1) // 24)))) * (user_id % 900 > 0)::INT AS n_frames, true AS unit, round(round(coalesce(avg(step), 0), 4), 2) AS phash_mean_change, coalesce(max(step), 0)::DOUBLE AS phash_max_change,
  round(round(coalesce(stddev_pop(step), 0), 4), 2) AS phash_std_change, round(round(avg(value), 4), 2) AS flow_mean_magnitude, round(round(stddev_pop(value), 4), 2) AS flow_std_magnitude FROM ({_FRAMES}) GROUP BY user_id""")
def udf_11(s: SparkSession, d: str) -> DataFrame:
    """All steps over one video per user, run by the registry in their order; the image model is a stand-in."""
    rows = table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("frames"))
    number = F.col("sample_id").cast("long")
    rows = rows.select("sample_id", F.col("frames.event_id").alias("hashes"), F.col("frames.value").alias("magnitudes"), F.lit(1920).alias("width"), (500 + number % 7 * 100).cast("int").alias("height"), (number % 900).cast("int").alias("raw_frames"),
                       F.lit(24.0).alias("rate"), F.lit(0.0).alias("seconds"), F.lit(1 << 20).alias("bytes"), F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.encode(F.to_json(F.array(i.cast("double"), number.cast("double"))), "utf-8")).alias("images"))
    rows = written(rows, "videos")
    out = model.standard({n: _json_model for n in ("clip", "siglip", "gve")}).run(rows)
    both = out["phash"].join(out["raft_flow"], "sample_id").join(out["compress"], "sample_id").join(out["ingest"], "sample_id")
    for n in ("clip", "siglip", "gve"):
        both = both.join(out[n], "sample_id")
    both = both.withColumns({"small": F.col("sizes")[480]["height"], "n_frames": F.size("frames").cast("long"), "unit": F.abs(F.aggregate("clip_embedding", F.lit(0.0), lambda a, x: a + x * x) - 1) < 1e-3})
    return both.select("sample_id", "small", "num_frames", "n_frames", "unit", F.round("phash_mean_change", 2).alias("phash_mean_change"), "phash_max_change", F.round("phash_std_change", 2).alias("phash_std_change"),
                       F.round("flow_mean_magnitude", 2).alias("flow_mean_magnitude"), F.round("flow_std_magnitude", 2).alias("flow_std_magnitude"))
