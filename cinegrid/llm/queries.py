"""The subpackage's named queries over a folder of tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegrid.functions.vectors import usable
from cinegrid.llm import bpe, clusters, neardup, neighbours, packing, spans, subset, terms
from cinegrid.scratch import written

#: The least size of a cluster of ``p5_clusters``.
MIN_SIZE = 25

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.similar_pairs(table(spark, folder, "clip_embedding"), "vec_id", "embedding", min_cosine=0.8)
    return pairs.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


@query
def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest, whatever their cosine, of every usable vector whose id is divisible by 100, against all rows."""
    clips = table(spark, folder, "clip_embedding")
    found = neighbours.similar(clips, "vec_id", "embedding", queries=clips.where("vec_id % 100 = 0").select("vec_id"))
    return found.select(F.col("id").alias("vec_id"), "other", F.round("cosine", 6).alias("cosine"), "rank")


@query
def p3_subset(spark: SparkSession, folder: str) -> DataFrame:
    captioned = table(spark, folder, "manifest").where(F.col("caption").rlike(r"\S")).select("dataset", "video_name").distinct()
    clips = table(spark, folder, "clip_embedding")
    # the join moves keys only; vectors are picked by id afterwards
    has = clips.select("vec_id", "dataset", "video_name").join(captioned, ["dataset", "video_name"], "left_semi").select("vec_id")
    return subset.varied(clips, "vec_id", "embedding", among=has).withColumnRenamed("id", "vec_id")


@query
def p3_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of ``p3_subset``: how many clips it has, that each stands once, is usable and captioned, and that no two are equal; and how
    many of the anchors' clusters it reaches."""
    picked = written(p3_subset(spark, folder), "picked")
    clips = table(spark, folder, "clip_embedding")
    captioned = table(spark, folder, "manifest").where(F.col("caption").rlike(r"\S")).select("dataset", "video_name").distinct()
    rows = clips.join(picked.select("vec_id"), "vec_id").join(captioned.withColumn("captioned", F.lit(True)), ["dataset", "video_name"], "left")
    labels = written(p5_found(spark, folder), "labels").join(picked, "vec_id").select(F.count_distinct("cluster_label").alias("clusters"))
    of = rows.agg(F.count("*").alias("clips"), F.count_distinct("vec_id").alias("ids"), F.count_distinct("embedding").alias("vectors"), F.count_if("captioned").alias("captioned"), F.count_if(usable(F.col("embedding"), 512)).alias("usable"))
    return of.crossJoin(labels)  # one row each


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.NearDuplicates(table(spark, folder, "manifest"), "entry_id", "caption").pairs()
    return pairs.select(F.col("a").alias("entry_a"), F.col("b").alias("entry_b"))


@query
def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per caption that is in a group, with the group and the number of its links."""
    return neardup.NearDuplicates(table(spark, folder, "manifest"), "entry_id", "caption").groups().withColumnRenamed("id", "entry_id")


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    anchors = table(spark, folder, "cluster_anchors").orderBy("anchor_id").select("cluster_label", "embedding").limit(clusters.ANCHORS + 1).collect()
    given = [(r[0], np.array(r[1], np.float32)) for r in anchors if r[1] is not None]
    made = clusters.graph(table(spark, folder, "clip_embedding"), "vec_id", "embedding", given, core=0, reach=0.42)
    found = clusters.joined_to_anchors(made)
    return found.select(F.col("id").alias("vec_id"), F.col("label").alias("cluster_label"))


@query
def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters themselves, with size and most typical members."""
    made = clusters.graph(table(spark, folder, "clip_embedding"), "vec_id", "embedding", core=2)
    return clusters.described(clusters.clustered(made, min_size=MIN_SIZE))


@query
def p5_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of ``p5_clusters``: every cluster has at least the least size, a vector is in one cluster at most and is usable, and
    exemplars are members and as many as there should be."""
    clips = table(spark, folder, "clip_embedding")
    members = written(clusters.clustered(clusters.graph(clips, "vec_id", "embedding", core=2), min_size=MIN_SIZE), "members")
    found = clusters.described(members)
    own = found.select("cluster", F.explode("exemplars").alias("id")).join(members, ["cluster", "id"])
    good = clips.where(usable(F.col("embedding"), 512)).select(F.col("vec_id").alias("id"))
    facts = {"sized": found.agg(F.coalesce(F.min("size") >= MIN_SIZE, F.lit(True)).alias("ok")), "once": members.agg((F.count("*") == F.count_distinct("id")).alias("ok")),
             "typical": own.agg(F.count("*").alias("n")).crossJoin(found.agg((F.count("*") * 5).alias("want"))).select((F.col("n") == F.col("want")).alias("ok")),
             "usable": members.join(good, "id", "left_anti").agg((F.count("*") == 0).alias("ok"))}
    parts = [df.select(F.lit(name).alias("fact"), "ok") for name, df in facts.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.frequencies(table(spark, folder, "manifest"), "caption").where("mark is not null").select("term", "mark")


@query
def p6_terms(spark: SparkSession, folder: str) -> DataFrame:
    """All terms with their counts."""
    return terms.frequencies(table(spark, folder, "manifest"), "caption")


@query
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), "doc_id", "text")


@query
def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    lengths = bpe.counted(table(spark, folder, "documents"), "doc_id", "text")
    return packing.packed(lengths, "doc_id", "n_tokens")


@query
def p9_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of ``p9_packed``: every document comes once with all its tokens, only what is longer than a container is split, no container is
    overfull, no two parts overlap, and there are at most a hundredth more containers than the tokens need."""
    packed = written(p9_packed(spark, folder), "packed")
    most = packing.CAPACITY
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n").alias("n"))
    lengths = bpe.counted(table(spark, folder, "documents"), "doc_id", "text")
    same = docs.join(lengths, "doc_id", "full_outer").agg(F.count("*").alias("documents"), F.count_if(~F.col("n").eqNullSafe(F.col("n_tokens"))).alias("wrong"), F.count_if((F.col("parts") > 1) & (F.col("n") <= most)).alias("split"))
    order = Window.partitionBy("container").orderBy("offset")
    filled = packed.where("n > 0").withColumn("before", F.coalesce(F.lag(F.col("offset") + F.col("n")).over(order), F.lit(0)))
    of = filled.groupBy("container").agg(F.max(F.col("offset") + F.col("n")).alias("full"), F.count_if(F.col("before") > F.col("offset")).alias("over"))
    of = of.join(filled.groupBy("container").agg(F.sum("n").alias("n")), "container")
    bound = of.agg(F.count_if(F.col("full") > most).alias("overfull"), F.coalesce(F.sum("over"), F.lit(0)).alias("overlaps"), (F.count("*") <= F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / most) * 1.01 + 1).alias("tight"))
    return same.crossJoin(bound)  # one row each


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spans.Spans(table(spark, folder, "documents"), "doc_id", "text").pairs()
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


@query
def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each text stands elsewhere too."""
    return spans.Spans(table(spark, folder, "documents"), "doc_id", "text").report().withColumnRenamed("doc", "doc_id")


_UNIT = """
WITH ok AS (
  SELECT vec_id, embedding::DOUBLE[512] AS v FROM clip_embedding
  WHERE embedding IS NOT NULL AND len(embedding) = 512 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
"""
SQL["p1_found"] = _UNIT + """
, near AS (
  SELECT a.vec_id AS a, b.vec_id AS b, array_cosine_similarity(a.v, b.v) AS c FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
), best AS (
  SELECT a, b FROM near WHERE c >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10
)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM best
"""
SQL["p1_neighbours"] = _UNIT + """
SELECT a.vec_id, b.vec_id AS other, round(array_cosine_similarity(a.v, b.v), 6) AS cosine,
       CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY array_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS INT) AS rank
FROM ok a JOIN ok b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10
"""
SQL["p5_found"] = "WITH RECURSIVE" + _UNIT.strip().removeprefix("WITH") + """
, links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.v, b.v) >= 0.42
), joined AS (
  SELECT vec_id, cluster_label FROM ok JOIN cluster_anchors k ON array_cosine_similarity(v, k.embedding::DOUBLE[512]) >= 0.42
  UNION
  SELECT b AS vec_id, cluster_label FROM joined JOIN links ON vec_id = a
)
SELECT vec_id, cluster_label FROM joined
"""
_WORDS = r"""
WITH said AS (
  SELECT entry_id, regexp_extract_all(lower(coalesce(caption, '')), '[\p{L}\p{Nd}]+') AS words FROM manifest
)
"""
_SETS = _WORDS + """
, sets AS (
  SELECT entry_id, list_distinct(words) AS w FROM said WHERE len(list_distinct(words)) >= 8
), word AS (
  SELECT entry_id, len(w) AS n, unnest(w) AS t FROM sets
), linked AS (
  SELECT a.entry_id AS x, b.entry_id AS y FROM word a JOIN word b ON a.t = b.t AND a.entry_id < b.entry_id
  GROUP BY a.entry_id, b.entry_id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*))
)
"""
SQL["p4_found"] = _SETS + "SELECT x AS entry_a, y AS entry_b FROM linked"
SQL["p4_groups"] = _SETS.replace("WITH said", "WITH RECURSIVE said") + """
, class AS (
  SELECT entry_id, list_sort(w) AS c FROM sets
), ends AS (
  SELECT x AS a, y AS b FROM linked UNION ALL SELECT y, x FROM linked
), reach AS (
  SELECT DISTINCT a AS id, a AS root FROM ends
  UNION
  SELECT b, root FROM reach JOIN ends ON id = a
), other AS (
  SELECT a, count(DISTINCT cb.c) AS links FROM ends JOIN class ca ON ca.entry_id = a JOIN class cb ON cb.entry_id = b WHERE ca.c <> cb.c GROUP BY a
)
SELECT id AS entry_id, min(root) AS "group", coalesce(any_value(links), 0) AS links FROM reach LEFT JOIN other ON a = id GROUP BY id
"""
SQL["p3_checked"] = _UNIT + """
, clip AS (
  SELECT DISTINCT embedding FROM clip_embedding JOIN ok USING (vec_id)
  WHERE (dataset, video_name) IN (SELECT (dataset, video_name) FROM manifest WHERE regexp_matches(caption, '\\S') AND dataset IS NOT NULL AND video_name IS NOT NULL)
), n AS (
  SELECT least(256, count(*)) AS n FROM clip
)
SELECT n AS clips, n AS ids, n AS vectors, n AS captioned, n AS usable, (SELECT count(*) FROM cluster_anchors) AS clusters FROM n
"""
SQL["p5_checked"] = "SELECT * FROM (VALUES ('sized', true), ('once', true), ('typical', true), ('usable', true)) v(fact, ok)"
SQL["p9_checked"] = "SELECT count(*) AS documents, 0 AS wrong, 0 AS split, 0 AS overfull, 0 AS overlaps, true AS tight FROM documents"
_TERMS = _WORDS + """
, held AS (
  SELECT count(*) AS n FROM said WHERE len(words) > 0
), term AS (
  SELECT entry_id, unnest(words) AS term FROM said
), counts AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT entry_id) AS rows FROM term GROUP BY term
), marked AS (
  SELECT term, occurrences, rows, CASE WHEN rows <= 2 THEN 'rare' WHEN rows > 0.1 * n THEN 'common' END AS mark FROM counts, held
)
"""
SQL["p6_found"] = _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL"
SQL["p6_terms"] = _TERMS + "SELECT * FROM marked"
SQL["p10_found"] = """
WITH w AS (
  SELECT DISTINCT doc_id, substring(text, i, 200) AS s
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)
)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.s = b.s AND a.doc_id < b.doc_id
"""
SQL["p10_shared"] = """
WITH w AS (
  SELECT doc_id, i, substring(text, i, 200) AS s
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)
), again AS (
  SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1
), starts AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w SEMI JOIN again USING (s)
), per AS (
  SELECT doc_id, count(*) FILTER (gap IS NULL OR gap > 200) AS spans,
         sum(CASE WHEN gap IS NULL OR gap > 200 THEN 200 ELSE gap END) AS chars FROM starts GROUP BY doc_id
)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(spans, 0) AS spans, CAST(coalesce(chars, 0) AS BIGINT) AS shared_chars,
       CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 ELSE coalesce(chars, 0) / length(text) END AS share
FROM documents LEFT JOIN per USING (doc_id)
"""
