"""The core's named queries over a folder of tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinegrid.operators import compaction, records

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


#: Bytes of bodies of a file in the queries: small beside a production file, so that the test tables too give several.
FILE_BYTES = 4 << 20


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.copies(table(spark, folder, "sample_files"), target_bytes=FILE_BYTES)


@query
def p2_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The compacted records themselves, as read back from the swapped folder."""
    from cinegrid.scratch import new_path

    report = compaction.compact(table(spark, folder, "sample_files"), new_path(spark, "compacted"), FILE_BYTES)
    return spark.read.parquet(f"{report.path}/records").select("file_id", "sample_id", "artifact", "video_name", "fps", "copies")


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return records.rejected(table(spark, folder, "short_csv"), "line_id", "raw_line").select("line_id", "reason")


@query
def p7_valid(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.valid(table(spark, folder, "short_csv"), "line_id", "raw_line")
    return rows.toDF(*(c.lower().replace(" ", "_") for c in rows.columns))


# DuckDB's JSON objects keep spelling and order, so the members are compared as a sorted list of (key, kind, value).
_FILES = r"""
WITH ok AS (
  SELECT file_id, sample_id, artifact, body::JSON AS j FROM sample_files
  WHERE body IS NOT NULL AND json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT'
), cells AS (
  SELECT file_id, sample_id, artifact, unnest(json_keys(j)) AS k, j FROM ok
), said AS (
  SELECT file_id, sample_id, artifact, k,
         CASE WHEN json_type(j, '$."' || k || '"') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')
              THEN 'n' || CAST(CAST(j->>('$."' || k || '"') AS DOUBLE) AS VARCHAR)
              ELSE coalesce('s' || (j->>('$."' || k || '"')), 'null') END AS v
  FROM cells
), bodies AS (
  SELECT file_id, sample_id, artifact, list([k, v] ORDER BY k) AS said FROM said GROUP BY ALL
)
"""
SQL["p2_found"] = _FILES + """
SELECT a.file_id AS file_a, b.file_id AS file_b FROM bodies a JOIN bodies b
ON a.sample_id = b.sample_id AND a.artifact = b.artifact AND a.said = b.said AND a.file_id < b.file_id
"""

SQL["p2_compacted"] = _FILES + """
, one AS (
  SELECT min(file_id) AS file_id, count(*) AS copies FROM bodies GROUP BY sample_id, artifact, said
), every AS (
  FROM one UNION ALL SELECT file_id, 1 AS copies FROM sample_files WHERE file_id NOT IN (SELECT file_id FROM bodies)
)
SELECT file_id, sample_id, artifact, copies, j->>'$.video_name' AS video_name, CAST(j->>'$.fps' AS DOUBLE) AS fps
FROM every JOIN sample_files USING (file_id) LEFT JOIN (SELECT file_id, j FROM ok) USING (file_id)
"""

_RECORDS = r"""
WITH said AS (
  SELECT line_id, coalesce(raw_line, '') AS s FROM short_csv
), formed AS (
  SELECT line_id, s, regexp_full_match(s, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS quoted FROM said
), cut AS (
  SELECT line_id, quoted,
         CASE WHEN quoted THEN list_transform(regexp_extract_all(',' || s, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
              lambda f: CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END) END AS f FROM formed
), judged AS (
  SELECT line_id, f, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 6 THEN 'columns'
    WHEN NOT regexp_full_match(f[1], '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.mp4')
      OR NOT regexp_full_match(f[4], ' *([+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)? *')
      OR regexp_matches(f[3], '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]') THEN 'value' END AS reason FROM cut
)
"""
SQL["p7_found"] = _RECORDS + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"
SQL["p7_valid"] = _RECORDS + """
SELECT line_id, f[1] AS clip_id, f[2] AS brief_description, f[3] AS summarized_description,
       TRY_CAST(trim(f[4]) AS DOUBLE) AS vtss_score, TRY_CAST(trim(f[5]) AS DOUBLE) AS motion_score,
       TRY_CAST(trim(f[6]) AS DOUBLE) AS video_clip_score FROM judged WHERE reason IS NULL
"""


def ask(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its identifier, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


from cinegrid import catalogue_queries  # noqa: E402, F401  registers the catalogue's operators
