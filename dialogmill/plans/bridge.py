"""The given tables as canonical views; the SQL text is the same for Spark and DuckDB but where marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = """SELECT concat('m', lpad(cast(conv_id AS STRING), 6, '0'), '-', lpad(cast(turn AS STRING), 4, '0')) AS id,
 concat('s', lpad(cast(conv_id AS STRING), 6, '0')) AS session_id, 1767225600000 + conv_id * 86400000 + turn * 60000 AS ts, role, text,
 CASE WHEN conv_id % 2 = 0 THEN 'opencode' ELSE 'pi' END AS source, concat('repo', cast(conv_id % 20 AS STRING)) AS repo,
 CASE WHEN role = 'assistant' THEN concat('p/m', cast(conv_id % 5 AS STRING)) END AS model, CASE WHEN conv_id % 2 = 0 THEN 'build' END AS agent, '' AS cmd
 FROM conversations WHERE role IN ('user', 'assistant')"""
SESSIONS = """SELECT concat('s', lpad(cast(c.conv_id AS STRING), 6, '0')) AS id, min(1767225600000 + c.conv_id * 86400000 + c.turn * 60000) AS ts_created,
 substring(split_part(max(CASE WHEN c.turn = f.t0 AND c.role = 'user' THEN c.text END), chr(10), 1), 1, 60) AS title,
 CASE WHEN c.conv_id % 2 = 0 THEN 'opencode' ELSE 'pi' END AS source, concat('repo', cast(c.conv_id % 20 AS STRING)) AS repo,
 CASE WHEN c.conv_id % 10 = 9 THEN concat('s', lpad(cast(c.conv_id - 1 AS STRING), 6, '0')) END AS parent_session
 FROM conversations c LEFT JOIN (SELECT conv_id, min(turn) AS t0 FROM conversations WHERE role = 'user' GROUP BY conv_id) f ON c.conv_id = f.conv_id GROUP BY c.conv_id"""
DOCS = f"""SELECT id, session_id, ts, role, agent, repo, model, cmd, text, source FROM ({EVENTS}) e
 UNION ALL SELECT id, id AS session_id, ts_created AS ts, 'title' AS role, NULL AS agent, repo, NULL AS model, '' AS cmd, title AS text, source FROM ({SESSIONS}) s WHERE title <> ''"""
RAW = """SELECT concat('d', lpad(cast(doc_id AS STRING), 6, '0')) AS part_id, text AS content, CASE WHEN doc_id % 2 = 0 THEN 'opencode' ELSE 'pi' END AS source FROM documents"""
#: {k} and {ms}: the expressions that differ between the engines.
CALLS = """SELECT concat('u', lpad(cast(user_id AS STRING), 6, '0')) AS session_id, concat('e', lpad(cast(event_id AS STRING), 8, '0')) AS id, event_type AS tool,
 concat('k: ', {k}) AS cmd, {ms} AS ts, value AS cost, CASE WHEN user_id % 2 = 0 THEN 'opencode' ELSE 'pi' END AS source FROM events"""
CALLS_SPARK = CALLS.format(k="get_json_object(props, '$.k')", ms="timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
CALLS_DUCKDB = CALLS.format(k="json_extract_string(props, '$.k')", ms="epoch_us(ts) // 1000")
QUERIES = "SELECT concat('q', lpad(cast(item_id AS STRING), 4, '0')) AS qid, text AS q FROM benchmark"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the given tables, read where it names them."""
    for name in ("conversations", "documents", "events", "benchmark", "labels", "pages", "orders", "customer"):
        for before in ("FROM ", "JOIN "):
            sql = sql.replace(f"{before}{name}", f"{before}parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(sql)
