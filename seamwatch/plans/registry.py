"""Registered queries: a Spark plan and, where SQL can express it, the same result in ANSI-style SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated plan under its function name."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


# SQL text shared by the comparison queries.
CAPTURES_SQL = """captures AS (
  SELECT o_orderkey AS capture_id, CAST(o_orderdate AS VARCHAR) AS capture_time,
         o_orderpriority AS received_at, CAST(o_custkey % 10 + 1 AS VARCHAR) AS station_id,
         CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'P' THEN 'failed' ELSE 'received' END AS status,
         o_totalprice / 1000.0 AS x_m, o_custkey
  FROM orders)"""
OBJECTS_SQL = """objects AS (
  SELECT l_orderkey AS capture_id, l_returnflag AS object_type, l_linestatus AS class_id,
         round(l_discount * 10, 4) AS confidence,
         l_quantity AS x1, l_tax * 1000 AS y1, l_quantity + 20 AS x2, l_tax * 1000 + 30 AS y2,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS object_index
  FROM lineitem)"""
CORRECTIONS_SQL = """corrections AS (
  SELECT event_id AS id, user_id + 1 AS capture_id, ts AS created_at, event_type <> 'error' AS active,
         event_type AS operator, props AS corrected_json,
         CAST(trunc(value % 4) AS BIGINT) AS corrected_objects
  FROM events)"""
ITEMS_SQL = """items AS (
  SELECT user_id AS batch_id, lpad(CAST(event_id AS VARCHAR), CAST(greatest(12, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0') AS relative_path,
         event_id % 1000 + 1 AS capture_id, ts,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'succeeded' END AS status,
         CASE WHEN event_type = 'error' THEN props END AS error
  FROM events)"""
READINGS_SQL = """readings AS (
  SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, ts, event_id, event_type AS raw_text,
         least(value / 100.0, 1.0) AS confidence,
         CASE WHEN value >= 20 THEN 'confirmed' ELSE 'unreadable' END AS status
  FROM events)"""
GAS_SQL = """gas AS (
  SELECT user_id AS device, CAST(date_trunc('day', ts) AS DATE) AS day, event_id, ts,
         CASE event_type WHEN 'view' THEN 'ch4' WHEN 'click' THEN 'o2' WHEN 'purchase' THEN 'co' WHEN 'signup' THEN 'h2s' WHEN 'error' THEN 'co' END AS channel,
         value,
         CASE WHEN event_type = 'error' THEN 'read_error' WHEN value > 80 THEN 'high_alarm' WHEN value < 5 THEN 'low_alarm' ELSE 'normal' END AS status
  FROM events)"""
RECORDS_SQL = """records AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), CAST(greatest(12, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS relative_path, doc_id AS capture_id, source AS batch_id,
         sha256(text) AS sha256, sha256(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS perceptual_hash,
         n_chars, lang
  FROM documents)"""
FRAMES_SQL = """frames AS (
  SELECT label AS device, vec_id AS sample_id,
         list_transform(embedding, lambda v: round(CAST(v AS DOUBLE) * 40.0 + 25.0, 4)) AS t
  FROM embeddings)"""
BITS_SQL = """bits AS (
  SELECT vec_id, label,
         CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i+1] > 0 THEN CAST(1 AS BIGINT) << (31 - i) ELSE 0 END)) AS BIGINT) AS hi,
         CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i+33] > 0 THEN CAST(1 AS BIGINT) << (31 - i) ELSE 0 END)) AS BIGINT) AS lo,
         CASE vec_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split
  FROM embeddings)"""
