"""Queries over gas and thermal streams and the file scans that feed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamwatch import adapters as A
from seamwatch import constants as K
from seamwatch.functions import registers as R
from seamwatch.functions import text as X
from seamwatch.functions import thermal as T
from seamwatch.operators import sensors as S
from seamwatch.plans.registry import FRAMES_SQL, GAS_SQL, query
from seamwatch.sinks import tables as sinks
from seamwatch.sources import files as SRC
from seamwatch.streaming import streams as ST

_DAY = "CAST(date_trunc('day', ts) AS DATE)"


def _hex(value, width: int):
    return F.lpad(F.hex(value.cast("bigint")), width, "0")


# --- register frames -----------------------------------------------------------------------------------------

_CRC_SQL = "[" + ",".join(str(s) for s in R.CRC_STEPS) + "]"
_REGISTERS_SQL = """regs AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber % 4 + 1 AS slave,
    CAST((l_suppkey % 5) * 2 AS BIGINT) AS unit_code, CAST(CASE WHEN l_quantity > 48 THEN 1 ELSE (l_partkey % 4) * 4 END AS BIGINT) AS decimal_code,
    CAST(l_partkey % 3 AS BIGINT) AS high, CAST((l_partkey * 31) % 65536 AS BIGINT) AS low, CAST(l_quantity AS BIGINT) % 18 AS status_code
  FROM lineitem)"""
_NAMES = "['" + "','".join(K.STATUS_CODES[i] for i in range(16)) + "']"
_DECODE_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  CASE WHEN decimal_code <> 1 THEN CAST(((high << 16) | low) / power(10, decimal_code // 4) AS DOUBLE) END AS value,
  CASE WHEN decimal_code <> 1 THEN CASE unit_code WHEN 0 THEN 'ppm' WHEN 2 THEN '%LEL' WHEN 4 THEN '%VOL' WHEN 6 THEN 'mg/m3' ELSE 'ppb' END END AS unit,
  CASE WHEN decimal_code <> 1 THEN CASE WHEN status_code < 16 THEN {_NAMES}[status_code + 1] ELSE 'unknown(0x' || upper(printf('%02x', status_code)) || ')' END END AS status,
  CASE WHEN decimal_code = 1 THEN '未知的小数位编码：0x1' END AS error"""


def _registers(spark: SparkSession, d: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    decimal_code = F.when(F.col("l_quantity") > 48, 1).otherwise((part % 4) * 4)
    head = ((supp % 5) * 2 * 4096 + decimal_code * 256 + (part % 3) * 64).cast("int")
    low = ((part * 31) % 65536).cast("int")
    zero = F.lit(0)
    status = (F.col("l_quantity").cast("bigint") % 18).cast("int")
    return A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_linenumber") % 4 + 1).alias("slave_id"),
        F.array(head, low, zero, zero, zero, status).alias("registers"))


@query(f"WITH {_REGISTERS_SQL} {_DECODE_SQL} FROM regs")
def register_decode(spark: SparkSession, d: str) -> DataFrame:
    out = S.decode_register_rows(_registers(spark, d))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("value").cast("double").alias("value"), "unit", "status", "error")


@query(f"""WITH {_REGISTERS_SQL},
body AS (SELECT *, [slave, 3, 12, (unit_code << 4) | decimal_code, high << 6, low // 256, low % 256, 0, 0, 0, 0, 0, 0, 0, status_code] AS b FROM regs),
summed AS (SELECT *, list_reduce(list_transform(list_prepend(65535, b), lambda x: CAST(x AS BIGINT)),
    lambda crc, x: xor(crc >> 8, CAST({_CRC_SQL}[CAST((xor(crc, x) & 255) + 1 AS INTEGER)] AS BIGINT))) AS crc FROM body)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, crc,
  CASE WHEN l_linenumber = 7 THEN 'CRC 校验失败' WHEN l_linenumber = 6 THEN '从机地址不匹配：期望 9，收到 ' || slave
       WHEN l_linenumber = 5 THEN '响应长度过短：4' WHEN decimal_code = 1 THEN '未知的小数位编码：0x1' END AS error,
  CASE WHEN l_linenumber < 5 AND decimal_code <> 1 THEN CAST(((high << 16) | low) / power(10, decimal_code // 4) AS DOUBLE) END AS value
FROM summed""")
def register_frames(spark: SparkSession, d: str) -> DataFrame:
    regs = _registers(spark, d)
    body = F.concat(_hex(F.col("slave_id"), 2), F.lit("030C"), *[_hex(F.get("registers", F.lit(i)), 4) for i in range(6)])
    framed = regs.withColumn("_body", F.unhex(body)).withColumn("crc", R.crc16(R.frame_bytes(F.col("_body"))).cast("bigint"))
    tail = F.concat(_hex(F.col("crc") % 256, 2), _hex(F.floor(F.col("crc") / 256), 2))
    line = F.col("l_linenumber")
    broken = F.when(line == 7, F.concat(F.hex("_body"), _hex((F.col("crc") + 1) % 256, 2), _hex(F.floor(F.col("crc") / 256), 2))).when(
        line == 5, F.substring(F.hex("_body"), 1, 8)).otherwise(F.concat(F.hex("_body"), tail))
    rows = framed.withColumn("frame", F.unhex(broken)).withColumn("slave_id", F.when(line == 6, 9).otherwise(F.col("slave_id")))
    out = S.parse_frames(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "crc", "error", F.col("value").cast("double").alias("value"))


@query(f"""WITH t AS (SELECT user_id, {_DAY} AS day, event_id, event_type, value,
   row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id) AS attempt FROM events),
tried AS (SELECT * FROM t WHERE attempt <= 3)
SELECT user_id, day, arg_min(value, attempt) FILTER (event_type <> 'error') AS value,
  CAST(min(attempt) FILTER (event_type <> 'error') AS INTEGER) AS used_attempt, count(*) AS attempts,
  CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'ok' ELSE 'read_error' END AS status,
  CASE WHEN count(*) FILTER (event_type <> 'error') = 0 THEN CAST(arg_max(event_id, attempt) AS VARCHAR) END AS error
FROM tried GROUP BY 1, 2""")
def first_valid_attempt(spark: SparkSession, d: str) -> DataFrame:
    rows = A.events(spark, d).withColumn("message", F.col("event_id").cast("string"))
    return S.first_valid_attempt(
        rows, ["user_id", "day"], ["ts", "event_id"], F.col("event_type") != "error", "value", "message")


# --- gas tables ---------------------------------------------------------------------------------------------------

_RECORD_SQL = f"""rec AS (SELECT user_id AS batch_id, event_id, ts, event_type, value,
  user_id % 19 = 0 AS bad_header,
  CASE WHEN event_type = 'error' AND value < 20 THEN 'gas timestamp must be ISO-8601'
       WHEN event_type = 'error' AND value < 40 THEN 'gas sample_id must be numeric'
       WHEN event_type = 'error' AND value < 60 THEN 'ch4_value must be numeric or blank'
       WHEN event_type = 'error' AND value < 80 THEN 'ch4_value must be finite' END AS broken,
  strftime(ts, '%Y%m%d_%H') || '0000_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS sample_key FROM events),
good AS (SELECT *, row_number() OVER (PARTITION BY batch_id, sample_key ORDER BY event_id) AS rn FROM rec WHERE NOT bad_header AND broken IS NULL)"""


def _gas_records(spark: SparkSession, d: str) -> DataFrame:
    """CSV records written from the events: both dialects, broken fields and wrong headers included."""
    kind, v = F.col("event_type"), F.col("value")
    bad = kind == "error"
    stamp = F.when(bad & (v < 20), "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:00:00'+08:00'"))
    sample = F.when(bad & (v >= 20) & (v < 40), "x1").otherwise(F.col("user_id").cast("string"))
    number = F.when(bad & (v >= 40) & (v < 60), "abc").when(bad & (v >= 60) & (v < 80), "Infinity").otherwise(v.cast("string"))
    zh = F.col("user_id") % 2 == 0
    english = F.concat_ws(",", stamp, sample, number, F.lit("%LEL"), F.lit("ok"), F.lit(""), F.lit("%VOL"), F.lit("ok"),
                          F.lit("2"), F.lit("ppm"), F.lit("ok"), F.lit("0"), F.lit("ppm"), F.lit("ok"), F.lit('" a, b "'))
    chinese = F.concat_ws(",", stamp, sample, number, F.lit(""), F.lit("2"), F.lit("0"), F.when(v > 50, "O2状态：low_alarm").otherwise("正常"))
    header = F.when(F.col("user_id") % 19 == 0, "a,b").when(zh, ",".join(K.GAS_HEADER_ZH)).otherwise(",".join(K.GAS_HEADER_EN))
    return A.table(spark, d, "events").select(
        F.col("user_id").alias("batch_id"), F.concat(F.lit("gas/"), F.col("user_id").cast("string"), F.lit(".csv")).alias("path"),
        header.alias("header"), F.when(zh, chinese).otherwise(english).alias("record"), (F.col("event_id") + 2).alias("row"))


@query(f"""WITH {_RECORD_SQL}
SELECT batch_id, sample_key, lpad(CAST(batch_id AS VARCHAR), 6, '0') AS sample_id, strftime(ts, '%Y-%m-%dT%H:00:00+08:00') AS captured_at,
  value AS ch4_value, CAST(NULL AS DOUBLE) AS o2_value, CAST(2 AS DOUBLE) AS co_value, '%VOL' AS o2_unit,
  CASE WHEN batch_id % 2 = 1 THEN 'ok' END AS ch4_status,
  CASE WHEN batch_id % 2 = 1 THEN 'a, b' WHEN value > 50 THEN 'O2状态：low_alarm' END AS gas_error
FROM good WHERE rn = 1""")
def gas_samples(spark: SparkSession, d: str) -> DataFrame:
    samples, _ = SRC.normalize_gas(_gas_records(spark, d))
    return samples.select("batch_id", "sample_key", "sample_id", "captured_at", "ch4_value", "o2_value", "co_value", "o2_unit", "ch4_status", "gas_error")


@query(f"""WITH {_RECORD_SQL}
SELECT DISTINCT CAST(batch_id AS VARCHAR) AS batch_id, 'gas' AS scope, 'error' AS level, CAST(NULL AS BIGINT) AS row,
  'invalid gas CSV header: ' || batch_id || '.csv' AS message FROM rec WHERE bad_header
UNION ALL SELECT CAST(batch_id AS VARCHAR), 'gas', 'error', event_id + 2, broken FROM rec WHERE NOT bad_header AND broken IS NOT NULL
UNION ALL SELECT CAST(batch_id AS VARCHAR), 'gas', 'error', event_id + 2, 'duplicate sensor sample: ' || sample_key FROM good WHERE rn > 1""")
def gas_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    _, notes = SRC.normalize_gas(_gas_records(spark, d))
    return notes.select("batch_id", "scope", "level", "row", "message")


@query(f"""WITH {_RECORD_SQL}, notes AS (
  SELECT DISTINCT batch_id, -1 AS k FROM rec WHERE bad_header
  UNION ALL SELECT batch_id, event_id FROM rec WHERE NOT bad_header AND broken IS NOT NULL
  UNION ALL SELECT batch_id, event_id FROM good WHERE rn > 1)
SELECT CAST(batch_id AS VARCHAR) AS batch_id, count(*) AS warning_count FROM notes GROUP BY 1""")
def diagnostics_count(spark: SparkSession, d: str) -> DataFrame:
    _, notes = SRC.normalize_gas(_gas_records(spark, d))
    return notes.groupBy("batch_id").agg(F.count(F.lit(1)).alias("warning_count"))


@query("""WITH stored AS (SELECT user_id AS batch_id, CASE event_id % 2 WHEN 0 THEN 'gas' ELSE 'thermal' END AS scope FROM events WHERE event_type = 'error'),
b AS (SELECT DISTINCT user_id AS batch_id FROM events WHERE user_id % 3 = 0),
m AS (SELECT * FROM stored WHERE NOT (scope = 'gas' AND batch_id IN (SELECT batch_id FROM b))
  UNION ALL SELECT user_id, 'gas' FROM events WHERE event_type = 'click' AND user_id % 3 = 0)
SELECT b.batch_id, count(m.batch_id) AS warning_count FROM b LEFT JOIN m USING (batch_id) GROUP BY 1""")
def diagnostics_recount(spark: SparkSession, d: str) -> DataFrame:
    """Counts of re-imported batches: their gas diagnostics are replaced, those of other scopes stay."""
    events = A.table(spark, d, "events").withColumnRenamed("user_id", "batch_id")
    message = F.col("event_id").cast("string").alias("message")
    stored = events.where("event_type = 'error'").select("batch_id", F.when(F.col("event_id") % 2 == 0, "gas").otherwise("thermal").alias("scope"), message)
    again = events.where("batch_id % 3 = 0")
    new = again.where("event_type = 'click'").select("batch_id", F.lit("gas").alias("scope"), message)
    return sinks.merge_diagnostics(stored, new, "gas", again.select("batch_id").distinct())[1]


@query("""SELECT source, CAST(sum(len(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: x <> '')) - 1) AS BIGINT) AS gas_rows
FROM documents GROUP BY 1""")
def gas_row_count(spark: SparkSession, d: str) -> DataFrame:
    files = A.table(spark, d, "documents").select("source", F.col("text").alias("content"))
    return SRC.count_gas_rows(SRC.csv_records(files), ["source"])


# --- thermal scans ------------------------------------------------------------------------------------------------

_THERMAL_SQL = """f AS (SELECT user_id AS batch_id, event_id,
  strftime(ts, '%Y%m%d_%H') || '0000_' || lpad(CAST(user_id % 40 AS VARCHAR), 6, '0') AS sample_key,
  strftime(ts, '%Y-%m-%dT%H:00:00') AS captured_at,
  CASE WHEN event_type = 'signup' THEN 'invalid thermal file name' WHEN event_type = 'error' AND value < 30 THEN 'uploaded image is empty'
       WHEN event_type = 'error' AND value < 60 THEN 'uploaded file is not a supported JPEG, PNG or BMP image'
       WHEN event_type = 'error' THEN 'thermal file must be PNG' END AS broken,
  sha256(unhex('89504E470D0A1A0A' || hex(props || event_id))) AS sha FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY batch_id, sample_key ORDER BY lpad(CAST(event_id AS VARCHAR), CAST(greatest(12, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0')) AS rn FROM f WHERE broken IS NULL)"""


def _thermal_files(spark: SparkSession, d: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    name = F.concat(F.date_format("ts", "yyyyMMdd_HH"), F.lit("0000_"), F.lpad((F.col("user_id") % 40).cast("string"), 6, "0"), F.lit(".PNG"))
    payload = F.hex(F.concat("props", F.col("event_id").cast("string")))
    magic = F.when(kind != "error", "89504E470D0A1A0A").when(v < 60, "0000").otherwise("FFD8FF")
    content = F.when((kind == "error") & (v < 30), F.unhex(F.lit(""))).otherwise(F.unhex(F.concat(magic, payload)))
    folder = X.zero_pad(F.col("event_id").cast("string"), 12)
    return A.table(spark, d, "events").select(
        F.col("user_id").alias("batch_id"),
        F.concat(folder, F.when(kind == "signup", "/heat_").otherwise("/Thermal_"), name).alias("path"), content.alias("content"))


@query(f"WITH {_THERMAL_SQL} SELECT batch_id, sample_key, captured_at, sha AS thermal_sha256 FROM g WHERE rn = 1")
def thermal_samples(spark: SparkSession, d: str) -> DataFrame:
    return SRC.normalize_thermal(_thermal_files(spark, d))[0].select("batch_id", "sample_key", "captured_at", "thermal_sha256")


@query(f"""WITH {_THERMAL_SQL} SELECT CAST(batch_id AS VARCHAR) AS batch_id, event_id, broken AS message FROM f WHERE broken IS NOT NULL
UNION ALL SELECT CAST(batch_id AS VARCHAR), event_id, 'duplicate thermal sample: ' || sample_key FROM g WHERE rn > 1""")
def thermal_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    notes = SRC.normalize_thermal(_thermal_files(spark, d))[1]
    return notes.select("batch_id", F.regexp_extract("path", "^[0-9]+", 0).cast("bigint").alias("event_id"), "message")


# --- alignment ----------------------------------------------------------------------------------------------------------

_SIDES_SQL = f"""g AS (SELECT user_id AS batch_id, {_DAY} AS day, min(event_id) AS gas_event, arg_min(value, event_id) AS gas_value FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2),
t AS (SELECT user_id AS batch_id, {_DAY} AS day, min(event_id) AS thermal_event, arg_min(value, event_id) AS thermal_value FROM events WHERE event_type NOT IN ('view', 'purchase') GROUP BY 1, 2),
aligned AS (SELECT coalesce(g.batch_id, t.batch_id) AS batch_id, coalesce(g.day, t.day) AS day, gas_event, gas_value, thermal_event, thermal_value,
  CASE WHEN g.batch_id IS NULL THEN 'missing_gas_row' WHEN t.batch_id IS NULL THEN 'missing_thermal_frame' END AS warning
FROM g FULL JOIN t ON g.batch_id = t.batch_id AND g.day = t.day)"""


def _side(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Every event is of one side: views and purchases are gas rows, the others thermal frames."""
    gas = F.col("event_type").isin("view", "purchase")
    rows = A.events(spark, d).where(gas if name == "gas" else ~gas)
    return rows.groupBy(F.col("user_id").alias("batch_id"), "day").agg(
        F.min("event_id").alias(f"{name}_event"), F.min_by("value", "event_id").alias(f"{name}_value"))


@query(f"WITH {_SIDES_SQL} SELECT * FROM aligned")
def sensor_align(spark: SparkSession, d: str) -> DataFrame:
    return S.align_sensors(_side(spark, d, "gas"), _side(spark, d, "thermal"), ["batch_id", "day"])


@query(f"""WITH {_SIDES_SQL} SELECT CAST(batch_id AS VARCHAR) AS batch_id, 'sensors' AS scope, CAST(day AS VARCHAR) AS sample_key, warning AS message
FROM aligned WHERE warning IS NOT NULL""")
def sensor_align_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    aligned = S.align_sensors(_side(spark, d, "gas"), _side(spark, d, "thermal"), ["batch_id", "day"])
    return S.alignment_diagnostics(aligned, key="day").select("batch_id", "scope", "sample_key", "message")


@query(f"""WITH {_SIDES_SQL} SELECT 'device ' || batch_id AS k, day, gas_event, gas_value, thermal_event, thermal_value, warning FROM aligned""")
def keyed_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The stream operator over static tables, by keys that carry no time."""
    gas, thermal = (_side(spark, d, name).select(F.concat(F.lit("device "), F.col("batch_id")).alias("k"), "day", F.col(f"{name}_event").alias("event"), F.col(f"{name}_value").alias("value"))
                    for name in ("gas", "thermal"))
    return ST.align_streams(gas, thermal, ["k", "day"])


_ALARM_SQL = f"""{GAS_SQL}, r AS (SELECT ts, device, channel, status, value, status IN ('low_alarm', 'high_alarm') AS alarm FROM gas WHERE channel IS NOT NULL)"""


def _gas_readings(spark: SparkSession, d: str) -> DataFrame:
    return A.gas_long(spark, d).where(F.col("channel").isNotNull())


@query(f"""WITH {_ALARM_SQL} SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, channel, count(*) AS readings, count(*) FILTER (alarm) AS alarms, max(value) AS peak FROM r GROUP BY 1, 2""")
def alarm_windows(spark: SparkSession, d: str) -> DataFrame:
    return ST.alarm_windows(_gas_readings(spark, d)).select(F.col("window.start").alias("start"), "channel", "readings", "alarms", "peak")


@query(f"""WITH {_ALARM_SQL}, a AS (SELECT ts, channel, value FROM r WHERE alarm),
f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '2 minutes' THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY channel ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f)
SELECT channel, min(ts) AS start, max(ts) + INTERVAL '2 minutes' AS until, count(*) AS alarms, max(value) AS peak FROM s GROUP BY channel, n""")
def alarm_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ST.alarm_sessions(_gas_readings(spark, d)).select("channel", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("until"), "alarms", "peak")


@query(f"SELECT DISTINCT user_id, {_DAY} AS day FROM events")
def sample_keys(spark: SparkSession, d: str) -> DataFrame:
    gas, thermal = (_side(spark, d, name).select(F.col("batch_id").alias("user_id"), "day") for name in ("gas", "thermal"))
    return gas.union(thermal).distinct()


_WIDE_SQL = f"""{GAS_SQL}, p AS (SELECT device, day,
  arg_min(value, event_id) FILTER (channel = 'ch4') AS ch4_value, arg_min(status, event_id) FILTER (channel = 'ch4') AS s1,
  arg_min(value, event_id) FILTER (channel = 'o2') AS o2_value, arg_min(status, event_id) FILTER (channel = 'o2') AS s2,
  arg_min(value, event_id) FILTER (channel = 'co') AS co_value, arg_min(status, event_id) FILTER (channel = 'co') AS s3,
  arg_min(value, event_id) FILTER (channel = 'h2s') AS h2s_value, arg_min(status, event_id) FILTER (channel = 'h2s') AS s4
FROM gas GROUP BY 1, 2),
m AS (SELECT *, list_filter([
  CASE WHEN s1 IS NULL THEN 'CH4缺少读数' WHEN s1 <> 'normal' THEN 'CH4状态：' || s1 END,
  CASE WHEN s2 IS NULL THEN 'O2缺少读数' WHEN s2 <> 'normal' THEN 'O2状态：' || s2 END,
  CASE WHEN s3 IS NULL THEN 'CO缺少读数' WHEN s3 <> 'normal' THEN 'CO状态：' || s3 END,
  CASE WHEN s4 IS NULL THEN 'H2S缺少读数' WHEN s4 <> 'normal' THEN 'H2S状态：' || s4 END], lambda x: x IS NOT NULL) AS msg FROM p)"""


@query(f"""WITH {_WIDE_SQL}
SELECT device, day, ch4_value, o2_value, co_value, h2s_value, CASE WHEN len(msg) = 0 THEN '正常' ELSE array_to_string(msg, '；') END AS status FROM m""")
def gas_wide(spark: SparkSession, d: str) -> DataFrame:
    readings = A.gas_long(spark, d).withColumn("error", F.lit(None).cast("string"))
    return S.gas_wide(readings, ["device", "day"], ["event_id"])


@query(f"""WITH {_WIDE_SQL}
SELECT CAST(day AS VARCHAR) AS day, CAST(day AS VARCHAR) || 'T00:00:00' AS c0_time, lpad(CAST(device AS VARCHAR), CAST(greatest(6, length(CAST(device AS VARCHAR))) AS INTEGER), '0') AS c1_number,
  CAST(ch4_value AS VARCHAR) AS c2_ch4, CAST(o2_value AS VARCHAR) AS c3_o2, CAST(co_value AS VARCHAR) AS c4_co, CAST(h2s_value AS VARCHAR) AS c5_h2s,
  CASE WHEN len(msg) = 0 THEN '正常' ELSE array_to_string(msg, '；') END AS c6_status FROM m""")
def gas_day_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the day files."""
    wide = gas_wide(spark, d).withColumn("ts", F.col("day").cast("timestamp")).withColumnRenamed("device", "sample_id")
    names = ("c0_time", "c1_number", "c2_ch4", "c3_o2", "c4_co", "c5_h2s", "c6_status")
    return sinks.gas_day_rows(wide).withColumnsRenamed(dict(zip(K.GAS_HEADER_ZH, names, strict=True)))


@query(f"""WITH {GAS_SQL}, p AS (SELECT device, day,
  arg_min(status, event_id) FILTER (channel = 'ch4') AS s1, arg_min(status, event_id) FILTER (channel = 'o2') AS s2,
  arg_min(status, event_id) FILTER (channel = 'co') AS s3, arg_min(status, event_id) FILTER (channel = 'h2s') AS s4 FROM gas GROUP BY 1, 2)
SELECT device, day, array_to_string(list_filter([CASE WHEN s1 <> 'normal' THEN 'ch4:' || s1 END, CASE WHEN s2 <> 'normal' THEN 'o2:' || s2 END,
  CASE WHEN s3 <> 'normal' THEN 'co:' || s3 END, CASE WHEN s4 <> 'normal' THEN 'h2s:' || s4 END,
  CASE WHEN device % 3 = 0 THEN 'thermal offline' END], lambda x: x IS NOT NULL), '|') AS errors FROM p""")
def sample_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = A.gas_long(spark, d).groupBy("device", "day").agg(*[
        F.min_by(F.when(F.col("channel") == c, F.col("status")), F.when(F.col("channel") == c, F.col("event_id"))).alias(c) for c in K.CHANNELS])
    reading = F.array(*[F.when(F.col(c) != "normal", F.concat(F.lit(f"{c}:"), F.col(c))) for c in K.CHANNELS])
    service = F.when(F.col("device") % 3 == 0, F.array(F.lit("thermal offline")))
    return rows.select("device", "day", F.array_join(S.sample_errors(reading, service), "|").alias("errors"))


# --- thermal frames -----------------------------------------------------------------------------------------------------

@query(f"""WITH {FRAMES_SQL} SELECT device, sample_id, list_min(t) AS t_min, list_max(t) AS t_max, round(list_sum(t) / 64, 6) AS t_mean,
  round(quantile_cont(x, 0.02), 6) AS t_low, round(quantile_cont(x, 0.98), 6) AS t_high
FROM (SELECT device, sample_id, t, unnest(t) AS x FROM frames) GROUP BY device, sample_id, t""")
def frame_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = S.frame_statistics(A.thermal_frames(spark, d), pixels=64)
    return out.select("device", "sample_id", "t_min", "t_max", *[F.round(c, 6).alias(c) for c in ("t_mean", "t_low", "t_high")])


@query(f"""WITH {FRAMES_SQL}, px AS (SELECT sample_id // 3 AS reading, unnest(range(64)) AS pixel, unnest(t) AS v FROM frames)
SELECT reading, CAST(pixel AS INTEGER) AS pixel, median(v) AS t FROM px GROUP BY 1, 2""")
def pixel_median(spark: SparkSession, d: str) -> DataFrame:
    frames = A.thermal_frames(spark, d).withColumn("reading", F.floor(F.col("sample_id") / 3))
    return S.pixel_median(frames, ["reading"])


@query(f"""WITH {FRAMES_SQL}, px AS (SELECT sample_id, unnest(range(64)) AS p, unnest(t) AS v FROM frames),
o AS (SELECT sample_id, p % 8 AS x, p // 8 AS y, v FROM px),
n AS (SELECT a.sample_id, a.x, a.y, median(b.v) AS m FROM o a JOIN o b ON a.sample_id = b.sample_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3)
SELECT sample_id, CAST(y * 8 + x AS INTEGER) AS pixel, m AS t FROM n""")
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    out = S.smooth_frames(A.thermal_frames(spark, d), 8, 8)
    return out.select("sample_id", F.posexplode("smoothed").alias("pixel", "t"))


_BOUNDS_SQL = f"""{FRAMES_SQL},
q AS (SELECT device, sample_id, quantile_cont(x, 0.02) AS a, quantile_cont(x, 0.98) AS b
  FROM (SELECT device, sample_id, unnest(t) AS x FROM frames) GROUP BY 1, 2),
target AS (SELECT device, sample_id, CASE WHEN b - a < 2 THEN (a + b) / 2 - 1 ELSE a END AS low, CASE WHEN b - a < 2 THEN (a + b) / 2 + 1 ELSE b END AS high,
  row_number() OVER (PARTITION BY device ORDER BY sample_id) AS k FROM q)"""


@query(f"""WITH RECURSIVE {_BOUNDS_SQL},
run AS (SELECT device, sample_id, k, low AS l, high AS h FROM target WHERE k = 1
  UNION ALL SELECT t.device, t.sample_id, t.k, CASE WHEN t.low < r.l THEN t.low ELSE r.l * 0.75 + t.low * 0.25 END,
    CASE WHEN t.high > r.h THEN t.high ELSE r.h * 0.75 + t.high * 0.25 END
  FROM run r JOIN target t ON t.device = r.device AND t.k = r.k + 1)
SELECT device, sample_id, round(l, 8) AS display_low, round(h, 8) AS display_high FROM run""")
def display_bounds(spark: SparkSession, d: str) -> DataFrame:
    frames = A.thermal_frames(spark, d).withColumn("_b", T.display_target(F.col("temperatures"))).select(
        "device", "sample_id", F.col("_b.low").alias("low"), F.col("_b.high").alias("high"))
    out = S.display_bounds(frames, "device", "sample_id", "low", "high")
    return out.select("device", "sample_id", F.round("display_low", 8).alias("display_low"), F.round("display_high", 8).alias("display_high"))


@query("""WITH g AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, user_id, CAST(coalesce(ceil(greatest(s - p - 3600, 0) / 3600), 0) AS BIGINT) AS missed_slots FROM g""")
def missed_slots(spark: SparkSession, d: str) -> DataFrame:
    out = S.missed_slots(A.table(spark, d, "events"), ["user_id"], "ts", ["event_id"], 3600.0)
    return out.select("event_id", "user_id", "missed_slots")


# --- photo scans --------------------------------------------------------------------------------------------------------------

_PATH_SQL = """p AS (SELECT user_id AS batch_id, event_id, CASE event_type
   WHEN 'view' THEN 'run' || user_id % 7 || '/' || event_id % 50 || '/metadata.json'
   WHEN 'click' THEN 'flat/color_' || strftime(ts, '%Y%m%d_%H%M%S') || '_000000.jpg'
   WHEN 'purchase' THEN '.trash/' || event_id || '/metadata.json'
   WHEN 'signup' THEN 'run/color_' || event_id || '.jpg' ELSE 'run/readme.txt' END AS rel FROM events)"""


def _visible(spark: SparkSession, d: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    rel = (
        F.when(kind == "view", F.concat(F.lit("run"), (F.col("user_id") % 7).cast("string"), F.lit("/"), (n % 50).cast("string"), F.lit("/metadata.json")))
        .when(kind == "click", F.concat(F.lit("flat/color_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_000000.jpg")))
        .when(kind == "purchase", F.concat(F.lit(".trash/"), n.cast("string"), F.lit("/metadata.json")))
        .when(kind == "signup", F.concat(F.lit("run/color_"), n.cast("string"), F.lit(".jpg"))).otherwise("run/readme.txt"))
    return A.table(spark, d, "events").select(F.col("user_id").alias("batch_id"), "event_id", "event_type", rel.alias("relative_path"))


@query(f"""WITH {_PATH_SQL} SELECT DISTINCT batch_id, CASE WHEN rel LIKE '%/metadata.json' THEN replace(rel, '/metadata.json', '') ELSE rel END AS item
FROM p WHERE rel NOT LIKE '.trash%' AND (rel LIKE '%/metadata.json' OR rel LIKE 'flat/%')""")
def visible_items(spark: SparkSession, d: str) -> DataFrame:
    return SRC.visible_items(_visible(spark, d))


@query(f"""WITH {_PATH_SQL} SELECT batch_id, rel AS relative_path, replace(replace(rel, 'flat/', ''), '.jpg', '') AS capture_id,
  substr(rel, 12, 4) || '-' || substr(rel, 16, 2) || '-' || substr(rel, 18, 2) || 'T' || substr(rel, 21, 2) || ':' || substr(rel, 23, 2) || ':' || substr(rel, 25, 2) || '+08:00' AS capture_time,
  '' AS station_id FROM p WHERE rel LIKE 'flat/%'""")
def flat_photos(spark: SparkSession, d: str) -> DataFrame:
    out = SRC.load_photos(_visible(spark, d))
    return out.where("error IS NULL").select("batch_id", "relative_path", "capture_id", "capture_time", "station_id")


@query("""SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 5 = 0 THEN 'offline visible package must declare exactly 3 images'
  WHEN o_custkey % 5 = 1 THEN 'image path escapes its root' WHEN o_custkey % 5 = 2 THEN 'queued image not found: 2.jpg'
  WHEN o_custkey % 5 = 3 THEN 'uploaded image is empty' END AS error FROM orders""")
def package_check(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey") % 5
    o = A.table(spark, d, "orders")
    names = F.when(c == 0, F.array(F.lit("0.jpg"))).when(c == 1, F.array(F.lit("0.jpg"), F.lit("../1.jpg"), F.lit("2.jpg"))).otherwise(
        F.array(F.lit("0.jpg"), F.lit("1.jpg"), F.lit("2.jpg")))
    meta = F.to_json(F.struct(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("capture_id"), F.lit("2026-08-04T15:30:05Z").alias("capture_time"),
        F.lit("8").alias("station_id"), names.alias("images")))
    base = o.select((F.col("o_orderkey") % 97).alias("batch_id"), F.concat(F.lit("visible/"), F.col("o_orderkey").cast("string")).alias("relative_path"),
                    meta.alias("metadata_json"), c.alias("c"), F.col("o_orderkey").alias("row_id"))
    files = base.select("batch_id", "relative_path", "c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).where(
        ~((F.col("c") == 2) & (F.col("i") == 2))).select(
        "batch_id", F.concat_ws("/", "relative_path", F.concat(F.col("i").cast("string"), F.lit(".jpg"))).alias("relative_path"),
        F.when((F.col("c") == 3) & (F.col("i") == 1), "uploaded image is empty").alias("image_error"))
    return SRC.load_packages(base.drop("c"), files).select("row_id", "error")
