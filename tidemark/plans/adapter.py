"""The driver's `events` as messages of moving entities, in Spark and in SQL alike."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFFS = ("2024-01-10", "2024-01-15", "2024-01-20")
LOOKBACK, HORIZON = 7, 7

#: Common table expressions that the SQL of queries begins with.
POS = """pos AS (
  SELECT event_id, user_id AS mmsi, ts AS observed_at, CAST(ts AS DATE) AS day, event_type AS nav_status, value AS sog,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CAST(55 AS DOUBLE) + (event_id % 97) * CAST(0.001 AS DOUBLE) AS lat, CAST(10 AS DOUBLE) + (event_id % 89) * CAST(0.001 AS DOUBLE) AS lon,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 9000000 + user_id // 2 * 10 + event_id % 2 END AS number,
         CAST(50 + user_id % 7 * 25 AS DOUBLE) AS length, CAST(10 + user_id % 3 AS DOUBLE) AS width,
         CASE event_id % 4 WHEN 0 THEN ' alpha ' WHEN 1 THEN 'Beta' WHEN 2 THEN 'unknown' END AS name,
         CASE event_id % 5 WHEN 0 THEN 'PA' WHEN 1 THEN 'LR' WHEN 2 THEN 'DK' END AS flag
  FROM events)"""
CUT = "cut AS (SELECT unnest([" + ", ".join(f"DATE '{c}'" for c in CUTOFFS) + "]) AS cutoff)"
ACT = """act AS (
  SELECT user_id AS id, CAST(ts AS DATE) AS date, CASE event_type WHEN 'signup' THEN 'add' ELSE 'remove' END AS action,
         CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS source
  FROM events WHERE event_type IN ('signup', 'error'))"""


def events(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def positions(spark, sf: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf).select(
        e, F.col("user_id").alias("mmsi"), F.col("ts").cast("timestamp_ntz").alias("observed_at"), F.to_date("ts").alias("day"), F.col("event_type").alias("nav_status"), F.col("value").alias("sog"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        (F.lit(55.0) + (e % 97) * F.lit(0.001)).alias("lat"), (F.lit(10.0) + (e % 89) * F.lit(0.001)).alias("lon"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit(9000000) + F.floor(F.col("user_id") / 2) * 10 + e % 2).alias("number"),
        (F.lit(50) + F.col("user_id") % 7 * 25).cast("double").alias("length"), (F.lit(10) + F.col("user_id") % 3).cast("double").alias("width"),
        F.when(e % 4 == 0, " alpha ").when(e % 4 == 1, "Beta").when(e % 4 == 2, "unknown").alias("name"),
        F.when(e % 5 == 0, "PA").when(e % 5 == 1, "LR").when(e % 5 == 2, "DK").alias("flag"),
    )


def cutoffs(spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CUTOFFS], "c string").select(F.to_date("c").alias("cutoff"))


def actions(spark, sf: str) -> DataFrame:
    e = events(spark, sf).where(F.col("event_type").isin("signup", "error"))
    source = F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "B").otherwise("C")
    return e.select(F.col("user_id").alias("id"), F.to_date("ts").alias("date"), F.when(F.col("event_type") == "signup", "add").otherwise("remove").alias("action"), source.alias("source"))
