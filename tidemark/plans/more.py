"""Queries of day tables, cross-checks, profiles and samples."""

from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import ingest as I
from ..operators import score as M
from ..operators import spatial as S
from ..operators import temporal as T
from .adapter import ACT, CUT, POS, actions, cutoffs, events, positions
from .domain import AT, MAP, _at, _entities
from .series import EDGE, HAV

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _raw(spark, sf):
    e = F.col("event_id")
    return events(spark, sf).select(
        F.when(e % 50 == 0, "no date").when(e % 2 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(e % 40 == 0, "Base Station").otherwise("Class A").alias("mobile_type"), F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("mmsi"), F.when(e % 60 == 0, "x").otherwise((F.lit(50) + e % 10).cast("string")).alias("lat"),
        (F.lit(10) + e % 7).cast("string").alias("lon"), F.when(F.col("user_id") % 3 == 0, "Tanker").when(F.col("user_id") % 3 == 1, "Cargo").otherwise("").alias("ship_type"), F.when(F.col("event_type") == "error", "DG cargo").alias("cargo_type"),
        F.when(F.col("user_id") % 5 == 0, "80").otherwise("150").alias("length"), F.when(e % 3 == 0, " ").otherwise("name").alias("name"),
    )


RAW = """raw AS (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE date_trunc('second', ts) END AS observed_at, CASE WHEN event_id % 40 = 0 THEN 'base station' ELSE 'class a' END AS mobile_type, user_id AS mmsi,
  CASE WHEN event_id % 60 = 0 THEN NULL ELSE CAST(50 + event_id % 10 AS DOUBLE) END AS lat, CAST(10 + event_id % 7 AS DOUBLE) AS lon, CASE user_id % 3 WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Cargo' END AS ship_type,
  CASE WHEN event_type = 'error' THEN 'DG cargo' END AS cargo_type, CASE WHEN user_id % 5 = 0 THEN 80.0::DOUBLE ELSE 150 END AS length, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'name' END AS name FROM events),
ddp AS (SELECT DISTINCT * FROM raw)"""


@query(f"WITH {RAW} SELECT count(*) AS n, count(observed_at) AS n_time, count(lat) AS n_lat, count(name) AS n_name, count(ship_type) AS n_type, (SELECT count(*) FROM ddp) AS n_distinct FROM raw")
def typed_raw(spark, sf):
    t = I.typed(_raw(spark, sf))
    counts = t.agg(F.count("*").alias("n"), F.count("observed_at").alias("n_time"), F.count("lat").alias("n_lat"), F.count("name").alias("n_name"), F.count("ship_type").alias("n_type"))
    return counts.join(F.broadcast(I.flagged(t).agg(F.count("*").alias("n_distinct"))))


@query(f"""WITH {RAW}, v AS (SELECT mmsi, CAST(observed_at AS DATE) AS day, count(*) AS n_rows, count(lat) AS n_pos_ok, count(*) - count(lat) AS n_bad_positions,
  bool_or(coalesce(contains(lower(ship_type), 'tanker') OR (contains(lower(ship_type), 'cargo') AND contains(lower(cargo_type), 'dg')), false)) AS carrier_row, min(length) AS length FROM ddp
  WHERE mobile_type <> 'base station' AND observed_at IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, carrier_row AND length >= 100 AS carrier_today FROM v)
SELECT mmsi, day, n_rows, n_pos_ok, n_bad_positions, length, carrier_today, carrier_today OR coalesce((SELECT min(day) FROM c f WHERE f.mmsi = c.mmsi AND f.carrier_today) < day, false) AS kept FROM c""")
def vessel_day(spark, sf):
    out = I.kept(I.profile(I.flagged(I.typed(_raw(spark, sf)))))
    return out.select("mmsi", "day", "n_rows", "n_pos_ok", "n_bad_positions", "length", "carrier_today", "kept")


@query(f"""WITH {POS}, {MAP}, s AS (SELECT p.event_id, p.day, e.method FROM pos p ASOF LEFT JOIN ent e ON p.mmsi = e.mmsi AND p.day >= e.effective_from)
SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE method = 'vote') AS n_vote, round(count(*) FILTER (WHERE method = 'vote') / count(*)::DOUBLE, 6) AS share FROM s GROUP BY 1""")
def coverage(spark, sf):
    return K.coverage(positions(spark, sf).select("mmsi", "day"), _entities(spark, sf))


@query(f"""WITH {POS}, {MAP}, {CUT}, {AT}, c AS (SELECT DISTINCT number, mmsi FROM pos WHERE number IS NOT NULL)
SELECT cutoff, number, count(DISTINCT entity) AS n_entities, count(DISTINCT mmsi) AS n_mmsi FROM atc JOIN c USING (mmsi) GROUP BY 1, 2 HAVING count(DISTINCT entity) > 1""")
def fragmentation(spark, sf):
    return K.fragmentation(positions(spark, sf), _at(spark, sf))


@query(f"""WITH {ACT}, a AS (SELECT id, min(date) AS da FROM act WHERE source = 'A' GROUP BY id), b AS (SELECT id, min(date) AS db FROM act WHERE source = 'B' GROUP BY id)
SELECT count(*) AS n_both, count(*) FILTER (WHERE abs(datediff('day', db, da)) <= 3) AS n_agree, max(abs(datediff('day', db, da))) AS most_days FROM a JOIN b USING (id)""")
def date_agreement(spark, sf):
    a = actions(spark, sf)
    return K.date_agreement(a.where("source = 'A'"), a.where("source = 'B'"), 3)


@query("""WITH a AS (SELECT l_orderkey % 1000 AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey % 1000 AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'A')
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def differences(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    pick = lambda f: li.where(F.col("l_returnflag") == f).select((F.col("l_orderkey") % 1000).alias("k"), F.col("l_linenumber").alias("n"))
    return K.differences(pick("R"), pick("A"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('sample|' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark, sf):
    return K.sample(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey", 100)


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('sample|' || o_orderkey), o_orderkey) AS n FROM orders) WHERE n <= 20")
def stratified_sample(spark, sf):
    return K.stratified_sample(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 20)


@query(f"""WITH {POS} SELECT event_id, mmsi, nav_status, flag, previous_nav_status, previous_flag FROM (SELECT *, lag(nav_status) OVER w AS previous_nav_status, lag(flag) OVER w AS previous_flag FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY observed_at, event_id))
WHERE nav_status <> previous_nav_status OR flag <> previous_flag""")
def type_changes(spark, sf):
    p = positions(spark, sf).select("event_id", "mmsi", "observed_at", "nav_status", "flag")
    return K.attribute_changes(p, "mmsi", ["observed_at", "event_id"], ["nav_status", "flag"]).drop("observed_at")


@query(f"""WITH {POS}, {EDGE}, g AS (SELECT event_id, lat, lon FROM (SELECT *, lead(observed_at) OVER (PARTITION BY mmsi ORDER BY observed_at, event_id) AS nxt FROM pos) WHERE epoch_us(nxt) - epoch_us(observed_at) > 86400000000),
t AS (SELECT x * 0.01::DOUBLE AS lat, y * 0.01::DOUBLE AS lon FROM edg), d AS (SELECT event_id, min({HAV.format(lat1='g.lat', lon1='g.lon', lat2='t.lat', lon2='t.lon')}) AS km FROM g, t GROUP BY event_id)
SELECT count(*) AS n, count(*) FILTER (WHERE km <= 1) AS n_edge, count(*) FILTER (WHERE km <= 1) >= 0.5 * count(*) AS at_edge FROM d""")
def gap_evidence(spark, sf):
    from pyspark.sql import Window

    p = positions(spark, sf)
    w = Window.partitionBy("mmsi").orderBy("observed_at", "event_id")
    gaps = p.withColumn("nxt", F.lead("observed_at").over(w)).where(F.unix_micros(F.col("nxt").cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp")) > 86_400_000_000)
    edge = S.edge_cells(p, 0.01).select((F.col("x") * F.lit(0.01)).alias("lat"), (F.col("y") * F.lit(0.01)).alias("lon"))
    near = S.nearest(gaps.select("event_id", "lat", "lon"), edge, 1.0, "event_id")
    return K.gap_verdict(near.select(F.col("nearest_km").isNotNull().alias("near_edge")))


@query("SELECT toxic, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS rate FROM labels GROUP BY toxic")
def verdict_rates(spark, sf):
    return K.rates(spark.read.parquet(f"{sf}/labels.parquet").withColumn("good", F.col("quality") == 1), ["toxic"], "good")


@query(f"WITH {CUT} SELECT a.cutoff, b.cutoff AS past FROM cut a JOIN cut b ON b.cutoff + 5 <= a.cutoff")
def usable_history(spark, sf):
    return M.usable_history(cutoffs(spark), 5)


@query(f"""WITH {POS}, s AS (SELECT *, sum(new) OVER (PARTITION BY mmsi ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM (
  SELECT *, CASE WHEN epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER (PARTITION BY mmsi ORDER BY observed_at, event_id) <= 21600000000 THEN 0 ELSE 1 END AS new FROM pos))
SELECT mmsi, count(DISTINCT seg) AS n_segments, count(*) AS n FROM s WHERE observed_at <= TIMESTAMP '2024-01-15 23:59:59' GROUP BY mmsi""")
def segments_as_of(spark, sf):
    p = positions(spark, sf).where("observed_at <= timestamp_ntz'2024-01-15 23:59:59'")
    return T.sessionize(p, "mmsi", "observed_at", "event_id", 6 * 3600.0).groupBy("mmsi").agg(F.count_distinct("session").alias("n_segments"), F.count("*").alias("n"))
