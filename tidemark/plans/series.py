"""Queries of the temporal, spatial and detector operators."""

from pyspark.sql import functions as F

from ..functions import cell, names_port, round_positive
from ..operators import detect as D
from ..operators import ingest as I
from ..operators import spatial as S
from ..operators import temporal as T
from ..operators.meetings import pair_runs
from .adapter import POS, cutoffs, events, positions

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SESSIONS = """ses AS (SELECT *, sum(new) OVER (PARTITION BY mmsi ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, CASE WHEN epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER (PARTITION BY mmsi ORDER BY observed_at, event_id) <= 43200000000 THEN 0 ELSE 1 END AS new FROM pos))"""


@query(f"""WITH {POS}, {SESSIONS}
SELECT mmsi, CAST(session AS BIGINT) AS session, min(observed_at) AS start_at, max(observed_at) AS end_at, count(*) AS n, round(sum(sog), 2) AS sum_sog FROM ses GROUP BY mmsi, session""")
def sessionize(spark, sf):
    s = T.sessionize(positions(spark, sf), "mmsi", "observed_at", "event_id", 12 * 3600.0)
    return s.groupBy("mmsi", "session").agg(F.min("observed_at").alias("start_at"), F.max("observed_at").alias("end_at"), F.count("*").alias("n"), F.round(F.sum("sog"), 2).alias("sum_sog"))


@query(f"""WITH {POS} SELECT event_id, mmsi, nav_status, day FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi, nav_status, day ORDER BY observed_at, event_id) AS n FROM pos) WHERE n = 1""")
def dedup_events(spark, sf):
    return T.dedup(positions(spark, sf), ["mmsi", "nav_status", "day"], ["observed_at", "event_id"]).select("event_id", "mmsi", "nav_status", "day")


@query(f"""WITH {POS}, b AS (SELECT *, CASE WHEN sog < 50 THEN 3600 ELSE 7200 END AS len FROM pos)
SELECT event_id, mmsi FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, len, floor(epoch_us(observed_at) / 1e6::DOUBLE / len) ORDER BY observed_at, event_id) AS n FROM b) WHERE n = 1""")
def downsample(spark, sf):
    return T.downsample(positions(spark, sf), "mmsi", "observed_at", "sog", "event_id", limit=50.0, slow=3600, fast=7200).select("event_id", "mmsi")


@query(f"""WITH {POS}, l AS (SELECT *, row_number() OVER w AS n, lag(nav_status) OVER w AS a, lag(flag) OVER w AS b FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY observed_at, event_id))
SELECT event_id, mmsi, nav_status, flag FROM l WHERE n = 1 OR nav_status IS DISTINCT FROM a OR flag IS DISTINCT FROM b""")
def change_points(spark, sf):
    return T.change_points(positions(spark, sf), "mmsi", ["observed_at", "event_id"], ["nav_status", "flag"]).select("event_id", "mmsi", "nav_status", "flag")


@query(f"""WITH {POS} SELECT * FROM (SELECT mmsi, observed_at AS gap_start, lead(observed_at) OVER w AS gap_end,
  round((epoch_us(lead(observed_at) OVER w) - epoch_us(observed_at)) / 3.6e9::DOUBLE, 6) AS gap_hours FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY observed_at, event_id)) WHERE gap_hours > 24""")
def gap_lead(spark, sf):
    return T.gaps(positions(spark, sf), "mmsi", "observed_at", "event_id", 24.0).withColumn("gap_hours", F.round("gap_hours", 6))


HAV = "2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
MOVED = f"""mov AS (SELECT *, {HAV.format(lat1='plat', lon1='plon', lat2='lat', lon2='lon')} AS dist_km, (epoch_us(observed_at) - pus) / 1e6::DOUBLE AS dt_s FROM (
  SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(epoch_us(observed_at)) OVER w AS pus FROM pos WINDOW w AS (PARTITION BY mmsi, day ORDER BY observed_at, event_id))),
jmp AS (SELECT *, coalesce(dist_km > 1 AND (dt_s <= 0 OR dist_km / 1.852::DOUBLE / (dt_s / 3600) > 1), false) AS jumped,
  CAST(floor(lat / 0.05::DOUBLE) AS BIGINT) || '_' || CAST(floor(lon / 0.05::DOUBLE) AS BIGINT) AS cell FROM mov)"""


def _moved(spark, sf):
    rows = positions(spark, sf).withColumns({"pos_ok": F.lit(True), "is_vessel": F.lit(True)})
    return I.jumps(rows, "event_id", size=0.05, min_km=1.0, max_kn=1.0)


@query(f"WITH {POS}, {MOVED} SELECT event_id, mmsi, round(dist_km, 6) AS dist_km, jumped, cell FROM jmp")
def jump_flags(spark, sf):
    return _moved(spark, sf).select("event_id", "mmsi", F.round("dist_km", 6).alias("dist_km"), "jumped", "cell")


BASE = "base AS (SELECT day, cell, count(DISTINCT mmsi) AS n_vessels, count(DISTINCT CASE WHEN jumped THEN mmsi END) AS n_jumped, round(count(DISTINCT CASE WHEN jumped THEN mmsi END) / count(DISTINCT mmsi)::DOUBLE, 6) AS share FROM jmp GROUP BY day, cell)"


@query(f"WITH {POS}, {MOVED}, {BASE} SELECT * FROM base")
def cell_baseline(spark, sf):
    return I.jump_baseline(_moved(spark, sf))


@query(f"WITH {POS}, {MOVED} SELECT mmsi, day, cell, count(*) AS n_rows, count(*) FILTER (WHERE jumped) AS n_jumps FROM jmp GROUP BY mmsi, day, cell")
def artifacts_cells(spark, sf):
    return I.artifacts(_moved(spark, sf)).select("mmsi", "day", F.explode("cells").alias("c")).select("mmsi", "day", "c.*")


@query(f"""WITH {POS}, {MOVED}, {BASE}, e AS (SELECT mmsi, day, cell, count(*) AS r, count(*) FILTER (WHERE jumped) AS j FROM jmp GROUP BY mmsi, day, cell),
x AS (SELECT e.mmsi, e.day, CAST(sum(j) AS BIGINT) AS n_jumps, round(CAST(CAST(sum(r * coalesce(CAST(share AS DECIMAL(20,12)), 0)) AS DOUBLE) / sum(r) AS DECIMAL(20,12)), 6) AS expected, count(*) AS n_cells FROM e LEFT JOIN base USING (cell, day) GROUP BY e.mmsi, e.day)
SELECT mmsi, day, n_jumps, CAST(expected AS DOUBLE) AS expected, CAST(CASE WHEN n_jumps > 0 THEN 1 ELSE 0 END - expected AS DOUBLE) AS excess, n_cells FROM x""")
def incidence_excess(spark, sf):
    moved = _moved(spark, sf)
    return D.excess_incidence(I.artifacts(moved), I.jump_baseline(moved))


@query(f"""WITH {POS}, c AS (SELECT mmsi, nav_status, count(*) AS n FROM pos GROUP BY mmsi, nav_status),
m AS (SELECT mmsi, nav_status AS modal_status, row_number() OVER (PARTITION BY mmsi ORDER BY n DESC, nav_status) AS r FROM c)
SELECT m.mmsi, modal_status, (SELECT count(*) FROM pos p WHERE p.mmsi = m.mmsi) AS n, (SELECT bool_or(nav_status = 'error') FROM pos p WHERE p.mmsi = m.mmsi) AS any_error FROM m WHERE r = 1""")
def profile_mode(spark, sf):
    return positions(spark, sf).groupBy("mmsi").agg(F.mode("nav_status", True).alias("modal_status"), F.count("*").alias("n"), F.bool_or(F.col("nav_status") == "error").alias("any_error"))


@query(f"""WITH {POS}, d AS (SELECT mmsi, nav_status, day, min(observed_at) AS since FROM pos GROUP BY mmsi, nav_status, day)
SELECT mmsi, nav_status, since FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, nav_status ORDER BY day) AS n FROM d) WHERE n = 3""")
def established_nth(spark, sf):
    return T.established(positions(spark, sf), ["mmsi", "nav_status"], "observed_at", 3)


@query(f"""WITH {POS} SELECT event_id, last_value(flag IGNORE NULLS) OVER w AS flag, last_value(number IGNORE NULLS) OVER w AS number
FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING)""")
def fill_forward(spark, sf):
    return T.fill_forward(positions(spark, sf), "mmsi", ["observed_at", "event_id"], ["flag", "number"]).select("event_id", "flag", "number")


@query(f"""WITH {POS}, r AS (SELECT * FROM (SELECT *, lag(flag) OVER (PARTITION BY mmsi ORDER BY observed_at, event_id) AS p FROM pos WHERE flag IS NOT NULL) WHERE p IS NULL OR p <> flag)
SELECT event_id, mmsi, flag, CASE WHEN lag(flag) OVER w IS NULL THEN 'first' WHEN flag = lag(flag, 2) OVER w THEN 'flip_back' ELSE 'change' END AS kind FROM r WINDOW w AS (PARTITION BY mmsi ORDER BY observed_at, event_id)""")
def flip_back(spark, sf):
    order = ["observed_at", "event_id"]
    runs = T.change_points(positions(spark, sf).where("flag is not null"), "mmsi", order, ["flag"])
    return T.flip_backs(runs, "mmsi", order, "flag").select("event_id", "mmsi", "flag", "kind")


@query(f"""WITH {POS} SELECT l.event_id, l.mmsi, r.flag AS flag_in_force, r.event_id AS flag_event
FROM (SELECT * FROM pos WHERE nav_status = 'view') l ASOF LEFT JOIN (SELECT * FROM pos WHERE nav_status = 'purchase') r ON l.mmsi = r.mmsi AND l.observed_at >= r.observed_at""")
def asof_left(spark, sf):
    p = positions(spark, sf)
    right = p.where("nav_status = 'purchase'").select("mmsi", F.col("observed_at").alias("t"), F.col("flag").alias("flag_in_force"), F.col("event_id").alias("flag_event"))
    return T.asof_left(p.where("nav_status = 'view'").select("event_id", "mmsi", "observed_at"), right, "mmsi", "observed_at", "t", ["flag_in_force", "flag_event"], "flag_event").drop("observed_at")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders), x AS (
  SELECT a.o_orderkey, b.o_orderkey AS previous, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) AS n
  FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderdate <= a.o_orderdate - INTERVAL 30 DAY)
SELECT o_orderkey, previous FROM x WHERE n = 1""")
def orders_month_before(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    left = o.select("o_orderkey", "o_custkey", (F.col("o_orderdate") - F.expr("interval 30 days")).alias("t"))
    right = o.select("o_custkey", F.col("o_orderdate").alias("s"), F.col("o_orderkey").alias("previous"))
    return T.asof_left(left, right, "o_custkey", "t", "s", ["previous"], "previous").select("o_orderkey", "previous")


PAIRS = f"""ppm AS (SELECT mmsi, time_bucket(INTERVAL 1 HOUR, observed_at) AS slot, avg(lat) AS lat, avg(lon) AS lon FROM pos GROUP BY 1, 2),
prs AS (SELECT * FROM (SELECT a.mmsi AS a, b.mmsi AS b, a.slot, 1000 * {HAV.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')} AS distance_m FROM ppm a JOIN ppm b ON a.slot = b.slot AND a.mmsi < b.mmsi) WHERE distance_m < 1000)"""


def _slots(spark, sf):
    slot = F.date_trunc("hour", "observed_at").cast("timestamp_ntz")
    return positions(spark, sf).groupBy("mmsi", slot.alias("slot")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


@query(f"WITH {POS}, {PAIRS} SELECT a, b, slot, round(distance_m, 4) AS distance_m FROM prs")
def pair_join(spark, sf):
    return S.pair_join(_slots(spark, sf), "mmsi", "slot", 1000.0, places=False).select("a", "b", "slot", round_positive("distance_m", 4).alias("distance_m"))


@query(f"""WITH {POS}, {PAIRS}, n AS (SELECT *, CASE WHEN epoch_us(slot) - lag(epoch_us(slot)) OVER (PARTITION BY a, b ORDER BY slot) <= 604800000000 THEN 0 ELSE 1 END AS new FROM prs),
s AS (SELECT *, sum(new) OVER (PARTITION BY a, b ORDER BY slot ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT a, b, min(slot) AS start_at, max(slot) AS end_at, count(*) AS n FROM s GROUP BY a, b, session HAVING count(*) >= 2""")
def pair_sessions(spark, sf):
    return pair_runs(_slots(spark, sf), "mmsi", "slot", 1000.0, 7 * 86400.0, least=2).withColumnsRenamed({"start": "start_at", "end": "end_at"})


@query(f"""WITH {POS}, m AS (SELECT mmsi, date_trunc('minute', observed_at) AS minute, avg(lat) AS lat, avg(lon) AS lon FROM pos WHERE sog < 100 GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN epoch_us(minute) - lag(epoch_us(minute)) OVER (PARTITION BY mmsi ORDER BY minute) <= 43200000000 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY mmsi ORDER BY minute ROWS UNBOUNDED PRECEDING) AS session FROM n),
g AS (SELECT mmsi, min(minute) AS start_at, max(minute) AS end_at, round((epoch_us(max(minute)) - epoch_us(min(minute))) / 3.6e9::DOUBLE, 6) AS hours, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM s GROUP BY mmsi, session)
SELECT * FROM g WHERE hours >= 24""")
def loitering(spark, sf):
    return D.loitering(positions(spark, sf), max_kn=100.0, min_hours=24.0, tolerance_min=720).withColumnsRenamed({"start": "start_at", "end": "end_at"})


CHANGES = f"""red AS (SELECT mmsi, observed_at, min(sog) AS value FROM pos WHERE nav_status = 'click' GROUP BY 1, 2 HAVING min(sog) = max(sog)),
chg AS (SELECT * FROM (SELECT mmsi, lag(observed_at) OVER w AS from_ts, observed_at AS to_ts, lag(value) OVER w AS previous, value, value - lag(value) OVER w AS delta FROM red WINDOW w AS (PARTITION BY mmsi ORDER BY observed_at)) WHERE abs(delta) >= 50),
mee AS (SELECT mmsi AS a, 1 + mmsi % 150 AS b, observed_at AS s, observed_at + INTERVAL 2 HOUR AS e FROM pos WHERE nav_status = 'view')"""


@query(f"""WITH {POS}, {CHANGES} SELECT mmsi, from_ts, to_ts, previous, value, round(delta, 6) AS delta,
  EXISTS (SELECT 1 FROM pos p WHERE p.nav_status = 'error' AND p.mmsi = chg.mmsi AND p.observed_at > from_ts AND p.observed_at < to_ts) AS moored_between,
  EXISTS (SELECT 1 FROM mee WHERE (mee.a = chg.mmsi OR mee.b = chg.mmsi) AND mee.e > from_ts AND mee.s < to_ts) AS met_between FROM chg""")
def value_changes(spark, sf):
    p = positions(spark, sf)
    meet = p.where("nav_status = 'view'").select(F.col("mmsi").alias("a"), (1 + F.col("mmsi") % 150).alias("b"), F.col("observed_at").alias("start"), (F.col("observed_at") + F.expr("interval 2 hours")).alias("end"))
    return D.value_changes(p.where("nav_status = 'click'").select("mmsi", "observed_at", F.col("sog").alias("value")), p.where("nav_status = 'error'"), meet, least=50.0)


@query(f"""WITH {POS}, d AS (SELECT mmsi, number, day, min(observed_at) AS t FROM pos WHERE number IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT mmsi, number, t FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, number ORDER BY day) AS n FROM d) WHERE n = 5)
SELECT * FROM (SELECT mmsi, t AS observed_at, lag(number) OVER (PARTITION BY mmsi ORDER BY t, number) AS old_value, number AS new_value FROM e) WHERE old_value IS NOT NULL""")
def churn(spark, sf):
    return D.churn(positions(spark, sf), "number", min_days=5)


@query(f"""WITH {POS} SELECT CAST(floor(lat / 0.01::DOUBLE) AS BIGINT) AS x, CAST(floor(lon / 0.01::DOUBLE) AS BIGINT) AS y, count(*) AS n, round(sum(sog), 6) AS hours FROM pos GROUP BY 1, 2 ORDER BY hours DESC, x, y LIMIT 20""")
def by_cell(spark, sf):
    return D.by_cell(positions(spark, sf), "sog", size=0.01)


EDGE = """cel AS (SELECT DISTINCT CAST(floor(lat / 0.01::DOUBLE) AS BIGINT) AS x, CAST(floor(lon / 0.01::DOUBLE) AS BIGINT) AS y FROM pos),
edg AS (SELECT * FROM (SELECT x, y, (SELECT count(*) FROM cel o WHERE abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1) - 1 AS n_around FROM cel c) WHERE n_around < 8)"""


@query(f"WITH {POS}, {EDGE} SELECT * FROM edg")
def edge_cells(spark, sf):
    return S.edge_cells(positions(spark, sf), 0.01)


@query(f"""WITH {POS}, {EDGE}, t AS (SELECT x * 0.01::DOUBLE AS lat, y * 0.01::DOUBLE AS lon FROM edg)
SELECT event_id, round(min(d) FILTER (WHERE d <= 1.5), 6) AS nearest_km FROM (SELECT event_id, {HAV.format(lat1='p.lat', lon1='p.lon', lat2='t.lat', lon2='t.lon')} AS d FROM pos p, t) GROUP BY event_id""")
def nearest_edge(spark, sf):
    p = positions(spark, sf)
    edge = S.edge_cells(p, 0.01).select((F.col("x") * F.lit(0.01)).alias("lat"), (F.col("y") * F.lit(0.01)).alias("lon"))
    return S.nearest(p.select("event_id", "lat", "lon"), edge, 1.5, "event_id").withColumn("nearest_km", F.round("nearest_km", 6))


@query(f"""WITH {POS} SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, count(DISTINCT mmsi) AS n_vessels, count(DISTINCT CASE WHEN nav_status = 'error' THEN mmsi END) AS n_error,
round(quantile_cont(sog, 0.5), 6) AS median_sog FROM pos GROUP BY 1""")
def monthly_counts(spark, sf):
    p = positions(spark, sf).groupBy(F.date_format("day", "yyyy-MM").alias("month"))
    return p.agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("n_vessels"), F.count_distinct(F.when(F.col("nav_status") == "error", F.col("mmsi"))).alias("n_error"), F.round(F.percentile("sog", 0.5), 6).alias("median_sog"))


@query(f"""WITH {POS} SELECT nav_status AS value, count(*) AS n FROM pos GROUP BY 1 ORDER BY n DESC, value LIMIT 20""")
def frequencies(spark, sf):
    return I.frequencies(positions(spark, sf), "nav_status")


@query("""SELECT CAST(d AS DATE) AS cutoff, CAST((SELECT min(m) FROM (SELECT last_day(x) AS m FROM unnest(generate_series(DATE '2023-01-01', DATE '2025-12-31', INTERVAL 1 MONTH)) t(x)) WHERE m >= DATE '2023-06-30') + 182 AS DATE) <= d AS supervised
FROM (SELECT last_day(x) AS d FROM unnest(generate_series(DATE '2023-01-01', DATE '2025-12-31', INTERVAL 1 MONTH)) t(x)) WHERE d BETWEEN DATE '2023-01-01' + 180 AND DATE '2025-12-31' - 182""")
def monthly_cutoffs(spark, sf):
    return T.monthly_cutoffs(spark, "2023-01-01", "2026-12-31", "2025-12-31")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup')
SELECT CAST(x AS DATE) AS day FROM unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) t(x) WHERE CAST(x AS DATE) NOT IN (SELECT day FROM d)""")
def missing_days(spark, sf):
    done = events(spark, sf).where("event_type = 'signup'").select(F.to_date("ts").alias("day"))
    return I.missing_days(spark, "2024-01-01", "2024-02-05", done)


@query("""SELECT p_partkey, regexp_matches(upper(p_name), 'RED|BLUE') OR regexp_matches(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), 'PART1') AS hit FROM part""")
def names_port_like(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", names_port("p_name", "RED|BLUE", "PART1").alias("hit"))


@query("""SELECT o_orderkey, lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') AS digits,
  (n BETWEEN 1000000 AND 9999999) AND ((n // 1000000 % 10) * 7 + (n // 100000 % 10) * 6 + (n // 10000 % 10) * 5 + (n // 1000 % 10) * 4 + (n // 100 % 10) * 3 + (n // 10 % 10) * 2) % 10 = n % 10 AS valid
FROM (SELECT o_orderkey, 9000000 + o_orderkey AS n FROM orders)""")
def number_valid(spark, sf):
    from ..functions import number_valid as valid

    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", F.lpad((F.col("o_orderkey") % 10000000).cast("string"), 7, "0").alias("digits"), valid(F.lit(9000000) + F.col("o_orderkey")).alias("valid"))
